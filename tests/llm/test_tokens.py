"""Tokenising against the library."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paceline.llm import bpe, token_counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT_FILE))
MINE = bpe.load(bpe.DEFAULT_FILE)
letters = st.sampled_from([*"aeThé文 \n\t\r\x0b\x1c\x85\xa0     　'!12٣🙂", "<|endoftext|>", "'ll", "the ", "  ", "\n\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(letters, max_size=30).map("".join))
def test_ids_and_text_equal_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert MINE.encode(text) == ids
    assert MINE.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_scan_and_heap_agree(word):
    assert MINE._scan(word) == MINE._heap(word)


def test_very_long_words():
    text = "ab" * 30_000 + " " + "z" * 10_000
    assert MINE.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_memo_keeps_answers_when_full():
    m = bpe.Memo(lambda w: (len(w),), most=600)
    assert [m["a" * (k % 7)] for k in range(50)] == [(k % 7,) for k in range(50)] and len(m) <= 4
    assert m["a" * 5000] == (5000,) and "a" * 5000 not in m


def test_piece_numbers_when_the_memo_is_full(monkeypatch):
    from collections import Counter

    monkeypatch.setattr(token_counts, "MEMO_BYTES", 500)
    c = token_counts.PieceCounts(bpe.DEFAULT_FILE, bpe.chunk_text)
    text = "one two three four five six seven two"
    for _ in range(3):
        assert c.total(Counter(bpe.chunks(text))) == len(LIBRARY.encode("\n" + text, add_special_tokens=False).ids)


def test_operators_on_odd_tables(odd, empty):
    from conftest import ODD

    def want(t):
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))

    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, bpe.digests(odd).collect()), key=key) == sorted([(r[0], *want(r[1] or "")) for r in ODD], key=key)
    counted = sorted([(r[0], len((r[1] or "").encode()), want(r[1] or "")[0], want(r[1] or "")[0] > 1024) for r in ODD], key=key)
    assert sorted(map(tuple, token_counts.count_tokens(odd).collect()), key=key) == counted
    assert bpe.digests(empty).count() == token_counts.count_tokens(empty).count() == 0


def test_round_trip_through_tables(docs_of):
    texts = ["Hello,  world!\n", "", "ünï <|endoftext|> x"]
    back = bpe.decode_documents(bpe.encode_documents(docs_of(texts)))
    assert [r["text"] for r in back.orderBy("doc_id").collect()] == texts


def test_other_files_are_refused(empty):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(empty, "piece_bpe_32k.model")
