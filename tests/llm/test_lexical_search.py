"""Ranked search against a plain scorer, MaxScore against full scoring, odd tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import lexical_search

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(lexical_search.UPPER, lexical_search.LOWER)))


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document."""
    sets = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(sets), sum(c.total() for _, c in sets)
    df = Counter(t for _, c in sets for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in sets:
            m = 25 + 75 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("shard", "few", "block"), [(4 << 20, 50_000, 50_000), (300, 50_000, 20), (300, 0, 20), (4 << 20, 0, 50_000)])
def test_equals_a_plain_scorer(spark, docs_of, monkeypatch, shard, few, block):
    """Whole and small shards, an index of all terms and of those asked for, one block of items and many."""
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical_search, "BROADCAST_ROWS", few)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search, "LIGHT_TERMS", 10 * block)
    r = random.Random(13)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 60}"
    texts = [" ".join(word() for _ in range(r.randrange(1, 60))) for _ in range(120)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (5, texts[6]), (None, texts[7]), (900, None), (901, ""), (902, "-- ,, \t"), (903, texts[0])]
    items = [(k, " ".join(word() for _ in range(r.randrange(1, 25))).upper()) for k in range(12)] + [(3, texts[3]), (3, texts[3]), (None, texts[9]), (40, None), (41, ""), (42, "nosuchword")]
    got = lexical_search.search(docs_of([(d, t, None, None) for d, t in docs]).repartition(3), spark.createDataFrame(items, ITEMS))
    assert sorted(map(repr, map(tuple, got.collect()))) == ranked(docs, items)


def test_odd_tables(spark, odd, empty):
    items = [(1, "One WORD"), (2, "ünïcödé 文字 endoftext"), (3, "line two three"), (4, "Ünïcödé")]
    got = lexical_search.search(odd.withColumns({c: F.lit("x") for c in ("item", "terms", "df", "rank", "score", "ids")}), spark.createDataFrame(items, ITEMS))
    assert sorted(map(repr, map(tuple, got.collect()))) == ranked([(r["doc_id"], r["text"]) for r in odd.collect()], items)
    assert lexical_search.search(empty, spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical_search.search(odd, spark.createDataFrame([], ITEMS)).count() == 0


def test_terms_of_pieces_are_those_of_the_text(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    text = "Über den-Wolken, 123abc!! muss   die FREIHEIT\x00wohl (grenzenlos) sein; 文字 ok"
    assert [t.decode() for some in lexical_search.tokens(text.encode()) for t in some] == terms(text)


def test_maxscore_scores_little_and_loses_nothing(monkeypatch):
    """Rare terms settle the ten best; the common term's list is probed only for what may still qualify."""
    r = np.random.default_rng(3)
    shard = lexical_search.Shard(None)
    for k in range(3000):
        words = [b"the"] * int(r.integers(1, 9)) + [b"rare"] * int(r.integers(1, 5)) * (k % 50 == 0) + [b"x%d" % r.integers(300)] * 3
        shard.add(k, b" ".join(words))
    lists = lexical_search.Lists(shard.row(), 3000, 30_000)
    asked = [(b"rare", 4000), (b"x7", 900), (b"the", 2)]
    full = np.zeros(3000, np.int64)
    for t, w in asked:
        docs, part, _ = lists.of(t)
        full[docs] += w * part
    want = sorted(((-int(s), d) for d, s in enumerate(full)))[:10]
    probes, plain = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v: probes.append(len(v)) or plain(a, v))
    assert lists.best(asked, 10) == [(d, -s) for s, d in want]
    assert probes and sum(probes) < 100


def test_lengths_beyond_64_bits():
    shard = lexical_search.Shard(None)
    shard.add(1, b"a b c")
    lists = lexical_search.Lists(shard.row() | {"lengths": [10**9]}, 10**11, 10**13)
    assert lists.norm.tolist() == [25 + 75 * 10**20 // 10**13]
