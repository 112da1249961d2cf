"""Byte-level BPE encoding and decoding.

A word is held as a contiguous array of parts with the rank of each adjacent
pair: the lowest rank is found by a scan, its boundary deleted and the two ranks
beside it refreshed.  Scans are cheapest for the short words that texts consist
of; a word above ``SHORT`` bytes takes the same merges from a heap, in n log n.

Pieces of words seen before come from a bounded two-generation memo.  Texts are
encoded where they lie: no shuffle.

Defined results: a null text counts as empty (0 ids, empty decoding); the
special string is one id, as the file says; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import released, small, table

DEFAULT_FILE = "byte_bpe_50k.json"
SHORT = 256
#: Bytes that a memo's generation holds, about; words of more letters are not kept.
MEMO_BYTES = 64 << 20
LONG_WORD = 512
ENTRY_BYTES = 160
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The pre-tokenizer's pattern, white space spelt out (possessive: it never has to give back).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: White space that leaves doubt about pre-token borders between blanks.
IRREGULAR = re.compile(r"\s\s|^\s|\s\Z|[^\S \n]").search
NO_RANK = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def chunks(text: str) -> list[str] | None:
    """The text cut before each blank and line end, or None for irregular white space.

    A pre-token always begins at a lone blank or line end, so chunks can be
    encoded apart.  The blank itself is left out of the chunk, and the list
    begins as if a line end came before the text (``chunk_text`` undoes both).
    """
    if IRREGULAR(text):
        return None
    return ("\n" + text).replace("\n", " \n").split(" ")[1:]


def chunk_text(chunk: str) -> str:
    return chunk if chunk[:1] == "\n" else " " + chunk


class Memo(dict):
    """word -> value, made once; old words go a generation at a time, by the bytes they hold."""

    def __init__(self, make, most: int = MEMO_BYTES):
        super().__init__()
        self.make, self.most, self.held, self.old = make, most, 0, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) > LONG_WORD:
            return value
        self.held += ENTRY_BYTES + 4 * len(word) + 8 * len(value)
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[word] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.held, self.old = 0, {}


class ByteBPE:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = raw[t]
        for t, i in self.added.items():
            self.tokens[i] = t.encode()
        self.decimal = [str(i) for i in range(len(self.tokens))]
        one = {raw[t]: i for t, i in vocab.items()}
        self.byte_id = [one[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memo = Memo(lambda w: tuple(self.word_ids(w.encode("utf-8"))))
        self.chunks = Memo(lambda c: tuple(chain.from_iterable(self.word_ids(w.encode("utf-8")) for w in self.find(chunk_text(c)))))
        self.line_end = self.word_ids(b"\n")

    def forget(self) -> None:
        """Drops the memos, which a worker process would hold through all that it does later."""
        self.memo.forget()
        self.chunks.forget()

    def word_ids(self, word: bytes) -> list[int]:
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        none, pairs = (NO_RANK, 0), self.pairs
        ids = [self.byte_id[b] for b in word]
        found = [pairs.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            low = min(found)
            if low[0] == NO_RANK:
                break
            i = found.index(low)
            ids[i] = low[1]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = pairs.get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = pairs.get((ids[i], ids[i + 1]), none)
        return ids

    def _heap(self, word: bytes) -> list[int]:
        ids: list[int] = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (got := self.pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (got := self.pairs.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (got[0], left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(is special, string) in order: special strings and what lies between."""
        if not self.special:
            return [(False, text)]
        return [(k % 2 == 1, s) for k, s in enumerate(self.special.split(text)) if s]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for special, s in self.parts(text):
            if special:
                ids.append(self.added[s])
            elif (cut := chunks(s)) is not None:
                start = len(ids)
                ids.extend(chain.from_iterable(map(self.chunks.__getitem__, cut)))
                del ids[start : start + len(self.line_end)]
            else:
                ids.extend(chain.from_iterable(map(self.memo.__getitem__, self.find(s))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@cache
def load(file: str) -> ByteBPE:
    """One vocabulary a worker process; its memo serves later tasks too."""
    return ByteBPE(public_tokenizers.path(file))


def encode_documents(docs: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """doc_id, ids array<int> for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for batch in small(batches):
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """doc_id, text for each row of doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for batch in small(batches):
            texts = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trips(docs: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """doc_id, n_tokens, ids and a digest of their decoding for each row, in one pass.

    Other stages use its worker processes again, so a task's memos end with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for batch in small(released(batches)):
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            n = pa.array([len(x) for x in ids], pa.int64())
            decoded = pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.list_(pa.int32())), decoded], ["doc_id", "n_tokens", "ids", "decoded_sha256"])
        bpe.forget()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string"
    )


def digests(docs: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of their decoding.

    Encodes and decodes in one pass, so that ids are never shipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        sha = hashlib.sha256
        for batch in small(batches):
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(sha(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
