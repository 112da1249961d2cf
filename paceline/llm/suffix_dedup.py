"""Suffix-array dedup: remove bytes of 50-byte strings seen in earlier documents.

A byte goes when it lies in a 50-byte string that also starts in a document with
a smaller doc_id.  The longest previous factor of a suffix is the longer of its
common prefixes with the previous and the next suffix, in suffix order, that lie
earlier in the corpus; where it reaches 50 the string is a later copy.

All suffixes of a large corpus are more than a cluster wants to sort, so those
that cannot have an earlier copy are left out first, without loss:

1.  Every 50-byte string has an anchor: the 25-byte string in it with the
    smallest hash, the leftmost of equals.  Equal strings have equal anchors at
    equal places, so copies are found among anchors (one byte in thirteen), and
    a string whose anchor is nowhere else has none.  Strings that follow each
    other and share their anchor are a run.
2.  Of runs whose anchor is somewhere else, all suffixes are put in suffix order
    with those of equal anchors, by their bytes, and previous and next smaller
    documents in that order tell which are later copies.  Runs equal in all
    bytes enter once, with their smallest document.

Documents stay where they were read: each task packs its own into cells of a few
megabytes, in order of doc_id, and only the packed cells are shuffled later.
Cells send each bucket of anchors one packed row of different anchors, and are
told by bits which of them other cells have; for those they send every different
run once, with its bytes and smallest doc_id, and are told by bits which strings
are later copies.  An anchor of very many different runs (the edge of a passage
that is everywhere) is dealt out further, by its 50-byte strings, each once a
cell.  Within a cell the same functions apply to its documents.  Hashes choose
who meets; what is equal is decided by bytes.

Defined results: a null text counts as empty; texts under 50 bytes stay whole;
rows of equal doc_id do not remove each other's bytes; rows with a null doc_id
stay whole and remove nothing; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, partitions, table
from paceline.llm.shingles import mixed

LENGTH = 50
ANCHOR = 25
SPAN = LENGTH - ANCHOR + 1
#: Bytes of text of a cell, about (a longer text is a cell of its own), and for each bucket.
CELL_BYTES = 6 << 20
BUCKET_BYTES = 3 << 20
ZSTD_LEVEL = 6
#: Parts of a bucket that are put in suffix order one after the other, to bound memory.
PARTS = 16
#: Different runs of one anchor above which its strings are dealt out one by one.
HOT_RUNS = 4096
#: Bytes hashed at once, so that the arrays stay in the processor's cache.
BLOCK = 1 << 17
_U = np.uint64
_LETTERS = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_P = {k: _U(pow(_BASE, k, 1 << 64)) for k in (1, 2, 4, 8, 16)}
_LOW = _U(0xFFFFFFFF)


def earlier_copy(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which suffixes have a longest previous factor of at least LENGTH.

    words: (n, 7) big-endian values of each suffix's first LENGTH bytes; place:
    the doc_id or rank of each suffix's document.  In suffix order, suffixes that agree in
    LENGTH bytes are a run; a suffix has an earlier copy if the previous or the
    next smaller place lies in its run.
    """
    n = len(place)
    if n == 0:
        return np.zeros(0, bool)
    order = np.lexsort(words.T[::-1])
    w, p = words[order], place[order]
    run = np.zeros(n, np.int64)
    run[1:] = np.cumsum((w[1:] != w[:-1]).any(axis=1))
    out = np.zeros(n, bool)
    out[order] = _smaller_before(p, run) | _smaller_before(p[::-1], run[::-1])[::-1]
    return out


def _smaller_before(p: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Whether the previous smaller value's position is in the same run.

    Pointers jump over larger values until each rests on a smaller one.
    """
    at = np.arange(-1, len(p) - 1)
    live = np.flatnonzero((at >= 0) & (run == run[at]))
    found = np.zeros(len(p), bool)
    while len(live):
        here = p[at[live]] < p[live]
        found[live[here]] = True
        live = live[~here]
        at[live] = at[at[live]]
        live = live[(at[live] >= 0)]
        live = live[run[live] == run[at[live]]]
    return found


def suffix_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(at), 56), np.uint8)
    if len(at):
        rows[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
    return rows.view(">u8").astype(np.uint64)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., count values of each."""
    if not len(first):
        return np.zeros(0, np.int64)
    total = np.cumsum(count)
    return np.arange(total[-1]) + np.repeat(first - np.concatenate([[0], total[:-1]]), count)


def string_hash(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for w in words.T:
        out = mixed(out * _P[1] + w)
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by a hash's upper half; in order where hashes are."""
    return (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def cuts(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, and where each begins (and the last one ends)."""
    new = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[new], np.append(new, len(sorted_values))


class Cell:
    """The runs of a cell's documents, in order of doc_id, their classes of equal bytes and their anchors."""

    def __init__(self, lens: np.ndarray, data: np.ndarray, buckets: int):
        self.data, self.ends, self.buckets = data, np.cumsum(lens), buckets
        self.starts = self.ends - lens
        parts = [self._runs(at, min(at + BLOCK, len(data))) for at in range(0, len(data), BLOCK)]
        none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
        h, c, self.first, self.count, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
        while True:
            order = np.lexsort((self.doc, c, h))
            new = np.ones(len(order), bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
            self.head = order[new]  # each class's first run
            self.klass = np.empty(len(order), np.int64)  # each run's class
            self.klass[order] = np.cumsum(new) - 1
            other = self._unlike(self.head[self.klass])
            if not len(other):
                break
            c[other] = mixed(c[other] + other.astype(np.uint64))  # equal hashes, other bytes
        anchors = h[self.head]
        self.anchors, begin = cuts(anchors)
        self.runs = np.diff(begin)  # classes of each anchor
        self.anchor = np.repeat(np.arange(len(self.anchors)), self.runs)  # each class's anchor
        self.cut_values, self.cut = cuts(bucket_of(self.anchors, buckets))  # anchors by bucket

    def _unlike(self, head: np.ndarray) -> np.ndarray:
        """Runs that differ from the run given for each in some byte."""
        r = np.flatnonzero(head != np.arange(len(head)))
        if not len(r):
            return r
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, 8)).view(np.uint64)[:, 0]
        a, b, last = self.first[r], self.first[head[r]], self.count[r] + LENGTH - 9
        same = self.count[r] == self.count[head[r]]
        for at in range(0, SPAN + LENGTH, 8):
            off = np.minimum(at, last)
            same &= words[a + off] == words[np.minimum(b + off, len(words) - 1)]
        return r[~same]

    def _runs(self, lo: int, z: int) -> tuple[np.ndarray, ...]:
        """Anchor hash, run hash, first string, strings and document of each run that starts in lo to z."""
        hi = min(z + LENGTH - 1, len(self.data))
        n = hi - lo
        none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
        if n < LENGTH:
            return none
        t = _LETTERS[self.data[lo:hi]]
        h2 = t[:-1] * _P[1] + t[1:]
        h4 = h2[:-2] * _P[2] + h2[2:]
        h8 = h4[:-4] * _P[4] + h4[4:]
        h16 = h8[:-8] * _P[8] + h8[8:]
        h24 = h16[:-8] * _P[8] + h8[16:]
        anchor = mixed(h24[:-1] * _P[1] + t[24:])
        low = (anchor & ~_LOW) | np.arange(len(anchor), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: n - LENGTH + 1], low[SPAN - 16 :])
        valid = np.ones(len(low), bool)
        near = self.ends[np.searchsorted(self.ends, lo, "right") : np.searchsorted(self.ends, hi, "right") + 1]
        for e in (near - lo).tolist():  # strings over a document's end
            valid[max(0, e - LENGTH + 1) : e] = False
        v = np.flatnonzero(valid)
        if not len(v):
            return none
        at = (low[v] & _LOW).astype(np.int64)
        new = np.ones(len(v), bool)
        new[1:] = (at[1:] != at[:-1]) | (v[1:] != v[:-1] + 1)
        r = np.flatnonzero(new)
        first = v[r]
        count = np.diff(np.append(r, len(v)))
        anchor_at = at[r]
        last = first + count - 1

        def whole(i: np.ndarray) -> np.ndarray:
            return ((h16[i] * _P[16] + h16[i + 16]) * _P[16] + h16[i + 32]) * _P[2] + h2[i + 48]

        shape = (anchor_at - first).astype(np.uint64) * _U(64) + count.astype(np.uint64)
        c = mixed(mixed(whole(first) + shape) * _P[1] + whole(last))
        doc = np.searchsorted(self.ends, first + lo, "right")
        return mixed(anchor[anchor_at]), c, first + lo, count, doc  # least hashes are small; mixed again, they fill all buckets alike

    def later(self, doc_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Within the cell: runs whose class an earlier document has; then strings
        of other classes' first runs (class, place in run) that one has."""
        who = doc_rank[self.doc]
        copied = who > who[self.head][self.klass] if len(self.klass) else np.zeros(0, bool)
        k = np.flatnonzero(self.runs[self.anchor] > 1) if len(self.anchor) else np.zeros(0, np.int64)
        heads = self.head[k]
        at = spread(self.first[heads], self.count[heads])
        found = earlier_copy(suffix_words(self.data, at), np.repeat(who[heads], self.count[heads]))
        return copied, k, found

    def flags(self, answers: list[dict], field: str) -> np.ndarray:
        """A bit for each anchor, from the answers of buckets."""
        out = np.zeros(len(self.anchors), bool)
        where = np.searchsorted(self.cut_values, [x["bucket"] for x in answers])
        for x, i in zip(answers, where.tolist(), strict=True):
            lo, hi = self.cut[i], self.cut[i + 1]
            out[lo:hi] = _unbits(x[field], hi - lo)
        return out

    def asked(self, answers: list[dict]) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """What other cells are asked about: (bucket, classes, parts), (bucket, different strings of
        hot anchors, parts), and of those strings the places and which of the different ones each is."""
        shared, hot = self.flags(answers, "shared"), self.flags(answers, "hot")
        k = np.flatnonzero((shared & ~hot)[self.anchor]) if len(self.anchor) else np.zeros(0, np.int64)
        part = bucket_of(self.anchors[self.anchor[k]], self.buckets * PARTS)
        values, at = cuts(bucket_of(self.anchors[self.anchor[k]], self.buckets))
        whole = [(int(b), k[at[i] : at[i + 1]], (part[at[i] : at[i + 1]] % PARTS).astype(np.uint8)) for i, b in enumerate(values)]
        heads = self.head[np.flatnonzero((shared & hot)[self.anchor])] if len(self.anchor) else np.zeros(0, np.int64)
        place = spread(self.first[heads], self.count[heads])
        doc = np.repeat(self.doc[heads], self.count[heads])
        words = suffix_words(self.data, place)
        hashes = string_hash(words)
        h, part = bucket_of(hashes, self.buckets), bucket_of(hashes, self.buckets * PARTS)
        order = np.lexsort((place, doc, *words.T[::-1], h))
        new = np.ones(len(order), bool)
        new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        firsts = order[new]
        values, at = cuts(h[firsts])
        single = [(self.buckets + int(b), place[firsts[at[i] : at[i + 1]]], (part[firsts[at[i] : at[i + 1]]] % PARTS).astype(np.uint8)) for i, b in enumerate(values)]
        return whole, single, place, which


def ranks(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])]) if len(ids) else np.zeros(0, np.int64)


CELL_TYPE = "cell bigint, ids binary, lens binary, data binary, size bigint"


def cells_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """Packed rows of documents, and the number of buckets."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, most = TaskContext.get().partitionId() << 24, 0, []

        def cell() -> pa.RecordBatch:
            most.sort(key=lambda x: x[0])
            raw = b"".join(t for _, t in most)
            ids, lens = np.array([i for i, _ in most]), np.array([len(t) for _, t in most])
            cols = [ids.tobytes(), lens.tobytes(), pa.Codec("zstd", ZSTD_LEVEL).compress(raw, asbytes=True)]
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), *[pa.array([c], pa.binary()) for c in cols], pa.array([len(raw)], pa.int64())], ["cell", "ids", "lens", "data", "size"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                if most and held + len(text) > CELL_BYTES:
                    yield cell()
                    made, held, most = made + 1, 0, []
                most.append((i, text))
                held += len(text)
        if most:
            yield cell()

    return checkpointed(rows.mapInArrow(pack, CELL_TYPE)), buckets


def opened(row: dict, buckets: int) -> tuple[np.ndarray, Cell]:
    raw = pa.decompress(row["data"], row["size"], "zstd", asbytes=True) if row["size"] else b""
    return np.frombuffer(row["ids"], np.int64), Cell(np.frombuffer(row["lens"], np.int64), np.frombuffer(raw, np.uint8), buckets)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of packed binaries, one after the other and not copied, and how many each row has."""
    rows = column.combine_chunks()
    at = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int32)
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data.view(kind), np.diff(at) // np.dtype(kind).itemsize


def anchor_answers(cells: DataFrame, buckets: int) -> DataFrame:
    """cell, answers: for each bucket, which of the cell's anchors other cells have too, and which are hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, c = opened(row, buckets)
            many = np.minimum(c.runs, 255).astype(np.uint8)
            short = (c.anchors & _LOW).astype(np.uint32)  # the bucket holds the upper half; who meets by chance is told apart by bytes
            anchors, runs = ([x[c.cut[i] : c.cut[i + 1]].tobytes() for i in range(len(c.cut_values))] for x in (short, many))
            yield pa.RecordBatch.from_arrays([pa.array(c.cut_values), pa.array(np.full(len(c.cut_values), row["cell"])), pa.array(anchors, pa.binary()), pa.array(runs, pa.binary())], ["bucket", "cell", "anchors", "runs"])

    def answer(key, batches):
        k, sizes = _flat(batches.column("anchors"), np.uint32)
        runs = _flat(batches.column("runs"), np.uint8)[0].astype(np.int64)
        order = np.argsort(k, kind="stable")
        _, at = cuts(k[order])
        cells_, total = np.diff(at), np.add.reduceat(runs[order], at[:-1]) if len(k) else at
        out = np.empty((2, len(k)), bool)
        out[0, order], out[1, order] = np.repeat(cells_ > 1, cells_), np.repeat(total > HOT_RUNS, cells_)
        at = np.concatenate([[0], np.cumsum(sizes)])
        pick = range(len(sizes))
        return pa.table({"cell": batches.column("cell"), "bucket": np.full(len(sizes), key[0].as_py()), "shared": [_bits(out[0, at[i] : at[i + 1]]) for i in pick], "hot": [_bits(out[1, at[i] : at[i + 1]]) for i in pick]})

    sent = cells.mapInArrow(send, "bucket bigint, cell bigint, anchors binary, runs binary")
    got = sent.groupBy("bucket").applyInArrow(answer, "cell bigint, bucket bigint, shared binary, hot binary")
    return checkpointed(got.groupBy("cell").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("answers")))


def string_answers(cells: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """cell, strings: for each bucket, which strings of the runs asked about an earlier document has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, c = opened(row, buckets)
            whole, single, *_ = c.asked(row["answers"])
            rows = []
            for b, k, part in whole:
                heads = c.head[k]
                rows.append((b, row["cell"], part.tobytes(), c.count[heads].astype(np.uint8).tobytes(), ids[c.doc[heads]].tobytes(), c.data[spread(c.first[heads], c.count[heads] + LENGTH - 1)].tobytes()))
            for b, at, part in single:
                docs = ids[np.searchsorted(c.ends, at, "right")]
                rows.append((b, row["cell"], part.tobytes(), b"\1" * len(at), docs.tobytes(), c.data[spread(at, np.full(len(at), LENGTH))].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["bucket", "cell", "parts", "counts", "docs", "bytes"])

    def answer(key, batches):
        every, runs = _flat(batches.column("counts"), np.uint8)
        every = every.astype(np.int64)
        data, docs, parts = _flat(batches.column("bytes"), np.uint8)[0], _flat(batches.column("docs"), np.int64)[0], _flat(batches.column("parts"), np.uint8)[0]
        begin, first = np.cumsum(every + LENGTH - 1) - (every + LENGTH - 1), np.cumsum(every) - every
        found = np.zeros(int(every.sum()), bool)
        for part in range(PARTS):
            r = np.flatnonzero(parts == part)
            found[spread(first[r], every[r])] = later_copies(data[spread(begin[r], every[r] + LENGTH - 1)], every[r], docs[r])
        upto, ends = np.concatenate([[0], np.cumsum(every)]), np.concatenate([[0], np.cumsum(runs)])
        at = upto[ends]
        return pa.table({"cell": batches.column("cell"), "bucket": np.full(len(runs), key[0].as_py()), "found": [_bits(found[at[i] : at[i + 1]]) for i in range(len(runs))]})

    sent = cells.join(answers, "cell").mapInArrow(send, "bucket bigint, cell bigint, parts binary, counts binary, docs binary, bytes binary")
    got = sent.groupBy("bucket").applyInArrow(answer, "cell bigint, bucket bigint, found binary")
    return checkpointed(got.groupBy("cell").agg(F.collect_list(F.struct("bucket", "found")).alias("strings")))


def later_copies(data: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For the strings of runs (bytes one after the other, so many strings each, a doc_id each):
    whether a run of a smaller doc_id holds them too."""
    size = counts + LENGTH - 1
    begin = np.cumsum(size) - size
    padded = np.zeros((len(counts), 80), np.uint8)
    padded.reshape(-1)[spread(np.arange(len(counts)) * 80, size)] = data
    words = padded.view(np.uint64)
    order = np.lexsort((docs, counts, *words.T))
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1) | (counts[order[1:]] != counts[order[:-1]])
    one = order[new]  # of equal runs the one of the smallest document
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    found = earlier_copy(suffix_words(data, spread(begin[one], counts[one])), np.repeat(docs[one], counts[one]))
    at = np.cumsum(counts[one]) - counts[one]
    return found[spread(at[which], counts)] | np.repeat(docs > docs[one][which], counts)


def removed(ids: np.ndarray, c: Cell, answers: list[dict], strings: list[dict]) -> np.ndarray:
    """Which bytes of the cell go."""
    copied, local, found = c.later(ranks(ids))
    whole, single, places, which = c.asked(answers)
    # strings of a class's first run, by class: those of its first document's other runs are the same
    size = c.count[c.head]
    at = np.concatenate([[0], np.cumsum(size)])
    string = np.zeros(at[-1], bool)
    string[spread(at[local], size[local])] = found
    told = {x["bucket"]: x["found"] for x in strings}
    for b, k, _ in whole:
        string[spread(at[k], size[k])] |= _unbits(told[b], int(size[k].sum()))
    if single:
        hot = np.concatenate([_unbits(told[b], len(x)) for b, x, _ in single])[which]
        # places are strings of first runs: from their place to their class's bit
        order = np.argsort(c.first[c.head])
        k = order[np.searchsorted(c.first[c.head][order], places, "right") - 1]
        string[at[k] + places - c.first[c.head][k]] |= hot
    every = np.logical_and.reduceat(np.append(string, True), at[:-1]) if len(size) else np.zeros(0, bool)
    gone = copied | every[c.klass]
    change = np.zeros(len(c.data) + 1, np.int32)
    full = np.flatnonzero(gone)
    change[c.first[full]] += 1
    change[c.first[full] + c.count[full] + LENGTH - 1] -= 1
    part = np.flatnonzero(~gone & np.logical_or.reduceat(np.append(string, False), at[:-1])[c.klass]) if len(c.klass) else full
    k = c.klass[part]
    here = spread(c.first[part], c.count[part])[string[spread(at[k], size[k])]]
    change[here] += 1
    change[here + LENGTH] -= 1
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def deduped(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary)."""
    cells, buckets = cells_of(docs)
    answers = anchor_answers(cells, buckets)
    strings = string_answers(cells, answers, buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, c = opened(row, buckets)
            gone = removed(ids, c, row["answers"] or [], row["strings"] or [])
            upto = np.concatenate([[0], np.cumsum(gone, dtype=np.int32)]).astype(np.int32)
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            inside = c.starts[c.starts < c.ends]
            rise[inside] = gone[inside]
            rises = np.concatenate([[0], np.cumsum(rise, dtype=np.int32)]).astype(np.int32)
            kept = c.data[~gone].tobytes()
            s, e = c.starts, c.ends
            a, z = (s - upto[s]).tolist(), (e - upto[e]).tolist()
            texts = [kept[i:j] for i, j in zip(a, z, strict=True)]
            cols = [pa.array(ids), pa.array(e - s), pa.array((upto[e] - upto[s]).astype(np.int64)), pa.array((rises[e] - rises[s]).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(texts, pa.binary())] if keep_text else [])], [*names, *(["kept"] if keep_text else [])])

    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    out = cells.join(answers, "cell", "left").join(strings, "cell", "left").mapInArrow(finish, kind)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    nobody = docs.where("doc_id IS NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *([text.alias("kept")] if keep_text else [])
    )
    return out.unionByName(nobody)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents"))
