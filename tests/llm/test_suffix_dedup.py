"""Against brute force, over one cell and over many."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paceline.llm import suffix_dedup as s


def brute(rows):
    seen: dict[bytes, int] = {}
    datas = sorted([(i, (t or "").encode()) for i, t in rows if i is not None], key=lambda x: x[0])
    for i, b in datas:
        for p in range(len(b) - s.LENGTH + 1):
            w = b[p : p + s.LENGTH]
            seen[w] = min(seen.get(w, i), i)
    out = []
    for i, b in datas:
        gone = bytearray(len(b))
        for p in range(len(b) - s.LENGTH + 1):
            if seen[b[p : p + s.LENGTH]] < i:
                gone[p : p + s.LENGTH] = b"\1" * s.LENGTH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def mess(seed: int, n: int = 120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randrange(1, 9)))
    passages = ["".join(word() for _ in range(r.randrange(5, 60))) for _ in range(12)]
    rows = []
    for k in range(n):
        t = "".join(r.choice([word(), r.choice(passages), r.choice(passages)[r.randrange(20) :]]) for _ in range(r.randrange(0, 12)))
        rows.append((k if r.random() > 0.05 else max(0, k - 1), t))
    return rows + [(500, "ab" * 300), (501, "ab" * 200), (502, "a" * 300), (503, "a" * 49), (504, "a" * 50), (505, rows[3][1]), (506, None)]


@pytest.mark.parametrize(("cell", "bucket", "hot", "block"), [(6 << 20, 16 << 20, 4096, 1 << 17), (800, 3000, 4096, 1 << 17), (800, 3000, 1, 300), (6 << 20, 3000, 3, 97)])
def test_equals_brute_force(docs_of, monkeypatch, cell, bucket, hot, block):
    monkeypatch.setattr(s, "CELL_BYTES", cell)
    monkeypatch.setattr(s, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(s, "HOT_RUNS", hot)
    monkeypatch.setattr(s, "BLOCK", block)
    rows = mess(1)
    got = s.deduped(docs_of([(i, t, "en", "a") for i, t in rows]).repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_odd_tables(odd, empty):
    from conftest import ODD

    got = s.deduped(odd).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute([(r[0], r[1]) for r in ODD])
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None) and len(got) == len(ODD)
    assert s.deduped(empty).count() == 0


def test_kept_bytes_are_given(docs_of):
    t = "the quick brown fox jumps over the lazy dog and runs far away from here"
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in s.deduped(docs_of([t, "before " + t + " after"]), keep_text=True).collect()}
    assert got == {0: t, 1: "before  after"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6)), max_size=40))
def test_earlier_copy_by_neighbours(rows):
    words = np.zeros((len(rows), 7), np.uint64)
    words[:, 3] = [w for w, _ in rows]
    place = np.array([p for _, p in rows], np.int64)
    want = [any(w2 == w and p2 < p for w2, p2 in rows) for w, p in rows]
    assert s.earlier_copy(words, place).tolist() == want


def test_equal_hashes_do_not_make_equal_runs(docs_of, monkeypatch):
    """With run hashes that always agree, bytes decide."""
    plain = s.Cell._runs

    def blunt(self, lo, z):
        h, c, *rest = plain(self, lo, z)
        return h, c * np.uint64(0), *rest

    monkeypatch.setattr(s.Cell, "_runs", blunt)
    monkeypatch.setattr(s, "CELL_BYTES", 2000)
    rows = mess(2, 60)
    got = s.deduped(docs_of([(i, t, "en", "a") for i, t in rows]).repartition(3)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_extra_columns_are_ignored(docs_of):
    from pyspark.sql import functions as F

    d = docs_of(["x" * 60, "x" * 60]).withColumns({c: F.lit("x") for c in ("cell", "ids", "lens", "data", "size", "n_removed", "bucket")})
    assert sorted(r["n_removed"] for r in s.deduped(d).collect()) == [0, 60]
