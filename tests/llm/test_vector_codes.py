"""Vector codes against plain integer loops, near ties and odd vectors."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from paceline.llm import common, vector_codes

KIND = "vec_id long, embedding array<double>, label int"


def by_loops(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label) that take part. -> (codes and errors, books)"""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[[math.floor(1024 * x) for x in r[1][p * width : (p + 1) * width]] for p in range(parts)] for r in rows]
    books = [[cut[k][p] for k in range(min(entries, len(rows)))] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, own in held.items():
                books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = []
    for r, c in zip(rows, cut, strict=True):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, ",".join(str(x) for book in books for entry in book for x in entry)


@pytest.mark.parametrize("entries", [256, 20])
def test_equals_plain_loops(spark, entries):
    r = random.Random(11)
    rows = [(k * 3, [r.choice([0.0, 0.001, -0.0005, 0.25, r.gauss(0, 1)]) for _ in range(8)], k % 3 or None) for k in range(150)]
    rows += [(7, rows[4][1], 1), (7, rows[4][1], 1), (None, rows[9][1], 2), (10**12, [1e-3] * 8, None)]
    want, text = by_loops(rows, entries=entries)
    t = vector_codes.usable(spark.createDataFrame(rows, KIND).repartition(3))
    books = vector_codes.fit(t, entries=entries)
    assert vector_codes.digest(books) == hashlib.sha256(text.encode()).hexdigest()
    got = vector_codes.encoded(t, books)
    assert sorted(map(repr, ((x["vec_id"], x["code"], x["error"]) for x in got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("size", [3, 1000, 1 << 20, 1 << 26])
def test_screening_never_loses_the_nearest(size):
    """Entries that differ by a unit in one place, at sizes where float32 cannot tell them apart."""
    r = np.random.default_rng(size)
    base = r.integers(-size, size + 1, 16)
    book = np.repeat(base[None], 256, 0)
    book[np.arange(256), r.integers(0, 16, 256)] += r.integers(-2, 3, 256)
    x = base + r.integers(-3, 4, (300, 16))
    exact = ((x[:, None] - book[None]) ** 2).sum(2)
    codes, errors = vector_codes.nearest(x, book)
    assert (codes == exact.argmin(1)).all() and (errors == exact.min(1)).all()


def test_screening_spares_most_entries():
    r = np.random.default_rng(5)
    x, book = r.integers(-300, 300, (500, 16)), r.integers(-300, 300, (256, 16))
    assert len(vector_codes.screened(x, book)[0]) < 1.1 * len(x)


def test_odd_vectors(spark):
    fine = [(k, [float(k), -1.0, 0.5, 2.0, 3.0], 1) for k in range(5)]
    odd = [(10, None, 1), (11, [1.0, None, 1.0, 1.0, 1.0], 1), (12, [1.0, math.nan, 1.0, 1.0, 1.0], 1), (13, [1.0, math.inf, 1.0, 1.0, 1.0], 1), (14, [1e306, 1.0, 1.0, 1.0, 1.0], 1), (15, [1.0], 1), (16, [], 1)]
    huge = [(20, [1e30, -1e30, 0.0, 0.0, 0.0], None), (21, [0.0] * 5, None)]
    t = vector_codes.usable(spark.createDataFrame(fine + odd + huge, KIND))
    books = vector_codes.fit(t)
    assert books.shape == (4, 7, 2)  # five numbers and three zeros to fill up
    got = {x["vec_id"]: x for x in vector_codes.encoded(t, books).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 20, 21] and all(x["error"] == 0 for x in got.values())
    assert vector_codes.decode(got[3]["code"], books).tolist() == [3.0, -1.0, 0.5, 2.0, 3.0, 0.0, 0.0, 0.0]
    none = vector_codes.usable(t.where("false"))
    assert vector_codes.encoded(none, vector_codes.fit(none)).count() == 0


def test_extra_columns_stay(spark):
    rows = spark.createDataFrame([(1, [1.0] * 4, 2, "a", None), (2, [2.0] * 4, 2, "b", "x")], KIND + ", code string, error string")
    got = vector_codes.encoded(vector_codes.usable(rows), vector_codes.fit(vector_codes.usable(rows)))
    assert got.columns == ["vec_id", "embedding", "label", "code", "error", "code_", "error_"]
    assert [tuple(x)[3:] for x in got.orderBy("vec_id").collect()] == [("a", None, "00000000", 0), ("b", "x", "01010101", 0)]


@pytest.mark.parametrize("most", [50_000, 0])
def test_errors_of_a_label(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = spark.createDataFrame([(k, k % 3 if k % 4 else None, k) for k in range(60)], "vec_id long, label int, error long")
    want = {}
    for x in rows.collect():
        want[x["label"]] = want.get(x["label"], 0) + x["error"]
    got = vector_codes.label_errors(rows).collect()
    assert len(got) == 60 and all(x["label_error"] == want[x["label"]] for x in got)
