"""One row of each group of near copies, told apart by row; every pipeline stage on odd tables."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paceline.llm import jaccard_join, line_dedup, mixing

SF = "/root/testdata/sf0.001"
A = " ".join(f"a{k}" for k in range(40))
OTHER = " ".join(f"b{k}" for k in range(40))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def one_of_each(rows):
    """Rows (doc_id, text, ...) that stay: all empty ones, and the first of each component."""
    sets = [shingles(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    best = {}
    for k, r in enumerate(rows):
        if sets[k]:
            best[comp[k]] = min(best.get(comp[k], (True, math.inf)), (r[0] is None, r[0] or 0))
    out, seen = [], set()
    for k, r in enumerate(rows):
        if not sets[k]:
            out.append((r[0], r[1] or ""))
        elif best[comp[k]] == (r[0] is None, r[0] or 0) and comp[k] not in seen:
            seen.add(comp[k])
            out.append((r[0], r[1]))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r["doc_id"], r["text"] or "")) for r in df.collect())


@pytest.mark.parametrize(
    "rows",
    [
        [(1, A), (5, A), (5, OTHER)],
        [(1, A), (1, A), (1, OTHER), (1, OTHER)],
        [(None, A), (None, A), (3, OTHER), (None, OTHER), (None, "lone words of a null id")],
        [(None, None), (None, ""), (2, None), (2, " \n"), (2, "x"), (3, "x"), (3, "y")],
        [(7, A), (None, A), (9, A), (9, A + " more"), (9, "not like the others at all")],
    ],
)
def test_rows_are_dropped_not_ids(docs_of, rows):
    got = found(jaccard_join.keep_one(docs_of([(*r, "en", "s") for r in rows])))
    assert got == one_of_each(rows)


def test_random_rows_with_repeated_ids_equal_brute_force(docs_of):
    r = random.Random(8)
    base = [[f"w{k}x{i}" for i in range(30)] for k in range(12)]
    rows = []
    for _ in range(120):
        w = list(r.choice(base))
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"e{r.randrange(9)}"
        rows.append((r.choice([None, *range(25)]), " ".join(w)))
    got = jaccard_join.keep_one(docs_of([(*x, "en", "s") for x in rows]))
    # which of several rows with the least id stays is the hash's choice: compare ids and that the text is a row's
    kept = [(x["doc_id"], x["text"]) for x in got.collect()]
    assert sorted(repr(d) for d, _ in kept) == sorted(repr(eval(x)[0]) for x in one_of_each(rows))
    assert all(x in rows for x in kept)


def test_rows_that_share_id_and_text_leave_one(docs_of):
    d = docs_of([(1, A, "en", "b"), (1, A, "en", "a"), (2, OTHER, "en", "c")])
    assert sorted((x["doc_id"], x["source"]) for x in jaccard_join.keep_one(d).collect()) == [(1, "a"), (2, "c")]


def _lines_by_hand(rows):
    sites, first = {}, {}
    for d, text, _, source in rows:
        for x in (text or "").split("\n"):
            x = x.strip(line_dedup.BLANKS)
            sites.setdefault(x, set()).add(source)
            if d is not None:
                first[x] = min(first.get(x, d), d)
    gone = lambda x, d: x and len(sites[x]) >= line_dedup.MIN_SITES and first.get(x) != d
    return sorted(repr((d, text if text is None else "\n".join(x for x in text.split("\n") if not gone(x.strip(line_dedup.BLANKS), d)))) for d, text, _, _ in rows)


def test_stages_on_odd_tables(spark, odd, empty):
    """Nulls, empty texts, repeated rows and ids, other columns, an empty table: every stage's result is the expected one."""
    extra = odd.withColumns({c: F.lit("x") for c in ("k_id", "gone", "h", "comp", "size", "of", "n")})
    site = [(100 + k, f"own {k} words of this very site here\nshared line", "en", f"t{k}") for k in range(12)] + [(None, "shared line", "en", "t0"), (103, "another text\nshared line", "en", "t3")]
    for docs in (odd, extra, odd.unionByName(spark.createDataFrame([(*r, len(r[1])) for r in site], odd.schema)), empty):
        columns, rows = docs.columns, [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
        kept = corpus_pipeline.classify(spark, docs, SF)
        assert kept.columns == columns and kept.count() <= len(rows)
        lines = corpus_pipeline.drop_lines(spark, docs, SF)
        assert lines.columns == columns and sorted(repr((r["doc_id"], r["text"])) for r in lines.collect()) == _lines_by_hand(rows)
        near = corpus_pipeline.drop_near_copies(spark, docs, SF)
        assert near.columns == columns and found(near) == one_of_each(rows)
        mixed = corpus_pipeline.mix_sources(spark, docs, SF)
        times = {}
        for r in mixing.mixed(docs).collect():
            times[r["source"]] = times.get(r["source"], 0) + r["epochs"]
        assert mixed.columns == columns and {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()} == {k: n for k, n in times.items() if n}
        assert corpus_pipeline.encode(spark, docs, SF).count() == len(rows)


def test_lines_meet_documents_by_salted_shuffle_too(spark, monkeypatch, docs_of):
    from paceline.llm import common

    rows = [(k, "\n".join([f"own {k}", *[f"common {i}" for i in range(40)], "", "common 3"]), "en", f"s{k % 15}") for k in range(60)] + [(None, "common 1\ncommon 1", "en", "s1")] * 2
    want = _lines_by_hand(rows)
    for most in (50_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = line_dedup.dedup_lines(docs_of(rows))
        assert sorted(repr((r["doc_id"], r["text"])) for r in got.collect()) == want
        assert got.agg(F.sum("n_removed")).first()[0] == 59 * 41 + 4
