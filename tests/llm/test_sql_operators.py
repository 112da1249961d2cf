"""Operators that SQL expresses: against it, and on odd tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from comparing import database, same  # noqa: E402

from paceline.llm import ORACLE_SQL, QUERIES, jaccard_join, license_scan, line_dedup, mixing, quality_rules  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name](spark, SF).toPandas(), database(SF).sql(ORACLE_SQL[name]).df())


def test_native_plans_run_no_python(spark):
    for name in ("op1_license_scan", "op5_line_dedup", "op8_quality_rules", "op9_mix_sources"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian")), name


def test_license_rules(docs_of):
    mit = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
    texts = [
        "Some prose\nLicensed under the Apache License, Version 2.0.",
        "# Licensed under CC BY-NC 4.0.\n# All rights reserved.",
        mit,
        "This is under a licence nobody knows.",
        "Nothing to see here.",
        "// Released under the MIT Licence.",
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(texts)).collect()}
    assert [got[k]["licences"] for k in range(6)] == ["Apache-2.0", "CC-BY-NC-4.0", "MIT", "", "", "MIT"]
    assert (got[3]["n_sentences"], got[3]["n_known"], got[3]["sentence_ids"]) == (1, 0, "?")
    assert got[2]["sentence_ids"] == "MITGrant,MITNotice" and got[4]["n_sentences"] == 0


def test_known_sentences_are_critical():
    import re

    assert all(re.search(license_scan.CRITICAL, s) for s in license_scan.SENTENCES)
    names = {*license_scan.SENTENCES.values(), *license_scan.PATTERNS.values(), *license_scan.EXPRESSION_IDS.values(), *[f"{k}-{x}" for k in ("SPDX", "Named") for x in license_scan.LICENCES]}
    assert all(set(run) <= names for _, run in license_scan.RULES)
    assert set(license_scan.NAMES) <= set(license_scan.LICENCES)


def test_odd_tables(odd, empty):
    n = odd.count()
    for f in (license_scan.scan, line_dedup.dedup_lines, quality_rules.judged, jaccard_join.similar):
        assert f(odd).count() == n, f
        assert f(empty).count() == 0, f
    assert mixing.mixed(odd).count() == n and mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_clashing_columns(docs_of):
    d = docs_of(["a b c", "a b c d"]).withColumns({c: F.lit("x") for c in ("h", "n", "node", "first", "size", "key", "ws", "target", "lines", "count", "__x", "__id", "__copy", "__source", "n_lines", "n_removed", "l_gone", "m_copy", "gone", "epochs", "passes")})
    for f in (license_scan.scan, line_dedup.dedup_lines, quality_rules.judged, mixing.mixed, mixing.mix, jaccard_join.similar, jaccard_join.keep_one):
        f(d).collect()
    out = line_dedup.dedup_lines(d)
    assert out.columns[-2:] == ["n_lines_", "n_removed_"] and {r["n_lines"] for r in out.collect()} == {"x"}
    assert mixing.mix(d).columns == jaccard_join.keep_one(d).columns == d.columns


def test_lines_spread_over_sites_stay_once(docs_of):
    common, rare = "a line that every site carries", "a line of two sites"
    rows = [(k, f"own {k}\n  {common}\t\n\n{rare if k < 2 else ''}", "en", f"s{k}") for k in range(12)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(rows), min_sites=10).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["text"] == rows[0][1]
    assert all(got[k]["n_removed"] == 1 for k in range(1, 12))
    assert got[1]["text"] == f"own 1\n\n{rare}"


def test_exact_counts_decide_near_the_threshold(docs_of):
    rows = [(k, "nine sites\nten sites" if k < 9 else "ten sites", "en", f"s{k}") for k in range(10)]
    got = line_dedup.boilerplate(line_dedup.line_rows(docs_of(rows)), min_sites=10)
    assert [r["first"] for r in got.collect()] == [0]


def test_adaptive_limits_follow_the_group(docs_of):
    plain = [(k, " ".join(f"w{k}x{i}" for i in range(60)), "en", "plain") for k in range(80)]
    noisy = [(100 + k, " ".join(f"# w{k}x{i}" for i in range(60)), "en", "noisy") for k in range(80)]
    odd_one = [(500, " ".join(f"### v{i}" for i in range(60)), "en", "plain")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs_of(plain + noisy + odd_one)).collect()}
    assert all(got[k] for k in range(80)) and all(got[100 + k] for k in range(80)) and not got[500]


def test_repeated_windows_are_counted_as_words(docs_of):
    texts = ["a b c a b c", "a a a a a", "a b c d e", "a b", "x a b c y a b c z a b c"]
    got = [r["n_repeat_words"] for r in quality_rules.measure(docs_of(texts)).orderBy("doc_id").collect()]
    assert got == [6, 5, 0, 0, 9]


def test_sketch_buckets_are_close(spark):
    rows = spark.range(100_000).select("id", quality_rules.bucket(F.col("id")).alias("b"))
    assert rows.where("b > id OR id - b > id / 32 OR (id < 64 AND b <> id)").count() == 0


def test_mix_meets_targets(docs_of):
    rows = [(k, "w " * (5 + k % 40), "en", f"s{k % 5}" if k % 7 else "s0") for k in range(3000)] + [(9999, "lone word", "en", None)]
    got = mixing.mixed(docs_of(rows)).groupBy("source").agg(F.sum(F.col("size") * F.col("epochs")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.max("epochs").alias("most")).collect()
    assert sum(r["target"] for r in got) == pytest.approx(sum(r["size"] for r in got), abs=0.01)
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 45 and r["most"] <= 3 and r["target"] <= 3 * r["size"]


def test_mix_repeats_rows_as_planned(docs_of):
    d = docs_of([(k, "w " * (5 + k % 9), "en", f"s{k % 4}") for k in range(400)])
    plan = {r["doc_id"]: r["epochs"] for r in mixing.mixed(d).collect()}
    out = {r["doc_id"]: r["count"] for r in mixing.mix(d).groupBy("doc_id").count().collect()}
    assert {k: v for k, v in plan.items() if v} == out
    assert sorted(map(tuple, mixing.mix(d).collect())) == sorted(map(tuple, mixing.mix(d).collect()))


def test_jaccard_tiles_equal_rows(spark, monkeypatch):
    want = None
    for rows, tile in ((100_000, 1 << 20), (0, 20_000), (20, 5_000)):
        monkeypatch.setattr(jaccard_join, "ROW_PAIRS", rows)
        monkeypatch.setattr(jaccard_join, "TILE_BYTES", tile)
        got = sorted(map(tuple, jaccard_join.similar(spark.read.parquet(f"{SF}/documents.parquet")).collect()))
        want = want or got
        assert got == want


def _edited(seed: int, n: int, edits: int, least: int = 60) -> list[str]:
    import random

    r = random.Random(seed)
    base = [f"w{r.randrange(50)}" for _ in range(80)]
    texts = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(1000)}"
        texts.append(" ".join(w[: r.randrange(least, 81)]))
    return texts


def _components_by_brute_force(texts: list[str]) -> dict[int, int]:
    import numpy as np

    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    place = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(texts), len(place)), np.float32)
    for k, x in enumerate(sets):
        has[k, [place[y] for y in x]] = 1
    both, n = has @ has.T, has.sum(1)
    for i, j in np.argwhere(100 * both >= 80 * (n[:, None] + n - both)).tolist():
        a, b = sorted((root(i), root(j)))
        comp[b] = a
    return {k: root(k) for k in range(len(texts))}


@pytest.mark.parametrize("pairs", [4096, 20])
def test_jaccard_of_edited_copies_equals_brute_force(docs_of, monkeypatch, pairs):
    monkeypatch.setattr(jaccard_join, "ROW_PAIRS", pairs)
    texts = _edited(5, 150, 5)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.similar(docs_of(texts)).collect()}
    assert got == _components_by_brute_force(texts)


def test_a_large_group_of_near_copies_takes_few_comparisons(docs_of, monkeypatch):
    """3,000 near copies: pairs compared exactly stay below ten times the rows."""
    seen, plain = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, sets: seen.append(pairs.count()) or plain(pairs, sets))
    texts = _edited(6, 3000, 5, 70)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.similar(docs_of(texts)).collect()}
    assert got == _components_by_brute_force(texts)
    assert sum(seen) < 10 * len(texts)


def test_shingles_of_long_texts_are_those_of_their_words(monkeypatch):
    import random

    import numpy as np

    from paceline.llm import shingles

    r = random.Random(2)
    texts = [b" ".join(b"w%d" % r.randrange(3000) for _ in range(n)) + b" \n" * 40 for n in (0, 3, 4, 5, 6, 40, 400)] + [b"Q" * 300, b"q" * 300]
    want = shingles.shingle_hashes(texts)
    monkeypatch.setattr(shingles, "BLOCK", 64)
    got = shingles.shingle_hashes(texts)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert got[-1] == got[-2]
    monkeypatch.setattr(shingles, "_LONG", __import__("re").compile(rb"[^\x20\x09-\x0D]{100,}"))
    monkeypatch.setattr(shingles, "LONG_WORD", 100)
    a, b, c = shingles.shingle_hashes([b"Q" * 300, b"q" * 300, b"q" * 301])
    assert len(a) == 1 and a == b and a != c


def test_bitmaps_never_refuse_a_link():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = r.random(len(a)) > 0.12
        b = np.unique(np.concatenate([a[keep], r.integers(0, 1 << 63, int(r.integers(0, 20)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert jaccard_join.links(a, b) == (100 * both >= 80 * (len(a) + len(b) - both))
