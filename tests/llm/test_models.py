"""The classifier on held-out rows, neighbours against brute force, and the pipeline."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paceline.llm import line_dedup, mixing, nearest, quality_cnn

sys.path += [str(Path(__file__).parent), str(Path(__file__).parent.parent)]
from comparing import database  # noqa: E402
from test_keep_one import found, one_of_each  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        data = bytes(k % 251 for k in range(n))
        rows = quality_cnn.chunked(data)
        seen = {k * quality_cnn.STEP + i for k, r in enumerate(rows) for i, x in enumerate(r) if x != quality_cnn.PAD}
        assert seen == set(range(n)) and len(rows) >= 1


def test_gradients_are_right():
    net = quality_cnn.Network(1)
    r = np.random.default_rng(0)
    codes = r.integers(0, 256, (4, quality_cnn.CHUNK)).astype(np.int16)
    y, w = np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32)

    def loss():
        z = net.log_odds(codes)
        return float((np.log1p(np.exp(z)) - y * z).mean())

    got = net._gradients(codes, y, w)
    for name, at in (("weight", (3,)), ("offset", (0,)), ("bias", (5,)), ("filter", (7, 2)), ("embed", (int(codes[0, 9]), 1))):
        old = net.p[name][at]
        step = 1e-3
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert got[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_cnn.op7_quality_cnn(spark, SF).join(labels, "doc_id").where("held_out").select("quality", "predicted").toPandas()
    assert len(got) > 60 and (got["quality"] == got["predicted"]).mean() >= 0.93


def test_scores_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (99, 0), (7, None)], "doc_id long, quality int")
    net = quality_cnn.train(odd, labels)
    got = quality_cnn.score(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_cnn.train(odd, labels.where("false")) is None
    assert {r["score"] for r in quality_cnn.score(odd, None).collect()} == {0.5}
    assert quality_cnn.score(empty, net).count() == 0


def test_long_texts_are_scored_as_in_one_piece(monkeypatch):
    net = quality_cnn.Network(3)
    texts = [b"abc " * 3000, b"", b"xyz", bytes(range(256)) * 40]
    want = [1 / (1 + np.exp(-net.log_odds(quality_cnn.chunked(t)).mean())) for t in texts]
    monkeypatch.setattr(quality_cnn, "BLOCK", 1024)
    assert net.scores(texts) == pytest.approx(want, rel=1e-5)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [int(ids[i]) for i in order if np.isfinite(d[i])]


def test_repeated_ids_do_not_depend_on_row_order(spark):
    rows = [(100, [1.0, 0.0]), (100, [9.0, 0.0]), (1, [1.5, 0.0]), (2, [8.0, 0.0])]
    answers = []
    for some in (rows, rows[::-1], rows[2:] + rows[:2]):
        t = vectors(spark, some)
        answers.append(sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(t, t.where("vec_id % 100 = 0")).collect()))
    assert answers[0] == answers[1] == answers[2] == [(100, 1, 1, 0.5), (100, 2, 2, 7.0)]


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), np.float64), rows["vec_id"].to_numpy()
    got = nearest.op6_nearest(spark, SF).toPandas()
    hits = [len(set(brute(x, ids, int(np.flatnonzero(ids == q)[0]), 10)) & set(g["vec_id"])) for q, g in got.groupby("query_id")]
    assert len(hits) == sum(i % 100 == 0 for i in ids) and np.mean(hits) >= 9


def test_without_stopping_it_is_exact_with_ties_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 40)
    r = np.random.default_rng(4)
    x = r.integers(-2, 3, (400, 3)).astype(np.float64)
    x[(x == 0).all(1)] = 1.0
    ids = r.permutation(4000)[:400]
    rows = vectors(spark, [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)])
    got = nearest.nearest(rows, nearest.usable(rows).where("vec_id % 9 = 0"), k=10, exact=True).toPandas()
    for q, g in got.groupby("query_id"):
        assert g.sort_values("rank")["vec_id"].tolist() == brute(x, ids, int(np.flatnonzero(ids == q)[0]), 10)


def test_odd_vectors(spark):
    fine = [(k, [float(k), 1.0, 2.0]) for k in range(1, 4)]
    odd = [(10, None), (11, [0.0, 0.0, 0.0]), (12, [1.0, None, 2.0]), (13, [1.0, float("nan"), 2.0]), (14, [1.0, float("inf"), 2.0]), (None, [1.0, 2.0, 3.0]), (15, [1.0]), (1, [1.0, 1.0, 2.0])]
    rows = vectors(spark, fine + odd)
    got = nearest.nearest(rows, nearest.usable(rows)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 2, 1.0), (1, 2, 3, 2.0), (2, 1, 1, 1.0), (2, 2, 3, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 2.0)]
    none = vectors(spark, [])
    assert nearest.nearest(none, nearest.usable(none)).count() == 0


def test_extra_and_clashing_columns_change_nothing(spark, docs_of):
    rows = vectors(spark, [(k, [float(k), 1.0 + k % 3]) for k in range(40)])
    extra = rows.withColumns({c: F.lit("x") for c in ("cell", "ids", "part", "score", "rank", "query_id", "h", "bound", "x")})
    got, want = (sorted(map(tuple, nearest.nearest(t, t.where("vec_id % 8 = 0")).collect())) for t in (extra, rows))
    assert got == want and len(got) == 50
    docs = docs_of(["good words here", "bad ### words", None, ""])
    more = docs.withColumns({c: F.lit("x") for c in ("quality", "score", "predicted", "held_out", "label", "chunk")})
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    net = quality_cnn.train(more, labels)
    assert sorted((r["doc_id"], r["score"]) for r in quality_cnn.score(more, net).collect()) == sorted((r["doc_id"], r["score"]) for r in quality_cnn.score(docs, net).collect())
    assert quality_cnn.keep_good(more, labels).columns == more.columns


def test_pipeline_stages_do_what_the_operators_say(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf).cache()
        rows = [r.asDict() for r in before.collect()]
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            net = quality_cnn.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
            scores = net.scores([r["text"].encode() for r in rows])
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= 0.5}
        elif k == 1:
            sites: dict[str, set] = {}
            first: dict[str, int] = {}
            for r in rows:
                for x in r["text"].split("\n"):
                    x = x.strip(line_dedup.BLANKS)
                    sites.setdefault(x, set()).add(r["source"])
                    first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])

            def kept(r):
                lines = r["text"].split("\n")
                return "\n".join(x for x in lines if not (y := x.strip(line_dedup.BLANKS)) or len(sites[y]) < line_dedup.MIN_SITES or first[y] == r["doc_id"])

            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()} == {r["doc_id"]: (kept(r), len(kept(r))) for r in rows}
        elif k == 2:
            assert found(after) == one_of_each([(r["doc_id"], r["text"]) for r in rows])
        elif k == 3:
            plan = database(sf, {"documents": before.toPandas()}).sql(mixing.ORACLE).df()
            times = {int(doc_id): int(taken // size) for doc_id, size, taken in zip(plan["doc_id"], plan["size"], plan["taken"], strict=True) if taken}
            assert {r["doc_id"]: r["count"] for r in after.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("doc_id").count().collect()} == times
        else:
            import public_tokenizers
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = sorted((r["doc_id"], hashlib.md5(str(lib.encode(r["text"], add_special_tokens=False).ids).encode()).hexdigest()) for r in rows)
            assert sorted((r["doc_id"], hashlib.md5(str(list(r["ids"])).encode()).hexdigest()) for r in after.collect()) == want
        before = after


def test_run_gives_rows(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").where(F.col("n_tokens") >= 0).count() > 0
