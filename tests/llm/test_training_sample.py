"""The classifier's training sample, and its network against plain loops."""

from __future__ import annotations

import math

import numpy as np

from paceline.llm import quality_cnn


def _labels(spark, n):
    ids = spark.range(60).where(quality_cnn.fold(quality_cnn.F.col("id")) != 1).limit(n)
    keys = [r["id"] for r in ids.collect()]
    return keys, spark.createDataFrame([(d, k % 2) for k, d in enumerate(keys)], "doc_id long, quality int")


def test_long_texts_and_repeated_ids(spark, docs_of):
    keys, labels = _labels(spark, 6)
    rows = [(keys[0], "x" * 300_000, "en", "a")] * 9 + [(d, f"text {d}", "en", "a") for d in keys[1:]]
    texts, target, there = quality_cnn.training_sample(docs_of(rows), labels, per_class=3)
    assert len(texts) == 6 and target.tolist().count(1.0) == 3 and there == {0: 3, 1: 3}
    assert sorted(map(len, texts))[-1] == 300_000


def test_the_sample_is_bounded_in_bytes_by_whole_texts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(quality_cnn, "TRAIN_BYTES", 1000)
    keys, labels = _labels(spark, 20)
    rows = [(keys[0], "x" * 300_000, "en", "a")] + [(d, "y" * 300, "en", "a") for d in keys[1:]]
    texts, target, _ = quality_cnn.training_sample(docs_of(rows), labels)
    assert set(map(len, texts)) == {300} and sorted(target.tolist()) == [0.0] * 3 + [1.0] * 3


def test_scores_equal_plain_loops():
    net = quality_cnn.Network(3)
    r = np.random.default_rng(5)
    net.p["bias"][:] = r.normal(0, 0.1, quality_cnn.FILTERS)
    texts = [b"", b"short", bytes(r.integers(0, 256, 700, dtype=np.uint8).tolist())]
    p = {k: v.astype(float) for k, v in net.p.items()}

    def plain(data: bytes) -> float:
        odds, n, at = 0.0, 0, 0
        while True:
            codes = [data[i] if i < len(data) else quality_cnn.PAD for i in range(at, at + quality_cnn.CHUNK)]
            z = float(p["offset"][0])
            for f in range(quality_cnn.FILTERS):
                best = -math.inf
                for w in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
                    a = 0.0
                    for i in range(quality_cnn.WIDTH):
                        for e in range(quality_cnn.EMBED):
                            a += p["embed"][codes[w + i], e] * p["filter"][i * quality_cnn.EMBED + e, f]
                    best = max(best, a)
                z += max(0.0, best + p["bias"][f]) * p["weight"][f]
            odds, n = odds + z, n + 1
            if at + quality_cnn.CHUNK >= len(data):
                return 1 / (1 + math.exp(-odds / n))
            at += quality_cnn.STEP

    assert np.allclose(net.scores(texts), [plain(t) for t in texts], atol=1e-5)
