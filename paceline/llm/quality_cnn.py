"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover the whole document.
Each chunk's bytes are embedded, learned filters pass over them, each filter's
answers are max-pooled over the chunk and a logistic layer turns the pooled
values into the chunk's log-odds; the mean over chunks gives the document's
probability.  Only the text's bytes are input.

Training takes labelled documents of each class, whole, in order of a hash of
doc_id: at most ``TRAIN_PER_CLASS``, and none beyond a sum of ``TRAIN_BYTES``, so
the driver's part does not grow with the corpus.  All chunks of a text taken are
learned from.
The weights (some 10 KB) travel in the task's closure; scoring is one pass.

Defined results: a null or empty text is one chunk of padding and gets a score;
repeated rows score alike; labels with null doc_id or null quality, or without a
document, are not learned from; without labels of both classes every score is
0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, small, table

#: Bounds of the training sample: labelled documents of each class, and bytes of their texts.
TRAIN_PER_CLASS = 1500
TRAIN_BYTES = 16 << 20
CHUNK, STEP = 256, 192
WIDTH, STRIDE, EMBED, FILTERS = 8, 4, 4, 24
WINDOWS = (CHUNK - WIDTH) // STRIDE + 1
PAD = 256
EPOCHS, BATCH, RATE, DECAY = 14, 256, 0.01, 1e-4
#: Bytes scored at once in a task.
BLOCK = 1 << 18


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def chunked(data: bytes) -> np.ndarray:
    """Rows of CHUNK byte codes, STEP apart, that cover all of data; the rest is PAD."""
    n = max(1, -(-max(0, len(data) - CHUNK) // STEP) + 1)
    flat = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "embed": r.normal(0, 0.5, (PAD + 1, EMBED)).astype(f),
            "filter": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "weight": r.normal(0, 0.1, FILTERS).astype(f),
            "offset": np.zeros(1, f),
        }

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """(chunks * WINDOWS, WIDTH * EMBED) embedded bytes under each filter place."""
        e = self.p["embed"][codes].reshape(len(codes), CHUNK * EMBED)
        v = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        return v.reshape(-1, WIDTH * EMBED)

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        """Each chunk's largest answer of each filter, cut off below 0."""
        a = (self.windows(codes) @ self.p["filter"]).reshape(len(codes), WINDOWS, FILTERS)
        return np.maximum(a.max(axis=1) + self.p["bias"], 0)

    def log_odds(self, codes: np.ndarray) -> np.ndarray:
        return self.pooled(codes) @ self.p["weight"] + self.p["offset"]

    def fit(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray, seed: int = 11) -> None:
        """Adam on the weighted logistic loss of single chunks."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = r.permutation(len(codes))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                step += 1
                for k, g in self._gradients(codes[pick], target[pick], weight[pick]).items():
                    g = g + DECAY * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        n = len(codes)
        win = self.windows(codes)
        a = (win @ self.p["filter"]).reshape(n, WINDOWS, FILTERS)
        best = a.argmax(axis=1)
        raw = np.take_along_axis(a, best[:, None, :], 1)[:, 0] + self.p["bias"]
        pooled = np.maximum(raw, 0)
        z = pooled @ self.p["weight"] + self.p["offset"]
        dz = ((1 / (1 + np.exp(-z)) - target) * weight / n).astype(np.float32)
        up = dz[:, None] * self.p["weight"] * (raw > 0)
        rows = (np.arange(n)[:, None] * WINDOWS + best).ravel()
        under = win[rows].reshape(n, FILTERS, WIDTH * EMBED)
        down = (up[:, :, None] * self.p["filter"].T[None]).reshape(-1, EMBED)
        at = np.take_along_axis(codes[:, None, :], (best[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(n, 1, -1), 2).ravel()
        embed = np.stack([np.bincount(at, down[:, k], PAD + 1) for k in range(EMBED)], 1).astype(np.float32)
        return {"embed": embed, "filter": np.einsum("nf,nfk->kf", up, under), "bias": up.sum(0), "weight": pooled.T @ dz, "offset": dz.sum(keepdims=True)}

    def scores(self, texts: list[bytes]) -> list[float]:
        """Probabilities of whole texts, about BLOCK bytes of chunks at a time."""
        out = np.zeros(len(texts))
        counts = np.zeros(len(texts))
        most = BLOCK // CHUNK
        parts: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if parts:
                who = np.concatenate(owner)
                np.add.at(out, who, self.log_odds(np.concatenate(parts)))
                np.add.at(counts, who, 1)
                parts.clear()
                owner.clear()
                held = 0

        for i, t in enumerate(texts):
            rows = chunked(t)
            for at in range(0, len(rows), most):
                parts.append(rows[at : at + most])
                owner.append(np.full(len(parts[-1]), i))
                held += len(parts[-1])
                if held >= most:
                    flush()
        flush()
        return (1 / (1 + np.exp(-out / np.maximum(counts, 1)))).tolist()


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> tuple[list[bytes], np.ndarray, dict[int, int]]:
    """Whole texts and labels of the sample, none held out, and how many labels of each class there are.

    A repeated doc_id gives one row, with its smallest text.  Rows enter in
    order of a hash of doc_id while their class's texts stay within TRAIN_BYTES
    in sum; a text is taken whole or not at all, so no long text fills the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 1)).select("doc_id", "quality")
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [usable.where(F.col("quality") == q).distinct().orderBy(*first).limit(per_class) for q in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    named = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    sizes = named.select("doc_id", F.length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("quality").orderBy(*first))  # 2 * per_class rows at most
    fits = checkpointed(sizes.where(F.col("size") <= TRAIN_BYTES).select("doc_id", "quality", "size", upto.alias("upto")).where(F.col("upto") <= TRAIN_BYTES))
    held = named.join(F.broadcast(fits), "doc_id").where(F.length("text") == F.col("size"))
    rows = held.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text")).orderBy("doc_id").collect()  # within the bounds
    there = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}  # 2 rows
    return [bytes(r["text"]) for r in rows], np.array([r["quality"] for r in rows], np.float32), there


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Network | None:
    texts, target, there = training_sample(docs, labels, per_class)
    if len(set(target.tolist())) < 2:
        return None
    codes = [chunked(t) for t in texts]
    share = {q: there[int(q)] / (target == q).sum() for q in (0.0, 1.0)}  # the classes as frequent as among the labels
    n = np.array([len(c) for c in codes])
    # a text's weight grows with the root of its length, shared by its chunks
    weight = np.repeat(np.array([share[q] for q in target.tolist()]) / n**0.5, n).astype(np.float32)
    net = Network()
    net.fit(np.concatenate(codes), np.repeat(target, n), weight / weight.mean())
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            got = net.scores(texts) if net else [0.5] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs (their columns) whose score is at least ``least``."""
    net = train(docs, labels)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [(t.as_py() or "").encode() for t in batch.column(at)]
            if net:
                batch = batch.filter(pa.array(np.array(net.scores(texts)) >= least, pa.bool_()))
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    return docs.mapInArrow(run, docs.schema)


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
