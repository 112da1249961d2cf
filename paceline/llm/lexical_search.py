"""Ranked lexical search: an inverted index in shards, searched by MaxScore.

Documents stay where they are read: each task cuts its documents into shards of
about ``SHARD_BYTES`` of text and writes a row a shard, with the documents' ids
and lengths, its terms, and each term's postings (document, occurrences) in
document order.  Totals and the documents a term has are sums over the shards.

A search reads a shard at a time.  For each item, the shard's lists of the
item's terms get an upper bound each (the largest contribution in the list).
Lists are taken from the highest bound down; while the bounds of those left can
together lift a new document to the k-th best score, they are essential and add
their documents.  The rest are non-essential: they are only probed, by binary
search, for documents that the bounds left could still lift there.  Each shard
gives k documents an item, and a window with Spark's group limit keeps k of all.

Items are packed into blocks of about ``BLOCK_TERMS`` terms; every block meets
every shard.  Blocks are broadcast while their sum is bounded (``LIGHT_TERMS``),
else joined by number.  Where the items' terms are few, the index holds the
lists of these terms only (``terms``); the result is the same.

Defined results: a null text has no terms and is no document of the counts; an
item without terms or without a match has no rows; items are told apart by row,
so repeated item_ids each get their ranks; repeated documents each count and
each may be ranked, a null doc_id comes last among equal scores; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paceline.llm.common import BROADCAST_ROWS, checkpointed, small, table

K = 10
#: Bytes of text of a shard, more where one text is longer.
SHARD_BYTES = 4 << 20
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Terms of a block of items, and of all blocks that are broadcast.
BLOCK_TERMS = 50_000
LIGHT_TERMS = 1_000_000
#: Bytes of a term that an index restricted to known terms keeps in every task, in sum.
KNOWN_BYTES = 16 << 20
#: The length norm's constants (fixed values): m = 100 - B + B * n * N div L; a term's part w * (SCALE * tf div (1000 * tf + 8 * m)).
B = 75
SCALE = 1_000_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z to lower case, and every ASCII byte that no term holds to a blank.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some at a time."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Numbers(dict):
    """A number for each new term."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Shard:
    """Documents taken in one by one, then their lists."""

    def __init__(self, known: frozenset[bytes] | None):
        self.known, self.numbers, self.bytes = known, _Numbers(), 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.of: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        n, self.bytes = 0, self.bytes + len(text)
        for some in tokens(text):
            n += len(some)
            if self.known is not None:
                some = [t for t in some if t in self.known]
            self.terms.append(np.fromiter(map(self.numbers.__getitem__, some), np.int64, len(some)))
            self.of.append(np.full(len(some), len(self.ids), np.int64))
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)

    def row(self) -> dict:
        docs = max(1, len(self.ids))
        pairs, tf = np.unique(np.concatenate([*self.terms, np.empty(0, np.int64)]) * docs + np.concatenate([*self.of, np.empty(0, np.int64)]), return_counts=True)
        df = np.bincount(pairs // docs, minlength=len(self.numbers))
        return {
            "ids": self.ids,
            "lengths": self.lengths,
            "terms": list(self.numbers),
            "df": df.tolist(),
            "docs": (pairs % docs).astype(np.int32).tobytes(),
            "tfs": tf.astype(np.int32).tobytes(),
        }


INDEX = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int64())), ("docs", pa.binary()), ("tfs", pa.binary())])
INDEX_KIND = "ids array<bigint>, lengths array<bigint>, terms array<binary>, df array<bigint>, docs binary, tfs binary"


def index(docs: DataFrame, terms: frozenset[bytes] | None = None) -> DataFrame:
    """A row a shard; with ``terms``, only the lists of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(terms)
        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py() or b"")
                if shard.bytes >= SHARD_BYTES:
                    yield pa.RecordBatch.from_pylist([shard.row()], INDEX)
                    shard = Shard(terms)
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], INDEX)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary")).mapInArrow(run, INDEX_KIND)


def query_terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return F.transform(found, lambda t: t.cast("binary"))


class Lists:
    """A shard's lists with each posting's part of a score, worked out as terms ask for them."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        self.place = {t: k for k, t in enumerate(row["terms"])}
        self.cut = np.concatenate([[0], np.cumsum(np.array(row["df"], np.int64))])
        self.docs, self.tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32)
        n = np.array(row["lengths"], np.int64)
        if int(n.max(initial=0)) * B * n_docs >= 1 << 63:  # beyond 64 bits: exact, and slower
            n = n.astype(object)
        self.norm = (100 - B + B * n * n_docs // max(1, n_terms)).astype(np.int64)
        # null ids last among equal scores
        self.order = np.array([(i is None, i or 0) for i in self.ids], [("none", bool), ("id", np.int64)])
        self.parts: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}

    def of(self, term: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, their parts for a weight of 1, the largest part) of a list."""
        if term not in self.parts:
            k = self.place[term]
            docs, tf = self.docs[self.cut[k] : self.cut[k + 1]], self.tfs[self.cut[k] : self.cut[k + 1]].astype(np.int64)
            part = SCALE * tf // (1000 * tf + 8 * self.norm[docs])
            self.parts[term] = docs, part, int(part.max())
        return self.parts[term]

    def best(self, terms: list[tuple[bytes, int]], k: int) -> list[tuple[int, int]]:
        """(document's place, score) of the k best for terms with their weights, by MaxScore."""
        lists = [(w * (x := self.of(t))[2], w, x) for t, w in terms if t in self.place and w > 0]
        lists.sort(key=lambda x: -x[0])
        left = np.cumsum([0, *[x[0] for x in lists[::-1]]])[::-1].tolist()  # bounds of lists j and after
        score = np.zeros(len(self.ids), np.int64)
        least, j = 0, 0
        while j < len(lists) and left[j] >= max(1, least):  # essential: equal scores may still win by id
            _, w, (docs, part, _) = lists[j]
            score[docs] += w * part
            j += 1
            if len(score) > k:
                least = int(np.partition(score, len(score) - k)[-k])
        held = np.flatnonzero(score)
        for i in range(j, len(lists)):
            held = held[score[held] + left[i] >= least]
            _, w, (docs, part, _) = lists[i]
            at = np.searchsorted(docs, held)
            at[at == len(docs)] = 0
            hit = docs[at] == held
            score[held[hit]] += w * part[at[hit]]
            if len(held) > k:
                least = max(least, int(np.partition(score[held], len(held) - k)[-k]))
        if len(held) > k:
            held = held[score[held] >= np.partition(score[held], len(held) - k)[-k]]
        top = held[np.lexsort((self.order["id"][held], self.order["none"][held], -score[held]))][:k]
        return list(zip(top.tolist(), score[top].tolist(), strict=True))


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    asked = checkpointed(items.select(F.col("item_id"), query_terms(F.col("text").cast("string")).alias("terms")).withColumn("item", F.monotonically_increasing_id()))
    uses = asked.select("item", F.explode("terms").alias("term")).groupBy("item", "term").count()
    vocabulary = checkpointed(uses.select("term").distinct())
    size = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= BROADCAST_ROWS and size["bytes"] <= KNOWN_BYTES
    known = frozenset(bytes(r["term"]) for r in vocabulary.collect()) if few else None
    shards = checkpointed(index(docs, known))
    n_docs, n_terms = shards.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    held = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = held.join(F.broadcast(vocabulary) if few else vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    weighted = checkpointed(uses.join(df, "term").select("item", "term", (weight * F.col("count")).cast("bigint").alias("weight")).where("weight > 0"))
    n_uses = weighted.count()
    blocks = max(1, -(-n_uses // BLOCK_TERMS))
    packed = weighted.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    packed = packed.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("item", "terms", "weights")).alias("items"))
    met = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(packed) if n_uses <= LIGHT_TERMS else packed, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            for row in batch.to_pylist():
                lists = Lists(row, n_docs, n_terms)
                out = [(x["item"], lists.ids[d], s) for x in row["items"] for d, s in lists.best(list(zip(x["terms"], x["weights"], strict=True)), k)]
                cols = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    found = met.select("ids", "lengths", "terms", "df", "docs", "tfs", "items").mapInArrow(run, "item bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = asked.select("item", "item_id")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents
), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
q AS (
  SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c
), s AS (
  SELECT item_id, doc_id, sum(qtf * w * (({SCALE} * tf) // (1000 * tf + 8 * ({100 - B} + ({B} * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (doc_id), c GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {K}
"""
