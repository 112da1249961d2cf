"""Mixing sources to target weights by hash thresholds.

Each source gets a share of all words; a target above a source's own size means
whole extra passes over it.  What is left after whole passes is a budget, met by
the documents whose hash lies below a threshold.  The threshold comes from sums
of words by source and hash bucket: the first bucket level finds the bucket the
budget ends in, only that bucket is refined, and again, 12 bits a level.  No
level sorts documents; each level is one aggregation with at most 4096 rows a
source.  Thresholds are nested: a larger budget keeps what a smaller one took.

Defined results: a null text has size 0; sources order by code point with null
last; a source without words has target 0; rows with equal doc_id share a hash
and so a fate; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import WORD, checkpointed, fresh_name, light, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
LEVEL_BITS = 12
LEVELS = 3


def _hash() -> Column:
    """36 bits of md5 of the id's decimal form, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 9), 16, 10).cast("bigint")


def _ranked(by_source: DataFrame) -> DataFrame:
    """by_source with k, the place of its source by code point (null last), from 1.

    Sources are dealt by range, so that a place is the row's place in its
    partition and the number of rows in those before: no task holds all sources.
    """
    dealt = checkpointed(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, {}
    for row in dealt.groupBy("part").count().orderBy("part").collect():  # one row a partition
        offsets[row["part"]], before = before, before + row["count"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part")) if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.select("source", "source_size", (offset + place).alias("k"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: shares by weight, capped and reshared.

    Every round gives the rest to the open sources by weight and closes those
    that reach their cap, until none does; a round is one sum over the sources.
    """
    ranked = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    capped = checkpointed(ranked.select("source", "source_size", weight.alias("w"), (max_epochs * F.col("source_size")).alias("cap")))
    total, level, seen = None, -1.0, None
    while level != seen:
        closed = F.col("cap") <= F.lit(level) * F.col("w")
        total, taken, open_w = capped.agg(F.sum("source_size"), F.sum(F.when(closed, F.col("cap"))), F.sum(F.when(~closed, F.col("w")))).first()
        seen, level = level, float((total or 0) - (taken or 0)) / open_w if open_w else max(level, 0.0)
    share = F.when(F.col("cap") <= F.lit(level) * F.col("w"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("w"))
    return capped.select("source", "source_size", F.round(share, 6).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("h", LEVEL_BITS * (LEVELS - 1 - level)).bitwiseAND(2**LEVEL_BITS - 1)


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """source, threshold: documents with a smaller hash make up the budget."""
    state = plan.select("source", F.col("budget").alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    rows = sized
    for level in range(LEVELS):
        sums = rows.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("b"))
        st = state.withColumnRenamed("source", "st_source")
        over = (
            sums.select("source", "b", "s", upto.alias("upto"))
            .join(st, F.col("source").eqNullSafe(F.col("st_source")))
            .where("upto > left")
            .groupBy("source")
            .agg(F.min(F.struct("b", "s", "upto", "left", "prefix")).alias("x"))
        )
        bits = LEVEL_BITS * (LEVELS - 1 - level)
        prefix = F.col("x.prefix") + F.col("x.b") * F.lit(2**bits)
        last = level == LEVELS - 1
        below = F.col("x.upto") - F.col("x.s")
        nearer = F.when(F.col("x.upto") - F.col("x.left") < F.col("x.left") - below, 1).otherwise(0)
        state = checkpointed(over.select("source", (F.col("x.left") - below).alias("left"), (prefix + nearer if last else prefix).alias("prefix"), F.col("x.b").alias("edge")))
        if not last:
            edge = light(state.select(F.col("source").alias("e_source"), "edge"))
            rows = rows.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (_bucket(level) == F.col("edge"))).select("doc_id", "source", "size", "h")
    return state.select("source", F.col("prefix").alias("threshold"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs (all columns) with source_size, target, epochs and size."""
    return _mixed(docs)[1]


def _mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = checkpointed(docs.select("doc_id", "source", size.alias("size"), _hash().alias("h")))
    plan = checkpointed(targets(sized)).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    cut = thresholds(sized, plan).withColumnRenamed("source", "c_source")
    rule = plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        F.col("source").alias("r_source"), "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold")
    )
    rule = light(checkpointed(rule))
    epochs = (F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).cast("bigint")
    return sized, sized.join(rule, F.col("source").eqNullSafe(F.col("r_source"))).select("doc_id", "size", "source_size", "target", epochs.alias("epochs"), "threshold", "passes", "source")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as its source's plan takes it.

    Rows with one doc_id in a source are taken equally often; those with a null
    doc_id share a hash too, and so one fate a source.
    """
    _, out = _mixed(docs)
    source, passes, threshold, copy = (fresh_name(docs, c) for c in ("m_source", "m_passes", "m_threshold", "m_copy"))
    rule = out.groupBy("source").agg(F.first("passes").alias(passes), F.first("threshold").alias(threshold)).withColumnRenamed("source", source)
    rule = light(checkpointed(rule))
    times = (F.col(passes) + F.when(_hash() < F.col(threshold), 1).otherwise(0)).cast("int")
    joined = docs.join(rule, docs["source"].eqNullSafe(F.col(source)))
    return joined.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 9))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), fill(round, source, source_size, w, target, done) AS (
  SELECT 0, source, source_size, w, NULL::DOUBLE, false FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w,
         CASE WHEN target IS NOT NULL THEN target WHEN 3 * source_size <= lvl * w THEN 3.0::DOUBLE * source_size END,
         fresh = 0
  FROM (
    SELECT *, sum(CASE WHEN target IS NULL AND 3 * source_size <= lvl * w THEN 1 ELSE 0 END) OVER () AS fresh
    FROM (
      SELECT *, (sum(source_size) OVER () - coalesce(sum(target) OVER (), 0))::DOUBLE
                / nullif(sum(CASE WHEN target IS NULL THEN w END) OVER (), 0) AS lvl
      FROM fill WHERE NOT done)
  )
), last AS (SELECT * FROM fill WHERE done),
lvl AS (SELECT (sum(source_size) - coalesce(sum(target), 0))::DOUBLE / nullif(sum(CASE WHEN target IS NULL THEN w END), 0) AS l FROM last),
t AS (SELECT source, source_size, round(coalesce(target, w * l, 0), 6) AS target FROM last, lvl),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
r AS (
  SELECT d.*, source_size, target, passes, greatest(0, target - passes * source_size) AS budget
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY source, h) AS here FROM r
), e AS (SELECT source, min(h) AS edge FROM c WHERE upto > budget GROUP BY source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN h < edge OR (h = edge AND upto - budget < budget - (upto - here)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.source
"""
