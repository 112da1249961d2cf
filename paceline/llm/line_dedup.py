"""Line dedup: remove boilerplate lines that spread over many sites.

A line is boilerplate when ``min_sites`` sources or more carry it.  Spread is
estimated by HyperLogLog sketches of sites, one a line hash, merged by
aggregation; only lines whose estimate is near the threshold are counted
exactly.  A boilerplate line stays in the document with the smallest doc_id
that has it, so no content leaves the corpus, and goes from all others.

Each hash's sketch, least site, greatest site and first document come from one
aggregation of the lines, merged in every task before the shuffle, so a hot line
is one row a task however many documents hold it.  Exact counts read distinct
(line, site) rows of the near lines only, at most a few more than the threshold
each.  No line's rows or documents are gathered.  Boilerplate lines meet the
documents by broadcast, or where they are many by a join that deals every line's
rows over several keys; a text then loses lines by their places.

Defined results: lines are compared without surrounding blanks; blank lines
stay; a null text stays null (0 lines); null source is a site of its own; rows
with a null doc_id lose a line if any numbered document has it; of documents
with the same smallest doc_id (repeated rows) all keep the line; an empty table
gives an empty result; other columns stay, and where docs has a column n_lines
or n_removed already, the new one's name gets a trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, fresh_name, joined, light, table

MIN_SITES = 10
#: log2 of the sketch's registers: standard error about 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly (6 errors).
NEAR = 0.1
BLANKS = " \t\r\x0b\f"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def line_rows(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.coalesce("source", F.lit("\x00")).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.btrim("line", F.lit(BLANKS)) != "").select("doc_id", "site", _key(F.col("line")).alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, first: hashes of boilerplate lines and the document that keeps each."""
    spread = lines.groupBy("h").agg(F.min("site").alias("a"), F.max("site").alias("z"), F.min("doc_id").alias("first"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    shared = spread.where(F.lit(min_sites <= 1) | (F.col("a") != F.col("z"))).select("h", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    shared = checkpointed(shared.where(F.col("sites") >= low))
    near = light(shared.where(F.col("sites") <= high).select("h"))
    exact = lines.select("h", "site").distinct().join(near, "h").groupBy("h").count().where(F.col("count") >= min_sites)
    chosen = shared.where(F.col("sites") > high).select("h", "first")
    return chosen.unionByName(shared.join(exact.select("h"), "h", "left_semi").select("h", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines removed, plus n_lines and n_removed."""
    common = boilerplate(line_rows(docs), min_sites)
    # rows without a doc_id are told apart by their text
    placed = docs.select("doc_id", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    placed = placed.where(F.btrim("line", F.lit(BLANKS)) != "").select("doc_id", "of", "place", _key(F.col("line")).alias("h"))
    later = joined(placed, common, "h", "inner").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    id_, of, lines, gone = (fresh_name(docs, c) for c in ("l_id", "l_of", "l_lines", "l_gone"))
    drops = later.groupBy(F.col("doc_id").alias(id_), F.col("of").alias(of)).agg(F.collect_set("place").alias(gone))
    # the text goes along as its lines, cut once
    cut = docs.withColumn(lines, F.split("text", "\n")).withColumn(f"{of}_", F.xxhash64("text")).drop("text")
    out = cut.join(drops, cut["doc_id"].eqNullSafe(F.col(id_)) & (F.col(f"{of}_") == F.col(of)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col(lines)).otherwise(F.transform(stay, lambda k: F.get(lines, k)))
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("bigint")
    return out.select(
        *[F.array_join(kept, "\n").alias("text") if c == "text" else cut[c] for c in docs.columns],
        count(lines).alias(fresh_name(docs, "n_lines")),
        count(gone).alias(fresh_name(docs, "n_removed")),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k,
         unnest(string_split(text, chr(10))) AS line
  FROM documents
), t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS n FROM l),
b AS (SELECT n, min(doc_id) AS first FROM t WHERE n <> '' GROUP BY n HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (
  SELECT t.doc_id, count(*) AS n_lines, count(*) FILTER (b.n IS NULL OR t.doc_id = b.first) AS n_kept,
         string_agg(t.line, chr(10) ORDER BY k) FILTER (b.n IS NULL OR t.doc_id = b.first) AS kept
  FROM t LEFT JOIN b USING (n) GROUP BY t.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, (coalesce(n_lines, 0) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
