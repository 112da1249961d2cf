"""Quality rules with cutoffs that adapt to language and source.

Every text is measured by a few integers.  Fixed rules (too few words, mostly
repeated windows) decide first; for the rest, each (lang, source) group has
upper limits read from a mergeable quantile sketch of its own documents.

The sketch is a log-linear histogram: a value below 64 has a bucket of its own,
a larger one keeps its six leading bits (error below 1/32).  Histograms of
parts merge by adding counts, so Spark's partial aggregation builds them before
the shuffle, and a group has a few hundred buckets at most, whatever its size.
Only measures, never texts, are shuffled.

Defined results: a null text counts as empty (base_failed); null lang or source
form groups of their own; repeated rows and ties are judged alike (a value equal
to its limit passes); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import SPACES, checkpointed, table, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Metric -> least room above the upper quartile, in the metric's unit.
ROOM = {"word_length": 20, "symbols": 100, "dup_lines": 500, "repeats": 350}
#: Documents' worth of weight that the limits of all groups' merged sketches have beside a group's own.
PRIOR = 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(ws: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array."""
    n = F.size(ws)
    hashes = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)),
    )
    return F.transform(F.array(hashes), _covered)[0]


def _covered(hashes: Column) -> Column:
    ordered = F.transform(
        F.array(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        lambda p: F.array_sort(
            F.transform(
                F.filter(p, lambda x, k: (F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))),
                lambda x: x["i"],
            )
        ),
    )[0]
    total = F.transform(
        F.array(ordered),
        lambda at: F.aggregate(
            F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
            F.lit(0).cast("bigint"),
            lambda s, x: s + x,
        ),
    )[0]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(total)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the integer measures of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"), words(F.col("text")).alias("ws"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return base.select(
        "doc_id",
        "lang",
        "source",
        F.size("ws").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("ws")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Each metric as a whole number, so that both engines agree on it."""
    return {
        "word_length": F.expr("try_divide(10 * word_chars, n_words)").cast("bigint"),
        "symbols": F.expr("try_divide(1000 * n_symbols, n_words)").cast("bigint"),
        "dup_lines": F.expr("try_divide(1000 * n_dup_lines, n_lines)").cast("bigint"),
        "repeats": F.expr("try_divide(1000 * n_repeat_words, n_words)").cast("bigint"),
    }


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number: its six leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    return v - v % F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)


def limits(measured: DataFrame) -> DataFrame:
    """lang, source and an upper limit per metric.

    Quantiles come from the sketches; limit = q75 + 3 * (q75 - q50) + room.  A
    group's limit is the mean of its own and that of all groups' merged
    sketches, weighted by its number of documents and by PRIOR.
    """
    long = measured.where(~base_failed()).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in metrics().items()])).alias("m")
    )
    sketch = long.groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket(F.col("m.v")).alias("b")).agg(F.count("*").alias("c"))

    def upper(s: DataFrame, keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys, "metric")
        ranked = s.select("*", F.sum("c").over(by.orderBy("b")).alias("upto"), F.sum("c").over(by).alias("n"))
        q = ranked.groupBy(*keys, "metric").agg(
            F.max("n").alias("n"),
            F.min(F.when(2 * F.col("upto") >= F.col("n"), F.col("b"))).alias("q50"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("n"), F.col("b"))).alias("q75"),
        )
        fence = 4 * F.col("q75") - 3 * F.col("q50")
        wide = [F.max(F.when(F.col("metric") == k, fence + room)).alias(f"max_{k}") for k, room in ROOM.items()]
        return q.groupBy(*keys).agg(F.max("n").alias("n"), *wide) if keys else q.agg(*wide)

    own = upper(sketch, ["lang", "source"])
    merged = sketch.groupBy("metric", "b").agg(F.sum("c").alias("c"))
    overall = upper(merged, []).select(*[F.col(f"max_{k}").alias(f"all_{k}") for k in ROOM])
    return own.join(F.broadcast(overall), F.lit(True)).select(  # one row
        F.col("lang").alias("g_lang"),
        F.col("source").alias("g_source"),
        *[F.expr(f"(n * max_{k} + {PRIOR} * all_{k}) div (n + {PRIOR})").alias(f"max_{k}") for k in ROOM],
    )


def judged(docs: DataFrame) -> DataFrame:
    """Measures, base_failed and kept for each row of documents."""
    measured = checkpointed(measure(docs))
    group = limits(measured)
    joined = measured.join(group, measured["lang"].eqNullSafe(group["g_lang"]) & measured["source"].eqNullSafe(group["g_source"]), "left")
    inside = F.lit(True)
    for k, v in metrics().items():
        inside = inside & (v <= F.col(f"max_{k}"))
    return joined.withColumn("base_failed", base_failed()).select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_METRIC_SQL = {
    "word_length": "10 * word_chars // n_words",
    "symbols": "1000 * n_symbols // n_words",
    "dup_lines": "1000 * n_dup_lines // n_lines",
    "repeats": "1000 * n_repeat_words // n_words",
}
_UNPIVOT = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS metric, {v} AS v FROM m WHERE NOT base_failed" for k, v in _METRIC_SQL.items())
_ROOM = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ROOM.items()) + " END"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), t AS (
  SELECT doc_id, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS w3
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), dup AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, w3) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m0 AS (
  SELECT d.doc_id, lang, source, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)
), m AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m0),
u AS ({_UNPIVOT}),
b AS (SELECT *, v - v % (1::BIGINT << greatest(0, length(bin(v)) - 6)) AS b FROM u),
own AS (
  SELECT lang, source, metric, count(*) AS n, quantile_disc(b, 0.5) AS q50, quantile_disc(b, 0.75) AS q75 FROM b GROUP BY ALL
), every AS (SELECT metric, quantile_disc(b, 0.5) AS q50, quantile_disc(b, 0.75) AS q75 FROM b GROUP BY ALL),
lim AS (
  SELECT lang, source, metric,
         (n * (4 * own.q75 - 3 * own.q50 + {_ROOM}) + {PRIOR} * (4 * every.q75 - 3 * every.q50 + {_ROOM})) // (n + {PRIOR}) AS top
  FROM own JOIN every USING (metric)
), bad AS (
  SELECT DISTINCT u.doc_id FROM u JOIN lim ON u.metric = lim.metric AND u.lang IS NOT DISTINCT FROM lim.lang
  AND u.source IS NOT DISTINCT FROM lim.source WHERE u.v > lim.top
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM m
"""
