"""URL filters: allow and block lists of host and path, the longest rule wins.

A URL is expanded into expressions, a suffix of its host followed by a prefix of
its path, in the numbers of labels and the path lengths that rules have.  The
expressions meet the rules in an equi-join on the first ``PREFIX`` hex digits of
their SHA-256 digests; the full digests then confirm, and of the rules that fit
a URL the longest decides.

Only expressions that some rule's short prefix equals outlive the join, so what
is grouped is small.  The rules are broadcast when few (``light``), else the
join shuffles; a hot host is dealt over ``SALTS`` keys then, and the rules are
repeated for each.

Defined results: the host is what lies after the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z in lower case (user names and ports stay in it);
the path is the rest up to ``?``, ``#`` or the end; a null url or one without
``://`` has neither.  A rule fits its host and all hosts below it, where the
path starts with the rule's.  The longest rule (host and path together) wins;
of equally long ones the longer host, then ``block``.  Rules without a host or
a verdict are passed over, a null path is empty.  Where no rule fits, the rule
is null and the verdict the method's, ``default``.  Repeated rows and null
page_ids are rows like others; an empty table gives an empty result; where pages
has a column host, path, rule or verdict, the new one's name gets a trailing
underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import BROADCAST_ROWS, checkpointed, fresh_name, table

ALLOW, BLOCK = "allow", "block"
#: The rules of the query: host, path, verdict (fixed values).
RULES = [
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
]
#: The verdict where no rule fits.
DEFAULT = ALLOW
#: Hex digits of the digest that are joined on.
PREFIX = 8
#: Keys that a hot expression is dealt over where the rules are too many to broadcast.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host_: Column, path_: Column) -> Column:
    """Of an expression; \\n parts host and path, so that neither runs into the other."""
    return F.sha2(F.concat(host_, F.lit("\n"), path_), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """prefix, digest, rule, labels, length, rank for each rule (host, path, verdict) that can fit."""
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.where((F.col("host") != "") & F.col("verdict").isNotNull())
    of = clean.select(
        _digest(F.col("host"), F.col("path")).alias("digest"),
        F.concat("host", "path").alias("rule"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("length"),
        F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == BLOCK).alias("blocks"), "verdict").alias("rank"),
    )
    one = of.groupBy("digest", "rule", "labels", "length").agg(F.max("rank").alias("rank"))
    return one.withColumn("prefix", F.substring("digest", 1, PREFIX))


def expressions(host_: Column, path_: Column, labels: list[int], lengths: list[int]) -> Column:
    """Digests of host suffixes of so many labels followed by path prefixes of so many characters."""
    own = F.size(F.split(host_, r"\."))
    suffixes = F.filter(F.array(*[F.when(own >= n, F.substring_index(host_, ".", -n)) for n in labels]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length(path_) >= n, F.substring(path_, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages (url and any other columns) with host, path, rule and verdict."""
    rules = checkpointed(prepared(rules))
    # a row of distinct numbers, as many as rules have labels and path lengths
    known = rules.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("labels")).alias("labels"), F.array_sort(F.collect_set("length")).alias("lengths")).first()
    names = [fresh_name(pages, c) for c in ("host", "path", "rule", "verdict")]
    url = pages["url"].cast("string")
    placed = pages.withColumn(names[0], host(url)).withColumn(names[1], path(url))
    if not known["n"]:
        return placed.withColumn(names[2], F.lit(None).cast("string")).withColumn(names[3], F.lit(default))
    # the verdict follows from host and path alone, so rows that share both are judged once a task
    seen = placed.select(F.col(names[0]).alias("u_host"), F.col(names[1]).alias("u_path"))
    asked = seen.select("*", F.explode(F.array_distinct(expressions(F.col("u_host"), F.col("u_path"), known["labels"], known["lengths"]))).alias("expression"))
    asked = asked.withColumn("prefix", F.substring("expression", 1, PREFIX))
    if known["n"] <= BROADCAST_ROWS:
        met = asked.join(F.broadcast(rules), "prefix")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"])
    best = met.where("expression = digest").groupBy("u_host", "u_path").agg(F.max(F.struct("rank", "rule")).alias("best"))
    found = best.select("u_host", "u_path", F.col("best.rule").alias(names[2]), F.col("best.rank.verdict").alias("u_verdict"))
    out = placed.join(found, (F.col(names[0]) == F.col("u_host")) & (F.col(names[1]) == F.col("u_path")), "left")
    return out.select(*pages.columns, names[0], names[1], names[2], F.coalesce("u_verdict", F.lit(default)).alias(names[3]))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def _oracle() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH rules(h, p, v) AS (VALUES {values}),
u AS (
  SELECT page_id, row_number() OVER () AS k,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), f AS (
  SELECT k, h || p AS rule, v FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC, v DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM s LEFT JOIN f USING (k)
"""


ORACLE = _oracle()
