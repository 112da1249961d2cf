"""Queries about live signals and about the stores of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import formats
from paceline.operators import signals, store
from paceline.plans import _sql
from paceline.sources import rides

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str, *parts: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = _sql.query(sql, *parts)
        return f

    return put


_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_AT = "epoch_us(ts) // 1000"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.to_timestamp("ts")) / 1000)
    return rides.table(spark, sf_dir, "events").select("user_id", at.alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("event_id").alias("value"))


@query(
    f"SELECT user_id, at_ms, seq, click, purchase FROM (SELECT user_id, {_AT} AS at_ms, event_id AS seq, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER {_W} AS click,"
    f" last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER {_W} AS purchase FROM events) WHERE event_type IN ('click', 'purchase') AND click IS NOT NULL AND purchase IS NOT NULL"
)
def latest_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest click and purchase of each user, whenever one of them changes."""
    return signals.latest_together(_signals(spark, sf_dir), ["click", "purchase"], "user_id").withColumnRenamed("at", "at_ms")


@query(f"SELECT user_id, event_id FROM events QUALIFY row_number() OVER {_W} > 1")
def first_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.without_first(_signals(spark, sf_dir), "user_id").select("user_id", F.col("seq").alias("event_id"))


_PRESENT = "st AS (SELECT track_id, seq, t_ms AS at_ms, seq % 12 < 8 AS present FROM points)"


@query(
    "SELECT track_id, at_ms + 4000 AS at_ms FROM (SELECT *, coalesce(lead(at_ms) OVER (PARTITION BY track_id ORDER BY seq), last) AS until FROM (SELECT *, max(at_ms) OVER (PARTITION BY track_id) AS last FROM st QUALIFY lag(present) OVER (PARTITION BY track_id ORDER BY seq) IS DISTINCT FROM present)) WHERE NOT present AND until - at_ms >= 4000",
    _PRESENT,
)
def route_teardowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that were away for four seconds or more."""
    states = rides.points(spark, sf_dir).select("track_id", "seq", F.col("t_ms").alias("at"), (F.col("seq") % 12 < 8).alias("present"))
    return signals.torn_down(states, "track_id").withColumnRenamed("at", "at_ms")


@query("SELECT track_id, t_ms + r * 3000 AS at_ms, seq, d_mm AS value, r::INT AS repeat FROM (SELECT *, coalesce(greatest(0, (lead(t_ms) OVER (PARTITION BY track_id ORDER BY seq) - t_ms - 1) // 3000), 0) AS n FROM points), LATERAL (SELECT unnest(range(0, n + 1)) AS r)")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with their repeats every three seconds."""
    return signals.kept_alive(rides.points(spark, sf_dir).select("track_id", F.col("t_ms").alias("at"), "seq", F.col("d_mm").alias("value")), "track_id").withColumnRenamed("at", "at_ms")


_KIND = "CASE seq % 20 WHEN 5 THEN 'open' WHEN 13 THEN 'close' ELSE CASE WHEN seq % 2 = 0 THEN 'replay' ELSE 'live' END END"


@query(
    f"SELECT track_id, seq, kind FROM (SELECT *, coalesce(last_value(CASE WHEN kind IN ('open', 'close') THEN kind END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq), 'close') AS state FROM (SELECT track_id, seq, {_KIND} AS kind FROM points)) WHERE (kind = 'replay' AND state = 'open') OR (kind = 'live' AND state = 'close')"
)
def source_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rides.points(spark, sf_dir).select("track_id", F.col("t_ms").alias("at"), "seq", F.expr(_KIND).alias("kind"))
    return signals.arbitrated(events, "track_id").select("track_id", "seq", "kind")


_SHOWN = """
mk AS (SELECT track_id, seq, CASE WHEN seq % 15 <> 0 THEN distance_m END AS place, seq % 40 = 0 OR seq % 40 = 21 AS again FROM points),
em(track_id, seq, shown, action) AS (SELECT track_id, seq, place, CASE WHEN place IS NOT NULL THEN 'show' END FROM mk WHERE seq = 1
  UNION ALL SELECT track_id, seq, CASE WHEN place IS NULL THEN NULL WHEN act = 'show' THEN place ELSE shown END, act
  FROM (SELECT k.track_id, k.seq, k.place, e.shown, CASE WHEN k.place IS NULL THEN CASE WHEN e.shown IS NOT NULL THEN 'hide' END WHEN e.shown IS NULL OR k.again OR abs(k.place - e.shown) >= 60 THEN 'show' END AS act
        FROM em e JOIN mk k ON k.track_id = e.track_id AND k.seq = e.seq + 1))
"""


@query("SELECT track_id, seq, action FROM em WHERE action IS NOT NULL", _SHOWN)
def marker_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a marker that moves 60 m or more, vanishes, or is asked again draws."""
    m = rides.points(spark, sf_dir).select("track_id", "seq", F.when(F.col("seq") % 15 != 0, F.col("distance_m")).alias("place_m"), ((F.col("seq") % 40 == 0) | (F.col("seq") % 40 == 21)).alias("reassert"))
    return signals.emitted(m, 60.0, "track_id")


@query("SELECT track_id, seq, lat IS NOT NULL AND isfinite(acc) AND acc <= 50 AS trusted FROM (SELECT track_id, seq, lat, CASE WHEN seq % 9 = 0 THEN 'inf'::DOUBLE ELSE (seq * 7 % 80)::DOUBLE END AS acc FROM points)")
def trusted_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    accuracy = F.when(F.col("seq") % 9 == 0, float("inf")).otherwise((F.col("seq") * 7 % 80).cast("double"))
    return rides.points(spark, sf_dir).select("track_id", "seq", signals.trusted_fix(F.col("lat"), F.col("lng"), accuracy).alias("trusted"))


_COPIES = "cp AS (SELECT track_id, length_mm / 1000.0::DOUBLE AS length_m, 'live' AS place FROM tracks WHERE track_id % 3 <> 0 UNION ALL SELECT track_id, length_mm / 1000.0::DOUBLE + track_id % 4 - 1, 'archive' FROM tracks WHERE track_id % 2 = 0)"


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides.tracks_of(rides.points(spark, sf_dir)).withColumn("length_m", F.col("length_mm") / 1000.0)


@query("SELECT track_id, length_m, place FROM cp QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY length_m DESC, place DESC) = 1", _COPIES)
def tracks_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir).select("track_id", "length_m")
    return store.everywhere(t.where("track_id % 3 <> 0"), t.where("track_id % 2 = 0").withColumn("length_m", F.col("length_m") + F.col("track_id") % 4 - 1))


@query("SELECT track_id, CASE WHEN track_id % 5 = 1 THEN 'archived' ELSE 'live' END AS state FROM tracks")
def archive_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir).select("track_id", F.lit("live").alias("state"))
    return store.archived(t, t.where("track_id % 5 = 1"))


_AGGS = """
old AS (SELECT 'r' || track_id AS route_key, track_id % 5 AS schema_version, started_ms - track_id * 864000000 AS updated_ms FROM tracks WHERE track_id % 3 <> 0),
new AS (SELECT 'r' || track_id AS route_key, 3 AS schema_version, started_ms AS updated_ms FROM tracks WHERE track_id % 4 = 0),
saved AS (SELECT * FROM old WHERE route_key NOT IN (SELECT route_key FROM new) UNION ALL SELECT * FROM new)
"""


def _aggregates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = _tracks(spark, sf_dir).withColumn("route_key", F.concat(F.lit("r"), "track_id"))
    old = t.where("track_id % 3 <> 0").select("route_key", (F.col("track_id") % 5).cast("int").alias("schema_version"), (F.col("started_ms") - F.col("track_id") * 864_000_000).alias("updated_ms"))
    return old, t.where("track_id % 4 = 0").select("route_key", F.lit(3).alias("schema_version"), F.col("started_ms").alias("updated_ms"))


@query("SELECT * FROM (SELECT * FROM saved WHERE schema_version BETWEEN 1 AND 3) WHERE updated_ms >= 1700000000000 - 46656000000 ORDER BY updated_ms DESC, route_key LIMIT 200", _AGGS)
def aggregate_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates after a save, of readable versions, swept to the newest of the last 540 days."""
    old, new = _aggregates(spark, sf_dir)
    return store.swept(store.current(store.updated(old, new)), 1_700_000_000_000)


@query(
    "SELECT coalesce(old.route_key, new.route_key) AS route_key, CASE WHEN old.schema_version BETWEEN 1 AND 3 OR new.route_key IS NULL THEN old.schema_version ELSE 3 END AS schema_version,"
    " CASE WHEN old.schema_version BETWEEN 1 AND 3 OR new.route_key IS NULL THEN old.updated_ms ELSE new.updated_ms END AS updated_ms FROM old FULL JOIN new ON old.route_key = new.route_key",
    _AGGS,
)
def aggregates_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved where there is none yet; one of a version that cannot be read counts as none."""
    old, new = _aggregates(spark, sf_dir)
    return store.updated(old, new, replace=False)


@query("SELECT track_id, track_id % 6 = 0 AND track_id % 4 <> 0 AS hit FROM tracks")
def fold_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides whose folds a cache of every third one still holds; every fourth has changed, odd ones were folded by other constants."""
    t = _tracks(spark, sf_dir)
    files = t.select("track_id", F.col("length_mm").alias("size"), F.when(F.col("track_id") % 4 == 0, F.col("started_ms") + 1).otherwise(F.col("started_ms")).alias("mtime"), F.lit("archive").alias("place"))
    cache = t.where("track_id % 3 = 0").select("track_id", F.col("length_mm").alias("size"), F.col("started_ms").alias("mtime"), F.lit("live").alias("place"), F.when(F.col("track_id") % 2 == 0, "v3").otherwise("v2").alias("signature"))
    hits, misses = store.fold_cache(files, cache, "v3")
    return hits.select("track_id", F.lit(True).alias("hit")).unionByName(misses.select("track_id", F.lit(False).alias("hit")))


_BOXES = "bx AS (SELECT track_id, min(lat) AS a, max(lat) AS b, min(lng) AS c, max(lng) AS d FROM points GROUP BY track_id)"


@query("SELECT track_id, round(a, 9) AS min_lat, round(b, 9) AS max_lat, round(c, 9) AS min_lng, round(d, 9) AS max_lng, a <= 41.002 AND b >= 41.001 AND c <= 0.034 AND d >= 0.01 AS meets FROM bx", _BOXES)
def track_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of rides, and whether they meet one around a place."""
    names = ["min_lat", "max_lat", "min_lng", "max_lng"]
    area = F.struct(F.lit(41.001).alias("min_lat"), F.lit(41.002).alias("max_lat"), F.lit(0.01).alias("min_lng"), F.lit(0.034).alias("max_lng"))
    got = store.boxes(rides.points(spark, sf_dir)).withColumn("x", F.struct(*names)).withColumn("y", area)
    return got.select("track_id", *[F.round(c, 9).alias(c) for c in names], store.boxes_meet("x", "y").alias("meets"))


_SPANS = "sp AS (SELECT track_id % 6 AS route_id, track_id, (track_id * 7919 % 3000)::DOUBLE AS start_m, (track_id * 7919 % 3000 + 200 + track_id * 31 % 700)::DOUBLE AS end_m, time_ms / 1000.0::DOUBLE AS time_s, started_ms FROM tracks)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("track_id") * 7919 % 3000
    return _tracks(spark, sf_dir).select((F.col("track_id") % 6).alias("route_id"), "track_id", start.cast("double").alias("start_m"), (start + 200 + F.col("track_id") * 31 % 700).cast("double").alias("end_m"), (F.col("time_ms") / 1000.0).alias("time_s"), "started_ms")


@query("SELECT route_id, round(sum(end_m - start_m) / sum(time_s), 6) AS speed_ms FROM sp GROUP BY route_id", _SPANS)
def average_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = _spans(spark, sf_dir).withColumn("distance_m", F.col("end_m") - F.col("start_m"))
    return store.average_speed(segs).withColumn("speed_ms", F.round("speed_ms", 6))


@query(
    "SELECT route_id, 'LAST' AS how, track_id FROM sp QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY started_ms DESC, track_id) = 1"
    " UNION ALL SELECT route_id, 'BEST', track_id FROM (SELECT *, end_m - start_m AS m, max(end_m - start_m) OVER (PARTITION BY route_id) AS longest FROM sp) WHERE m >= 0.9 * longest QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY m / time_s DESC, track_id) = 1",
    _SPANS,
)
def dominant_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).withColumn("span_m", F.col("end_m") - F.col("start_m"))
    pick = lambda how: store.dominant(spans, how).select("route_id", F.lit(how).alias("how"), "track_id")
    return pick("LAST").unionByName(pick("BEST"))


@query("SELECT route_id, start_m, end_m FROM sp s WHERE track_id // 6 % 2 = 1 AND NOT EXISTS (SELECT 1 FROM sp p WHERE p.track_id // 6 % 2 = 0 AND p.route_id = s.route_id AND p.start_m <= s.start_m AND p.end_m >= s.end_m)", _SPANS)
def not_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of odd rides that no span of an even ride of the road holds whole."""
    spans = _spans(spark, sf_dir)
    return store.not_contained(spans.where("track_id div 6 % 2 = 1"), spans.where("track_id div 6 % 2 = 0"))


@query("SELECT 'q' || k || ':' || route_id AS id, (SELECT min(start_m) FROM sp WHERE sp.route_id = r.route_id AND start_m > k * 100) AS next_m FROM (SELECT DISTINCT route_id FROM sp) r, range(0, 40) AS x(k)", _SPANS)
def next_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next span that begins after every 100 m of a road."""
    spans = _spans(spark, sf_dir)
    asked = spans.select("route_id").distinct().select("route_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    asked = asked.select(F.concat(F.lit("q"), "k", F.lit(":"), "route_id").alias("id"), "route_id", (F.col("k") * 100.0).alias("at_m"))
    return store.next_start(asked, spans).select("id", "next_m")


_CELLS = "ix AS (SELECT DISTINCT track_id, floor((lat + 90) / 180 * 32768)::BIGINT AS row FROM points)"


@query("SELECT track_id, row FROM ix", _CELLS)
def index_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two overlapping parts, merged."""
    cells = rides.points(spark, sf_dir).select("track_id", F.floor((F.col("lat") + 90) / 180 * 32768).alias("row"))
    return store.merged_index(cells.where("track_id % 3 < 2"), cells.where("track_id % 3 > 0"))


@query("SELECT track_id FROM tracks WHERE track_id % 4 <> 2")
def keys_subtracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _tracks(spark, sf_dir).select("track_id", F.concat(F.lit("k"), "track_id").alias("source_key"))
    return store.without_keys(keys, keys.where("track_id % 4 = 2")).select("track_id")


_LINE = "concat(CASE WHEN event_id % 3 = 0 THEN 'fix lat=41.4863 lng=-2,31 ok' WHEN event_id % 3 = 1 THEN 'nav name=Casa - Trabajo routeLen=1200' ELSE 'race on ''Home loop'' navLen=9' END, ' #', CAST(event_id AS VARCHAR))"


@query(
    f"SELECT event_id, regexp_replace(regexp_replace(regexp_replace({_LINE}, '(lat|lng)=-?[0-9]+([.,][0-9]+)?', '\\1=•', 'g'), 'name=.* routeLen=', 'name=• routeLen='), '(on|for) ''[^'']*''', '\\1 ''•''', 'g') AS line FROM events"
)
def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(_LINE.replace("''", "\\'").replace("VARCHAR", "STRING"))
    return rides.table(spark, sf_dir, "events").select("event_id", formats.redacted(line).alias("line"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN event_id ELSE -1 END AS a, CASE WHEN event_id % 4 = 2 THEN '' ELSE 'x' END AS b FROM events")
def tolerant_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with unknown, missing, unquoted and unfit fields."""
    n = F.col("event_id").cast("string")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"a": '), n, F.lit(', "b": "x", "new": [1]}')))
        .when(F.col("event_id") % 4 == 1, F.lit('{"a": "no number", "b": "x"}'))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"a": '), n, F.lit("}")))
        .otherwise(F.concat(F.lit("{a: "), n, F.lit(", b: 'x'}")))
    )
    return rides.table(spark, sf_dir, "events").select("event_id", formats.tolerant_json(text, "a bigint, b string").alias("s")).select("event_id", F.coalesce("s.a", F.lit(-1)).alias("a"), F.coalesce("s.b", F.lit("")).alias("b"))


@query(
    "SELECT active, estimated, status, time_s, distance, imperial, count(*) AS n FROM (SELECT active, active AND est AS estimated, CASE WHEN NOT active OR abs(g) < 1 THEN 'NEUTRAL' WHEN g < 0 THEN 'AHEAD' ELSE 'BEHIND' END AS status,"
    " CASE WHEN active THEN trunc(g)::INT ELSE 0 END AS time_s, CASE WHEN active THEN trunc(CASE WHEN imp THEN m * 3.280839895 ELSE m END)::INT ELSE 0 END AS distance, imp AS imperial FROM ("
    "SELECT seq % 10 <> 0 AS active, seq % 3 = 0 AS est, track_id % 2 = 0 AS imp, (t_ms - d_mm * 18 // 100) / 1000.0::DOUBLE AS g, (d_mm - t_ms * 5) / 1000.0::DOUBLE AS m FROM points)) GROUP BY ALL"
)
def render_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ticks look alike."""
    g, m = F.expr("(t_ms - d_mm * 18 div 100) / 1000.0D"), F.expr("(d_mm - t_ms * 5) / 1000.0D")
    key = formats.render_key(g, m, F.col("seq") % 10 != 0, F.col("seq") % 3 == 0, F.col("track_id") % 2 == 0)
    return rides.points(spark, sf_dir).select(key.alias("k")).select("k.*").groupBy("active", "estimated", "status", "time_s", "distance", "imperial").agg(F.count("*").alias("n"))


@query("SELECT count, count(*) AS nodes FROM (SELECT track_id % 6 AS road, (d_mm // 500000)::BIGINT AS k, count(DISTINCT track_id) AS count FROM points GROUP BY ALL) GROUP BY count")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many half kilometres of a road have how many rides."""
    nodes = rides.points(spark, sf_dir).groupBy((F.col("track_id") % 6).alias("road"), F.expr("d_mm div 500000").alias("k")).agg(F.count_distinct("track_id").alias("count"))
    return store.node_counts(nodes)
