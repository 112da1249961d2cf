"""Queries that run streams: signals of rides arrive out of order, rules put them right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.plans import _sql, live as stored
from paceline.sources import rides
from paceline.streaming import live, ordered, race, replay, resumption

QUERIES = {}
ORACLE_SQL = {}
#: The watermark's last time is so far beyond the last row.
TAIL_MS = 7_777
#: All rides begin at this time, and their own times count from it.
BEGIN_MS = 1_700_000_000_000


def query(sql: str, *parts: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = _sql.query(sql, *parts)
        return f

    return put


def _run(rows: DataFrame, rule: ordered.Rule) -> DataFrame:
    """rows (track_id, at, seq, ...) through a rule, arriving shuffled; at_ms for the output's time."""
    rows = rows.withColumn("at", F.col("at") + BEGIN_MS)
    rows = rides.checkpointed(rows)
    (lo, hi), n = replay.bounds(rows), rows.count()
    spark, parts = rows.sparkSession, replay.parts(n)
    folder = replay.arrived(rows, "track_id", lo, hi, hi + TAIL_MS, parts=parts)
    out = replay.finished(ordered.over_stream(replay.stream(spark, folder, rows.schema, parts), rule, "track_id", f"{replay.delay_ms(lo, hi)} milliseconds"), n_rows=n)
    return out.withColumn("at", F.col("at") - BEGIN_MS).withColumnRenamed("at", "at_ms") if "at" in out.columns else out


_NAMED = "sg AS (SELECT track_id, t_ms AS at_ms, seq, CASE seq % 3 WHEN 0 THEN 'distance' WHEN 1 THEN 'elapsed' ELSE 'speed' END AS name, CASE WHEN seq % 8 <> 6 THEN d_mm / 1000.0::DOUBLE END AS value FROM points)"
_LASTS = ", ".join(f"last_value(CASE WHEN name = '{n}' THEN value END IGNORE NULLS) OVER w AS {n}" for n in ("distance", "elapsed", "speed"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("seq") % 3 == 0, "distance").when(F.col("seq") % 3 == 1, "elapsed").otherwise("speed")
    value = F.when(F.col("seq") % 8 != 6, F.col("distance_m"))
    return rides.points(spark, sf_dir).select("track_id", F.col("t_ms").alias("at"), F.col("seq").cast("bigint").alias("seq"), name.alias("name"), value.alias("value"))


@query(f"SELECT track_id, at_ms, seq, distance, elapsed, speed FROM (SELECT track_id, at_ms, seq, {_LASTS} FROM sg WINDOW w AS (PARTITION BY track_id ORDER BY at_ms, seq)) WHERE distance IS NOT NULL AND elapsed IS NOT NULL AND speed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY at_ms, seq) > 1", _NAMED)
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, time and speed from three signals, at every change of one, without each ride's first."""
    return _run(_signals(spark, sf_dir), live.Latest(["distance", "elapsed", "speed"], drop_first=True))


_AWAY = """
aw AS (SELECT track_id, seq, t_ms AS at_ms, seq % {n} < {k} AS present FROM points),
ae AS (SELECT *, lead(at_ms) OVER (PARTITION BY track_id ORDER BY seq) AS next_ms FROM (SELECT * FROM aw QUALIFY lag(present) OVER (PARTITION BY track_id ORDER BY seq) IS DISTINCT FROM present)),
ah AS (SELECT * FROM ae, (SELECT max(at_ms) + 7777 AS until FROM aw) WHERE NOT present AND coalesce(next_ms, until) - at_ms >= {grace})
"""
_GONE = "SELECT track_id, at_ms + {grace} AS at_ms, 'gone' AS kind FROM ah UNION ALL SELECT track_id, next_ms, 'back' FROM ah WHERE next_ms IS NOT NULL"


def _present(spark: SparkSession, sf_dir: str, n: int, k: int) -> DataFrame:
    return rides.points(spark, sf_dir).select("track_id", F.col("t_ms").alias("at"), F.col("seq").cast("bigint").alias("seq"), (F.col("seq") % n < k).alias("present"))


@query(_GONE.format(grace=4000), _AWAY.format(n=5, k=4, grace=4000))
def stream_teardowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that were away for four seconds, by a timer, and their returns."""
    return _run(_present(spark, sf_dir, 5, 4), live.Absence())


@query(_GONE.format(grace=180_000), _AWAY.format(n=40, k=10, grace=180_000))
def stream_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers blanked after three minutes without a reading, and shown again."""
    return _run(_present(spark, sf_dir, 40, 10), live.Absence(live.GIVE_UP_MS))


_REPEATS = "SELECT track_id, at_ms + r * 3000 AS at_ms, seq, value, r::INT AS repeat FROM (SELECT *, (coalesce(lead(at_ms) OVER (PARTITION BY track_id ORDER BY seq) - 1, until) - at_ms) // 3000 AS n FROM {rows}, (SELECT max(t_ms) + 7777 AS until FROM points)), LATERAL (SELECT unnest(range(0, greatest(0, n) + 1)) AS r)"


def _values(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    value = F.floor(F.col("d_mm") / every).cast("double")
    return rides.points(spark, sf_dir).select("track_id", F.col("t_ms").alias("at"), F.col("seq").cast("bigint").alias("seq"), value.alias("value"))


@query(_REPEATS.format(rows="hv"), "hv AS (SELECT track_id, t_ms AS at_ms, seq, (d_mm // 1)::DOUBLE AS value FROM points)")
def stream_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value, and again each three seconds until the next, by a timer."""
    return _run(_values(spark, sf_dir, 1), live.Repeats())


@query(_REPEATS.format(rows="hc"), "hv AS (SELECT track_id, t_ms AS at_ms, seq, (d_mm // 100000)::DOUBLE AS value FROM points), hc AS (SELECT * FROM hv QUALIFY lag(value) OVER (PARTITION BY track_id ORDER BY seq) IS DISTINCT FROM value)")
def stream_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn of a value that is seen to 100 m: changes only, each again every three seconds."""
    return _run(_values(spark, sf_dir, 100_000), live.Repeats(changed_only=True))


@query("SELECT ride_id AS track_id, seq, round(age, 6) AS age_s FROM health WHERE alert", stored._ALERTS.replace("seq % 4 = 1 AS refused", "false AS refused"))
def stream_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of lost positions, from ticks that arrive shuffled."""
    pts = rides.points(spark, sf_dir)
    last = F.max(F.when((F.col("seq") % 60).between(3, 24), F.col("time_s") - 1)).over(Window.partitionBy("track_id").orderBy("seq"))
    ticks = pts.select("track_id", F.col("t_ms").alias("at"), F.col("seq").cast("bigint").alias("seq"), F.col("time_s").alias("now_s"), F.when(F.col("track_id") % 5 != 0, last).alias("last_fix_s"), (F.col("seq") % 90).between(50, 65).alias("paused"))
    return _run(ticks, live.Losses()).withColumn("age_s", F.round("age_s", 6))


#: Races stop after this tick; a ride in four has another route when it asks to go on, and begins anew.
CUT = 30
_LEGS = f"""
raw AS ({stored._RAW}),
leg AS (SELECT *, seq > {CUT} AND ride_id % 4 = 3 AS anew FROM raw),
tk AS (SELECT ride_id * 2 + anew::INT AS ride_id, row_number() OVER w AS seq, t, raw, speed, history, grade, greatest(0, t - lag(t) OVER w) AS dt FROM leg WINDOW w AS (PARTITION BY ride_id, anew ORDER BY seq))
"""


@query(f"SELECT ride_id // 2 AS ride_id, seq + CASE WHEN ride_id % 2 = 1 THEN {CUT} ELSE 0 END AS seq, gap_time_s, gap_distance_m, tag FROM ({stored._GAPS_SQL})", _LEGS, stored._COAST, stored._RACE)
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races stopped after a tick and gone on with in another stream, where the gates let them."""
    ticks = stored.ticks(spark, sf_dir).withColumns({"at": (F.round(F.col("elapsed_s") * 1000) + BEGIN_MS).cast("bigint"), "seq": F.col("seq").cast("bigint")})
    ticks = rides.checkpointed(ticks)
    n, folder = ticks.count(), rides.scratch(spark, "raced")
    parts = replay.parts(n)

    def run(part: DataFrame, to: str, initial: DataFrame | None = None) -> DataFrame:
        lo, hi = replay.bounds(part)
        arriving = replay.stream(spark, replay.arrived(part, "ride_id", lo, hi, hi + TAIL_MS, parts=parts), part.schema, parts)
        return replay.finished(race.race_stream(arriving, f"{replay.delay_ms(lo, hi)} milliseconds", initial), to, n)

    before = run(ticks.where(F.col("seq") <= CUT), folder)
    held = resumption.saved(spark, replay.log_of(folder))
    rides_ = held.select("ride_id")
    cuts = rides_.select("ride_id", F.lit(1).alias("epoch"), F.lit("road").alias("route_key"), F.lit("AVERAGE").alias("pick"), F.lit("HISTORY").alias("comparator"), F.lit(0).alias("saved_ms"))
    now = rides_.select("ride_id", F.lit(1).alias("epoch"), F.when(F.col("ride_id") % 4 == 3, "other").otherwise("road").alias("route_key"), F.lit("AVERAGE").alias("pick"), F.lit(1000).alias("now_ms"), F.lit(0.0).alias("now_m"), F.lit(0.0).alias("now_s"))
    after = run(ticks.where(F.col("seq") > CUT), f"{folder}-on", resumption.handed_over(resumption.judged(held, cuts, now)))
    return before.unionByName(after).select("ride_id", "seq", *[F.round(c, 6).alias(c) for c in ("gap_time_s", "gap_distance_m")], "tag")


_CUTS = """
cp AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_id % 5 END AS epoch, event_id * 7001 % 50000000 AS age_ms, event_id % 4 <> 0 AS route, event_id % 7 <> 0 AS pick, event_id % 11 <> 0 AS compared,
       (event_id * 37 % 900)::DOUBLE AS m, CASE WHEN event_id % 6 = 0 THEN -1 ELSE (event_id * 53 % 300)::DOUBLE END AS s, (event_id * 41 % 1000)::DOUBLE AS nm, (event_id * 59 % 300)::DOUBLE AS ns FROM events),
gt AS (SELECT event_id AS ride_id, age_ms <= 21600000 AS recent, route AS same_route, pick AS same_pick, coalesce(epoch = 3, false) OR (s >= 0 AND m > 300 AND nm > 300 AND abs(nm - m) <= 300 AND ns >= s - 30) AS continuous, compared FROM cp)
"""


@query("SELECT *, recent AND same_route AND same_pick AND continuous AND compared AS resumes FROM gt", _CUTS)
def resume_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gate of a resumption, for cuts that pass all, some and none."""
    e = lambda x: F.expr(x)
    ev = rides.table(spark, sf_dir, "events")
    blank = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in race.Racing.state.replace("array<array<double>>", "string").split(", ")}
    races = ev.select(F.col("event_id").alias("ride_id"), *[c.alias(n) for n, c in blank.items()]).withColumns({"at_m": e("CAST(ride_id * 37 % 900 AS DOUBLE)"), "race_clock": e("CASE WHEN ride_id % 6 <> 0 THEN CAST(ride_id * 53 % 300 AS DOUBLE) END")})
    cuts = ev.select(F.col("event_id").alias("ride_id"), e("CASE WHEN event_id % 9 <> 0 THEN event_id % 5 END").alias("epoch"), F.lit("road").alias("route_key"), F.lit("BEST").alias("pick"), e("CASE WHEN event_id % 11 <> 0 THEN 'HISTORY' END").alias("comparator"), F.lit(0).cast("bigint").alias("saved_ms"))
    now = ev.select(F.col("event_id").alias("ride_id"), F.lit(3).cast("bigint").alias("epoch"), e("CASE WHEN event_id % 4 <> 0 THEN 'road' ELSE 'other' END").alias("route_key"), e("CASE WHEN event_id % 7 <> 0 THEN 'BEST' ELSE 'LAST' END").alias("pick"), e("event_id * 7001 % 50000000").alias("now_ms"), e("CAST(event_id * 41 % 1000 AS DOUBLE)").alias("now_m"), e("CAST(event_id * 59 % 300 AS DOUBLE)").alias("now_s"))
    return resumption.judged(races, cuts, now).select("ride_id", *resumption.GATES, "resumes")
