"""Queries about ticks, gaps and what is shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions import formats
from paceline.operators import joins, laps, route, rules, samples, signals
from paceline.plans import _sql, routes
from paceline.sources import rides
from paceline.streaming import alerts, race, tracking

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None, *parts: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _sql.query(sql, *parts)
        return f

    return put


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick for each point; some odometers are frozen, some speeds missing."""
    pts = rides.points(spark, sf_dir)
    w = Window.partitionBy("track_id").orderBy("seq")
    frozen = F.col("seq") % 11 == 5
    raw = F.when(frozen, F.lag("distance_m").over(w)).otherwise(F.col("distance_m"))
    speed = F.when(F.col("seq") % 13 == 3, F.lit(None)).otherwise(F.col("seq") % 9 + 1.0).cast("double")
    return pts.select(
        F.col("track_id").alias("ride_id"),
        "seq",
        F.col("time_s").alias("elapsed_s"),
        raw.alias("raw_m"),
        speed.alias("speed_ms"),
        F.when(F.col("seq") % 3 != 0, 0.18).alias("history_tpm"),
        F.when(F.col("seq") % 3 == 0, 0.2).alias("grade_tpm"),
        F.lit("recording").alias("state"),
    )


#: Ticks as above; a tick's event, then what it makes of the state before it.
_RAW = "SELECT track_id AS ride_id, seq, time_s AS t, CASE WHEN seq % 11 = 5 THEN lag(distance_m) OVER w ELSE distance_m END AS raw, CASE WHEN seq % 13 <> 3 THEN (seq % 9 + 1)::DOUBLE END AS speed, CASE WHEN seq % 3 <> 0 THEN 0.18::DOUBLE END AS history, CASE WHEN seq % 3 = 0 THEN 0.2::DOUBLE END AS grade, greatest(0, time_s - lag(time_s) OVER w) AS dt FROM points WINDOW w AS (PARTITION BY track_id ORDER BY seq)"
_TK = f"tk AS ({_RAW})"
_COAST = """
coast(ride_id, seq, raw, gained, due_m, due_s, spent, blind, frozen, cruise, forward, held, ev) AS (
  SELECT ride_id, seq, raw, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CASE WHEN speed BETWEEN 0.5 AND 30 THEN speed ELSE 0.0::DOUBLE END, false, false, 'read' FROM tk WHERE seq = 1
  UNION ALL
  SELECT ride_id, seq, raw,
         CASE ev WHEN 'read' THEN 0 WHEN 'lost' THEN 0 WHEN 'hold' THEN gained WHEN 'stand' THEN gained WHEN 'stall' THEN gained + due_m ELSE gained + due_m + rate * room END,
         CASE ev WHEN 'hold' THEN due_m + least(speed, 30) * dt WHEN 'stand' THEN due_m ELSE 0 END,
         CASE ev WHEN 'hold' THEN due_s + dt WHEN 'stand' THEN due_s ELSE 0 END,
         CASE ev WHEN 'read' THEN 0 WHEN 'stall' THEN spent + due_s WHEN 'coast' THEN spent + due_s + room ELSE spent END,
         CASE WHEN ev = 'read' THEN 0 WHEN ev = 'coast' AND speed IS NULL THEN blind + room ELSE blind END,
         CASE ev WHEN 'read' THEN 0 WHEN 'lost' THEN 0 WHEN 'stand' THEN frozen ELSE frozen + dt END,
         CASE WHEN ev = 'read' AND speed BETWEEN 0.5 AND 30 THEN speed ELSE cruise END,
         CASE WHEN ev = 'read' THEN raw > was ELSE forward END,
         ev = 'hold' OR (ev = 'stand' AND held), ev
  FROM (SELECT *, CASE WHEN speed IS NULL THEN cruise ELSE least(speed, 30) END AS rate,
               least(dt, greatest(0, 1800 - spent - due_s), CASE WHEN speed IS NULL THEN greatest(0, 30 - blind) ELSE dt END) AS room FROM (
    SELECT k.ride_id, k.seq, k.raw, k.speed, k.dt, c.raw AS was, c.gained, c.due_m, c.due_s, c.spent, c.blind, c.frozen, c.cruise, c.forward, c.held,
           CASE WHEN k.raw <> c.raw THEN 'read' WHEN k.speed IS NULL AND c.cruise <= 0 THEN CASE WHEN c.forward THEN 'stall' ELSE 'lost' END WHEN k.speed < 0.5 THEN 'stand'
                WHEN k.speed IS NOT NULL AND c.spent = 0 AND c.frozen + k.dt > 0 AND c.frozen + k.dt <= 2 THEN 'hold' ELSE 'coast' END AS ev
    FROM coast c JOIN tk k ON k.ride_id = c.ride_id AND k.seq = c.seq + 1)))
"""


@query("SELECT ride_id, seq, round(raw + gained, 6) AS distance_m, CASE WHEN held OR frozen <= 0 THEN 'LIVE' WHEN frozen <= 30 THEN 'COASTING' ELSE 'LONG_LOSS' END AS quality, round(frozen, 6) AS frozen_s FROM coast", _TK, _COAST)
def coast_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.odometers(ticks(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("distance_m", "frozen_s")})


#: The race: the clock that stands while the rider does, the lead, and the ghost's place on a path of crumbs.
_RACE = """
cx AS (SELECT ride_id, seq, coast.raw + gained AS dist, CASE WHEN held OR frozen <= 0 THEN 'LIVE' WHEN frozen <= 30 THEN 'COASTING' ELSE 'LONG_LOSS' END AS quality, held, ev,
       ev = 'read' AND lag(held) OVER (PARTITION BY ride_id ORDER BY seq) AND tk.speed < 0.5 AS still, t, history, grade FROM coast JOIN tk USING (ride_id, seq)),
offer AS (SELECT *, CASE WHEN quality <> 'LIVE' THEN 'GP' WHEN history IS NOT NULL THEN 'SEG' WHEN grade IS NOT NULL THEN 'GRADE' ELSE 'GP' END AS tag, CASE WHEN quality = 'LIVE' THEN coalesce(history, grade) END AS pace FROM cx),
rc(ride_id, seq, t, raced, at_m, clock, lead, matched, filled, path, back) AS (
  SELECT ride_id, seq, t, 0.0::DOUBLE, dist, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, [{'d': dist, 't': 0.0::DOUBLE}], 0.0::DOUBLE FROM offer WHERE seq = 1
  UNION ALL
  SELECT ride_id, seq, t, raced, at2, clock2, lead2, matched2, filled2, path2,
         CASE WHEN held THEN back ELSE at2 - CASE WHEN clock2 > path2[-1].t THEN CASE WHEN lead2 < 0 THEN at2 WHEN clock2 + lead2 > path2[-1].t THEN path2[-1].d + least(1, (clock2 - path2[-1].t) / (clock2 + lead2 - path2[-1].t)) * (at2 - path2[-1].d) ELSE path2[-1].d END
              WHEN k = 0 THEN path2[1].d WHEN path2[k + 1].t > path2[k].t THEN path2[k].d + least(1, (clock2 - path2[k].t) / (path2[k + 1].t - path2[k].t)) * (path2[k + 1].d - path2[k].d) ELSE path2[k].d END END
  FROM (SELECT *, len(list_filter(path2, lambda x: x.t < clock2)) AS k FROM (
    SELECT *, CASE WHEN held THEN at_m ELSE dist END AS at2, CASE WHEN held THEN clock ELSE raced END AS clock2, CASE WHEN held THEN lead ELSE lead1 END AS lead2,
           matched + CASE WHEN NOT held AND step > 0 AND pace IS NOT NULL THEN step ELSE 0 END AS matched2, filled + CASE WHEN NOT held AND step > 0 AND pace IS NULL THEN step ELSE 0 END AS filled2,
           CASE WHEN held THEN path WHEN step > 0 THEN CASE WHEN dist - path[-1].d >= 20 THEN list_append(path, {'d': dist, 't': raced + lead1}) ELSE path END
                WHEN step < 0 THEN CASE WHEN path[1].d <= dist THEN list_filter(path, lambda x: x.d <= dist) ELSE [{'d': dist, 't': raced}] END ELSE path END AS path2
    FROM (SELECT *, CASE WHEN step > 0 THEN lead + (CASE WHEN pace IS NULL THEN greatest(0, took) ELSE pace * step END - took) ELSE lead - took END AS lead1 FROM (
      SELECT *, dist - at_m AS step, raced - clock AS took FROM (
        SELECT o.*, r.at_m, r.clock, r.lead, r.matched, r.filled, r.path, r.back,
               r.raced + CASE WHEN o.t < r.t OR NOT (coalesce(o.still, false) OR (o.dist <= r.at_m AND o.ev <> 'hold')) THEN o.t - r.t ELSE 0 END AS raced
        FROM rc r JOIN offer o ON o.ride_id = r.ride_id AND o.seq = r.seq + 1))))))
"""
_GAPS_SQL = "SELECT ride_id, seq, t AS elapsed_s, round(dist, 6) AS distance_m, quality, tag, round(0 - lead, 6) AS gap_time_s, round(back, 6) AS gap_distance_m, round(matched, 6) AS matched_m, round(filled, 6) AS filled_m, lead > 0 AS ahead, quality <> 'LIVE' AS estimated FROM rc JOIN offer USING (ride_id, seq, t)"


def _rounded(gaps: DataFrame) -> DataFrame:
    return gaps.withColumns({c: F.round(c, 6) for c in ("distance_m", "gap_time_s", "gap_distance_m", "matched_m", "filled_m")})


@query(_GAPS_SQL, _TK, _COAST, _RACE)
def race_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(race.race_batch(ticks(spark, sf_dir)))


@query(f"SELECT ride_id, seq, 0 - gap_time_s AS seconds, gap_distance_m AS metres, estimated::INT AS estimated, 'STREAMING' AS status FROM ({_GAPS_SQL})", _TK, _COAST, _RACE)
def gap_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race.gap_stream(_rounded(race.race_batch(ticks(spark, sf_dir))))


@query(
    "SELECT ride_id, seq, tag, round(0 - lead, 6) AS gap_time_s, round(CASE WHEN lead >= 0 THEN back WHEN tag = 'GRADE' THEN lead / grade END, 6) AS gap_distance_m FROM rc JOIN offer USING (ride_id, seq, t)",
    f"tk AS (SELECT * REPLACE (NULL::DOUBLE AS history) FROM ({_RAW}))",
    _COAST,
    _RACE,
)
def post_route_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races whose route has ended: gradient and neutral ticks only."""
    return _rounded(race.post_route(ticks(spark, sf_dir))).select("ride_id", "seq", "tag", "gap_time_s", "gap_distance_m")


@query(
    "SELECT track_id, seq, CASE WHEN seq % 9 = 4 THEN NULL WHEN track_id % 4 = 0 THEN 1 / (seq % 7 + 2.0::DOUBLE) WHEN seq % 3 <> 0 THEN 0.18::DOUBLE WHEN seq % 6 = 0 THEN 0.2::DOUBLE END AS pace_tpm FROM points"
)
def race_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pace that answers a tick: the target of races against one, else the road, else the gradient."""
    kind = F.when(F.col("track_id") % 4 == 0, "TARGET").otherwise("HISTORY")
    road, slope = F.when(F.col("seq") % 3 != 0, 0.18), F.when(F.col("seq") % 6 == 0, 0.2)
    return rides.points(spark, sf_dir).select("track_id", "seq", route.race_pace(kind, F.col("seq") % 9 != 4, F.col("seq") % 7 + 2.0, road, slope).alias("pace_tpm"))


@query("SELECT track_id, seq, (floor(time_s)::BIGINT // 60) || ':' || lpad((floor(time_s)::BIGINT % 60)::VARCHAR, 2, '0') AS label FROM points")
def elapsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides.points(spark, sf_dir).select("track_id", "seq", formats.mmss(F.col("time_s")).alias("label"))


@query("SELECT event_id, last_ms IS NULL OR now_ms < last_ms OR now_ms - last_ms >= CASE WHEN asked < 3 THEN 259200000 ELSE 864000000 END AS due FROM (SELECT event_id, event_id % 6 AS asked, CASE WHEN event_id % 11 <> 0 THEN event_id * 7001 % 1000000000 END AS last_ms, event_id * 104729 % 2000000000 AS now_ms FROM events)")
def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reminder is due: three times after 72 hours, then every ten days; a clock set back fires."""
    due = rules.reminder(F.col("event_id") % 6, F.expr("CASE WHEN event_id % 11 <> 0 THEN event_id * 7001 % 1000000000 END"), F.expr("event_id * 104729 % 2000000000"))
    return rides.table(spark, sf_dir, "events").select("event_id", due.alias("due"))


#: Laps of a ride's own road, folded node by node from the last good one.
_LAPS = """
pairs AS (SELECT track_id AS lap_id, lag(distance_m) OVER w AS d0, distance_m AS d1, lag(time_s) OVER w AS t0, time_s AS t1 FROM points WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
ends AS (SELECT track_id AS lap_id, max(distance_m) AS hi, min(distance_m) AS lo FROM points GROUP BY track_id),
node AS (SELECT lap_id, k::INT AS k, k * 25.0::DOUBLE AS d FROM ends, range(0, 61) AS r(k) WHERE k * 25 >= lo AND k * 25 <= hi AND lo < hi),
passed AS (SELECT lap_id, k, d, min(CASE WHEN d1 > d0 THEN t0 + (d - d0) / (d1 - d0) * (t1 - t0) ELSE t0 END) AS t FROM node JOIN pairs USING (lap_id) WHERE d0 <= d AND d <= d1 GROUP BY ALL),
good AS (SELECT lap_id, 0 AS k, 0.0::DOUBLE AS d, 0.0::DOUBLE AS t FROM ends WHERE lo < hi
         UNION ALL
         SELECT lap_id, k, d, t FROM (
           SELECT p.lap_id, p.k, p.d, p.t, row_number() OVER (PARTITION BY p.lap_id ORDER BY p.k) AS rn
           FROM good g JOIN passed p ON p.lap_id = g.lap_id AND p.k > g.k AND p.t > g.t AND p.d - g.d <= 30 * (p.t - g.t) + 1e-9) WHERE rn = 1),
folds AS (SELECT b.lap_id, b.k, least(50, b.t - a.t) AS dt_s FROM good a JOIN good b ON a.lap_id = b.lap_id AND b.k = a.k + 1)
"""


def _laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laps.lap_folds(laps.route_laps(rides.points(spark, sf_dir)), 1500.0)


@query("SELECT lap_id, k, round(dt_s, 6) AS dt_s FROM folds", _LAPS)
def lap_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from node to node of every ride's first 1,500 m."""
    return _laps(spark, sf_dir).withColumn("dt_s", F.round("dt_s", 6))


@query(
    "SELECT k, round(sum(dt_s * CASE WHEN o <= 4 THEN 1.0::DOUBLE / least(n, 4) * 0.75::DOUBLE ** greatest(0, n - 4) ELSE 0.25::DOUBLE * 0.75::DOUBLE ** (n - o) END), 6) AS dt_s, round(min(dt_s), 6) AS min_dt_s, round(max(CASE WHEN o = n THEN dt_s END), 6) AS last_dt_s, count(*) AS count"
    " FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY started_ms, lap_id) AS o, count(*) OVER (PARTITION BY k) AS n FROM folds JOIN tracks ON track_id = lap_id) GROUP BY k",
    _LAPS,
)
def lap_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rides' laps folded by node, oldest first."""
    order = F.struct(rides.started_ms("lap_id"), "lap_id")
    got = laps.fold_of_laps(_laps(spark, sf_dir), order)
    return got.select("k", *[F.round(c, 6).alias(c) for c in ("dt_s", "min_dt_s", "last_dt_s")], "count")


#: A latch a ride, walked tick by tick: anchor, whether the alert is out, and whether this tick raises it.
_ALERTS = """
ft AS (SELECT track_id AS ride_id, seq, time_s AS now, CASE WHEN track_id % 5 <> 0 THEN max(CASE WHEN seq % 60 BETWEEN 3 AND 24 THEN time_s - 1 END) OVER (PARTITION BY track_id ORDER BY seq) END AS fix,
       seq % 90 BETWEEN 50 AND 65 AS paused, seq % 4 = 1 AS refused FROM points),
health(ride_id, seq, anchor, was, fired, alert, age) AS (
  SELECT ride_id, seq, now, paused, false, false, 0.0::DOUBLE FROM ft WHERE seq = 1
  UNION ALL
  SELECT ride_id, seq, anchor, paused, CASE WHEN NOT judged THEN fired WHEN age >= 60 THEN fired OR NOT refused WHEN now - fix < 30 THEN false ELSE fired END, judged AND age >= 60 AND NOT fired, age
  FROM (SELECT *, now - greatest(anchor, fix) AS age, NOT paused AND fix IS NOT NULL AS judged FROM (
    SELECT t.*, h.fired, CASE WHEN h.was AND NOT t.paused THEN t.now ELSE h.anchor END AS anchor FROM health h JOIN ft t ON t.ride_id = h.ride_id AND t.seq = h.seq + 1)))
"""


@query("SELECT ride_id, seq, round(age, 6) AS age_s FROM health WHERE alert", _ALERTS)
def position_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of rides that lose their position and pause for a while; some never had one, some alerts are refused."""
    pts = rides.points(spark, sf_dir)
    last = F.max(F.when((F.col("seq") % 60).between(3, 24), F.col("time_s") - 1)).over(Window.partitionBy("track_id").orderBy("seq"))
    ticks_ = pts.select(F.col("track_id").alias("ride_id"), "seq", F.col("time_s").alias("now_s"), F.when(F.col("track_id") % 5 != 0, last).alias("last_fix_s"), (F.col("seq") % 90).between(50, 65).alias("paused"))
    return alerts.position_alerts(ticks_, refused=F.col("seq") % 4 == 1).withColumn("age_s", F.round("age_s", 6))


_GAPS = "gaps AS (SELECT track_id, seq, CASE WHEN seq % 19 = 0 THEN NULL ELSE (t_ms - d_mm * 18 // 100) / 1000.0::DOUBLE END AS gap_s, (d_mm - t_ms * 5) / 1000.0::DOUBLE AS gap_m FROM points)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides.points(spark, sf_dir).select(
        "track_id", "seq", F.when(F.col("seq") % 19 != 0, F.expr("(t_ms - d_mm * 18 div 100) / 1000.0D")).alias("gap_s"), F.expr("(d_mm - t_ms * 5) / 1000.0D").alias("gap_m")
    )


_A = "trunc(abs(gap_s))::BIGINT"
_SIGN = "CASE WHEN abs(gap_s) < 1 THEN '' WHEN gap_s < 0 THEN '+' ELSE '-' END"
_V = "floor(gap_m + 0.5)::BIGINT"


@query(
    f"SELECT track_id, seq, CASE WHEN gap_s IS NULL THEN '---' ELSE {_SIGN} || CASE WHEN {_A} >= 3600 THEN printf('%d:%02d:%02d', {_A} // 3600, {_A} % 3600 // 60, {_A} % 60) ELSE printf('%d:%02d', {_A} // 60, {_A} % 60) END END AS time_label,"
    f" CASE WHEN {_V} = 0 THEN '' WHEN {_V} > 0 THEN '+' ELSE '-' END || abs({_V}) || ' m' AS distance_label FROM gaps",
    _GAPS,
)
def gap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("track_id", "seq", formats.gap_time(F.col("gap_s")).alias("time_label"), formats.gap_distance(F.col("gap_m")).alias("distance_label"))


@query("SELECT status, count(*) AS n, round(sum(frac), 4) AS frac FROM (SELECT CASE WHEN abs(gap_s) < 1 THEN 'NEUTRAL' WHEN gap_s < 0 THEN 'AHEAD' ELSE 'BEHIND' END AS status, least(1, greatest(-1, -gap_m / 200)) AS frac FROM gaps WHERE gap_s IS NOT NULL) GROUP BY status", _GAPS)
def gap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _gaps(spark, sf_dir).where("gap_s IS NOT NULL").select(formats.gap_status(F.col("gap_s")).alias("status"), formats.window_fraction(F.col("gap_m"), F.col("gap_s"), 200.0).alias("frac"))
    return got.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("frac"), 4).alias("frac"))


@query("SELECT p_partkey, trim(substr(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), 1, 64), '-') || '_' || (floor(p_retailprice / 100 + 0.5) * 100)::BIGINT AS route_key FROM part")
def route_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides.table(spark, sf_dir, "part").select("p_partkey", formats.route_key(F.col("p_name"), F.col("p_retailprice")).alias("route_key"))


_GAP_MS = "(date_diff('microsecond', lag(ts) OVER w, ts) // 1000)"


@query(f"SELECT CASE WHEN g < 1000 THEN '<1 s' WHEN g < 60000 THEN '<1 min' WHEN g < 3600000 THEN '<1 h' ELSE '1 h+' END AS bucket, count(*) AS n, max(g) AS longest_ms FROM (SELECT {_GAP_MS} AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE g >= 0 GROUP BY 1")
def cadence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a user's events by fixed buckets; upper bounds are exclusive."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(F.to_timestamp(c))
    g = rides.table(spark, sf_dir, "events").select(F.floor((us(F.col("ts")) - us(F.lag("ts").over(w))) / 1000).alias("g")).where("g >= 0")
    name = F.when(F.col("g") < 1000, "<1 s").when(F.col("g") < 60_000, "<1 min").when(F.col("g") < 3_600_000, "<1 h").otherwise("1 h+")
    return g.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"), F.max("g").alias("longest_ms"))


@query("SELECT track_id, seq, d_mm, CASE WHEN inside THEN 'enter' ELSE 'exit' END AS edge FROM (SELECT *, d_mm % 600000 < 350000 AS inside, coalesce(lag(d_mm % 600000 < 350000) OVER (PARTITION BY track_id ORDER BY seq), false) AS was FROM points) WHERE inside <> was")
def segment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where rides enter and leave stretches of 350 m every 600 m."""
    w = Window.partitionBy("track_id").orderBy("seq")
    inside = rides.points(spark, sf_dir).withColumn("inside", F.col("d_mm") % 600_000 < 350_000)
    edges = inside.withColumn("was", F.coalesce(F.lag("inside").over(w), F.lit(False))).where("inside <> was")
    return edges.select("track_id", "seq", "d_mm", F.when(F.col("inside"), "enter").otherwise("exit").alias("edge"))


@query("SELECT event_type AS ride_id, date_trunc('second', ts) AS second, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('second', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY ALL")
def tick_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each kind and second."""
    ev = rides.table(spark, sf_dir, "events").select(F.col("event_type").alias("ride_id"), F.col("ts"), "event_id")
    return race.latest_a_second(ev).select("ride_id", "second", "event_id")


@query(
    "SELECT track_id, seq, round(CASE WHEN pt IS NULL THEN d ELSE pd + least(1, greatest(0, 400.0::DOUBLE / 800)) * (d - pd) END, 4) AS shown_m FROM (SELECT track_id, seq, distance_m AS d, lag(distance_m) OVER w AS pd, lag(time_s) OVER w AS pt FROM points WINDOW w AS (PARTITION BY track_id ORDER BY seq))"
)
def marker_glide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a marker is drawn 400 ms after each tick, gliding for 800 ms."""
    p = rides.points(spark, sf_dir).select("track_id", "seq", F.col("t_ms").alias("at"), F.col("distance_m").alias("value"))
    return signals.glided(p, 400, "track_id").select("track_id", "seq", F.round("shown", 4).alias("shown_m"))


@query(
    "SELECT user_id, event_id, event_type, was, coalesce((lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us) // 1000, -1) AS held_ms FROM (SELECT *, epoch_us(ts) AS us, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type"
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose kind differs from the one before, and how long that kind was held (-1: still)."""
    e = rides.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.to_timestamp("ts")).alias("at"), F.col("event_id").alias("seq"))
    held = F.coalesce(F.floor(F.col("held_ms") / 1000), F.lit(-1))
    return signals.changes(e, "event_type", "user_id").select("user_id", "event_id", "event_type", "was", held.alias("held_ms"))


_RECORDED = """
here AS (SELECT track_id, seq, seq % 7 <> 4 AS has, lat, lng, d_mm, time_s FROM points),
kept(track_id, seq, d_mm) AS (SELECT track_id, seq, d_mm FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS rn FROM here WHERE has) WHERE rn = 1
  UNION ALL SELECT track_id, seq, d_mm FROM (SELECT n.*, row_number() OVER (PARTITION BY n.track_id ORDER BY n.seq) AS rn FROM kept k JOIN here n ON n.track_id = k.track_id AND n.has AND n.seq > k.seq AND n.d_mm - k.d_mm >= 20000) WHERE rn = 1),
tail(track_id, seq, d_mm) AS (SELECT track_id, min(seq), arg_min(d_mm, seq) FROM here WHERE has GROUP BY track_id
  UNION ALL SELECT track_id, seq, d_mm FROM (SELECT n.*, row_number() OVER (PARTITION BY n.track_id ORDER BY n.seq) AS rn FROM tail k JOIN here n ON n.track_id = k.track_id AND n.seq > k.seq AND n.d_mm - k.d_mm >= 20000) WHERE rn = 1),
every AS (SELECT track_id, seq FROM kept UNION SELECT track_id, max(seq) FROM here WHERE has GROUP BY track_id),
rec AS (SELECT h.*, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY h.track_id) AS n, t.d_mm AS tail_mm FROM here h JOIN every USING (track_id, seq) JOIN (SELECT track_id, max(d_mm) AS d_mm FROM tail GROUP BY track_id) t ON t.track_id = h.track_id WINDOW w AS (PARTITION BY h.track_id ORDER BY h.seq))
"""


@query("SELECT track_id AS ride_id, k::INT AS seq, round(lat, 9) AS lat, round(lng, 9) AS lng, d_mm / 1000.0::DOUBLE AS distance_m, time_s, tail_mm / 1000.0::DOUBLE AS tail_m FROM rec WHERE n > 1", _RECORDED)
def recorded_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides as the recorder keeps them; some samples have no position."""
    pts = rides.points(spark, sf_dir)
    lost = F.col("seq") % 7 == 4
    return race.recorded_tracks(pts.select(F.col("track_id").alias("ride_id"), "seq", F.when(~lost, F.col("lat")).alias("lat"), F.when(~lost, F.col("lng")).alias("lng"), "distance_m", "time_s", "d_mm")).withColumns({c: F.round(c, 9) for c in ("lat", "lng")})


_SITUATIONS = "sit AS (SELECT event_id, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b, event_id % 5 = 0 AS c, event_id % 7 = 0 AS d, CASE WHEN event_id % 4 = 0 THEN 'TARGET' ELSE 'HISTORY' END AS kind FROM events)"


@query(
    "SELECT event_id, CASE WHEN kind = 'HISTORY' AND NOT a THEN 'INACTIVE' WHEN b AND c THEN 'HOLD' ELSE 'PUBLISH' END AS publication,"
    " CASE WHEN NOT a THEN 'VP' WHEN NOT b THEN 'END_RACE_THEN_VP' WHEN NOT c THEN 'POST_STEP' WHEN d THEN 'POST_WAIT_REPUBLISH' ELSE 'POST_REANCHOR_THEN_STEP' END AS action,"
    " NOT a AND b AS snapshot, b AND d AS refresh_checkpoint FROM sit",
    _SITUATIONS,
)
def race_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = (F.col("event_id") % k == 0 for k in (2, 3, 5, 7))
    kind = F.when(F.col("event_id") % 4 == 0, "TARGET").otherwise("HISTORY")
    duties = rules.inactive_duties(a, b, c, d)
    return rides.table(spark, sf_dir, "events").select("event_id", rules.publication(kind, a, b, c).alias("publication"), rules.without_route(a, b, c, d).alias("action"), duties["snapshot"].alias("snapshot"), duties["refresh_checkpoint"].alias("refresh_checkpoint"))


_SAVED = """
sv AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_id // 3 END AS se, (event_id * 37 % 900)::DOUBLE AS sm, (event_id * 53 % 300)::DOUBLE AS ss, event_id * 7001 % 50000000 AS age,
       event_id % 5 * event_id // 3 AS epoch, (event_id * 41 % 1000)::DOUBLE AS nm, (event_id * 59 % 300)::DOUBLE AS ns, event_id * 17 % 120000 AS deferred FROM events),
sx AS (SELECT *, sm > 300 AND nm > 300 AND abs(nm - sm) <= 300 AS carries FROM sv)
"""


@query(
    "SELECT event_id, CASE WHEN se IS NULL OR age > 21600000 THEN 'FRESH' WHEN se = epoch OR (carries AND ns >= ss - 30) THEN 'ADOPT' WHEN carries AND ns < ss - 30 AND deferred < 60000 THEN 'DEFER' ELSE 'FRESH' END AS decision, nm <= ns * 30 + 300 AS coherent FROM sx",
    _SAVED,
)
def origin_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda x: F.expr(x)
    decision = rules.origin_decision(
        e("CASE WHEN event_id % 9 <> 0 THEN event_id div 3 END"), e("CAST(event_id * 37 % 900 AS DOUBLE)"), e("CAST(event_id * 53 % 300 AS DOUBLE)"), e("event_id * 7001 % 50000000"),
        e("event_id % 5 * event_id div 3"), e("CAST(event_id * 41 % 1000 AS DOUBLE)"), e("CAST(event_id * 59 % 300 AS DOUBLE)"), e("event_id * 17 % 120000"), 21_600_000,
    )
    fine = rules.coherent(e("CAST(event_id * 41 % 1000 AS DOUBLE)"), e("CAST(event_id * 59 % 300 AS DOUBLE)"))
    return rides.table(spark, sf_dir, "events").select("event_id", decision.alias("decision"), fine.alias("coherent"))


_PROFILES = "pr AS (SELECT 'p' || c_custkey AS profile_id, c_name AS profile_name, c_custkey % 3 = 0 AS use_global, c_acctbal / 100 AS target_speed_ms, c_custkey % 2 = 0 AS enabled, c_custkey % 5 = 0 AS race_enabled, CASE WHEN c_custkey % 4 = 0 THEN 'BEST' ELSE 'LAST' END AS ghost_pick FROM customer WHERE c_custkey % 7 <> 0)"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return rides.table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(
        F.concat(F.lit("p"), k).alias("profile_id"), F.col("c_name").alias("profile_name"), (k % 3 == 0).alias("use_global"), (F.col("c_acctbal") / 100).alias("target_speed_ms"), (k % 2 == 0).alias("enabled"), (k % 5 == 0).alias("race_enabled"), F.when(k % 4 == 0, "BEST").otherwise("LAST").alias("ghost_pick")
    )


@query(
    "SELECT o_orderkey, pid AS profile_id, CASE WHEN g THEN true ELSE enabled END AS active, round(CASE WHEN g THEN 6.0 WHEN target_speed_ms > 0 AND target_speed_ms <= 30 THEN target_speed_ms ELSE 20 / 3.6::DOUBLE END, 6) AS target_speed_ms, coalesce(profile_name, '') AS profile_name,"
    " CASE WHEN g THEN true ELSE race_enabled END AS race_enabled, CASE WHEN g THEN 'AVERAGE' ELSE ghost_pick END AS ghost_pick FROM ("
    "SELECT o_orderkey, 'p' || o_custkey AS pid, pr.*, pr.profile_id IS NULL OR use_global AS g FROM orders LEFT JOIN pr ON pr.profile_id = 'p' || o_custkey)",
    _PROFILES,
)
def profile_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = rides.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("p"), F.col("o_custkey")).alias("profile_id"))
    got = rules.resolved(asked, _profiles(spark, sf_dir), {"master": True, "target_speed_ms": 6.0, "race_enabled": True, "ghost_pick": "AVERAGE"})
    return got.withColumn("target_speed_ms", F.round("target_speed_ms", 6))


@query(
    "SELECT profile_id, profile_name FROM (SELECT profile_id, CASE WHEN substr(profile_id, 2)::INT % 10 = 1 THEN 'new ' || profile_id ELSE profile_name END AS profile_name FROM pr WHERE substr(profile_id, 2)::INT % 10 <> 2)"
    " UNION ALL SELECT 'q' || substr(profile_id, 2), profile_name FROM pr WHERE substr(profile_id, 2)::INT % 10 = 2",
    _PROFILES,
)
def profile_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth profile renamed, every other tenth replaced by a new id of its name."""
    settings = _profiles(spark, sf_dir)
    k = F.substring("profile_id", 2, 20).cast("int")
    renamed = settings.where(k % 10 == 1).select("profile_id", F.concat(F.lit("new "), F.col("profile_id")).alias("profile_name"))
    replaced = settings.where(k % 10 == 2).select(F.concat(F.lit("q"), k).alias("profile_id"), "profile_name")
    return rules.learned(settings, renamed.unionByName(replaced)).select("profile_id", "profile_name")


def _tracking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    steps = samples.deltas(rides.points(spark, sf_dir))
    ticks = steps.select(F.col("track_id").alias("ride_id"), "seq", (F.col("track_id") % 6).alias("route_id"), "lat", "lng", "heading", F.col("distance_m").alias("odo_m"), (F.col("dd_m") > 0.5 * F.col("dt_s")).alias("moving"), (F.col("seq") % 9 != 4).alias("fresh"))
    return ticks, joins.segments(routes.routes(spark))


#: A ride's place tick by tick: the near segments that run its way, and which of them follows from the last place.
_TRACKED = f"""
tkt AS (SELECT track_id AS ride_id, seq, track_id || ':' || seq AS id, distance_m AS odo, dd_m > 0.5 * dt_s AS moving, seq % 9 <> 4 AS fresh FROM steps),
nr AS (SELECT id, list({{'along': along_m, 'lo': lo_m, 'hi': hi_m}} ORDER BY perp_m, i) AS near FROM feet WHERE perp_m <= 40 AND {_sql.turn('seg_heading', 'heading')} <= 45 GROUP BY id),
al AS (SELECT id, near, list_sort(list_transform(near, lambda s: s.along)) AS a FROM nr),
gp AS (SELECT id, near, list_append(list_transform(range(1, len(a)), lambda k: a[k + 1] - a[k]), a[1] + total_m - a[-1]) AS gaps, total_m FROM al JOIN tkt USING (id) JOIN totals ON route_id = ride_id % 6),
tt AS (SELECT t.*, near, coalesce(len(list_filter(gaps, lambda g: g > 75)) < 2 AND total_m - list_max(gaps) <= 200, false) AS one FROM tkt t LEFT JOIN gp USING (id)),
tr(ride_id, seq, place, odo_then, lost) AS (
  SELECT DISTINCT ride_id, 1::BIGINT, NULL::DOUBLE, NULL::DOUBLE, 0 FROM tkt
  UNION ALL
  SELECT ride_id, seq, coalesce(hit.along, place), CASE WHEN hit IS NOT NULL THEN odo ELSE odo_then END, CASE WHEN hit IS NOT NULL THEN 0 ELSE lost END
  FROM (SELECT *, coalesce(hit1, CASE WHEN miss AND lost = 5 AND one THEN near[1] END) AS hit FROM (
    SELECT * EXCLUDE (lost), CASE WHEN miss THEN least(lost + 1, 5) ELSE lost END AS lost FROM (
      SELECT *, fresh AND hit1 IS NULL AND place IS NOT NULL AND moving AS miss FROM (
        SELECT t.*, r.place, r.odo_then, r.lost, CASE WHEN NOT t.fresh THEN NULL WHEN r.place IS NULL THEN near[1] ELSE list_filter(near, lambda s: s.hi >= r.place - 120 AND s.lo <= r.place + 300 + least(greatest(t.odo - r.odo_then, 0), 400))[1] END AS hit1
        FROM tr r JOIN tt t ON t.ride_id = r.ride_id AND t.seq = r.seq + 1)))))
"""


@query("SELECT ride_id, seq, round(place, 2) AS place_m, lost < 5 AS reliable FROM tr WHERE seq > 1", _sql.STEPS, routes.VERTICES, routes.FEET, _TRACKED)
def route_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where along its road's route each ride is, tick by tick; every ninth position is stale."""
    return tracking.tracked(*_tracking(spark, sf_dir)).withColumn("place_m", F.round("place_m", 2))


_MARKED = """
mk AS (SELECT ride_id, tr.seq, place, lost < 5 AS reliable, total_m, distance_m AS odo, CASE WHEN place IS NOT NULL THEN greatest(0, place / 5 - 20) * 5 END AS ghost FROM tr JOIN steps ON track_id = ride_id AND steps.seq = tr.seq JOIN totals ON route_id = ride_id % 6),
mf AS (SELECT *, bool_or(coalesce(total_m > 100 AND total_m - place <= 50 AND odo >= greatest(total_m - 3000, total_m * 0.5), false)) OVER w AS finished FROM mk WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
mm AS (SELECT *, bool_or(coalesce(finished AND place < total_m * 0.5, false)) OVER w AS again, last_value(CASE WHEN reliable THEN ghost END IGNORE NULLS) OVER w AS held FROM mf WINDOW w AS (PARTITION BY ride_id ORDER BY seq))
"""


@query("SELECT ride_id, seq, round(CASE WHEN again THEN NULL WHEN reliable THEN ghost ELSE held END, 2) AS marker_m FROM mm", _sql.STEPS, routes.VERTICES, routes.FEET, _TRACKED, _MARKED)
def ghost_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker of a ghost that rides the route at 5 m/s, 20 s behind the rider."""
    ticks, segs = _tracking(spark, sf_dir)
    at = tracking.tracked(ticks, segs).join(ticks.select("ride_id", "seq", "route_id", "odo_m"), ["ride_id", "seq"]).withColumn("lead_s", F.lit(20.0))
    ends = segs.groupBy("route_id").agg(F.max("hi_m").alias("total_m"))
    curve = ends.select("route_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("distance_m"), F.lit(0.0).alias("time_s")), F.struct(F.lit(1).alias("k"), F.col("total_m").alias("distance_m"), (F.col("total_m") / 5.0).alias("time_s")))).alias("c")).select("route_id", "c.*")
    return tracking.markers(at, curve).withColumn("marker_m", F.round("marker_m", 2))
