"""Pieces of comparing SQL: geodesy and the samples of a ride."""

from __future__ import annotations

from paceline.sources.rides import SQL as RIDES


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(sin(radians(({c}) - ({a})) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians(({d}) - ({b})) / 2) ** 2)"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    dl = f"radians(({d}) - ({b}))"
    y = f"sin({dl}) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({dl})"
    return pmod(f"degrees(atan2({y}, {x})) + 360")


def pmod(x: str, m: str = "360.0::DOUBLE") -> str:
    return f"((({x}) % {m} + {m}) % {m})"


def turn(a: str, b: str) -> str:
    d = pmod(f"abs(({a}) - ({b}))")
    return f"(CASE WHEN {d} > 180 THEN 360 - {d} ELSE {d} END)"


def row(lat: str) -> str:
    return f"floor(({lat}) / (18.0::DOUBLE / 111320.0::DOUBLE))::INT"


def col(lng: str, row_: str) -> str:
    return f"floor(({lng}) / (18.0::DOUBLE / greatest(1.0::DOUBLE, 111320.0::DOUBLE * cos(radians((({row_}) + 0.5::DOUBLE) * (18.0::DOUBLE / 111320.0::DOUBLE))))))::INT"


#: steps(track_id, seq, a_*, *, dd_m, dt_s, chord_m, heading), samples, cells.
STEPS = f"""
s0 AS (SELECT *, lag(lat) OVER w AS a_lat, lag(lng) OVER w AS a_lng, lag(distance_m) OVER w AS a_distance_m, lag(time_s) OVER w AS a_time_s FROM points WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
steps AS (SELECT *, distance_m - a_distance_m AS dd_m, time_s - a_time_s AS dt_s, {hav('a_lat', 'a_lng', 'lat', 'lng')} AS chord_m,
          {bearing('a_lat', 'a_lng', 'lat', 'lng')} AS heading FROM s0 WHERE a_lat IS NOT NULL),
paced AS (SELECT *, CASE WHEN dd_m / dt_s < 0.5 THEN 2.0::DOUBLE ELSE dt_s / dd_m END AS tpm FROM steps WHERE dd_m > 0 AND dt_s > 0 AND dd_m / dt_s <= 30 AND chord_m <= 200),
dense AS (SELECT *, CASE WHEN dd_m > chord_m * 1.5 THEN 1 ELSE greatest(1, ceil(chord_m / 12.0)) END::INT AS n FROM paced),
samples AS (SELECT track_id, seq, sub, a_lat + sub::DOUBLE / n * (lat - a_lat) AS lat, a_lng + sub::DOUBLE / n * (lng - a_lng) AS lng, heading, tpm
            FROM (SELECT *, unnest(range(1, n + 1)) AS sub FROM dense)),
keyed AS (SELECT *, {row('lat')} AS ci, {col('lng', row('lat'))} AS cj,
          least(7, floor({pmod('heading')} / 45.0))::INT AS bin FROM samples),
cells AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY track_id, ci, cj, bin ORDER BY seq, sub) = 1)
"""
#: laps: cells with the order of their ride; ema by recurrence; road: the model.
ROAD = f"""
laps AS (SELECT c.*, row_number() OVER (PARTITION BY ci, cj, bin ORDER BY started_ms, c.track_id) AS o, count(*) OVER (PARTITION BY ci, cj, bin) AS n FROM cells c JOIN tracks USING (track_id)),
ema AS (SELECT ci, cj, bin, o, n, tpm AS e FROM laps WHERE o = 1
        UNION ALL SELECT l.ci, l.cj, l.bin, l.o, l.n, CASE WHEN m.o < 4 THEN (m.e * m.o + l.tpm) / (m.o + 1) ELSE 0.25::DOUBLE * l.tpm + 0.75::DOUBLE * m.e END
        FROM ema m JOIN laps l ON l.ci = m.ci AND l.cj = m.cj AND l.bin = m.bin AND l.o = m.o + 1),
road AS (SELECT g.*, ema.e AS ema FROM (
           SELECT ci, cj, bin, min(tpm) AS min, arg_max(tpm, o) AS last, count(*) AS count,
                  {pmod('degrees(atan2(sum(sin(radians(heading))), sum(cos(radians(heading))))) + 360')} AS mean_heading
           FROM laps GROUP BY ci, cj, bin) g
         JOIN ema ON g.ci = ema.ci AND g.cj = ema.cj AND g.bin = ema.bin AND ema.o = ema.n)
"""
PICKS = {
    "BEST": "greatest(min, ema / 2)",
    "LAST": "last",
    "AVERAGE": "CASE WHEN count >= 2 THEN ema ELSE last END",
}
GRADED = """
w0 AS (SELECT p.*, s.dd_m, s.dt_s, round(p.distance_m * 1000)::BIGINT AS mm,
       sum(CASE WHEN s.dd_m > 200 OR (s.dt_s > 0 AND s.dd_m / s.dt_s > 30) THEN 1 ELSE 0 END) OVER (PARTITION BY p.track_id ORDER BY p.seq) AS run
       FROM points p LEFT JOIN steps s USING (track_id, seq)),
w1 AS (SELECT a.track_id, a.seq, a.run, a.dd_m, a.dt_s, a.ele_m, a.distance_m, max(b.seq) AS bseq
       FROM w0 a LEFT JOIN w0 b ON b.track_id = a.track_id AND b.run = a.run AND b.mm <= a.mm - 100000 WHERE a.dd_m IS NOT NULL GROUP BY ALL),
windowed AS (SELECT w1.track_id, w1.seq, w1.dd_m, w1.dt_s, (w1.ele_m - p.ele_m) / (w1.distance_m - p.distance_m) * 100 AS grade_pct
             FROM w1 LEFT JOIN points p ON p.track_id = w1.track_id AND p.seq = w1.bseq),
graded AS (SELECT * FROM windowed WHERE dd_m > 0 AND dd_m <= 200 AND dt_s > 0 AND dd_m / dt_s <= 30 AND dd_m / dt_s >= 0.5 AND abs(grade_pct) <= 20)
"""
FOOT = f"""
centre AS (SELECT track_id, median(lat) AS c_lat, median(lng) AS c_lng FROM points GROUP BY track_id),
foot AS (SELECT track_id, quantile_disc({hav('c_lat', 'c_lng', 'lat', 'lng')}, 0.95) AS footprint_m FROM points JOIN centre USING (track_id) GROUP BY track_id)
"""
GATES = f"""
t0 AS (SELECT *, NOT (dd_m > 0 AND dd_m <= 200 AND dt_s > 0 AND dd_m <= 30 * dt_s) AS fault FROM steps),
t1 AS (SELECT *, sum(fault::INT) OVER (PARTITION BY track_id ORDER BY seq) AS run FROM t0),
t2 AS (SELECT track_id, {turn('lag(heading) OVER w', 'heading')} / ((lag(chord_m) OVER w + chord_m) / 2) AS rate FROM t1 WHERE NOT fault AND chord_m >= 5 WINDOW w AS (PARTITION BY track_id, run ORDER BY seq)),
t3 AS (SELECT track_id, count(rate) AS n_pairs, median(rate) AS turn_rate FROM t2 WHERE rate IS NOT NULL GROUP BY track_id),
t4 AS (SELECT track_id, count(*) AS n_grades, median(abs(grade_pct)) AS grade FROM graded GROUP BY track_id),
drift AS (SELECT track_id, coalesce(n_pairs, 0) AS n_pairs, turn_rate, footprint_m,
          coalesce(coalesce(n_pairs, 0) >= 20 AND turn_rate > degrees(1 / 40.0::DOUBLE) AND footprint_m < 1000 AND (coalesce(n_grades, 0) < 20 OR grade < 2), false) AS drift
          FROM foot LEFT JOIN t3 USING (track_id) LEFT JOIN t4 USING (track_id)),
motor AS (SELECT *, fast_s >= 45 AND fast_s >= 0.05 * moving_s AND uphill_s >= 30 AS motorised FROM (
          SELECT track_id, sum(dt_s) AS moving_s, coalesce(sum(dt_s) FILTER (dd_m / dt_s > 15 AND grade_pct >= -1), 0) AS fast_s,
                 coalesce(sum(dt_s) FILTER (dd_m / dt_s > 15 AND grade_pct >= 2), 0) AS uphill_s
          FROM windowed WHERE dd_m > 0 AND dd_m <= 200 AND dt_s > 0 AND dd_m / dt_s >= 0.5 GROUP BY track_id))
"""
FOLDS = """
folds AS (SELECT track_id, floor(least(20, greatest(-20, grade_pct)) + 0.5)::INT AS bin, sum(dt_s) AS sum_dt, sum(dd_m) AS sum_dd FROM graded
          WHERE track_id NOT IN (SELECT track_id FROM drift WHERE drift) AND track_id NOT IN (SELECT track_id FROM motor WHERE motorised) GROUP BY 1, 2),
grades AS (SELECT bin, mean, coalesce(q_min, mean) AS min, coalesce(q_last, mean) AS last, metres, count FROM (
           SELECT bin, sum(sum_dt) / sum(sum_dd) AS mean, min(sum_dt / sum_dd) FILTER (sum_dd >= 400) AS q_min,
                  arg_max(sum_dt / sum_dd, (started_ms, track_id)) FILTER (sum_dd >= 400) AS q_last, sum(sum_dd) AS metres, count(*) AS count
           FROM folds JOIN tracks USING (track_id) GROUP BY bin))
"""
#: Of rides (track_id, start_ms, end_ms, metres): overlapping pairs, and the greedy pick of the longest.
PAIRS = "op AS (SELECT a.track_id AS a, b.track_id AS b, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms, least(a.end_ms - a.start_ms, b.end_ms - b.start_ms) AS shorter FROM rides a JOIN rides b ON a.track_id < b.track_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms WHERE a.end_ms > a.start_ms AND b.end_ms > b.start_ms)"
GREEDY = """
ordered AS (SELECT *, row_number() OVER (ORDER BY metres DESC, track_id) AS o FROM rides),
pick(o, taken) AS (SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL SELECT p.o + 1, CASE WHEN EXISTS (SELECT 1 FROM op WHERE overlap_ms > 0.5 * shorter AND ((op.a = r.track_id AND list_contains(p.taken, op.b)) OR (op.b = r.track_id AND list_contains(p.taken, op.a)))) THEN p.taken ELSE list_append(p.taken, r.track_id) END
  FROM pick p JOIN ordered r ON r.o = p.o + 1)
"""


def query(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join([RIDES, *parts]) + " " + select
