"""Queries about the track library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions import formats, geo
from paceline.operators import delta, library
from paceline.plans import _sql
from paceline.plans.pace import rounded
from paceline.sources import rides
from paceline.sources.rides import checkpointed

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None, *parts: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _sql.query(sql, *parts)
        return f

    return put


#: The library as several sources saw it: each ride, and every fifth once more by the device.
COPIES = """
copies AS (SELECT track_id, 'RECORDED' AS source, started_ms, length_mm / 1000.0::DOUBLE AS length_m FROM tracks
           UNION ALL SELECT track_id + 1000000, 'FITFILES_SCAN', started_ms + 2000 * (track_id % 7), length_mm / 1000.0::DOUBLE + track_id % 3 FROM tracks WHERE track_id % 5 = 0),
keys AS (SELECT *, (started_ms // 60000) || ':' || trunc(length_m / 10)::BIGINT AS source_key FROM copies)
"""


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rides.tracks_of(rides.points(spark, sf_dir))
    own = t.select("track_id", F.lit("RECORDED").alias("source"), "started_ms", (F.col("length_mm") / 1000.0).alias("length_m"))
    again = t.where("track_id % 5 = 0").select(
        F.expr("track_id + 1000000").alias("track_id"), F.lit("FITFILES_SCAN").alias("source"), F.expr("started_ms + 2000 * (track_id % 7)").alias("started_ms"), F.expr("length_mm / 1000.0D + track_id % 3").alias("length_m")
    )
    return own.unionByName(again)


@query("SELECT track_id, source, source_key FROM keys", COPIES)
def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).select("track_id", "source", formats.source_key(F.col("started_ms"), F.col("length_m")).alias("source_key"))


@query("SELECT track_id, source, source_key FROM keys WHERE source_key NOT IN (SELECT source_key FROM keys WHERE track_id % 9 = 4) QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY track_id) = 1", COPIES)
def source_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = _copies(spark, sf_dir)
    known = tracks.where("track_id % 9 = 4").select(formats.source_key(F.col("started_ms"), F.col("length_m")).alias("source_key"))
    return library.first_by_source_key(tracks, known).select("track_id", "source", "source_key")




def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = rides.tracks_of(rides.points(spark, sf_dir))
    files = t.select(F.concat("track_id", F.lit(".fit")).alias("path"), (F.col("n_points") * 40).alias("size"), F.col("started_ms").alias("mtime"))
    ledger = t.where("track_id % 2 = 0").select(F.concat("track_id", F.lit(".fit")).alias("path"), F.expr("n_points * 40 + CAST(n_points % 3 = 0 AS INT)").alias("size"), F.col("started_ms").alias("mtime"))
    return files, ledger


@query("SELECT track_id || '.fit' AS path, n_points * 40 AS size, started_ms AS mtime FROM tracks WHERE track_id % 2 = 1 OR n_points % 3 = 0")
def ledger_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, ledger = _files(spark, sf_dir)
    return library.unprocessed(files, ledger).select("path", "size", "mtime")


@query("SELECT track_id || '.fit' AS path, (n_points * 40)::BIGINT AS size, started_ms AS mtime FROM tracks")
def ledger_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, ledger = _files(spark, sf_dir)
    return library.marked(ledger, files)


_CELLS = """
g0 AS (SELECT track_id, seq, floor((lat + 90) / 180 * 32768)::BIGINT AS r, floor((lng + 180) / 360 * 32768)::BIGINT AS c FROM points),
g1 AS (SELECT *, coalesce(lag(r) OVER w, r) AS pr, coalesce(lag(c) OVER w, c) AS pc FROM g0 WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
cells6 AS (SELECT DISTINCT track_id, row, col FROM g1, LATERAL (SELECT unnest(range(least(r, pr), greatest(r, pr) + 1)) AS row) x, LATERAL (SELECT unnest(range(least(c, pc), greatest(c, pc) + 1)) AS col) y)
"""
_BOX = (41.001, 41.002, 0.010, 0.034)
_IN_BOX = f"row BETWEEN floor(({_BOX[0]} + 90) / 180 * 32768) AND floor(({_BOX[1]} + 90) / 180 * 32768) AND col BETWEEN floor(({_BOX[2]} + 180) / 360 * 32768) AND floor(({_BOX[3]} + 180) / 360 * 32768)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.path_cells(rides.points(spark, sf_dir))


def _geohash_sql(row: str, col: str, precision: int) -> str:
    letters = []
    n = 5 * precision
    n_lat = n // 2
    for letter in range(precision):
        bits = []
        for bit in range(5):
            k = 5 * letter + bit
            src, at = (col, n - n_lat - 1 - k // 2) if k % 2 == 0 else (row, n_lat - 1 - k // 2)
            bits.append(f"(({src} >> {at}) & 1) * {1 << (4 - bit)}")
        letters.append(f"substr('{geo.GEOHASH_ALPHABET}', ({' + '.join(bits)} + 1)::INT, 1)")
    return " || ".join(letters)


@query(f"SELECT track_id, {_geohash_sql('row', 'col', 6)} AS cell FROM cells6", _CELLS)
def track_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("track_id", geo.geohash_of(F.col("row"), F.col("col"), 6).alias("cell"))


@query(f"SELECT track_id, count(*) AS shared FROM cells6 WHERE {_IN_BOX} GROUP BY track_id ORDER BY shared DESC, track_id LIMIT 250", _CELLS)
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.ranked_candidates(_cells(spark, sf_dir), _BOX)


@query(f"SELECT DISTINCT track_id FROM cells6 WHERE {_IN_BOX}", _CELLS)
def candidate_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.candidates(_cells(spark, sf_dir), _BOX)


@query("SELECT track_id FROM tracks WHERE track_id % 10 = 7")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = rides.points(spark, sf_dir)
    return library.orphans(rides.tracks_of(pts).select("track_id"), library.path_cells(pts.where("track_id % 10 <> 7")))


@query(
    "SELECT road, a AS n_seeded, b AS n_now, CASE WHEN gone + new = 0 THEN false WHEN a < 5 THEN true ELSE gone + new >= greatest(5, floor(a * 0.2)) END AS due FROM ("
    "SELECT track_id % 6 AS road, count(*) FILTER (track_id % 7 <> 1) AS a, count(*) FILTER (track_id % 8 <> 2) AS b, count(*) FILTER (track_id % 7 <> 1 AND track_id % 8 = 2) AS gone, count(*) FILTER (track_id % 7 = 1 AND track_id % 8 <> 2) AS new FROM tracks GROUP BY 1)"
)
def reseed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rides.tracks_of(rides.points(spark, sf_dir)).groupBy((F.col("track_id") % 6).alias("road"))
    ids = t.agg(F.collect_list(F.when(F.expr("track_id % 7 <> 1"), F.col("track_id"))).alias("seeded"), F.collect_list(F.when(F.expr("track_id % 8 <> 2"), F.col("track_id"))).alias("now"))
    return ids.select("road", F.size("seeded").cast("bigint").alias("n_seeded"), F.size("now").cast("bigint").alias("n_now"), library.should_reseed(F.col("seeded"), F.col("now")).alias("due"))


_ENRICH = """
scan AS (SELECT track_id, seq, distance_m + (seq % 3) AS distance_m, ele_m FROM points),
have AS (SELECT track_id, distance_m AS d0, ele_m AS e0, lead(distance_m) OVER w AS d1, lead(ele_m) OVER w AS e1 FROM scan WHERE ele_m IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY distance_m)),
rec AS (SELECT track_id, seq, distance_m, CASE WHEN seq % 4 = 0 THEN ele_m END AS ele_m FROM points),
fit AS (SELECT r.track_id, r.seq, h.d0, h.e0 + (r.distance_m - d0) / (d1 - d0) * (e1 - e0) AS e, d1 FROM rec r ASOF JOIN have h ON r.track_id = h.track_id AND r.distance_m > h.d0
        WHERE r.ele_m IS NULL AND d1 > d0 AND d1 - d0 <= 200 AND r.distance_m <= d1)
"""


@query("SELECT r.track_id, r.seq, round(coalesce(r.ele_m, fit.e), 3) AS ele_m FROM rec r LEFT JOIN fit USING (track_id, seq)", _ENRICH)
def altitude_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides without most heights, filled from a device scan a few metres off."""
    pts = rides.points(spark, sf_dir)
    scan = pts.select("track_id", "seq", (F.col("distance_m") + F.col("seq") % 3).alias("distance_m"), "ele_m")
    bare = pts.select("track_id", "seq", "distance_m", F.when(F.col("seq") % 4 == 0, F.col("ele_m")).alias("ele_m"))
    return rounded(library.enriched(bare, scan).select("track_id", "seq", "ele_m"), ele_m=3)


#: Twin rides: each ride, and a copy of every fourth, 2 m north and a little longer.
TWINS = f"""
tp AS (SELECT track_id, seq, lat, lng, distance_m FROM points UNION ALL SELECT track_id + 1000000, seq, lat + 2 / 111320.0::DOUBLE, lng, distance_m * 1.001::DOUBLE FROM points WHERE track_id % 4 = 0),
h0 AS (SELECT track_id, seq, floor((lat + 90) / 180 * 1048576)::BIGINT AS r, floor((lng + 180) / 360 * 1048576)::BIGINT AS c FROM tp),
h1 AS (SELECT *, coalesce(lag(r) OVER w, r) AS pr, coalesce(lag(c) OVER w, c) AS pc FROM h0 WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
fine AS (SELECT DISTINCT track_id, row, col FROM h1, LATERAL (SELECT unnest(range(least(r, pr), greatest(r, pr) + 1)) AS row) x, LATERAL (SELECT unnest(range(least(c, pc), greatest(c, pc) + 1)) AS col) y),
wide AS (SELECT DISTINCT track_id, row + i AS row, col + j AS col FROM fine, (VALUES (-1), (0), (1)) AS a(i), (VALUES (-1), (0), (1)) AS b(j)),
share AS (SELECT f.track_id AS a, w.track_id AS b FROM fine f JOIN wide w USING (row, col) JOIN (SELECT track_id, count(*) AS n FROM fine GROUP BY 1) n ON n.track_id = f.track_id
          WHERE f.track_id <> w.track_id GROUP BY f.track_id, w.track_id, n.n HAVING count(*) >= 0.9 * n.n),
tot AS (SELECT track_id, max(distance_m) AS len FROM tp GROUP BY 1),
marks AS (SELECT tp.track_id, any_value(len) AS len, {', '.join(f'arg_min(lat, seq) FILTER (distance_m >= len * {q}) AS lat{k}, arg_min(lng, seq) FILTER (distance_m >= len * {q}) AS lng{k}' for k, q in ((1, '0.25::DOUBLE'), (2, '0.5::DOUBLE'), (3, '0.75::DOUBLE')))} FROM tp JOIN tot USING (track_id) GROUP BY 1),
pairs AS (SELECT s.a, s.b FROM share s JOIN share t ON s.a = t.b AND s.b = t.a JOIN marks x ON x.track_id = s.a JOIN marks y ON y.track_id = s.b
          WHERE s.a < s.b AND abs(x.len - y.len) <= 0.1 * greatest(x.len, y.len)
          {' '.join(f'AND sqrt(((y.lng{k} - x.lng{k}) * cos(radians((x.lat{k} + y.lat{k}) / 2)) * 111320) ** 2 + ((y.lat{k} - x.lat{k}) * 111320) ** 2) <= 250' for k in (1, 2, 3))}),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) p ON r.b = p.a),
grp AS (SELECT a AS track_id, least(a, min(b)) AS grp FROM reach GROUP BY a)
"""


def _twin_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = rides.points(spark, sf_dir).select("track_id", "seq", "lat", "lng", "distance_m")
    copy = pts.where("track_id % 4 = 0").select(F.expr("track_id + 1000000").alias("track_id"), "seq", (F.col("lat") + 2 / 111_320.0).alias("lat"), "lng", (F.col("distance_m") * 1.001).alias("distance_m"))
    return pts.unionByName(copy)


@query("SELECT a, b FROM pairs", TWINS)
def twin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.twins(_twin_points(spark, sf_dir))


@query("SELECT track_id, grp FROM grp", TWINS)
def twin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.groups(library.twin_links(_twin_points(spark, sf_dir))).withColumnRenamed("group", "grp")


#: Twins as live recordings and device scans; a third of the scans start too late to be the same ride.
_FACTS = """
facts AS (SELECT g.track_id, grp, CASE WHEN g.track_id >= 1000000 THEN 'FITFILES_SCAN' ELSE 'RECORDED' END AS source, len AS length_m, time_ms / 1000.0::DOUBLE AS time_s,
          started_ms + CASE WHEN g.track_id < 1000000 THEN 0 WHEN t.track_id % 3 = 0 THEN 1200000 ELSE 2000 * (t.track_id % 7) END AS started_ms
          FROM grp g JOIN tot ON tot.track_id = g.track_id JOIN tracks t ON t.track_id = g.track_id % 1000000),
same AS (SELECT a.track_id AS a, b.track_id AS b, abs(a.started_ms - b.started_ms) AS apart FROM facts a JOIN facts b USING (grp)
         WHERE a.source = 'RECORDED' AND b.source = 'FITFILES_SCAN' AND abs(a.started_ms - b.started_ms) <= 600000 AND abs(a.length_m - b.length_m) <= greatest(100, 0.01 * greatest(a.length_m, b.length_m))),
bare AS (SELECT DISTINCT a, b FROM same JOIN fine f ON f.track_id = b LEFT JOIN wide w ON w.track_id = a AND w.row = f.row AND w.col = f.col WHERE w.track_id IS NULL),
rec AS (SELECT track_id, row_number() OVER (ORDER BY track_id) AS o FROM facts WHERE source = 'RECORDED'),
claims(o, taken) AS (SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL SELECT o, CASE WHEN want IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bare WHERE a = track_id AND b = want) THEN list_append(taken, want) ELSE taken END
  FROM (SELECT r.o, r.track_id, c.taken, (SELECT arg_min(b, (apart, b)) FROM same s WHERE s.a = r.track_id AND NOT list_contains(c.taken, s.b)) AS want FROM claims c JOIN rec r ON r.o = c.o + 1)),
twice AS (SELECT unnest(taken) AS track_id FROM (SELECT taken FROM claims ORDER BY o DESC LIMIT 1))
"""
_PLAUSIBLE = "time_s > 0 AND length_m / time_s * 3.6 >= 0.5 AND length_m / time_s * 3.6 <= 80"
_TIDY = f"""
ranked AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY grp ORDER BY started_ms DESC, track_id) AS newest, {_PLAUSIBLE} AS ok,
           row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN {_PLAUSIBLE} THEN 0 ELSE 1 END, time_s, track_id) AS fastest FROM facts WHERE track_id NOT IN (SELECT track_id FROM twice) WINDOW w AS (PARTITION BY grp)),
stay AS (SELECT *, n <= 3 OR newest <= 2 OR (fastest = 1 AND ok) AS stays FROM ranked),
ground AS (SELECT DISTINCT grp, row, col FROM wide JOIN stay USING (track_id) WHERE stays),
beyond AS (SELECT DISTINCT s.track_id FROM stay s JOIN fine f USING (track_id) LEFT JOIN ground g ON g.grp = s.grp AND g.row = f.row AND g.col = f.col WHERE NOT stays AND g.grp IS NULL)
"""


def _facts(spark: SparkSession, sf_dir: str, pts: DataFrame) -> DataFrame:
    own = rides.tracks_of(rides.points(spark, sf_dir)).select(F.col("track_id").alias("own"), "started_ms", (F.col("time_ms") / 1000.0).alias("time_s"))
    length = pts.groupBy("track_id").agg(F.max("distance_m").alias("length_m")).withColumn("own", F.expr("track_id % 1000000"))
    scan = F.col("track_id") >= 1_000_000
    late = F.when(~scan, 0).otherwise(F.expr("CASE WHEN own % 3 = 0 THEN 1200000 ELSE 2000 * (own % 7) END"))
    return length.join(own, "own").select("track_id", F.when(scan, "FITFILES_SCAN").otherwise("RECORDED").alias("source"), (F.col("started_ms") + late).alias("started_ms"), "length_m", "time_s")


@query("SELECT track_id, grp, track_id NOT IN (SELECT track_id FROM twice) AND coalesce(stays OR track_id IN (SELECT track_id FROM beyond), false) AS keep FROM facts LEFT JOIN (SELECT track_id, stays FROM stay) USING (track_id)", TWINS, _FACTS, _TIDY)
def tidy_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _twin_points(spark, sf_dir)
    return library.kept_of_groups(pts, _facts(spark, sf_dir, pts), checkpointed(library.twin_links(pts))).withColumnRenamed("group", "grp")


@query("SELECT track_id FROM twice", TWINS, _FACTS)
def same_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device scans of rides that were recorded live as well."""
    pts = _twin_points(spark, sf_dir)
    return library.same_ride_losers(pts, _facts(spark, sf_dir, pts), checkpointed(library.twin_links(pts)))


def _changed(pts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that came last, and ids that go; the rest was there before."""
    ids = pts.select("track_id").distinct()
    return ids.where("track_id % 3 = 1"), ids.where("track_id % 11 = 5")


def _reader(pts: DataFrame):
    return lambda asked: pts.join(asked, "track_id", "left_semi")


@query("SELECT track_id, row, col FROM cells6 WHERE track_id % 11 <> 5", _CELLS)
def index_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lost some rides, holds others that are gone and old cells of changed ones, put right."""
    pts = rides.points(spark, sf_dir)
    changed, removed = _changed(pts)
    stale = library.path_cells(pts.where("track_id % 3 <> 1 AND track_id % 10 <> 7")).unionByName(library.path_cells(pts.where("track_id % 6 = 1 AND seq <= 5")))
    tracks = pts.select("track_id").distinct().join(removed, "track_id", "left_anti")
    return delta.index_after(stale, tracks, changed, _reader(pts))


def _delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """points of before and of now, the index, ids that came and that went."""
    pts = _twin_points(spark, sf_dir)
    changed, removed = _changed(pts)
    now = pts.where("track_id % 11 <> 5")
    changed = changed.join(removed, "track_id", "left_anti")
    return pts.where("track_id % 3 <> 1"), now, checkpointed(library.path_cells(now)), checkpointed(changed), checkpointed(removed)


@query("SELECT a, b FROM pairs WHERE a % 11 <> 5 AND b % 11 <> 5", TWINS)
def delta_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twin pairs after a third of the rides came and some went, from those of before."""
    before, now, index, changed, removed = _delta(spark, sf_dir)
    return delta.twins_after(library.twins(before), now, index, changed, removed)


#: The same verdicts over the rides that are left.
_LEFT = TWINS.replace("FROM points WHERE track_id % 4 = 0)", "FROM points WHERE track_id % 4 = 0),\ntp AS (SELECT * FROM tp0 WHERE track_id % 11 <> 5)").replace("tp AS (SELECT track_id, seq, lat", "tp0 AS (SELECT track_id, seq, lat", 1)


@query("SELECT track_id, grp, track_id NOT IN (SELECT track_id FROM twice) AND coalesce(stays OR track_id IN (SELECT track_id FROM beyond), false) AS keep FROM facts LEFT JOIN (SELECT track_id, stays FROM stay) USING (track_id)", _LEFT, _FACTS, _TIDY)
def delta_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rides stay, judged anew only in groups that changes touched."""
    before, now, index, changed, removed = _delta(spark, sf_dir)
    old = checkpointed(library.twin_links(before))
    kept = checkpointed(library.kept_of_groups(before, _facts(spark, sf_dir, before), old))
    links = checkpointed(delta.links_after(old, now, index, changed, removed))
    got = delta.tidied_after(kept, old, links, now, _facts(spark, sf_dir, now), changed, removed)
    return got.withColumnRenamed("group", "grp")


_RIDES = "rides AS (SELECT track_id, started_ms AS start_ms, started_ms + time_ms AS end_ms, length_mm / 1000.0::DOUBLE AS metres FROM tracks)"


def _rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides.tracks_of(rides.points(spark, sf_dir)).select("track_id", F.col("started_ms").alias("start_ms"), (F.col("started_ms") + F.col("time_ms")).alias("end_ms"), (F.col("length_mm") / 1000.0).alias("metres"))


@query("SELECT a, b, overlap_ms FROM op WHERE overlap_ms > 0.5 * shorter", _RIDES, _sql.PAIRS)
def ride_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.overlap_pairs(_rides(spark, sf_dir))




@query("SELECT track_id, list_contains((SELECT taken FROM pick ORDER BY o DESC LIMIT 1), track_id) AS kept FROM rides", _RIDES, _sql.PAIRS, _sql.GREEDY)
def ride_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.suppressed(_rides(spark, sf_dir))


@query("SELECT count(*) AS total, count(*) FILTER (o = 'imported') AS imported, count(*) FILTER (o = 'duplicate') AS duplicates, count(*) FILTER (o = 'failed') AS failed FROM (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'duplicate' ELSE 'imported' END AS o FROM events)")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "duplicate").otherwise("imported")
    return library.import_summary(rides.table(spark, sf_dir, "events").select(kind.alias("outcome")))


@query("SELECT track_id AS id, started_ms AS updated_ms FROM tracks WHERE started_ms >= (SELECT max(started_ms) FROM tracks) - 86400000 ORDER BY started_ms DESC, track_id LIMIT 20")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rides.tracks_of(rides.points(spark, sf_dir)).select(F.col("track_id").alias("id"), F.col("started_ms").alias("updated_ms"))
    return library.retained(t, t.agg(F.max("updated_ms")).first()[0] or 0, 20, 86_400_000)


@query("SELECT track_id, round(len, 3) AS length_m, round(lat1, 8) AS lat1, round(lng1, 8) AS lng1, round(lat2, 8) AS lat2, round(lng2, 8) AS lng2, round(lat3, 8) AS lat3, round(lng3, 8) AS lng3 FROM marks", TWINS)
def track_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = library.summaries(_twin_points(spark, sf_dir))
    return s.select("track_id", F.round("length_m", 3).alias("length_m"), *[F.round(f"p{k}.{c}", 8).alias(f"{c}{k}") for k in (1, 2, 3) for c in ("lat", "lng")])


@query("SELECT source, source_key, count(*) AS n FROM keys GROUP BY ALL HAVING count(*) > 1", COPIES)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("source", "source_key"))
    keyed = source_keys(spark, sf_dir).withColumn("n", n).where("n > 1")
    return keyed.select("source", "source_key", "n").distinct()
