"""Keeping the track library: keys, ledger, candidates, twins, duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import geo
from paceline.functions.formats import source_key
from paceline.operators.twins import tiled
from paceline.sources.rides import checkpointed

INDEX_PRECISION = 6
FINE_PRECISION = 8


def first_by_source_key(tracks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Tracks whose source key nobody had before; in a batch the smallest id wins.

    tracks: track_id, started_ms, length_m.  A track without a start or a length
    has no key, and an empty key is none: neither ever counts as seen.
    """
    keyed = tracks.withColumn("source_key", source_key(F.col("started_ms"), F.col("length_m")))
    has = F.coalesce(F.col("source_key") != "", F.lit(False))
    rn = F.row_number().over(Window.partitionBy("source_key").orderBy("track_id"))
    first = keyed.where(has).withColumn("rn", rn).where("rn = 1").drop("rn")
    if known is not None:
        first = first.join(known.select("source_key").where("source_key <> ''"), "source_key", "left_anti").select(first.columns)
    return first.unionByName(keyed.where(~has))


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files the ledger does not hold with the same size and time."""
    return files.join(ledger.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def marked(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger after done (path, size, mtime) were processed."""
    return ledger.join(done.select("path"), "path", "left_anti").unionByName(done.select("path", "size", "mtime"))


def path_cells(points: DataFrame, precision: int = INDEX_PRECISION) -> DataFrame:
    """track_id, row, col: geohash cells that the boxes of a ride's steps touch."""
    w = Window.partitionBy("track_id").orderBy("seq")
    r, c = geo.geohash_rows(F.col("lat"), precision), geo.geohash_cols(F.col("lng"), precision)
    ends = points.select("track_id", r.alias("r"), c.alias("c"), F.lag(r).over(w).alias("pr"), F.lag(c).over(w).alias("pc"))
    ends = ends.select("track_id", "r", "c", F.coalesce("pr", "r").alias("pr"), F.coalesce("pc", "c").alias("pc"))
    rows = ends.withColumn("row", F.explode(F.sequence(F.least("r", "pr"), F.greatest("r", "pr"))))
    return rows.withColumn("col", F.explode(F.sequence(F.least("c", "pc"), F.greatest("c", "pc")))).select("track_id", "row", "col").distinct()


def dilated(cells: DataFrame) -> DataFrame:
    """Cells and their neighbours."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return cells.select("track_id", "row", "col", o.alias("o")).select("track_id", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col")).distinct()


def box_cells(min_lat: float, max_lat: float, min_lng: float, max_lng: float, cells: DataFrame, precision: int = INDEX_PRECISION) -> DataFrame:
    """The rows of cells that a box touches: a range filter on whole numbers."""
    lo_r, hi_r = geo.geohash_rows(F.lit(min_lat), precision), geo.geohash_rows(F.lit(max_lat), precision)
    lo_c, hi_c = geo.geohash_cols(F.lit(min_lng), precision), geo.geohash_cols(F.lit(max_lng), precision)
    return cells.where(F.col("row").between(lo_r, hi_r) & F.col("col").between(lo_c, hi_c))


def candidates(cells: DataFrame, box: tuple[float, float, float, float], precision: int = INDEX_PRECISION) -> DataFrame:
    return box_cells(*box, cells, precision).select("track_id").distinct()


def ranked_candidates(cells: DataFrame, box: tuple[float, float, float, float], most: int = 250, precision: int = INDEX_PRECISION) -> DataFrame:
    """track_id, shared: most cells shared with the box first, then by id."""
    got = box_cells(*box, cells, precision).groupBy("track_id").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "track_id")
    return got.limit(most) if most > 0 else got


def orphans(documents: DataFrame, cells: DataFrame) -> DataFrame:
    """Live tracks that the index misses."""
    return documents.join(cells.select("track_id").distinct(), "track_id", "left_anti")


def should_reseed(seeded: Column, now: Column) -> Column:
    """Whether a node grid is due: arrays of the ids it was seeded from and of now."""
    a, b = F.size(F.array_except(seeded, now)), F.size(F.array_except(now, seeded))
    enough = a + b >= F.greatest(F.lit(5), F.floor(F.size(seeded) * 0.2))
    return F.when(seeded.isNull(), True).when(a + b == 0, False).when(F.size(seeded) < 5, True).otherwise(enough)


def enriched(recorded: DataFrame, scanned: DataFrame, max_span_m: float = 200.0) -> DataFrame:
    """recorded with ele_m filled from scanned by place along the ride.

    recorded, scanned: track_id, seq, distance_m, ele_m.  A missing height is
    interpolated between the two heights around it, if at most 200 m apart.
    """
    have = scanned.where("ele_m IS NOT NULL").select("track_id", F.col("distance_m").alias("at"), "ele_m")
    w = Window.partitionBy("track_id").orderBy("at")
    pairs = have.select("track_id", F.col("at").alias("d0"), F.lead("at").over(w).alias("d1"), F.col("ele_m").alias("e0"), F.lead("ele_m").over(w).alias("e1"))
    pairs = pairs.where((F.col("d1") > F.col("d0")) & (F.col("d1") - F.col("d0") <= max_span_m))
    spread = pairs.withColumn("b", F.explode(F.sequence(F.floor(F.col("d0") / 1000), F.floor(F.col("d1") / 1000))))
    gaps = recorded.where("ele_m IS NULL").withColumn("b", F.floor(F.col("distance_m") / 1000))
    hit = gaps.select("track_id", "seq", "distance_m", "b").join(spread, ["track_id", "b"]).where("distance_m > d0 AND distance_m <= d1")
    f = (F.col("distance_m") - F.col("d0")) / (F.col("d1") - F.col("d0"))
    value = hit.groupBy("track_id", "seq").agg(F.max_by(F.col("e0") + f * (F.col("e1") - F.col("e0")), "d0").alias("filled"))
    return recorded.join(value, ["track_id", "seq"], "left").select(*[F.coalesce("ele_m", "filled").alias("ele_m") if c == "ele_m" else recorded[c] for c in recorded.columns])


def summaries(points: DataFrame) -> DataFrame:
    """track_id, length_m, and the first place at a quarter, half and three quarters."""
    total = points.groupBy("track_id").agg(F.max("distance_m").alias("length_m"))
    both = points.join(total, "track_id")
    marks = [F.min(F.when(F.col("distance_m") >= F.col("length_m") * q, F.struct("seq", "lat", "lng"))).alias(f"p{k}") for k, q in enumerate((0.25, 0.5, 0.75), 1)]
    return both.groupBy("track_id").agg(F.first("length_m").alias("length_m"), *marks)


def twins(points: DataFrame, cover: float = 0.90, length_tolerance: float = 0.10, place_m: float = 250.0, precision: int = FINE_PRECISION, asked: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of the same route, direction and footprint; with asked (track_id), those that one of these is in.

    Rides meet by the cell of their half-way place and by a band of lengths, are
    compared at three places, and only pairs that pass count shared cells.  On a
    popular road there are as many pairs as rides squared: they are not kept
    anywhere, and come out of the tasks that find them.
    """
    return tiled(summaries(points), path_cells(points, precision), cover, length_tolerance, place_m, links=False, asked=asked)


def twin_links(points: DataFrame, cover: float = 0.90, length_tolerance: float = 0.10, place_m: float = 250.0, precision: int = FINE_PRECISION) -> DataFrame:
    """Pairs (a, b) that connect rides into the groups that twins connect; about one a ride and tile, however many twins there are."""
    return tiled(summaries(points), path_cells(points, precision), cover, length_tolerance, place_m, links=True)


def _within(pairs: DataFrame, fine: DataFrame) -> DataFrame:
    """a, b, c: for pairs of tracks, how many cells of a lie in the widened cells of b, where any do."""
    mine = pairs.join(fine.withColumnRenamed("track_id", "a"), "a")
    wide = dilated(fine.join(pairs.select(F.col("b").alias("track_id")).distinct(), "track_id", "left_semi"))
    return mine.join(wide.withColumnRenamed("track_id", "b"), ["b", "row", "col"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("c"))


def groups(pairs: DataFrame) -> DataFrame:
    """track_id, group: connected components of pairs (a, b), by their smallest id.

    Labels spread along pairs and then along labels, so long chains shorten
    twice as fast; pairs and each round's labels go to the checkpoint folder.
    """
    keep = checkpointed
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = keep(both)
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("g"))
    before = None
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("g").alias("h")), "b").groupBy("a").agg(F.min("h").alias("h"))
        one = label.join(near, "a").select("a", F.least("g", "h").alias("g"))
        hop = one.select(F.col("a").alias("g"), F.col("g").alias("h"))
        label = keep(one.join(hop, "g", "left").select("a", F.coalesce("h", "g").alias("g")))
        now = label.agg(F.sum(F.col("g").cast("decimal(38,0)")), F.count("*")).first()
        if now == before:
            return label.select(F.col("a").alias("track_id"), F.col("g").alias("group"))
        before = now


def kept_of_groups(points: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """track_id, group, keep of the rides that have twins; what is not kept may be archived.

    facts: track_id, source, started_ms, length_m, time_s; pairs (a, b): twins, or links of twins.
    Second copies of one ride go first.  Of more than three rides left in a
    group, the fastest plausible one and the two newest stay, and so does every
    ride that has a cell outside the widened cells of those: nothing is archived
    that would leave ground uncovered.
    """
    named = facts.join(groups(pairs), "track_id")
    twice = checkpointed(same_ride_losers(points, facts, pairs))
    left = named.join(twice, "track_id", "left_anti")
    kmh = F.col("length_m") / F.col("time_s") * 3.6
    plausible = F.coalesce((F.col("time_s") > 0) & (kmh >= 0.5) & (kmh <= 80), F.lit(False))
    w = Window.partitionBy("group")
    fastest = F.row_number().over(w.orderBy(F.when(plausible, 0).otherwise(1), "time_s", "track_id"))
    newest = F.row_number().over(w.orderBy(F.desc("started_ms"), "track_id"))
    ranked = left.select("track_id", "group", (F.count("*").over(w) <= 3).alias("few"), ((newest <= 2) | ((fastest == 1) & plausible)).alias("stays"))
    ranked = checkpointed(ranked)
    cells = path_cells(points, FINE_PRECISION)
    base = ranked.where("stays AND NOT few").select("track_id", "group")
    ground = dilated(cells.join(base, "track_id", "left_semi")).join(base, "track_id").select("group", "row", "col").distinct()
    asked = cells.join(ranked.where("NOT stays AND NOT few").select("track_id", "group"), "track_id")
    beyond = asked.join(ground, ["group", "row", "col"], "left_anti").select("track_id").distinct().withColumn("beyond", F.lit(True))
    kept = ranked.join(beyond, "track_id", "left").select("track_id", "group", (F.col("few") | F.col("stays") | F.col("beyond").isNotNull()).alias("keep"))
    return kept.unionByName(named.join(twice, "track_id", "left_semi").select("track_id", "group", F.lit(False).alias("keep")))


def same_ride_losers(points: DataFrame, facts: DataFrame, pairs: DataFrame, window_ms: int = 600_000) -> DataFrame:
    """track_id of device scans that a live recording of the same ride replaces.

    facts: track_id, source, started_ms, length_m; pairs (a, b): twins, or links of twins.  Within a
    group of twins each recording, in order of id, claims the unclaimed scan of
    about its length that started nearest to it, and replaces it if the scan's
    fine cells lie in its own widened ones.  Recordings and scans meet by start
    time; claims depend on each other only where they do, so each set of
    recordings and scans linked by that is one group's work.
    """
    named = facts.join(groups(pairs), "track_id")
    slot = F.floor(F.col("started_ms") / window_ms)
    one = named.where("source = 'RECORDED'").select("group", F.col("track_id").alias("a"), F.col("started_ms").alias("a_ms"), F.col("length_m").alias("a_m"), F.explode(F.sequence(slot - 1, slot + 1)).alias("slot"))
    two = named.where("source = 'FITFILES_SCAN'").select("group", F.col("track_id").alias("b"), F.col("started_ms").alias("b_ms"), F.col("length_m").alias("b_m"), slot.alias("slot"))
    apart, longer = F.abs(F.col("a_ms") - F.col("b_ms")), F.greatest("a_m", "b_m")
    match = one.join(two, ["group", "slot"]).where((apart <= window_ms) & (longer > 0)).where(F.abs(F.col("a_m") - F.col("b_m")) <= F.greatest(F.lit(100.0), longer * 0.01))
    match = checkpointed(match.select("a", "b", apart.alias("apart")))
    asked = match.select(F.col("a").alias("track_id")).unionByName(match.select(F.col("b").alias("track_id"))).distinct()
    fine = checkpointed(path_cells(points.join(asked, "track_id", "left_semi"), FINE_PRECISION))
    n = fine.groupBy(F.col("track_id").alias("b")).agg(F.count("*").alias("n"))
    held = _within(match.select(F.col("b").alias("a"), F.col("a").alias("b")), fine).select(F.col("a").alias("b"), F.col("b").alias("a"), "c")
    asked = match.join(held, ["a", "b"], "left").join(n, "b").withColumn("covered", F.coalesce("c", F.lit(0)) == F.col("n"))
    asked = asked.join(groups(match.select("a", "b")).select(F.col("track_id").alias("a"), "group"), "a").select("group", "a", "b", "apart", "covered")

    def claim(pdf):
        taken: set[int] = set()
        for _, mine in pdf.sort_values(["a", "apart", "b"]).groupby("a", sort=True):
            free = mine[~mine["b"].isin(taken)]
            if len(free) and free.iloc[0]["covered"]:
                taken.add(int(free.iloc[0]["b"]))
        return pd.DataFrame({"track_id": sorted(taken)}, dtype="int64")

    return asked.groupBy("group").applyInPandas(claim, "track_id bigint")


def overlap_pairs(rides: DataFrame, share: float = 0.5, day_ms: int = 86_400_000) -> DataFrame:
    """Pairs a < b whose intervals overlap by more than half of the shorter.

    rides: track_id, start_ms, end_ms; only datable ones (0 < length <= 24 h)
    meet, by the days they touch.
    """
    fine = rides.where((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") <= day_ms))
    spread = fine.select("track_id", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / 3_600_000), F.floor(F.col("end_ms") / 3_600_000))).alias("h"))
    left, right = spread.toDF("a", "a0", "a1", "h"), spread.toDF("b", "b0", "b1", "h")
    both = left.join(right, "h").where("a < b").dropDuplicates(["a", "b"])
    common = F.least("a1", "b1") - F.greatest("a0", "b0")
    shorter = F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"))
    return both.where(common > share * shorter).select("a", "b", common.alias("overlap_ms"))


def suppressed(rides: DataFrame) -> DataFrame:
    """track_id, kept: rides in order of metres (then id), each dropped if it overlaps one accepted before.

    Rounds over the overlapping pairs: a ride that no open pair has as the later
    one is accepted, what it overlaps is dropped, and pairs with a dropped ride
    are closed.  rides adds metres to overlap_pairs' columns.
    """
    order = rides.select("track_id", F.struct((-F.col("metres")).alias("m"), "track_id").alias("at"))
    pairs = overlap_pairs(rides).join(order.toDF("a", "at_a"), "a").join(order.toDF("b", "at_b"), "b")
    first = F.col("at_a") < F.col("at_b")
    pairs = checkpointed(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lo")))
    gone = pairs.select(F.col("lo").alias("track_id")).limit(0)
    while not pairs.isEmpty():
        accepted = pairs.select("hi").distinct().join(pairs.select(F.col("lo").alias("hi")), "hi", "left_anti")
        now = checkpointed(pairs.join(accepted, "hi", "left_semi").select(F.col("lo").alias("track_id")).distinct())
        gone = checkpointed(gone.unionByName(now))
        pairs = checkpointed(pairs.join(now.toDF("hi"), "hi", "left_anti").join(now.toDF("lo"), "lo", "left_anti"))
    return rides.select("track_id").join(gone.withColumn("gone", F.lit(True)), "track_id", "left").select("track_id", F.col("gone").isNull().alias("kept"))


def import_summary(outcomes: DataFrame) -> DataFrame:
    """total, imported, duplicates, failed of outcomes (outcome); the three make the total."""
    is_ = lambda v: F.count_if(F.col("outcome") == v)
    return outcomes.agg(F.count("*").alias("total"), is_("imported").alias("imported"), is_("duplicate").alias("duplicates"), is_("failed").alias("failed"))


def retained(items: DataFrame, now_ms: int, most: int, max_age_ms: int) -> DataFrame:
    """The newest items (id, updated_ms) not older than max_age_ms."""
    young = items.where(F.col("updated_ms") >= now_ms - max_age_ms)
    return young.orderBy(F.desc("updated_ms"), "id").limit(most)
