"""Upkeep of the library after some rides changed: index, twins and tidying for their neighbourhood only.

Rides that are new or changed meet their neighbours through the cell index, and
only those rides' points are read.  The results are those of the whole library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators import library
from paceline.sources.rides import checkpointed

#: At most so many ids are sent to every task to filter pairs; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select("track_id").distinct()


def index_after(index: DataFrame, tracks: DataFrame, changed: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index (track_id, row, col) of the library's tracks.

    Entries of tracks that are gone go; tracks that changed, and those that the
    index lost, are entered from their points, which read gives for the ids
    asked for.  A ride of fewer than two points has no entry.
    """
    again = checkpointed(_ids(changed).unionByName(library.orphans(_ids(tracks), index)).distinct().join(_ids(tracks), "track_id", "left_semi"))
    points = checkpointed(read(again))
    paths = points.groupBy("track_id").count().where("count > 1").select("track_id")
    fresh = library.path_cells(points.join(paths, "track_id", "left_semi"))
    return index.join(_ids(tracks), "track_id", "left_semi").join(again, "track_id", "left_anti").select("track_id", "row", "col").unionByName(fresh)


def neighbours(changed: DataFrame, index: DataFrame) -> DataFrame:
    """track_id of the rides that have an index cell on or beside one of a changed ride, these themselves too."""
    mine = index.join(_ids(changed), "track_id", "left_semi")
    around = library.dilated(mine).select("row", "col").distinct()
    return _ids(index.join(around, ["row", "col"], "left_semi"))


def twins_after(pairs: DataFrame, points: DataFrame, index: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Twin pairs (a, b) after rides changed (or came) and others were removed.

    pairs: those of before; points and index: of the library as it is now.
    """
    touched = checkpointed(_ids(changed).unionByName(_ids(removed)).distinct())
    if touched.count() <= BROADCAST_IDS:  # pairs are many: they should not be shuffled for a few ids
        touched = F.broadcast(touched)
    end = lambda c: touched.withColumnRenamed("track_id", c)
    kept = pairs.select("a", "b").join(end("a"), "a", "left_anti").join(end("b"), "b", "left_anti")
    near = checkpointed(neighbours(changed, index).join(_ids(removed), "track_id", "left_anti"))
    found = library.twins(points.join(near, "track_id", "left_semi"), asked=_ids(changed))
    return kept.select("a", "b").unionByName(found.select("a", "b"))


def links_after(links: DataFrame, points: DataFrame, index: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Links (a, b) of the groups of twins (``library.twin_links``) after rides changed or came and others were removed.

    A group that lost a ride may fall apart, and links do not tell how: the
    groups of before that a changed or removed ride was in, or that changed rides
    come near to, are linked anew; those of the others stand.
    """
    near = neighbours(changed, index)
    odd = checkpointed(_ids(changed).unionByName(_ids(removed)).unionByName(near).distinct())
    again = checkpointed(odd.unionByName(groups_of(odd, links)).distinct())
    kept = links.select("a", "b").join(again.withColumnRenamed("track_id", "a"), "a", "left_anti")
    mine = again.join(_ids(removed), "track_id", "left_anti")
    return kept.select("a", "b").unionByName(library.twin_links(points.join(mine, "track_id", "left_semi")))


def groups_of(touched: DataFrame, pairs: DataFrame) -> DataFrame:
    """track_id of all rides in a group with a touched one."""
    both = checkpointed(pairs.select(F.col("a").alias("track_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("track_id"), F.col("a").alias("other"))))
    ids = edge = checkpointed(_ids(touched))
    while not edge.isEmpty():
        edge = checkpointed(_ids(both.join(edge, "track_id", "left_semi").select(F.col("other").alias("track_id"))).join(ids, "track_id", "left_anti"))
        ids = checkpointed(ids.unionByName(edge))
    return ids


def tidied_after(kept: DataFrame, before: DataFrame, pairs: DataFrame, points: DataFrame, facts: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """track_id, group, keep of rides that have twins, judged anew in groups that a change touched.

    kept: the verdicts of before, for the pairs ``before``; pairs: those of now.
    Both may be links that connect the same groups.
    A removed ride's partners of before are touched too: their group may have
    fallen apart.
    """
    odd = _ids(changed).unionByName(_ids(removed)).distinct()
    touched = checkpointed(odd.unionByName(groups_of(odd, before)).distinct())
    ids = groups_of(touched, pairs)
    mine = pairs.join(ids.withColumnRenamed("track_id", "a"), "a", "left_semi").select("a", "b")
    again = library.kept_of_groups(points.join(ids, "track_id", "left_semi"), facts.join(ids, "track_id", "left_semi"), checkpointed(mine))
    return kept.join(ids, "track_id", "left_anti").select("track_id", "group", "keep").unionByName(again)
