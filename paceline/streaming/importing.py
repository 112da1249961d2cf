"""Importing ride files as they come: a stream of files, a committed batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators import imports
from paceline.sources import fit, gpx
from paceline.sources.ride_store import RideStore
from paceline.sources.rides import checkpointed

#: What decodes a file, by the end of its name (path, content -> points and outcomes).
DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {".fit": fit.decoded, ".gpx": gpx.decoded}
FILE = "path string, modificationTime timestamp, length bigint, content binary"
FILES_A_BATCH = 1000


def arriving(spark: SparkSession, folder: str, files_a_batch: int = FILES_A_BATCH) -> DataFrame:
    """A stream of the files in a folder and below it."""
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(folder)


def decoded(files: DataFrame, decoders: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """path, outcome, track_id, started_ms and points of files (path, content) by the decoder for each name; others have failed."""
    decoders = DECODERS if decoders is None else decoders
    lower, out, known = F.lower("path"), None, F.lit(False)
    for end, decode in decoders.items():
        part = decode(files.where(lower.endswith(end)))
        out = part if out is None else out.unionByName(part)
        known = known | lower.endswith(end)
    return out.unionByName(files.where(~known).select("path", F.lit("failed").alias("outcome")), allowMissingColumns=True)


def import_batch(store: RideStore, batch: int, files: DataFrame, source: str = "FIT_IMPORT", decoders: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
    """Imports files (path, modificationTime, length, content) as one batch of the store.

    Files that the ledger holds as they are are passed over unread by decoders.
    A batch that the store has already is not written again.
    """
    if store.has(batch):
        return
    listed = files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))
    todo = checkpointed(imports.asked(listed, store.ledger()).select("path", "size", "mtime"))
    rows = checkpointed(decoded(files.join(todo.select("path"), "path", "left_semi").select("path", "content"), decoders))
    facts = rows.groupBy("path").agg(F.first("outcome").alias("said"), F.first("track_id").alias("track_id"), F.first("started_ms").alias("started_ms"))
    asked = checkpointed(todo.join(facts, "path").withColumn("source", F.lit(source)))
    points = rows.where("outcome = 'decoded'").select("path", "seq", "lat", "lng", "distance_m", "time_s", "ele_m")
    # a file that is no ride decoded fully: it has a point, so that it counts as invalid, not as failed
    no_ride = asked.where("said = 'invalid'").select("path", F.lit(0).alias("seq"), F.lit(0.0).alias("distance_m"))
    library = store.points()
    got = imports.imported(asked.drop("said", "track_id"), points.unionByName(no_ride, allowMissingColumns=True), store.ledger(), library, tracks=store.rides())
    names = asked.select("path", "track_id", "started_ms", "source")
    added = got.added.join(names, "path")
    kept = store.rides().join(got.completed.select("track_id").distinct(), "track_id", "left_semi")
    store.write(batch, "rides", added.select("track_id", "source", "source_key", "started_ms").distinct().unionByName(kept.select("track_id", "source", "source_key", "started_ms")))
    store.write(batch, "points", added.unionByName(got.completed, allowMissingColumns=True))
    store.write(batch, "outcomes", got.outcomes)
    new = got.ledger.join(todo.select("path"), "path", "left_semi")
    store.write(batch, "ledger", new)
    store.commit(batch, imports.watermark(got.outcomes, store.last_scan_ms()).first()[0])


def import_stream(files: DataFrame, store: RideStore, log: str, source: str = "FIT_IMPORT", decoders: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
    """Starts importing all files that are there, and returns the running query; log: its checkpoint location."""
    work = lambda batch, number: import_batch(store, number, batch, source, decoders)
    return files.writeStream.foreachBatch(work).option("checkpointLocation", log).trigger(availableNow=True).start()
