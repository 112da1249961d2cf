"""Shared pieces of the corpus operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, in every contract of this subpackage.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset,
    a temporary folder takes its place on one machine (tests); a cluster has no
    folder that all its machines share then, which is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint(eager=True)


#: Rows of a side that is broadcast at most; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000


def light(df: DataFrame) -> DataFrame:
    """A checkpointed side of a join, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Keys that one key of a large side is dealt over where the other side is too large to broadcast.
SALTS = 16


def joined(rows: DataFrame, facts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows with the other columns of facts (at most one row a key; nulls are equal), null where it has none.

    facts is broadcast if it has few rows; else the rows of a key, however
    many, are dealt over SALTS keys, and facts is repeated for each.
    """
    facts = checkpointed(facts)
    other, deal = fresh_name(rows, f"{key}_"), fresh_name(rows, "deal")
    facts = facts.withColumnRenamed(key, other)
    same = rows[key].eqNullSafe(facts[other])
    if facts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), same, how).drop(other)
    facts = facts.withColumn(f"{deal}_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn(deal, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(facts, dealt[key].eqNullSafe(facts[other]) & (dealt[deal] == facts[f"{deal}_"]), how).drop(other, deal, f"{deal}_")


#: Rows of a partition of a small table.
TASK_ROWS = 4096


def compact(df: DataFrame) -> tuple[DataFrame, int]:
    """df checkpointed, in no more partitions than its rows are worth, and their number."""
    df = checkpointed(df)
    rows = df.count()
    return df.coalesce(max(1, -(-rows // TASK_ROWS))), rows


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one a worker, which later tasks use again, gives back the memory Arrow keeps."""
    yield from batches
    pa.default_memory_pool().release_unused()


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows, so that a task holds the work on few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
