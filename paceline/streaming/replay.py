"""Stored rows as a stream of files, and a stream run to its end: for backfills and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.sources.rides import scratch

#: Rows arrive in so many files, in two neighbouring ones of which a time may be.
FILES = 5
#: What arrives at once is so many files more as it has so many rows, each written and read by a task of its own.
ROWS_A_FILE = 250_000
#: A task of the stream holds the state of so many rows, about.
ROWS_A_PARTITION = 250_000
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def bounds(rows: DataFrame) -> tuple[int, int]:
    """(first, last) time of rows, 0 for none."""
    lo, hi = rows.agg(F.min("at"), F.max("at")).first()
    return lo or 0, hi or 0


def parts(n_rows: int, files: int = FILES) -> int:
    """In how many files a batch of so many rows in all arrives."""
    return max(1, -(-n_rows // ((files + 1) * ROWS_A_FILE)))


def delay_ms(lo: int, hi: int, files: int = FILES) -> int:
    """By how much rows are late at most."""
    return 2 * ((hi - lo) // files + 1)


def arrived(rows: DataFrame, key: str, lo: int, hi: int, until: int, files: int = FILES, parts: int = 1) -> str:
    """A folder of files in order of arrival: rows (key, at, seq, ...) shuffled within
    two files' worth of time, then one that brings the watermark to ``until``.

    With ``parts`` each of these is about so many files, none of which holds more
    than its part.  A row is in time whatever is read together: files of one
    arrival hold no time that the watermark passed after any before it.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, "arrivals")
    width = (hi - lo) // files + 1
    placed = rows.withColumn("file_", F.floor((F.col("at") - lo) / width) + F.pmod(F.xxhash64(key, "seq"), F.lit(2)))
    dealt = [] if parts == 1 else [F.pmod(F.xxhash64("seq", key), F.lit(parts))]
    placed = placed.repartition((files + 1) * parts, "file_", *dealt).sortWithinPartitions(F.xxhash64("seq", key)).persist()
    for k in range(files + 1):
        now = placed.where(F.col("file_") == k).drop("file_")
        (now.coalesce(1) if parts == 1 else now).write.mode("append").parquet(folder)
    placed.unpersist()
    flush = [F.lit(until + delay_ms(lo, hi, files) if c == "at" else -1 if c in (key, "seq") else None).cast(t).alias(c) for c, t in rows.dtypes]
    spark.range(1).select(*flush).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark: SparkSession, folder: str, schema, parts: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", parts).parquet(folder)


def log_of(folder: str) -> str:
    """The checkpoint location of a stream that was finished into a folder."""
    return f"{folder}-log"


def finished(out: DataFrame, folder: str | None = None, n_rows: int = 0) -> DataFrame:
    """Runs a stream over all that is there, into files of a folder, and gives these; its log is beside it.

    n_rows: about how many rows come; state is dealt over more tasks the more there are.
    """
    spark, folder = out.sparkSession, folder or scratch(out.sparkSession, "streamed")
    conf = STORE | {"spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS_A_PARTITION)))}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        job = out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", log_of(folder)).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    job.awaitTermination()
    return spark.read.schema(out.schema).parquet(folder)
