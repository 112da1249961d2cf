"""Ride files: listings without reading them, and the files themselves by Spark's own readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str, since_ms: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files in a folder and below it.

    Spark reads no content that is not asked for, groups small files into
    partitions, and passes over files that a filter on time or length excludes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files if since_ms is None else files.where(F.col("modificationTime") > F.timestamp_millis(F.lit(since_ms)))


def listed(spark: SparkSession, folders: list[tuple[str, str, str]]) -> DataFrame:
    """path, size, mtime, source of the files in folders and below them.

    folders: (folder, file name pattern, source).  Only names, sizes and times are read.
    """

    def one(folder: str, pattern: str, source: str) -> DataFrame:
        files = listing(spark, folder, pattern)
        return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.lit(source).alias("source"))

    return reduce(DataFrame.unionByName, [one(*f) for f in folders])


def counted(files: DataFrame) -> DataFrame:
    """source, files, bytes."""
    return files.groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
