"""The store of imported rides: batches that appear whole or not at all.

A batch is folders of Parquet (rides, points, ledger, outcomes), each named by
the batch's number, and at last its commit record.  Readers see the batches that
have one.  A batch that was stopped half-way is written over when it runs again,
so nothing appears twice, and nothing of it is seen before all of it is.

A ride stands as its newest batch has it: an import that fills in heights writes
the ride anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = {
    "rides": "track_id string, source string, source_key string, started_ms bigint",
    "points": "track_id string, seq int, lat double, lng double, distance_m double, time_s double, ele_m double",
    "ledger": "path string, size bigint, mtime bigint",
    "outcomes": "path string, mtime bigint, outcome string, enriched boolean",
    "commits": "last_scan_ms bigint",
}


class RideStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, kind: str) -> DataFrame:
        """All rows of a kind with their batch, committed or not."""
        schema = StructType.fromDDL(KINDS[kind] + ", batch bigint")
        reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").option("ignoreMissingFiles", True)
        return reader.parquet(f"{self.folder}/{kind}") if self._there(kind) else self.spark.createDataFrame([], schema)

    def _there(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commits(self) -> DataFrame:
        """batch, last_scan_ms: a row a batch that is whole."""
        return self._read("commits").select("batch", "last_scan_ms")

    def committed(self, kind: str) -> DataFrame:
        return self._read(kind).join(self.commits().select("batch"), "batch", "left_semi")

    def rides(self) -> DataFrame:
        """The library's rides, each of its newest batch (column ``batch``)."""
        newest = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("batch")))
        return self.committed("rides").withColumn("n_", newest).where("n_ = 1").drop("n_")

    def points(self) -> DataFrame:
        """Points of the library's rides, with source and source_key."""
        return self._read("points").join(self.rides(), ["track_id", "batch"]).drop("batch")

    def ledger(self) -> DataFrame:
        """path, size, mtime of the files processed, as they were last."""
        newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("batch")))
        return self.committed("ledger").withColumn("n_", newest).where("n_ = 1").select("path", "size", "mtime")

    def outcomes(self) -> DataFrame:
        return self.committed("outcomes")

    def last_scan_ms(self) -> int:
        """Of the newest batch, 0 before the first."""
        row = self.commits().orderBy(F.desc("batch")).first()
        return row["last_scan_ms"] if row else 0

    def has(self, batch: int) -> bool:
        return not self.commits().where(F.col("batch") == batch).isEmpty()

    def write(self, batch: int, kind: str, rows: DataFrame) -> None:
        """Writes a batch's rows of a kind, over what an earlier try of the batch left."""
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(KINDS[kind])])
        if kind == "points":  # a ride in one file, in order
            typed = typed.repartition("track_id").sortWithinPartitions("track_id", "seq")
        typed.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")

    def commit(self, batch: int, last_scan_ms: int) -> None:
        """Makes a batch seen: the last thing written of it."""
        self.write(batch, "commits", self.spark.range(1).select(F.lit(last_scan_ms).alias("last_scan_ms")).coalesce(1))
