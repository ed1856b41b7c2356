"""The hashes of all files taken in, kept bucketed so that a batch is held against them without moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "hash string, epoch bigint"


class Ledger:
    """A table of hash and epoch, bucketed and sorted by hash, below a folder; one is made where there is none.

    A batch is dealt into as many partitions as there are buckets and merged with them bucket by bucket: the history is
    neither shuffled nor broadcast, whatever its length. Each generation is a folder of its own, the newest complete one
    counts; ``compact`` writes the next, with one file a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64, name: str | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = name or "ledger_" + "".join(c if c.isalnum() else "_" for c in self.path).strip("_").lower()
        self._open(max(self._generations(), default=0))

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation={generation}"

    def _generations(self) -> list[int]:
        """Generations whose folder a writer has finished."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("generation=")]
        return [int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _open(self, generation: int) -> None:
        self.generation = generation
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # the name alone: the folder is the caller's
        self._create(self.name, generation)

    def _create(self, name: str, generation: int) -> None:
        self.spark.sql(f"CREATE TABLE {name} (hash STRING, epoch BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self._folder(generation)}'")

    def seen(self, before: int | None = None) -> DataFrame:
        """hash of all that was added, or of what was added before an epoch."""
        rows = self.spark.table(self.name)
        return (rows if before is None else rows.where(F.col("epoch") < before)).select("hash")

    def fresh(self, files: DataFrame, before: int | None = None) -> DataFrame:
        """One row of files for each hash that the ledger doesn't hold, and none for a null one."""
        dealt = files.where("hash is not null").repartition(self.buckets, "hash").dropDuplicates(["hash"])
        return dealt.join(self.seen(before).hint("merge"), "hash", "left_anti")

    def add(self, hashes: DataFrame, epoch: int) -> None:
        """Adds the hashes of an epoch; adding them again changes nothing that fresh can tell."""
        rows = hashes.where("hash is not null").select("hash", F.lit(epoch).cast("bigint").alias("epoch"))
        rows.repartition(self.buckets, "hash").sortWithinPartitions("hash").write.insertInto(self.name)

    def compact(self) -> None:
        """Writes the next generation: the first epoch of each hash, a file a bucket. The one before stays until it is deleted."""
        following, staged = self.generation + 1, f"{self.name}_next"
        self.spark.sql(f"DROP TABLE IF EXISTS {staged}")
        self._create(staged, following)
        rows = self.spark.table(self.name).groupBy("hash").agg(F.min("epoch").alias("epoch"))
        rows.sortWithinPartitions("hash").write.mode("overwrite").insertInto(staged)
        self.spark.sql(f"DROP TABLE {staged}")
        self._open(following)
