"""Classes of duplicates kept up to date as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality

BUCKETS = 64


class RunStore:
    """Runs of values (quality.value_runs) in folders by batch and bucket of their group.

    A batch reads the newest state of the buckets that its groups fall in, merges what it touches there and writes those
    buckets anew in its own folder; other buckets are neither read nor written. What counts for a batch are folders of
    batches before it, so one that is run again gives the same.
    """

    def __init__(self, spark: SparkSession, path: str, *, cents: float = 0.01, buckets: int = BUCKETS):
        self.spark, self.path, self.cents, self.buckets = spark, path.rstrip("/"), cents, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*quality.KEYS), F.lit(self.buckets)).cast("int"))

    def _folders(self, before: int | None) -> list[str]:
        """The newest folder of each bucket, of batches before the given one."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        newest: dict[str, tuple[int, str]] = {}
        if fs.exists(root):
            for batch in fs.listStatus(root):
                name = batch.getPath().getName()
                done = self.spark._jvm.org.apache.hadoop.fs.Path(batch.getPath(), "_SUCCESS")
                if not name.startswith("_epoch=") or not fs.exists(done) or (before is not None and int(name.split("=")[1]) >= before):
                    continue
                for f in fs.listStatus(batch.getPath()):
                    bucket = f.getPath().getName()
                    if bucket.startswith("_bucket="):
                        newest[bucket] = max(newest.get(bucket, (-1, "")), (int(name.split("=")[1]), f.getPath().toString()))
        return [path for _, path in newest.values()]

    def runs(self, before: int | None = None) -> DataFrame:
        """KEYS, _low, _high, classe, n as they are now, or were before a batch; a bucket is read only if it is asked for."""
        schema = "_issuer string, _number string, _series string, _low bigint, _high bigint, classe bigint, n bigint"
        folders = self._folders(before)
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return self._bucketed(rows)

    def apply(self, docs: DataFrame, epoch: int) -> None:
        """Takes in the documents of a batch, none of which came before."""
        values = self._bucketed(quality.values_of(docs)).persist()
        try:
            touched = [r[0] for r in values.select("_bucket").distinct().collect()]  # as many as there are buckets, at most
            folders = [f for f in self._folders(epoch) if int(f.rsplit("=", 1)[1]) in touched]
            empty = self.runs(epoch).limit(0)
            before = self._bucketed(self.spark.read.schema(empty.drop("_bucket").schema).parquet(*folders)) if folders else empty
            after, replaced = quality.extended_runs(before.drop("_bucket"), values.drop("_bucket"), cents=self.cents)
            rest = before.join(replaced.select(*quality.KEYS, "_low"), [*quality.KEYS, "_low"], "left_anti")
            self._bucketed(rest.drop("_bucket").unionByName(after)).repartition(self.buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/_epoch={epoch}")
        finally:
            values.unpersist()

    def classes(self, docs: DataFrame) -> DataFrame:
        """id, classe, n of documents that were taken in."""
        return quality.classes_of(docs, self.runs().drop("_bucket"))
