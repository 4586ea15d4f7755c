"""Stored rows by key, in buckets: a change rewrites the buckets of its own keys and no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import upsert


class KeyedTable:
    """A table of unique keys in folders by bucket (a hash of the key) and version.

    A version writes the buckets it touches anew and ends with a mark; a reader takes each bucket's last marked version,
    so a batch that failed half-way leaves what was stored, and one that comes again writes the same folders once
    more. Of a bucket the version before the last one stays too, for readers that began earlier; older ones are
    removed. Keys that are null are keys like any other.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        return hadoop, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str, prefix: str = "") -> list[int]:
        hadoop, fs = self._fs()
        at = hadoop.Path(folder)
        found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removeprefix(prefix)) for n in found if n.startswith(prefix) and n.removeprefix(prefix).lstrip("-").isdigit())

    def versions(self) -> list[int]:
        """The versions written whole, in order."""
        return self._names(f"{self.path}/_done")

    def folders(self) -> dict[int, list[int]]:
        """Bucket -> its versions written whole."""
        done = set(self.versions())
        found = {b: [v for v in self._names(f"{self.path}/bucket={b}", "version=") if v in done] for b in self._names(self.path, "bucket=")}
        return {b: versions for b, versions in found.items() if versions}

    def read(self, buckets: set[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None where nothing is stored."""
        newest = [f"{self.path}/bucket={b}/version={v[-1]}" for b, v in sorted(self.folders().items()) if buckets is None or b in buckets]
        return self.spark.read.option("basePath", self.path).parquet(*newest).drop("bucket", "version") if newest else None

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def upsert(self, rows: DataFrame, update: list[str], version: int) -> None:
        """Rows inserted, or their `update` columns replaced where the key is known. A key that stands twice in rows counts once (any; deduplicate before). A version that is there already changes nothing."""
        if version in self.versions():
            return
        new = self.placed(rows)
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most as many as there are buckets
        before = self.read(touched)
        merged = upsert(before, rows.dropDuplicates(self.key), self.key, update) if before is not None else rows.dropDuplicates(self.key)
        out = self.placed(merged).withColumn("version", F.lit(version))
        out.repartition("bucket").write.partitionBy("bucket", "version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        hadoop, fs = self._fs()
        fs.create(hadoop.Path(f"{self.path}/_done/{version}"), True).close()
        for bucket, versions in self.folders().items():
            for old in versions[:-2] if bucket in touched else ():
                fs.delete(hadoop.Path(f"{self.path}/bucket={bucket}/version={old}"), True)
