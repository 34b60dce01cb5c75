"""Keyed state of a stream as a versioned table in buckets.

A snapshot holds one row per key. Keys are hashed into a fixed number of buckets;
a micro-batch reads and rewrites only the buckets that its keys fall into, so its
cost follows the batch and not the state:

    <root>/batch=<id>/bucket=<b>      the rows of a touched bucket as of that batch
    <root>_versions/batch=<id>        for every bucket the batch that wrote it last

The list of versions has one row per bucket (a parameter, not a data size). A
batch starts from the versions of the batch before it and overwrites its own
folders, so a replay, or a restart between the two writes, gives the same tables.
``expire`` deletes bucket versions that no later batch can read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innlytics.plans.checkpoint import _file_system

BUCKETS = 64
VERSIONS = "bucket int, version long"


class Snapshot:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _versions_path(self, batch_id: int) -> str:
        return f"{self.root}_versions/batch={batch_id}"

    def versions(self, batch_id: int) -> dict[int, int]:
        """The batch that wrote each bucket last, as of ``batch_id``."""
        if batch_id < 0:
            return {}
        rows = self.spark.read.schema(VERSIONS).parquet(self._versions_path(batch_id)).collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, batch_id: int) -> DataFrame:
        """All rows as of a batch."""
        return self._read(self.versions(batch_id))

    def update(self, batch_id: int, changed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the touched buckets: ``changed`` has the keys of this batch, and
        ``step`` makes the new rows of their buckets from the old ones. Returns the
        number of buckets written."""
        before = self.versions(batch_id - 1)
        touched = [r[0] for r in changed.select(self.bucket()).distinct().collect()]  # at most one row a bucket
        held = self._read({b: before[b] for b in touched if b in before})
        (step(held).withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.root}/batch={batch_id}"))
        after = before | {b: batch_id for b in touched}
        self.spark.createDataFrame(sorted(after.items()), VERSIONS).coalesce(1).write.mode("overwrite").parquet(
            self._versions_path(batch_id))
        return len(touched)

    def before(self, batch_id: int, changed: DataFrame) -> DataFrame:
        """The rows of the buckets that ``changed`` touches, as of the batch before."""
        old = self.versions(batch_id - 1)
        touched = [r[0] for r in changed.select(self.bucket()).distinct().collect()]
        return self._read({b: old[b] for b in touched if b in old})

    def expire(self, batch_id: int, keep: int = 2) -> int:
        """Delete bucket versions that the last ``keep`` batches up to ``batch_id``
        do not refer to; a replay of these stays possible. Returns how many."""
        needed = {(b, v) for n in range(max(0, batch_id - keep), batch_id + 1) for b, v in self.versions(n).items()}
        gone = 0
        for n in range(max(0, batch_id - keep)):
            held = _file_system(self.spark, f"{self.root}/batch={n}")
            if not held or not held[0].exists(held[1]):
                continue
            for status in held[0].listStatus(held[1]):
                name = status.getPath().getName()
                if name.startswith("bucket=") and (int(name[len("bucket="):]), n) not in needed:
                    held[0].delete(status.getPath(), True)
                    gone += 1
        return gone
