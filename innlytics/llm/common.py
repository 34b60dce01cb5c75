"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innlytics.plans.checkpoint import cut, drop
from innlytics.plans.joins import lookup
from innlytics.session import checkpoint_dir

__all__ = ["cut", "drop", "fresh", "give_back", "mix64", "new_path", "numbered", "read", "release", "shingles", "short_plans", "small_batches", "text_bytes", "trimmed", "word_hashes"]

# Words are runs of anything but ASCII white space. ``bytes.split()`` splits
# exactly there (space, \t, \n, \v, \f, \r), so texts are handled as bytes.

# Rows and bytes per Arrow batch: a batch ends at either, and a text that is longer
# is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return the freed memory of this Python process to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def trimmed(step: Callable) -> Callable:
    """A ``mapInPandas`` function that gives freed memory back to the system when it
    ends: a Python worker is used again by later tasks, beside the JVM, and would
    else keep the most that any of its tasks took."""
    @functools.wraps(step)
    def held(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return held


@contextmanager
def short_plans(spark: SparkSession, characters: int = 20_000) -> Iterator[None]:
    """Within, Spark describes the plans of its jobs in at most so many characters.
    The driver keeps the descriptions of its last thousand jobs; those of loops over
    joins are long."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(characters))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when
    the driver's JVM collects their handles, which may be much later. The driver's
    Python gives back what it has freed, too."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def text_bytes(col: str = "text") -> Column:
    """The whole text as UTF-8 bytes; NULL counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """The rows with an id of their own (a long, the same at every reading), and
    the new column's name. Of a Parquet table it is the place in the files (their
    paths, which the driver lists for any read, are a table of their own,
    broadcast after a check of its size); other frames are written once with it."""
    rid = fresh(docs, "rid")
    if not _is_parquet(docs):
        return cut(docs.withColumn(rid, F.monotonically_increasing_id()), name), rid
    file, no = fresh(docs, "file"), fresh(docs, "file_no")
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    # from an Arrow table: a list would be serialised by Python workers of their own, kept beside those of the operators
    numbers = docs.sparkSession.createDataFrame(pa.table({file: pa.array(files, pa.string()), no: pa.array(range(len(files)), pa.int64())}))
    placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(rid))
    return placed.join(lookup(numbers), file).select(
        *[F.col(f"`{c}`") for c in docs.columns], (F.shiftleft(no, 40) + F.col(rid)).alias(rid)), rid


def _is_parquet(docs: DataFrame) -> bool:
    """Whether the frame is a Parquet table as read, nothing done to it."""
    if "_metadata" in docs.columns:
        return False
    try:
        if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
            return False
        docs.select("_metadata.row_index")
    except Exception:  # noqa: BLE001 - another format, or a Spark Connect session
        return False
    return True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(words: list) -> np.ndarray:
    """64-bit hash of each word (a list of byte strings)."""
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: list, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter text
    is one shingle (its whole sequence), no words give none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - size + 1)
    if len(h) < size:
        acc = np.full(1, len(h), np.uint64)
        for x in h:
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + x)
        return acc
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return np.unique(mix64(acc))
