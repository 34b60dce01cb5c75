"""Lineage cuts that survive executor loss.

A cut writes the DataFrame once as a parquet table under the shared folder
named by ``spark.checkpoint.dir`` and reads it back, so later steps (and
task retries after a lost executor) start from durable files instead of
re-running the lineage. ``localCheckpoint`` is never used: its blocks die
with the executor. (A reliable ``DataFrame.checkpoint()`` would compute the
plan twice unless cached first; the table write computes it once.)

``drop`` deletes a table as soon as no later step reads it; what is left
goes when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from innlytics.session import checkpoint_dir


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of a location, or None on a Spark Connect session."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(sc._jsc.hadoopConfiguration()), hpath


def persist_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    spark = df.sparkSession
    target = path or f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    if path is None and (held := _file_system(spark, target)):
        held[0].deleteOnExit(held[1])
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return persist_table(df, name)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if held := _file_system(df.sparkSession, folder):
            held[0].delete(held[1], True)
