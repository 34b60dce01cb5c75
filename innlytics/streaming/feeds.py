"""Structured Streaming versions of the trigger operators.

* ``run_transitions`` (C2 and C4 on a stream): ``foreachBatch`` applies the batch
  operator ``changes.status_transitions`` to each micro-batch, with the last
  status of every reservation as the status before it. Last rows, and the latest
  write of every room, are snapshots in buckets (``snapshot.Snapshot``): a batch
  rewrites the buckets that it touches, and a replayed batch rewrites the same
  output from the same input. A row older than its reservation's last row is kept
  with ``late = true`` and does not move the snapshot (the original has no notion
  of late rows).
* ``audit_stream`` (C1/C3): stateless projections, stream-safe as is.
* ``room_status_stream`` (C4): the latest effective transition of each
  reservation per micro-batch, joined with the stay lines, then the latest
  write of each room.
* ``run_to_tables``: drives a query with ``availableNow`` into
  ``foreachBatch`` parquet outputs keyed by batch id (idempotent overwrite on
  replay), under a checkpoint folder derived from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innlytics.operators import changes as CH
from innlytics.plans.checkpoint import _file_system, cut, drop
from innlytics.session import checkpoint_dir
from innlytics.sources import catalog as C
from innlytics.streaming.snapshot import BUCKETS, Snapshot

TRANSITION_SCHEMA = ("reservasi_id long, ts timestamp_ntz, seq long, old_status long, new_status long, "
                     "late boolean")
SNAPSHOT_SCHEMA = "reservasi_id long, ts timestamp_ntz, seq long, status_reservasi_id long"
ROOM_SCHEMA = "kamar_id long, ts timestamp_ntz, seq long, room_status long"


def transitions_of(batch: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transitions with ``late``, the new last rows) of one micro-batch of the
    feed, given the last row (SNAPSHOT_SCHEMA) of each reservation before it."""
    before = last.select("reservasi_id", F.struct("ts", "seq").alias("_at"),
                         F.col("status_reservasi_id").alias("_status"))
    known = batch.join(before, "reservasi_id", "left")
    is_late = F.coalesce(F.struct("ts", "seq") < F.col("_at"), F.lit(False))
    late = known.where(is_late).select("reservasi_id", "ts", "seq", F.col("_status").alias("old_status"),
                                       F.col("status_reservasi_id").alias("new_status"), F.lit(True).alias("late"))
    fresh = known.where(~is_late).select(*batch.columns)
    moved = CH.status_transitions(fresh, initial=last).withColumn("late", F.lit(False))
    row = F.struct("ts", "seq", "status_reservasi_id")
    new_last = (last.select("reservasi_id", row.alias("_r")).unionByName(fresh.select("reservasi_id", row.alias("_r")))
                .groupBy("reservasi_id").agg(F.max_by("_r", F.struct("_r.ts", "_r.seq")).alias("_r"))
                .select("reservasi_id", "_r.*"))
    return moved.unionByName(late), new_last


def run_transitions(feed: DataFrame, out_dir: str, checkpoint: str, stays: DataFrame | None = None,
                    buckets: int = BUCKETS) -> None:
    """C2 over a streaming feed (reservasi_id, ts, seq, status_reservasi_id),
    run to completion. Transitions go to ``out_dir/transitions/batch=<id>``, the
    last row of each reservation to the snapshot ``out_dir/last``. With the stay
    lines, C4 too: the latest write of each room goes to the snapshot
    ``out_dir/rooms``. All of it is overwritten on replay."""
    root = out_dir.rstrip("/")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch, "feed")
        last = Snapshot(spark, f"{root}/last", SNAPSHOT_SCHEMA, "reservasi_id", buckets)
        moved, new_last = transitions_of(batch, last.before(batch_id, batch))
        moved.write.mode("overwrite").parquet(f"{root}/transitions/batch={batch_id}")
        last.update(batch_id, batch, lambda held: new_last)
        if stays is not None:
            moved = spark.read.schema(TRANSITION_SCHEMA).parquet(f"{root}/transitions/batch={batch_id}")
            writes = cut(room_writes(moved, stays), "writes")
            rooms = Snapshot(spark, f"{root}/rooms", ROOM_SCHEMA, "kamar_id", buckets)
            rooms.update(batch_id, writes, lambda held: latest_writes(held.unionByName(writes)))
            drop(writes)
        drop(batch)

    (feed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())


def last_batch(spark: SparkSession, out_dir: str) -> int:
    """The last finished batch under ``out_dir`` (-1: none)."""
    held = _file_system(spark, f"{out_dir.rstrip('/')}/last_versions")
    if not held or not held[0].exists(held[1]):
        return -1
    return max((int(s.getPath().getName()[len("batch="):]) for s in held[0].listStatus(held[1])
                if s.getPath().getName().startswith("batch=")), default=-1)


def rooms_after(spark: SparkSession, kamar: DataFrame, out_dir: str, buckets: int = BUCKETS) -> DataFrame:
    """C4: the room table after all finished batches of ``run_transitions``."""
    state = Snapshot(spark, f"{out_dir.rstrip('/')}/rooms", ROOM_SCHEMA, "kamar_id", buckets).read(last_batch(spark, out_dir))
    new = state.select("kamar_id", F.col("room_status").alias("_new"))
    return (kamar.join(new, F.col("id_kamar") == F.col("kamar_id"), "left")
            .withColumn("status_id", F.coalesce("_new", "status_id")).drop("kamar_id", "_new"))


def latest_writes(writes: DataFrame) -> DataFrame:
    """Per room the latest write (ROOM_SCHEMA)."""
    row = F.struct("ts", "seq", "room_status")
    return (writes.groupBy("kamar_id").agg(F.max_by(row, F.struct("ts", "seq")).alias("_r")).select("kamar_id", "_r.*"))


def room_writes(transitions: DataFrame, stays: DataFrame) -> DataFrame:
    """C4 over the transitions of a micro-batch: per room its latest write."""
    return latest_writes(CH.room_updates(transitions.where(~F.col("late")), stays).select("kamar_id", "ts", "seq", "room_status"))


def audit_stream(transitions: DataFrame) -> DataFrame:
    """C3 lines for the non-late transitions of a stream."""
    return CH.audit_transitions(transitions.where(~F.col("late")))


def room_status_stream(transitions: DataFrame, stays: DataFrame) -> DataFrame:
    """C4 over the transitions of a micro-batch: per room the latest write."""
    writes = CH.room_updates(transitions.where(~F.col("late")), stays)
    return writes.groupBy("kamar_id").agg(F.max_by("room_status", F.struct("ts", "seq")).alias("status_id"))


def stream_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def run_to_tables(df: DataFrame, out_dir: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming DataFrame to completion (``availableNow``); every
    micro-batch is written to ``out_dir/batch=<id>`` with overwrite, so a
    replayed batch replaces its own output instead of duplicating it."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")

    q = (df.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def write_feed(feed: DataFrame, path: str, parts: int) -> None:
    """A feed as ``parts`` Parquet files in feed order (spans of time of about
    equal size), written one after the other, as a source of micro-batches."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = feed.select(at.cast("double").alias("at")).approxQuantile("at", [k / parts for k in range(1, parts)], 0.01)
    bounds = [None, *sorted(set(ends)), None]
    for lo, hi in zip(bounds, bounds[1:]):
        span = (F.lit(True) if lo is None else at > F.lit(int(lo))) & (F.lit(True) if hi is None else at <= F.lit(int(hi)))
        feed.where(span).coalesce(1).write.mode("append").parquet(path)


def read_feed_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """File source of feed parquet files (one micro-batch per file by default)."""
    return (spark.readStream.schema(C.FEED_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path))
