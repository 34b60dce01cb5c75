"""Scalable row numbering and per-group top-k.

``row_number().over(partitionBy(g).orderBy(k))`` sorts a whole group inside
one task; a hot group (a third of all rows) would serialise the job. The
helpers here split each group into blocks, number/select inside blocks in
parallel, and combine small per-block summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innlytics.plans.checkpoint import cut


def numbered(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
             block: Column, out: str = "no") -> DataFrame:
    """Dense 1-based numbering inside ``group_cols`` by ``order_cols``.

    ``block`` must be monotone in the ordering (e.g. ``floor(id / 65536)``),
    so blocks partition each group into ordered slices. Each (group, block)
    is numbered independently; the offset of a block is the count of the
    earlier blocks of its group, computed from a per-block count summary
    whose size is bounded by the number of blocks, not rows.
    """
    group_cols = list(group_cols)
    tagged = df.withColumn("_blk", block)
    local = Window.partitionBy(*group_cols, "_blk").orderBy(*order_cols)
    counts = tagged.groupBy(*group_cols, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*group_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    renamed = [f"_g{i}" for i in range(len(group_cols))]
    offsets = counts.select(*[F.col(g).alias(r) for g, r in zip(group_cols, renamed)],
                            F.col("_blk").alias("_ob"),
                            F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"))
    # NULL group values form a group of their own (null-safe join).
    cond = [F.col(g).eqNullSafe(F.col(r)) for g, r in zip(group_cols, renamed)] + [
        F.col("_blk").eqNullSafe(F.col("_ob"))]
    return (tagged.withColumn("_local", F.row_number().over(local))
            .join(offsets, cond, "inner")
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_blk", "_local", "_off", "_ob", *renamed))


def new_ids(df: DataFrame, order: str, starts: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Assign ``start + 1, start + 2, ...`` in ``order`` order to each column of
    ``starts`` (batch AUTO_INCREMENT; a start holds the current max id).

    The batch is dealt once into ranges of the order key (sampled quantiles, so
    sparse and dense keys give even ranges) and sorted inside them; the written
    table fixes each row's range and place, and the offsets are a prefix over one
    count per range (a parameter, not a data size)."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # range and place in one number: the range in the upper 31 bits, the place in the lower 33
    dealt = cut(df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()),
                "numbered")
    rng, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(rng.alias("_rng")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_rng", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = dealt.withColumn("_rng", rng).join(F.broadcast(offsets), "_rng")  # at most n rows
    for name, start in starts.items():
        out = out.withColumn(name, (start + F.col("_off") + place + 1).cast("bigint"))
    return out.drop("_rng", "_at", "_off")


def top_k(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], k: int) -> DataFrame:
    """Top ``k`` rows per group under ``order_cols`` (a total order). The filter
    on ``row_number`` becomes a partial window group limit below the shuffle,
    so at most ``k`` rows a group leave each partition."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
