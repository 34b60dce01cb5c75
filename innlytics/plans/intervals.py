"""Interval (stay) building blocks that never pair rows with rows.

A room's stays are reduced to one summary row per (room, check-in day)
before any ordered window runs, so every window partition is bounded by the
calendar (distinct days), not by the number of stays; hot rooms are absorbed
by map-side partial aggregation. Range lookups are cumulative counts over day
summaries; counts of intervals inside an interval go by dyadic blocks of days,
so that a lookup costs at most twice the logarithm of its length in rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEG_INF_DAY = "0001-01-01"
POS_INF_DAY = "9999-12-31"
#: Largest dyadic block of days (4096); longer ranges take several of these.
TOP_LEVEL = 12


def count_before(events: DataFrame, points: DataFrame, keys: Sequence[str], ev_day: str, weight: str,
                 pid: str | Sequence[str], pt_day: str, out: str = "cnt") -> DataFrame:
    """For every point (pid..., keys, pt_day): sum of ``weight`` over events
    of the same keys with ``ev_day < pt_day``. Returns (pid..., keys, out) for
    every point (0 when nothing precedes, or a key or the day is NULL).

    Events and the days asked for become one summary row per (keys, day), a
    running sum goes over the days of each key (bounded by the calendar), and a
    point meets the one row of its day."""
    keys = list(keys)
    pids = [pid] if isinstance(pid, str) else list(pid)
    both = events.select(*keys, F.col(ev_day).alias("_day"), F.col(weight).cast("bigint").alias("_w")).unionByName(
        points.select(*keys, F.col(pt_day).alias("_day"), F.lit(0).cast("bigint").alias("_w")))
    days = both.where(F.col("_day").isNotNull()).groupBy(*keys, "_day").agg(F.sum("_w").alias("_w"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    sums = days.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_day", F.sum("_w").over(earlier).alias(out))
    cond = [F.col(k) == F.col(f"_s_{k}") for k in keys] + [F.col(pt_day) == F.col("_day")]
    return points.join(sums, cond, "left").select(*pids, *keys, F.coalesce(out, F.lit(0)).cast("bigint").alias(out))


def _day_number(day: str) -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01"))


def _blocks_of(ranges: DataFrame, top: Column) -> DataFrame:
    """The dyadic blocks (_level, _block) that make up the days [_a, _b) of each
    row: at most two a level below the top, and all between at the top."""
    a, b = F.expr("-shiftright(-_a, _level)"), F.expr("shiftright(_b, _level)")
    odd = lambda c: F.pmod(c, F.lit(2)) == 1
    none = F.array().cast("array<int>")
    ends = F.concat(F.when(odd(a), F.array(a)).otherwise(none), F.when(odd(b), F.array(b - 1)).otherwise(none))
    return (ranges.withColumn("_level", F.explode(F.sequence(F.lit(0), top))).where(a < b)
            .withColumn("_block", F.explode(F.when(F.col("_level") == top, F.sequence(a, b - 1)).otherwise(ends))))


def _blocks_around(rows: DataFrame, top: Column) -> DataFrame:
    """The blocks (_level, _block) that hold the day _a of each row, one a level."""
    return rows.withColumn("_level", F.explode(F.sequence(F.lit(0), top))).withColumn(
        "_block", F.expr("shiftright(_a, _level)"))


def earliest_overlap(items: DataFrame, asked: DataFrame, key: str, start: str, end: str, order: str,
                     out: str = "first") -> DataFrame:
    """Per row of ``asked`` (order, key, start, end) the smallest ``order`` of the items
    of the same key that overlap it (both [start, end) in day numbers, never empty);
    rows without any are absent. No pairs: an item that overlaps either begins
    among the row's days, or holds the row's first day, and both are minima over
    dyadic blocks of days."""
    longest = items.unionByName(asked).agg(F.max(F.col(end) - F.col(start))).scalar()
    top = F.least(F.lit(TOP_LEVEL), F.ceil(F.log2(longest)).cast("int"))
    days = lambda df: df.select(order, key, F.col(start).alias("_a"), F.col(end).alias("_b"))
    tag = lambda df, kind: df.select(order, key, F.lit(kind).alias("_kind"), "_level", "_block")
    held = tag(_blocks_around(days(items), top), 0).unionByName(tag(_blocks_of(days(items), top), 1))
    least = held.groupBy(key, "_kind", "_level", "_block").agg(F.min(order).alias("_least"))
    probes = tag(_blocks_of(days(asked), top), 0).unionByName(tag(_blocks_around(days(asked), top), 1))
    return probes.join(least, [key, "_kind", "_level", "_block"]).groupBy(order).agg(F.min("_least").alias(out))


def count_inside(intervals: DataFrame, ranges: DataFrame, keys: Sequence[str], start: str, end: str, weight: str,
                 rid: str, lo: str, hi: str, out: str = "cnt") -> DataFrame:
    """Per range (rid, keys, lo, hi): sum of ``weight`` over intervals of the same
    keys strictly inside it, ``lo < start`` and ``end < hi``, where ``start <= end``
    in every interval. Ranges without any are absent.

    A two-dimensional dominance count: an interval's start lies in one block of
    2^l days for each level l; the days between lo and hi are at most two blocks a
    level; in a block the ends before hi are a cumulative count. Only intervals
    that fit into the longest range, and levels that it needs, take part."""
    keys = list(keys)
    ranges = ranges.where(F.datediff(hi, lo) >= 2).select(rid, *keys, lo, hi)
    longest = ranges.agg(F.max(F.datediff(hi, lo))).scalar()
    top = F.least(F.lit(TOP_LEVEL), F.ceil(F.log2(longest)).cast("int"))
    x = _day_number(start)
    blocks = (intervals.where(F.datediff(end, start) <= longest - 2).groupBy(*keys, start, end)
              .agg(F.sum(weight).alias("_w")).withColumn("_level", F.explode(F.sequence(F.lit(0), top)))
              .select(*keys, "_level", F.expr(f"shiftright(datediff({start}, '1970-01-01'), _level)").alias("_block"),
                      F.col(end).alias("_end"), "_w"))
    asked = _blocks_of(ranges.withColumn("_a", _day_number(lo) + 1).withColumn("_b", _day_number(hi)), top).select(
        rid, *keys, "_level", "_block", hi)
    counts = count_before(blocks, asked, [*keys, "_level", "_block"], "_end", "_w", rid, hi, out="_c")
    return counts.where("_c <> 0").groupBy(rid).agg(F.sum("_c").alias(out))


def overlap_count(stays: DataFrame, requests: DataFrame, keys: Sequence[str], rid: str, ci: str, co: str,
                  out: str = "n", requests_valid: bool = False) -> DataFrame:
    """Per request (rid, keys, ci, co), the number of stays of the same keys with
    ``s.ci < co AND s.co > ci``, whatever the order of the dates on either side;
    a NULL date overlaps nothing. No key, however hot, produces pairs:

    * stays with s.co > s.ci: #(s.ci < co) - #(s.co <= ci), to which a turned
      request (co <= ci) adds the stays inside it, subtracted twice;
    * turned stays (s.co <= s.ci) overlap the requests that they lie inside.

    ``requests_valid`` says that no request is turned."""
    keys = list(keys)
    req = requests.select(rid, *keys, ci, co).where(F.col(ci).isNotNull() & F.col(co).isNotNull())
    right, turned = stays.where(F.col(co) > F.col(ci)), stays.where(F.col(co) <= F.col(ci))
    one = F.lit(1).cast("bigint")
    ev = right.select(*keys, F.explode(F.array(
        F.struct(F.col(ci).alias("_ed"), F.lit(0).alias("_kind")),
        F.struct(F.col(co).alias("_ed"), F.lit(1).alias("_kind")))).alias("_e")).select(
        *keys, "_e._ed", "_e._kind", one.alias("_one"))
    pts = req.select(rid, *keys, F.explode(F.array(
        F.struct(F.col(co).alias("_px"), F.lit(0).alias("_kind")),
        F.struct(F.date_add(F.col(ci), 1).alias("_px"), F.lit(1).alias("_kind")))).alias("_q")).select(
        rid, *keys, "_q._px", "_q._kind")
    c = count_before(ev, pts, [*keys, "_kind"], "_ed", "_one", rid, "_px", out="_c")
    parts = [c.select(rid, F.when(F.col("_kind") == 0, F.col("_c")).otherwise(-F.col("_c")).alias("_c"))]
    before, after = F.date_sub(F.col(co), 1).alias("_lo"), F.date_add(F.col(ci), 1).alias("_hi")
    parts.append(count_inside(turned.withColumn("_one", one), req, keys, co, ci, "_one", rid, ci, co, out="_c"))
    if not requests_valid:
        back = req.where(F.col(co) <= F.col(ci)).select(rid, *keys, before, after)
        parts.append(count_inside(right.withColumn("_one", one), back, keys, ci, co, "_one", rid, "_lo", "_hi", out="_c"))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy(rid).agg(F.sum("_c").cast("bigint").alias(out))


def day_summary(stays: DataFrame, key: str, ci: str, co: str) -> DataFrame:
    """Per (key, check-in day): number of stays and latest checkout, with the
    running max checkout of *earlier* days and the next check-in day of the
    same key. The window runs over summary rows only."""
    daily = stays.groupBy(key, ci).agg(F.count(F.lit(1)).alias("_n"), F.max(co).alias("_mx"))
    w = Window.partitionBy(key).orderBy(ci)
    return (daily.withColumn("_prev_mx", F.max("_mx").over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("_next_ci", F.lead(ci).over(w)))


def overlap_flags(stays: DataFrame, key: str, ci: str, co: str, out: str = "overlaps") -> DataFrame:
    """Flag each stay that overlaps another stay of the same key (half-open
    [ci, co), requires co > ci): same check-in day with a second stay, an
    earlier stay still running at ci, or the next check-in before co."""
    s = day_summary(stays, key, ci, co)
    return (stays.join(s, [key, ci], "inner")
            .withColumn(out, (F.col("_n") >= 2) | F.coalesce(F.col("_prev_mx") > F.col(ci), F.lit(False))
                        | F.coalesce(F.col("_next_ci") < F.col(co), F.lit(False)))
            .drop("_n", "_mx", "_prev_mx", "_next_ci"))


def busy_blocks(stays: DataFrame, key: str, ci: str, co: str, merge_touching: bool = True) -> DataFrame:
    """Maximal blocks of each key's occupied nights (islands). Touching stays
    ([1,3) and [3,5)) are merged when ``merge_touching``; otherwise only
    overlapping ones (connected components of the overlap relation)."""
    s = day_summary(stays, key, ci, co)
    starts_new = (F.col("_prev_mx").isNull() | (F.col(ci) > F.col("_prev_mx")) if merge_touching
                  else F.col("_prev_mx").isNull() | (F.col(ci) >= F.col("_prev_mx")))
    w = Window.partitionBy(key).orderBy(ci)
    tagged = s.withColumn("_blk", F.sum(starts_new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return tagged.groupBy(key, "_blk").agg(F.min(ci).alias("blk_start"), F.max("_mx").alias("blk_end"))


def block_of(stays: DataFrame, key: str, ci: str, co: str, merge_touching: bool = False) -> DataFrame:
    """Attach to every stay the start day of its block (see ``busy_blocks``)."""
    s = day_summary(stays, key, ci, co)
    starts_new = (F.col("_prev_mx").isNull() | (F.col(ci) > F.col("_prev_mx")) if merge_touching
                  else F.col("_prev_mx").isNull() | (F.col(ci) >= F.col("_prev_mx")))
    w = Window.partitionBy(key).orderBy(ci)
    start_day = F.when(starts_new, F.col(ci))
    tagged = s.withColumn("block_start", F.last(start_day, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))).select(key, ci, "block_start")
    return stays.join(tagged, [key, ci], "inner")


def free_gaps(blocks: DataFrame, keys_df: DataFrame, key: str) -> DataFrame:
    """Free ranges [gap_start, gap_end) of every key in ``keys_df``: before the
    first block, between blocks, after the last; keys without blocks get one
    unbounded gap. Open ends use sentinel days. Other columns of ``keys_df``
    are carried along.

    One left join of keys to their blocks and one window (per key, over its
    blocks only) emit all gaps through an explode, so ``blocks`` is read once."""
    neg, pos = F.lit(NEG_INF_DAY).cast("date"), F.lit(POS_INF_DAY).cast("date")
    j = keys_df.join(blocks.select(key, "blk_start", "blk_end"), key, "left")
    w = Window.partitionBy(key).orderBy("blk_start")
    j = j.withColumn("_prev_end", F.lag("blk_end").over(w)).withColumn("_next", F.lead("blk_start").over(w))
    gap = lambda s, e: F.struct(s.alias("gap_start"), e.alias("gap_end"))
    gaps = F.when(F.col("blk_start").isNull(), F.array(gap(neg, pos))).otherwise(
        F.when(F.col("_next").isNull(),
               F.array(gap(F.coalesce("_prev_end", neg), F.col("blk_start")), gap(F.col("blk_end"), pos)))
        .otherwise(F.array(gap(F.coalesce("_prev_end", neg), F.col("blk_start")))))
    carry = [c for c in keys_df.columns if c != key]
    return (j.select(key, *carry, F.explode(gaps).alias("_g"))
            .select(key, *carry, "_g.gap_start", "_g.gap_end"))


def nights(stays: DataFrame, ci: str, co: str, out: str = "night") -> DataFrame:
    """One row per occupied night (bounded by stay length); none when co <= ci."""
    seq = F.when(F.col(co) > F.col(ci), F.sequence(F.col(ci), F.date_sub(F.col(co), 1)))
    return stays.withColumn(out, F.explode(seq))
