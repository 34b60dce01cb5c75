"""First come, first served on several unique keys at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.plans.checkpoint import cut, drop
from innlytics.session import checkpoint_dir


def first_come(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """(order, won): rows are taken in ``order`` (all different); one wins unless
    an earlier winner holds one of its keys. NULL keys are exempt.

    Decided in rounds: the rows that are the earliest undecided ones of all
    their keys win, then the undecided ones that share a key with a winner
    lose. The earliest row always wins, so each round decides some; a round is a
    few aggregations and joins, and its decisions are added to one table, so
    that the plan of the result does not grow with the rounds. With one key the
    first round decides everything."""
    spark = rows.sparkSession
    names = [f"_k{i}" for i in range(len(keys))]
    pending = cut(rows.select(F.col(order).alias("_at"), *[F.col(k).alias(n) for k, n in zip(keys, names)]), "pending")
    decided = f"{checkpoint_dir(spark).rstrip('/')}/tables/decided-{uuid.uuid4().hex}"
    while True:
        firsts, lost = pending, F.lit(False)
        first = F.lit(True)
        for n in names:
            least = pending.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("_at").alias(f"_f{n}"))
            firsts = firsts.join(least, n, "left")
            first = first & (F.col(n).isNull() | (F.col(f"_f{n}") == F.col("_at")))
        marked = cut(firsts.select("_at", *names, first.alias("_won")), "pending")
        rest = marked.where(~F.col("_won"))
        for n in names:
            taken = marked.where(F.col("_won") & F.col(n).isNotNull()).select(n, F.lit(True).alias(f"_t{n}"))
            rest = rest.join(taken, n, "left")
            lost = lost | F.col(f"_t{n}").isNotNull()
        rest = cut(rest.select("_at", *names, lost.alias("_lost")), "pending")
        (marked.where("_won").select("_at", "_won").unionByName(rest.where("_lost").select("_at", F.lit(False).alias("_won")))
         .write.mode("append").parquet(decided))
        drop(pending)
        drop(marked)
        pending = rest.where("NOT _lost").drop("_lost")
        if pending.isEmpty():
            break
    drop(rest)
    return spark.read.parquet(decided).select(F.col("_at").alias(order), F.col("_won").alias("won"))
