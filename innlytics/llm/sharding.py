"""Sharding by balanced label propagation under the ``rows`` law.

Every document starts in the shard its id hashes to. In each round a Spark
job counts, for each group of linked documents, the members in each shard
(map-side combined: at most shards rows a group), names the group's target
shards (those with most members and room, as many as the group needs) and
lets the members elsewhere ask to move there. The flows between shards (at most
shards**2 numbers) are held against the shards' capacity, and each flow is
let through up to its quota. Rounds end when no member is left outside its
group's target, or when several in a row brought none there. At last the
counts are made at most one apart: each shard's rows are numbered with its
unlinked rows last, those beyond its quota fill the shards that have room.
The numbering runs in blocks, so no task sorts a whole shard.

Groups may be of any size: one larger than a shard is spread over as many
target shards as it fills.

Defined edge results: NULL text has size 16 and crc32 0; NULL doc_ids and
repeated rows are rows like others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innlytics.llm.common import cut, drop

#: Rounds in a row, each with other draws, that bring no group together, after which those left find no room.
IDLE_ROUNDS = 4
ROWS_PER_BLOCK = 20_000


def _hash_share(*cols) -> Column:
    """A number in [0, 1) made from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _allowed(flows: dict[tuple[int, int], int], sizes: list[int], cap: float) -> dict[tuple[int, int], float]:
    """The share of each flow (from, to) that may move: what stays in a shard
    and what comes in may not go over its capacity. Outflows give room too,
    but only as far as they are let through themselves."""
    n = len(sizes)
    into = [0] * n
    for (_, t), c in flows.items():
        into[t] += c
    share = [1.0] * n
    for _ in range(20):  # shrink until no shard is over its capacity
        out = [0.0] * n
        for (f, t), c in flows.items():
            out[f] += c * share[t]
        new = [min(1.0, max(0.0, (cap - sizes[t] + out[t]) / into[t])) if into[t] else 0.0 for t in range(n)]
        if all(abs(a - b) < 1e-6 for a, b in zip(new, share)):
            break
        share = [min(a, b) for a, b in zip(new, share)]
    return {(f, t): share[t] for (f, t) in flows}


def propagate(rows: DataFrame, n_shards: int, idle_rounds: int = IDLE_ROUNDS) -> DataFrame:
    """``rows`` has a unique column rid and a column link (documents with equal
    link are linked; NULL: none). Returns (rid, linked, shard, slot)."""
    start = F.pmod(F.xxhash64("rid", F.lit(17)), F.lit(n_shards)).cast("int")
    many = (rows.where("link IS NOT NULL").groupBy("link").agg(F.count(F.lit(1)).alias("members"))
            .where("members > 1"))
    state = cut(rows.join(many, "link", "left").select(
        "rid", F.when(F.col("members").isNotNull(), F.col("link")).alias("link"), "members", start.alias("shard")),
        "shards")
    total = sum(_sizes(state, n_shards))
    cap = max(1, total // n_shards)  # of linked rows: the others make room for them at last
    sizes = _sizes(state.where("link IS NOT NULL"), n_shards)
    turn, fewest, idle = 0, total + 1, 0
    while True:
        turn += 1
        linked = state.where("link IS NOT NULL")
        held = linked.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("c"), F.first("members").alias("members"))
        # a shard draws a group by its members there and by the room it has left
        room = F.element_at(F.array(*[F.lit(0.05 + max(0.0, 1 - x / cap)) for x in sizes]), F.col("shard") + 1)
        pull = F.struct((F.col("c") * room).alias("pull"), F.xxhash64("link", "shard", F.lit(turn)).alias("tie"), "shard")
        # the array has n_shards entries at most
        targets = cut(held.groupBy("link").agg(F.sort_array(F.collect_list(pull), asc=False).alias("by"),
                                            F.first("members").alias("m"))
                   .select("link", F.slice("by.shard", F.lit(1), F.ceil(F.col("m") / F.lit(cap)).cast("int")).alias("to")),
            "targets")
        pick = F.element_at("to", (F.pmod(F.xxhash64("rid", F.lit(turn)), F.size("to")) + 1).cast("int"))
        wants = cut(linked.join(targets, "link").where(~F.array_contains("to", F.col("shard")))
                    .select("rid", "link", "members", F.col("shard").alias("f"), pick.alias("t")), "moves")
        flows = {(r["f"], r["t"]): r["c"] for r in wants.groupBy("f", "t").agg(F.count(F.lit(1)).alias("c")).collect()}
        waiting = sum(flows.values())
        fewest, idle = min(fewest, waiting), 0 if waiting < fewest else idle + 1
        if not flows or idle == idle_rounds:
            break
        share = _allowed(flows, sizes, cap)
        quota = F.element_at(F.array(*[F.lit(share.get((f, t), 0.0)) for f in range(n_shards) for t in range(n_shards)]),
                             F.col("f") * n_shards + F.col("t") + 1)
        # a group goes as a whole, or row by row if it is larger than a shard
        draw = F.when(F.col("members") > cap, _hash_share("rid", F.lit(turn))).otherwise(_hash_share("link", F.lit(turn)))
        moved = wants.where(draw < quota).select("rid", F.col("t").alias("new"))
        old, state = state, cut(state.join(moved, "rid", "left").select(
            "rid", "link", "members", F.coalesce("new", "shard").alias("shard")), "shards")
        drop(old)
        sizes = _sizes(state.where("link IS NOT NULL"), n_shards)
    return _even(state, n_shards, _sizes(state, n_shards))


def _sizes(state: DataFrame, n_shards: int) -> list[int]:
    got = {r["shard"]: r["c"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    return [got.get(s, 0) for s in range(n_shards)]


def _even(state: DataFrame, n_shards: int, sizes: list[int]) -> DataFrame:
    """Counts at most one apart, slots gapless from 0 in each shard."""
    total = sum(sizes)
    blocks = max(8, -(-total // (n_shards * ROWS_PER_BLOCK)))
    last = F.col("link").isNull().cast("int")
    tagged = state.withColumn("blk", (last * blocks + F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(blocks))).cast("int"))
    counts = tagged.groupBy("shard", "blk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "blk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    ranked = tagged.withColumn("r", F.row_number().over(Window.partitionBy("shard", "blk").orderBy("rid")) - 1)
    ranked = ranked.join(offsets, ["shard", "blk"]).withColumn("r", F.col("r") + F.col("off"))
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    over, free, room = [], [], 0
    gone = 0
    for s in range(n_shards):
        over.append(gone)
        gone += max(0, sizes[s] - quota[s])
        if quota[s] > sizes[s]:
            free.append((room, s, sizes[s]))
            room += quota[s] - sizes[s]
    at = lambda xs: F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("shard") + 1)
    spare = F.when(F.col("r") >= at(quota), at(over) + F.col("r") - at(quota))  # number among the rows that must go
    if not free:
        return ranked.select("rid", "link", "shard", F.col("r").cast("long").alias("slot"))
    picked = ranked.withColumn("spare", spare)
    # the last shard with room whose range begins at or before the number
    arr = F.array(*[F.struct(F.lit(int(a)).cast("long").alias("a"), F.lit(s).alias("s"), F.lit(int(h)).cast("long").alias("h"))
                    for a, s, h in free])
    hit = F.element_at(F.filter(arr, lambda x: x["a"] <= F.col("spare")), -1)
    picked = picked.withColumn("hit", F.when(F.col("spare").isNotNull(), hit))
    return picked.select(
        "rid", "link", F.coalesce("hit.s", "shard").alias("shard"),
        F.when(F.col("spare").isNull(), F.col("r")).otherwise(F.col("spare") - F.col("hit.a") + F.col("hit.h"))
        .cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Equal texts are linked. One row per document: doc_id, size, text_crc32,
    law ('rows'), shard, slot, grown_shard (NULL under this law)."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    # rid tells repeated rows apart; it is written once, so it is fixed
    base = cut(docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"),
                           F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("link"),
                           F.monotonically_increasing_id().alias("rid")), "shard-base")
    placed = propagate(base.select("rid", "link"), n_shards)
    return base.select("doc_id", "size", "text_crc32", "rid").join(
        placed.select("rid", "shard", "slot"), "rid").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
