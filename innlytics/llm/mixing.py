"""Operator 13: mixing sources to target weights by weighted fair queueing
(native: DataFrame operations alone).

Sources in code-point order (NULL last) get the weights of ``WEIGHTS``, repeated. The budget is the size of
all documents together; a source's target is its share by weight, but at most ``MAX_REPEATS`` times its size,
and what is cut off goes to the others by weight until none is above.

A source sends its documents in a shuffled order, up to ``MAX_REPEATS`` times over. A copy's virtual start and
finish time are the words that its source has sent before and after it, divided by the source's target. The mix
is all copies in the order of their finish times (sorted globally in ranges of time); it is truncated where the
words sent reach the budget. Targets add up to the budget, so that is time 1: copies that finish by then are
taken whole, and of the one copy that a source is sending just then the words sent so far.

No task holds a source: running sums are taken over buckets of the shuffled order and over bins of time, and
bucket sums are summed in two levels again.

Defined cases: a NULL text has no words; a document without words is in no queue (0 words taken). NULL and
repeated doc_ids are rows of their own. The shuffled order is that of an MD5 hash of doc_id and text, so it
depends on nothing but the rows; equal rows (same id and text) stand next to each other, in the order in
which they were read. An empty table gives an empty mix. Other columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innlytics.llm.common import cut
from innlytics.plans.joins import lookup
from innlytics.plans.numbering import new_ids

#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
MAX_REPEATS = 3
#: About so many rows share a bucket of the order, and so many buckets a span of the second level.
BUCKET_ROWS, SPAN_BUCKETS = 1 << 9, 1 << 13

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, weight, source_size, target) from (source, source_size), one row a source.

    The level (words per unit of weight) rises in rounds: sources that would get more than ``repeats`` times
    their size are held there and the rest is shared by the others. A round is one aggregation over the
    sources, and each but the last holds at least one more of them."""
    order = F.struct(F.col("source").isNull().alias("last"), F.col("source").alias("at"))
    ranked = new_ids(sizes.withColumn("order", order), "order", {"rank": F.lit(0)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    held = cut(ranked.select("source", "source_size", weight.cast("long").alias("weight"),
                             (F.col("source_size") * repeats).alias("most")), "sources")
    budget = held.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, free = 0.0, None
    while True:
        # compared as products of whole numbers and one double: above the level means held
        open_ = F.col("most") > F.col("weight") * F.lit(level)
        left, units, n = held.agg(F.lit(budget) - F.coalesce(F.sum(F.when(~open_, F.col("most"))), F.lit(0)),
                                  F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0)),
                                  F.count_if(open_)).first()
        if n == free or not units:
            break
        level, free = left / units, n
    return held.select("source", "weight", "source_size", F.least(
        F.col("weight") * F.lit(float(level)), F.col("most").cast("double")).alias("target"))


def _before(rows: DataFrame, group: list[str], bucket: str, order: list[Column], amount: str, out: str) -> DataFrame:
    """Running sum of ``amount`` before each row in its group, by (bucket, order): within a bucket by a window;
    the sums of buckets, and of spans of buckets, by windows over those sums."""
    span = F.floor(F.col(bucket) / SPAN_BUCKETS)
    sums = rows.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum")).withColumn("_span", span)
    spans = sums.groupBy(*group, "_span").agg(F.sum("_sum").alias("_all"))
    rest = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_first", F.coalesce(F.sum("_all").over(
        rest(Window.partitionBy(*group).orderBy("_span"))), F.lit(0))).drop("_all")
    sums = (sums.withColumn("_in", F.coalesce(F.sum("_sum").over(
        rest(Window.partitionBy(*group, "_span").orderBy(bucket))), F.lit(0)))
        .join(spans, [*group, "_span"]).select(*group, bucket, (F.col("_first") + F.col("_in")).alias("_offset")))
    local = F.coalesce(F.sum(amount).over(rest(Window.partitionBy(*group, bucket).orderBy(*order))), F.lit(0))
    return (rows.withColumn("_local", local).join(sums, [*group, bucket])
            .withColumn(out, F.col("_offset") + F.col("_local")).drop("_local", "_offset"))


def _bits(n: int) -> int:
    """Bits of so many buckets that about BUCKET_ROWS of n rows share one."""
    return min(40, max(1, (n // BUCKET_ROWS).bit_length()))


def queue(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document, written: rid, doc_id, source, size, place (rank of the source), source_size,
    weight, target, sent (words its source sends before it in each round of its documents)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    sized = cut(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
                .withColumn("rid", F.monotonically_increasing_id()), "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, repeats)
    number = F.monotonically_increasing_id()  # an id for joins on a source, NULL included
    targets = cut(targets.withColumn("place", number), "targets")
    same = sized["source"].eqNullSafe(targets["source"])
    rows = sized.join(lookup(targets), same).select(
        sized["rid"], "doc_id", sized["source"], "size", "key", "place", "weight", "source_size", "target")
    bits = _bits(sized.count())
    bucket = F.shiftrightunsigned(F.conv(F.substring("key", 1, 10), 16, 10).cast("long"), 40 - bits)
    rows = _before(rows.withColumn("bucket", bucket), ["place"], "bucket", [F.col("key"), F.col("rid")], "size", "sent")
    return cut(rows.drop("bucket"), "queue")


def mix(queued: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix: one row per copy taken (rid, round, finish, words, position); ``position`` counts the words of
    the mix before the copy, in the order of the finish times."""
    sent = F.col("round") * F.col("source_size") + F.col("sent")
    left = F.floor(F.col("target")) - sent
    copies = (queued.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
              .withColumn("words", F.least(F.col("size"), left)).where("words > 0")
              .select("rid", "key", "place", "round", "words", ((sent + F.col("size")) / F.col("target")).alias("finish")))
    # at most one copy a source finishes after time 1
    bins = 1 << _bits(queued.count())
    copies = copies.withColumn("bin", F.least(F.floor(F.col("finish") * bins), F.lit(bins)))
    order = [F.col(c) for c in ("finish", "key", "rid", "round")]
    placed = _before(copies.withColumn("all", F.lit(0)), ["all"], "bin", order, "words", "position")
    return placed.select("rid", "round", "finish", "words", "position")


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_position) for every document; the mix is
    truncated at the budget, the size of all documents."""
    queued = queue(docs, weights, repeats)
    budget = queued.agg(F.sum("size")).scalar()
    room = F.least(F.col("words"), budget - F.col("position"))
    taken = (mix(queued, repeats).withColumn("words", room).where("words > 0").groupBy("rid")
             .agg(F.sum("words").alias("taken"), F.min("position").alias("first_position")))
    return queued.join(taken, "rid", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_position")
