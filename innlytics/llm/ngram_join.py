"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct 5-word shingles (ASCII lower case). Two
documents link when 100 * intersection >= 80 * union, so linked sets of sizes
a and b differ in at most (a + b) / 9 shingles. Sets are put into size bands;
a set emits signatures for its own band and, when a partner may lie there,
for the next. In a band the shingle domain is dealt by hash into partitions,
and a signature is the content of one non-empty partition. With k possible
differences and more than k non-empty partitions, two linked sets agree on at
least one of them: no link is lost. (The subsets of PartEnum's second level
are those of one partition: with many differences allowed, more partitions
cost fewer signatures than larger subsets.)

Common passages would make signatures that half the corpus shares. Shingles
seen often in a bounded sample (``SAMPLE_DOCS``) are therefore left out of
the domain. Leaving shingles out never adds differences, so the guarantee
stays; a set that keeps too few partitions also emits signatures over the
whole domain, and if even those are too few, one for each shingle.

A linked pair agrees on at least (non-empty partitions - possible
differences) signatures of a scheme, often dozens. Once the frequency of each
signature is known, a document therefore leaves its most frequent ones out,
one less than that number: ordered by frequency, the rarest signature that two
linked documents share stays in both. Shared passages disappear by this.

Links without all pairs: documents with the same shingle set count as one. Of
the sets that share a signature only pairs with its smallest member (the hub)
are checked, each document first with the hub it shares most with, then with
the hubs of other components. Where a family (documents connected by kept
signatures) still has more than one component, its documents outside the
largest component are compared with the family in blocks, inside tasks; only
one link between two components leaves a task. Every check is exact, on whole
sets, and no pair that could link is skipped.

Scale: signatures travel packed, bucketed by hash; a chunk of documents sends
a signature once (its other members are attached to the chunk's hub at once),
so a signature held by a third of all rows costs a task one entry a chunk.

Defined edge results: NULL and empty texts have no shingles and component_id
doc_id; rows with equal doc_id are one document (it has the links of all its
rows); a NULL doc_id links with nothing and has component_id NULL; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innlytics.llm.common import cut, drop, mix64, numbered, release, shingles, short_plans, small_batches, text_bytes, trimmed
from innlytics.plans.components import components

BAND_RATIO = 1.7
SAMPLE_DOCS = 4_000
SAMPLE_MIN = 4  # a shingle in that many sampled documents is common
MAX_COMMON = 65_536
SIGS_PER_BUCKET = 500_000
MIN_BUCKETS = 256
CHUNK_SIGS = 400_000
BROADCAST_ROWS = 200_000
BLOCK = 64  # documents on one side of a block comparison
CODE = np.uint64(0xFF)  # the low byte of a signature tells band and scheme


def band_edges(limit: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


EDGES = np.array(band_edges(), np.int64)
_SCHEME = 0xA24BAED4963EE407


def _coded(x: np.ndarray, code: int) -> np.ndarray:
    return (mix64(x + np.uint64((code + 1) * _SCHEME % (1 << 64))) & ~CODE) | np.uint64(code)


def _partitions(s: np.ndarray, n_parts: int, code: int) -> np.ndarray:
    """A signature for each non-empty partition of the sets' domain."""
    part = ((s >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    p = part[order]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    total = np.add.reduceat(mix64(s[order]), first)
    return _coded(total + mix64(p[first].astype(np.uint64)), code)


def schemes(s: np.ndarray, common: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
    """(code, signatures, least number that a linked partner shares) of each
    scheme a set of shingle hashes takes part in."""
    n, out = len(s), []
    if not n:
        return out
    rare = s
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rare = s[common[at] != s]
    own = int(np.searchsorted(EDGES, n, side="right")) - 1
    for band in (own, own + 1):
        low, high = int(EDGES[band]), int(EDGES[band + 1])
        if band > own and n * 5 // 4 < low:
            break
        k = (n + min(n * 5 // 4, high - 1)) // 9  # most differences from a partner in this band
        n_parts = -(-high // 4) + 2
        got = _partitions(rare, n_parts, 3 * band) if len(rare) else np.empty(0, np.uint64)
        out.append((3 * band, got, max(1, len(got) - k)))
        if len(got) <= k:
            whole = _partitions(s, n_parts, 3 * band + 1)
            out.append((3 * band + 1, whole, max(1, len(whole) - k)))
            if len(whole) <= k:
                out.append((3 * band + 2, _coded(s, 3 * band + 2), max(1, n - k)))
    return out


def signatures(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """All signatures of a set of shingle hashes."""
    return np.concatenate([np.empty(0, np.uint64), *[got for _, got, _ in schemes(s, common)]])


def shingle_set(b: bytes) -> np.ndarray:
    return shingles(b.lower().split())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set."""
    @trimmed
    def step(batches):
        import xxhash
        for pdf in batches:
            sets = [shingle_set(b) for b in pdf["b"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                                "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]})

    return _texts(docs).mapInPandas(step, "doc_id long, n_shingles long, digest binary")


def common_shingles(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles found often in a sample of about SAMPLE_DOCS documents (by the
    hash of their id). They only steer the choice of signatures."""
    every = max(1, n_docs // SAMPLE_DOCS)

    @trimmed
    def step(batches):
        sets = [shingle_set(b) for pdf in batches for b in pdf["b"]]
        if sets:
            s, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pd.DataFrame({"s": s.view(np.int64), "n": n})

    part = _texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInPandas(step, "s long, n long")
    top = (part.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_MIN)
           .orderBy(F.desc("n"), "s").limit(MAX_COMMON).collect())
    return np.sort(np.array([r["s"] for r in top], np.int64).view(np.uint64))


def _packed(docs: DataFrame, common: np.ndarray, n_buckets: int) -> DataFrame:
    """Signatures by bucket, packed: sig and doc (the chunk's hubs), and
    lsig, lhub, ldoc (members already attached to a hub of their chunk)."""
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))

    def flush(sig, doc, turn):
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        head = np.r_[True, sig[1:] != sig[:-1]]
        hub = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
        more = ~head & (doc != hub)
        ls, lh, ld = sig[more].view(np.int64), hub[more], doc[more]
        sig, doc = sig[head], doc[head]
        bucket = (sig >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cuts[1:], len(sig)]
        share = np.linspace(0, len(ls), len(cuts) + 1).astype(int)  # attached members go anywhere
        return pd.DataFrame({
            "bucket": bucket[cuts].astype(np.int32),
            "sig": [sig[i:j].tobytes() for i, j in zip(cuts, ends)],
            "doc": [doc[i:j].tobytes() for i, j in zip(cuts, ends)],
            "lsig": [ls[i:j].tobytes() for i, j in zip(share, share[1:])],
            "lhub": [lh[i:j].tobytes() for i, j in zip(share, share[1:])],
            "ldoc": [ld[i:j].tobytes() for i, j in zip(share, share[1:])]})

    @trimmed
    def step(batches):
        sigs, ids, held, turn = [], [], 0, 0
        for pdf in batches:
            for doc, b in zip(pdf["doc_id"], pdf["b"]):
                g = signatures(shingle_set(b), common)
                if len(g):
                    sigs.append(g)
                    ids.append(np.full(len(g), int(doc), np.int64))
                    held += len(g)
                if held >= CHUNK_SIGS:
                    yield flush(np.concatenate(sigs), np.concatenate(ids), turn)
                    sigs, ids, held, turn = [], [], 0, turn + 1
        if held:
            yield flush(np.concatenate(sigs), np.concatenate(ids), turn)

    return _texts(docs).where("doc_id IS NOT NULL").mapInPandas(
        step, "bucket int, sig binary, doc binary, lsig binary, lhub binary, ldoc binary")


def _hub_links(packed: DataFrame, n_parts: int) -> DataFrame:
    """(sig, hub, doc) for every signature with more than one document."""
    def links(sig, doc):
        sig, doc = np.concatenate(sig), np.concatenate(doc)
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        head = np.r_[True, sig[1:] != sig[:-1]]
        hub = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
        more = ~head & (doc != hub)
        return pd.DataFrame({"sig": sig[more].view(np.int64), "hub": hub[more], "doc": doc[more]})

    @trimmed
    def step(batches):
        bucket, sig, doc = None, [], []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.bucket != bucket:
                    if sig:
                        yield links(sig, doc)
                    bucket, sig, doc = r.bucket, [], []
                sig.append(np.frombuffer(r.sig, np.uint64))
                doc.append(np.frombuffer(r.doc, np.int64))
            own = [np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) if len(pdf) else np.empty(0, np.int64)
                   for c in ("lsig", "lhub", "ldoc")]
            if len(own[0]):
                yield pd.DataFrame(dict(zip(("sig", "hub", "doc"), own)))
        if sig:
            yield links(sig, doc)

    return (packed.repartition(n_parts, "bucket").sortWithinPartitions("bucket")
            .mapInPandas(step, "sig long, hub long, doc long"))


def _bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint when the frame is small (counted), else a plain join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shared_at_least(docs: DataFrame, ids: DataFrame, common: np.ndarray) -> DataFrame:
    """(node, code, least): schemes of the given documents in which a linked
    partner shares more than one signature, and how many it shares."""
    @trimmed
    def step(batches):
        for pdf in batches:
            rows = [(d, code, least) for d, b in zip(pdf["doc_id"], pdf["b"])
                    for code, _, least in schemes(shingle_set(b), common) if least > 1]
            yield pd.DataFrame(rows, columns=["node", "code", "least"]).astype("int64")

    return (_texts(docs).join(_bounded(ids), "doc_id", "left_semi")
            .mapInPandas(step, "node long, code long, least long")
            .groupBy("node", "code").agg(F.min("least").alias("least")))


def rare_members(members: DataFrame, least: DataFrame) -> DataFrame:
    """(sig, node) without the least - 1 most frequent signatures of each
    document and scheme, and without signatures that one document is left with."""
    seen = cut(members.groupBy("sig").agg(F.count(F.lit(1)).alias("f")), "sig-counts")
    order = Window.partitionBy("node", "code").orderBy(F.desc("f"), "sig")
    ranked = (members.withColumn("code", F.col("sig").bitwiseAND(0xFF)).join(seen, "sig")
              .withColumn("rank", F.row_number().over(order)).join(least, ["node", "code"], "left"))
    return cut(ranked.where(F.col("rank") >= F.coalesce("least", F.lit(1))).select("sig", "node"), "members")


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of a signature's smallest document and another
    one, with the number of signatures for which they are such a pair."""
    hubs = cut(members.groupBy("sig").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
               .select("sig", "a"), "hubs")
    return cut(members.join(hubs, "sig").where("node <> a").groupBy("a", F.col("node").alias("b"))
               .agg(F.count(F.lit(1)).alias("shared")), "hub-pairs")


def links(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact test of two shingle sets (sorted distinct hashes)."""
    if not len(x) or not len(y) or 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ok): the exact test of each pair on the whole shingle sets."""
    @trimmed
    def test(batches):
        for pdf in batches:
            yield pdf[["a", "b"]].assign(ok=[links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                                             for x, y in zip(pdf["sa"], pdf["sb"])])

    with_b = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    with_a = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    return cut(with_a.select("a", "b", "sa", "sb").mapInPandas(test, "a long, b long, ok boolean")
               .groupBy("a", "b").agg(F.max("ok").alias("ok")), "pairs-tested")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose documents are not yet in one component."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    return (pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
            .where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(*pairs.columns))


def block_links(left: list, right: list, left_root, right_root) -> list[tuple[int, int]]:
    """Index pairs (one for each pair of components) of linked sets."""
    n = len(left)
    sets = left + right
    size = np.array([len(x) for x in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    column = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    row, col = row[keep], column[at[keep]]
    both = np.zeros((n, len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = 8192  # shingles at once: a bounded matrix
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, [first, first + step])
        m = np.zeros((len(sets), step), np.float32)
        m[row[i:j], col[i:j] - first] = 1
        both += m[:n] @ m[n:].T
    union = size[:n, None] + size[None, n:] - both
    out, seen = [], set()
    for i, j in zip(*np.nonzero((100 * both >= 80 * union) & (both > 0))):
        key = (left_root[i], right_root[j])
        if key[0] != key[1] and key not in seen:
            seen.add(key)
            out.append((int(i), int(j)))
    return out


def family_links(members: DataFrame, pairs: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between different components of a family, found by
    comparing the documents outside its largest component with all of it, in
    blocks. A document is sent once for each block it meets."""
    family = components(pairs).withColumnRenamed("root", "fam")
    at = family.join(roots, "node", "left").select("fam", "node", F.coalesce("root", "node").alias("root"))
    by_root = cut(at.groupBy("fam", "root").agg(F.count(F.lit(1)).alias("n")), "family-parts")
    whole = (by_root.groupBy("fam").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"),
                                        F.count(F.lit(1)).alias("parts"), F.max("n").alias("largest"))
             .where("parts > 1").withColumn("rest", F.col("n") - F.col("largest")))
    whole = cut(whole.select("fam", "main", F.ceil(F.col("rest") / BLOCK).cast("int").alias("rest_blocks"),
                             F.ceil((F.col("n") - F.col("rest")) / BLOCK).cast("int").alias("main_blocks")), "families")
    if whole.isEmpty():
        return pairs.select("a", "b").limit(0)
    spot = F.xxhash64("node")
    placed = at.join(whole, "fam").withColumn("is_rest", F.col("root") != F.col("main"))
    mine = F.pmod(spot, F.when(F.col("is_rest"), F.col("rest_blocks")).otherwise(F.col("main_blocks"))).cast("int")
    placed = placed.withColumn("mine", mine).join(sets.select(F.col("doc_id").alias("node"), "s"), "node")
    # blocks of the rest are numbered 0..rest_blocks - 1, those of the main part below zero
    meets = F.when(F.col("is_rest"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda k: F.struct(
            F.least(F.col("mine"), k).alias("x"), F.greatest(F.col("mine"), k).alias("y"), (F.col("mine") <= k).alias("left"))),
        F.transform(F.sequence(F.lit(1), F.col("main_blocks")), lambda k: F.struct(
            F.col("mine").alias("x"), (-k).alias("y"), F.lit(True).alias("left")))
    )).otherwise(F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda k: F.struct(
        k.alias("x"), (-F.col("mine") - 1).alias("y"), F.lit(False).alias("left"))))
    sent = placed.select("fam", "node", "root", "s", F.explode(meets).alias("m")).select(
        "fam", "m.x", "m.y", "m.left", "node", "root", "s")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets_ = [np.frombuffer(x, np.uint64) for x in pdf["s"]]
        node, root = pdf["node"].to_numpy(), pdf["root"].to_numpy()
        if pdf["x"].iloc[0] == pdf["y"].iloc[0]:  # a block with itself
            li = ri = np.arange(len(pdf))
        else:
            li, ri = np.flatnonzero(pdf["left"]), np.flatnonzero(~pdf["left"])
        out = []
        for i in range(0, len(li), BLOCK):
            for j in range(0, len(ri), BLOCK):
                x, y = li[i:i + BLOCK], ri[j:j + BLOCK]
                out += [(node[x[p]], node[y[q]]) for p, q in block_links(
                    [sets_[k] for k in x], [sets_[k] for k in y], root[x], root[y])]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return sent.groupBy("fam", "x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    small_batches(docs.sparkSession)
    with short_plans(docs.sparkSession):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    meta = cut(sizes(docs), "set-sizes")
    total = meta.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("s")).first()
    # equal sets are one: the smallest id stands for them
    equal = cut(meta.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest")
                .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).where("rep <> other")
                .select("digest", "rep"), "equal-sets")
    meta = cut(meta.join(equal, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "sets")
    copies = cut(meta.where("rep <> doc_id").select("doc_id", "rep").distinct(), "set-copies")
    n_buckets = MIN_BUCKETS
    while n_buckets * SIGS_PER_BUCKET < total["s"] // 2:
        n_buckets *= 2
    common = common_shingles(docs, total["n"])
    raw = cut(_hub_links(_packed(docs, common, n_buckets), n_buckets), "hub-links")
    release(spark)
    held = raw.select("sig", F.col("doc").alias("doc_id")).union(raw.select("sig", "hub"))
    members = cut(held.join(copies, "doc_id", "left").select("sig", F.coalesce("rep", "doc_id").alias("node")).distinct(),
                  "members")
    drop(raw)
    ids = cut(members.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    kept = rare_members(members, cut(shared_at_least(docs, ids, common), "least"))
    drop(members)
    pairs = hub_pairs(kept)
    release(spark)
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "nodes")

    @trimmed
    def as_sets(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "s": [shingle_set(b).tobytes() for b in pdf["b"]]})

    sets = cut(_texts(docs).join(_bounded(ids), "doc_id", "left_semi").mapInPandas(as_sets, "doc_id long, s binary"),
               "pair-sets")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    tested = verified(sets, best)
    roots = cut(components(tested.where("ok")), "roots")
    again = verified(sets, _across(pairs.select("a", "b"), roots).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    good = tested.union(again).where("ok").select("a", "b")
    roots = cut(components(good), "roots")
    more = cut(family_links(kept, pairs, roots, sets), "family-links")
    drop(sets)
    joined = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(good).union(more)
    final = cut(components(joined), "classes")
    release(spark)
    return meta.join(final.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each component of rows the one with the smallest (doc_id, row id), all
    columns. Every row is a document of its own, also with a NULL or repeated id."""
    rows, rid = numbered(docs)
    linked = near_duplicates(rows.select(F.col(rid).alias("doc_id"), "text")).select(
        F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(rid).alias("row"), F.col("doc_id").cast("long").alias("id"))
    classes = cut(linked.join(ids, "row"), "near-classes")
    stays = classes.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select(
        F.col("first.row").alias("row"))
    gone = _bounded(cut(classes.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(rid)), "near-copies"))
    return rows.join(gone, rid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
