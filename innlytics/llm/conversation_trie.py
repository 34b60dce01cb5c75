"""Operator 12: prefix trie of conversations.

Distinct turns (role and text) get a dictionary code; a conversation is its array of codes, and equal arrays
become one row. The arrays are dealt in ranges of their order. A task builds a ternary search tree of one range
shard at a time: of each range of siblings the median is inserted first, so that the links to smaller and larger
codes stay balanced, and the link in the middle leads to the next turn. An iterative walk then adds up members,
leaves and savings from the leaves up.

A node whose conversations lie in several shards (its path is shared by the last array of one shard and the
first of the next) is a boundary node; the root always is one. Shards return what they hold of it, and the parts
are merged by its path's digest: members, leaves and children are sums (less the children counted in several
shards). A boundary node's own saving is known only then; it belongs to all boundary nodes above it. In the
order of the trie those below a node are neighbours: those that begin in its first shard at its depth or deeper,
and those that begin in later shards but before its last. So running sums over shards, and over depths within a
shard, give them.

Defined cases: turns stand in the order of ``turn`` (NULL first), equal ones in that of a digest of role and
text; a NULL role or text is empty. Rows with a NULL conv_id belong to no conversation and are left out. An
empty table has no conversation and no node. Other columns do not matter. A conversation's codes (not its
texts) are held as one array, and a shard's arrays by one task; the ids of equal conversations never are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innlytics.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: A conversation is rebuilt on the first turns of the one whose id is the next lower multiple of this.
FAMILY = 20
#: At most this many turns less one are taken from there.
HEADS = 4
#: About so many turns make a shard.
SHARD_TURNS = 250_000
#: Ids of equal conversations are gathered in blocks of so many consecutive ids.
BLOCK_IDS = 4096

NODE_SCHEMA = ("shard long, key binary, up_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
               "n_children long, n_leaves long, saved long, words long, ends string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, codes, words): the dictionary codes of its turns in order, and the words of each."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = cut(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n")), "turns")
    codes = cut(turns.groupBy("digest").agg(F.first("n").alias("words"))
                .withColumn("code", F.monotonically_increasing_id()), "codes")
    at = F.sort_array(F.collect_list(F.struct("turn", "digest", "code", "words")))
    return (turns.join(codes, "digest").groupBy("conv_id").agg(at.alias("at"))
            .select("conv_id", F.col("at.code").alias("codes"), F.col("at.words").alias("words")))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation with its first turns (none to HEADS - 1, by the crc32 of its id) replaced by those of
    the conversation that heads its family; that one may have fewer, or be absent."""
    seqs = cut(seqs, "sequences")
    head = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = seqs.where(head == F.col("conv_id")).select(
        F.col("conv_id").alias("head"), *[F.slice(c, 1, HEADS - 1).alias(f"head_{c}") for c in ("codes", "words")])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.array().cast("array<bigint>")
    turn = lambda c: F.concat(F.slice(F.coalesce(f"head_{c}", none), F.lit(1), h),
                              F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))).alias(c)
    return seqs.join(heads, head == F.col("head"), "left").select("conv_id", turn("codes"), turn("words"))


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per array of codes from its blocks of ids, sorted by (codes, block)."""
    last, row, digest = None, None, None
    for pdf in batches:
        out = []
        for codes, words, n, conv, ids in zip(pdf["codes"], pdf["words"], pdf["n"].tolist(), pdf["conv_id"].tolist(),
                                              pdf["ids"].tolist()):
            this = codes.tobytes()
            if this == last:
                digest.update(b"," + ids.encode())
                row[2] += n
                continue
            if row:
                out.append((*row, digest.hexdigest()))
            last, row, digest = this, [codes, words, n, conv], hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["codes", "words", "n", "conv_id", "ends"])
    if row:
        yield pd.DataFrame([(*row, digest.hexdigest())], columns=["codes", "words", "n", "conv_id", "ends"])


def unique_sequences(seqs: DataFrame) -> DataFrame:
    """(codes, words, n, conv_id, ends): each distinct array once, with the number of its conversations, their
    smallest id, and the SHA-256 of their ids in order, joined by commas."""
    blocks = seqs.withColumn("block", F.floor(F.col("conv_id") / BLOCK_IDS)).groupBy("codes", "block").agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    return (blocks.repartition("codes").sortWithinPartitions("codes", "block")
            .select("codes", "words", "n", "conv_id", "ids")
            .mapInPandas(_endings, "codes array<long>, words array<long>, n long, conv_id long, ends string"))


def _common(a: list, b: list | None) -> int:
    """Length of the common beginning; -1 if there is no second array."""
    if b is None:
        return -1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _path_keys(codes: list, depth: int) -> list[bytes]:
    """Digests of the beginnings of 0 to ``depth`` codes."""
    h = hashlib.sha256()
    out = [h.digest()]
    for c in codes[:max(depth, 0)]:
        h.update(c.to_bytes(8, "big", signed=True))
        out.append(h.digest())
    return out


class SearchTree:
    """Ternary search tree of sorted distinct arrays of codes. Node k stands for a beginning: ``up[k]`` is the
    beginning one turn shorter (-1: the root), rows ``first[k]`` to ``last[k]`` - 1 start with it."""

    def __init__(self, seqs: list[list[int]]):
        self.code, self.depth, self.up, self.first, self.last = [], [], [], [], []
        self.low, self.next, self.high = [], [], []
        links = (self.low, self.next, self.high)
        self.root = -1
        start = 1 if seqs and not seqs[0] else 0
        todo = [(start, len(seqs), 0, -1, -1, 1)] if start < len(seqs) else []
        while todo:
            a, b, d, up, at, side = todo.pop()
            middle = (a + b) // 2
            code = seqs[middle][d]
            i = bisect_left(seqs, code, a, middle, key=lambda s: s[d])
            j = bisect_right(seqs, code, middle, b, key=lambda s: s[d])
            k = len(self.code)
            for values, value in ((self.code, code), (self.depth, d + 1), (self.up, up), (self.first, i), (self.last, j),
                                  (self.low, -1), (self.next, -1), (self.high, -1)):
                values.append(value)
            if at < 0:
                self.root = k
            else:
                links[side][at] = k
            if a < i:
                todo.append((a, i, d, up, k, 0))
            if j < b:
                todo.append((j, b, d, up, k, 2))
            inner = i + (len(seqs[i]) == d + 1)  # an array that ends here stands first
            if inner < j:
                todo.append((inner, j, d + 1, k, k, 1))

    def walk(self) -> list[int]:
        """All nodes, each after the one above it in the trie."""
        order, todo = [], [self.root] if self.root >= 0 else []
        while todo:
            k = todo.pop()
            order.append(k)
            todo.extend(x for x in (self.high[k], self.next[k], self.low[k]) if x >= 0)
        return order


def _shard_nodes(shard: int, before: list | None, after: list | None, rows: list[tuple]) -> pd.DataFrame:
    """The nodes of one shard; rows: (codes, words, n, conv_id, ends), sorted."""
    seqs = [r[0] for r in rows]
    left, right = _common(seqs[0], before), _common(seqs[-1], after)
    left_keys, right_keys = _path_keys(seqs[0], left), _path_keys(seqs[-1], right)
    tree = SearchTree(seqs)
    size = len(tree.code)
    # at index -1 (the last): the root
    key = [None] * size + [left_keys[0]]
    words, conv, ends = [0] * (size + 1), [None] * (size + 1), [None] * (size + 1)
    members, children, leaves, saved = ([0] * (size + 1) for _ in range(4))
    if not seqs[0]:
        members[-1], conv[-1], ends[-1] = rows[0][2:]
    order = tree.walk()
    for k in reversed(order):
        d, i = tree.depth[k], tree.first[k]
        if len(seqs[i]) == d:
            own, least, ends[k] = rows[i][2:]
            members[k] += own
            conv[k] = least if conv[k] is None else min(conv[k], least)
        words[k] = rows[i][1][d - 1]
        if i == 0 and d <= left:
            key[k] = left_keys[d]
        elif tree.last[k] == len(rows) and d <= right:
            key[k] = right_keys[d]
        else:
            saved[k] += (members[k] - 1) * words[k]
            leaves[k] = leaves[k] or 1
        up = tree.up[k]
        members[up] += members[k]
        children[up] += 1
        leaves[up] += leaves[k]
        saved[up] += saved[k]
        conv[up] = conv[k] if conv[up] is None else min(conv[up], conv[k])
    out = [(shard, key[-1], None, conv[-1], 0, None, members[-1], children[-1], leaves[-1], saved[-1], 0, ends[-1])]
    for k in order:
        up = tree.up[k]
        out.append((shard, key[k], key[up], conv[k], tree.depth[k], conv[up] if key[up] is None else None, members[k],
                    children[k], leaves[k], saved[k], words[k], ends[k]))
    pdf = pd.DataFrame(out, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
    return pdf.astype({"conv_id": "Int64", "parent_conv_id": "Int64"})


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (shard, kind, codes): kind 0 is the array before the shard, 2 the one after it."""
    shard, before, after, rows = None, None, None, []
    for pdf in batches:
        for s, kind, codes, words, n, conv, ends in zip(
                pdf["shard"].tolist(), pdf["kind"].tolist(), pdf["codes"], pdf["words"], pdf["n"].tolist(),
                pdf["conv_id"].tolist(), pdf["ends"].tolist()):
            if s != shard:
                if rows:
                    yield _shard_nodes(shard, before, after, rows)
                shard, before, after, rows = s, None, None, []
            if kind == 0:
                before = codes.tolist()
            elif kind == 2:
                after = codes.tolist()
            else:
                rows.append((codes.tolist(), words.tolist(), n, conv, ends))
    if rows:
        yield _shard_nodes(shard, before, after, rows)


def _trees(seqs: DataFrame, shard_turns: int) -> DataFrame:
    """NODE_SCHEMA rows of all shards; boundary nodes have a key."""
    spark = seqs.sparkSession
    unique = cut(unique_sequences(seqs), "unique")
    turns = unique.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // shard_turns + 1)
    dealt = cut(unique.repartitionByRange(n, "codes").withColumn("shard", F.spark_partition_id().cast("long")), "shards")
    in_order = Window.orderBy("shard")  # one row a shard
    ends = dealt.groupBy("shard").agg(F.min("codes").alias("least"), F.max("codes").alias("most")).select(
        "shard", F.lag("most").over(in_order).alias("before"), F.lead("least").over(in_order).alias("after"))
    none = F.array().cast("array<bigint>")
    mark = lambda kind, c: ends.where(F.col(c).isNotNull()).select(
        "shard", F.lit(kind).alias("kind"), F.col(c).alias("codes"), none.alias("words"), F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("conv_id"), F.lit("").alias("ends"))
    rows = (dealt.select("shard", F.lit(1).alias("kind"), "codes", "words", "n", "conv_id", "ends")
            .unionByName(mark(0, "before")).unionByName(mark(2, "after")))
    return cut(rows.repartition(n, "shard").sortWithinPartitions("shard", "kind", "codes")
               .mapInPandas(_shards, NODE_SCHEMA), "nodes")


def prefix_trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id, codes, words; one row a conversation): conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = _trees(seqs, shard_turns)
    parts = nodes.where(F.col("key").isNotNull())
    merged = cut(parts.groupBy("key").agg(
        F.min("shard").alias("begin"), F.max("shard").alias("end"), F.count(F.lit(1)).alias("parts"),
        F.max("up_key").alias("up_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("words").alias("words"), F.max("ends").alias("ends"))
        .withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "boundary")
    # own savings of the boundary nodes that begin before a shard, and until its end
    begun = merged.groupBy(F.col("begin").alias("shard")).agg(F.sum("own").alias("begun"))
    until = F.sum(F.coalesce("begun", F.lit(0))).over(Window.orderBy("shard"))  # one row a shard
    sums = parts.where("depth = 0").select("shard").join(begun, "shard", "left").select(
        "shard", until.alias("until"), (until - F.coalesce("begun", F.lit(0))).alias("before"))
    deeper = F.sum("own").over(Window.partitionBy("begin").orderBy(F.desc("depth")))
    below = (merged.withColumn("deeper", deeper)
             .join(sums.select(F.col("shard").alias("begin"), "until"), "begin")
             .join(sums.select(F.col("shard").alias("end"), "before"), "end")
             .withColumn("saved_tokens", F.col("saved") + F.col("deeper") + F.when(
                 F.col("end") > F.col("begin"), F.col("before") - F.col("until")).otherwise(0)))
    twice = merged.where("up_key is not null").groupBy(F.col("up_key").alias("key")).agg(F.sum(F.col("parts") - 1).alias("twice"))
    parents = merged.select(F.col("key").alias("up_key"), F.col("conv_id").alias("parent_conv_id"))
    boundary = below.join(twice, "key", "left").join(parents, "up_key", "left").withColumn(
        "n_children", F.col("n_children") - F.coalesce("twice", F.lit(0))).withColumn(
        "n_leaves", F.greatest("n_leaves", F.lit(1)))
    # each shard's own copy of a boundary node's id: its many children are joined shard by shard
    local = parts.select("shard", F.col("key").alias("up_key")).join(parents, "up_key")
    inner = nodes.where("key is null").withColumn("saved_tokens", F.col("saved"))
    hung = inner.where("up_key is not null").drop("parent_conv_id").join(local, ["shard", "up_key"])
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    return inner.where("up_key is null").select(*cols).unionByName(hung.select(*cols)).unionByName(boundary.select(*cols))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_trie(rebuilt(sequences(conversations)), shard_turns)
