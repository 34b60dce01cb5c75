"""Operator 11: groups of spelling variants by a trie of letter counts.

Words are arranged by their numbers of letters: first the length, then the counts of four coarse letter groups,
then those of finer groups (a letter each, accented ones in six). One inserted letter is a surplus of one in one
group, one deleted letter a deficit of one, one replaced letter both at most, in coarse and in fine groups. So the
near words of a word lie below few nodes of the trie, and a depth-first search that may spend a surplus and a
deficit of one reaches all of them; words at the leaves are compared letter by letter.

The top of the trie (length and coarse counts) is the key of a shard. A word is stored once and asked for in the
shards that its budget can reach, in one direction only (longer words, or the same length and a key not below its
own), so that each near pair is found once. A shard of many words is split by hash, and every part is asked; a
task holds the words of one part and streams the words that ask, a block of them down the trie at a time. A leaf of
very many words (equal counts of all letters) is looked up by its words without one letter, never pair by pair.

A word's form is its near word that occurs most, if it does so ``RATIO`` times as often at least; following
forms, found by doubling, leads to its root.

Defined cases: a NULL text has no words, a NULL doc_id counts as an empty one; repeated rows count each time; an
empty table has no words. Ties between near words of equal count go to the smallest in code-point order. Runs of
any length are held whole. Other columns do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.llm.common import cut, drop

#: A run of letters (fixed by the contract).
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many (document, run) pairs loses a letter.
DAMAGE = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Letters of the first three coarse groups, about equally frequent; all others are the fourth.
COARSE = ("eay", "tinc", "osrhl")
ACCENTED = 6
#: Words stored in one part of a shard, and words of a leaf that are compared one by one.
PART_WORDS = 20_000
LEAF_WORDS = 256
#: Bytes compared at once; below so many a node is compared as a whole.
BLOCK_BYTES, NODE_BYTES = 1 << 22, 1 << 14

COUNTS = [f"c{i}" for i in range(len(COARSE))]
KEY = ["size", *COUNTS]


def spellings(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(doc_id, word) of every run of every whole text, lower-cased (A-Z alone) and damaged by the rule: if
    ``damage`` divides the CRC-32 of ``<doc_id>:<run>``, the code point at that number modulo length goes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    run, word = F.col("run"), F.col("word")
    # lower() of ASCII letters does what translate() does
    lower = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (F.col("h") % F.length(word)).cast("int")
    cut_one = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return (docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
            .select("doc_id", lower.alias("word")).withColumn("h", h)
            .select("doc_id", F.when(F.col("h") % damage == 0, cut_one).otherwise(word).alias("word")))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words long and frequent enough."""
    return (spellings(docs).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def _matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of bytes (their code points, all below 256)."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _fine_groups() -> np.ndarray:
    """Fine group of each code point."""
    group = 26 + np.arange(256) % ACCENTED
    for i, c in enumerate(LOWER):
        group[ord(c)] = i
    return group


def _vectors(matrix: np.ndarray) -> np.ndarray:
    """Count of each fine group, one row a word."""
    groups, rows = _fine_groups(), np.arange(len(matrix))
    out = np.zeros((len(matrix), 26 + ACCENTED), np.int32)
    for column in matrix.T:
        out[rows, groups[column]] += 1
    return out


def routes(words: DataFrame) -> DataFrame:
    """(size, c0.., kind, word, n): each word once as stored (kind 0), asking in its own shard (1), and asking in
    the other shards that a budget of one surplus and one deficit reaches (2)."""
    size = F.length("word")
    counts = [(size - F.length(F.translate("word", group, ""))).cast("int") for group in COARSE]
    here = words.select("word", "n", size.alias("size"), *[c.alias(x) for c, x in zip(counts, COUNTS)])
    n = len(COARSE) + 1
    moves = [(0, 0, [0] * n), (1, 0, [0] * n)]
    for i in range(n):  # one more letter, in group i
        moves.append((2, 1, [int(k == i) for k in range(n)]))
    for i in range(n):  # one more in group i, one less in a later group
        moves += [(2, 0, [int(k == i) - int(k == j) for k in range(n)]) for j in range(i + 1, n)]
    options = F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("size") + more).alias("size"),
                                 *[(F.col(x) + d).alias(x) for x, d in zip(COUNTS, change)]) for kind, more, change in moves])
    out = here.select("word", "n", F.explode(options).alias("to")).select("word", "n", "to.*")
    rest = F.col("size")
    for x in COUNTS:
        rest = rest - F.col(x)
    return out.where((F.least(*COUNTS) >= 0) & (rest >= 0))


class CountTrie:
    """Words of one length, sorted by the counts of their fine groups (those that differ most come first)."""

    def __init__(self, words: list[bytes]):
        matrix = _matrix(words)
        vectors = _vectors(matrix)
        self.levels = np.argsort(-vectors.var(axis=0), kind="stable")
        vectors = vectors[:, self.levels]
        order = np.lexsort(vectors.T[::-1])
        self.order, self.matrix, self.vectors = order, matrix[order], vectors[order]
        self.words = [words[i] for i in order]

    def near(self, asking: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``asking``, place in the words given) one letter apart; ``asking`` has words of the
        same length, or all one letter shorter."""
        matrix = _matrix(asking)
        vectors = _vectors(matrix)[:, self.levels]
        size = self.matrix.shape[1]
        same = matrix.shape[1] == size
        m = len(asking)
        found_a, found_w = [], []
        todo = [(0, len(self.words), 0, np.arange(m), np.ones(m, np.int8), np.full(m, int(same), np.int8))]
        while todo:
            lo, hi, level, who, surplus, deficit = todo.pop()
            leaf = level == len(self.levels)
            if leaf and hi - lo > LEAF_WORDS:
                pairs = self._without_one(lo, hi, [asking[i] for i in who], who, same)
            elif leaf or hi - lo <= 4 or len(who) * (hi - lo) * size <= NODE_BYTES:
                pairs = self._verified(matrix, who, lo, hi, same)
            else:
                column = self.vectors[lo:hi, level]
                ends = np.append(np.flatnonzero(column[1:] != column[:-1]) + 1, hi - lo)
                a = 0
                for b in ends.tolist():
                    change = column[a] - vectors[who, level]
                    s, d = surplus - np.maximum(change, 0), deficit - np.maximum(-change, 0)
                    keep = (s >= 0) & (d >= 0)
                    if keep.any():
                        todo.append((lo + a, lo + b, level + 1, who[keep], s[keep], d[keep]))
                    a = b
                continue
            found_a.append(pairs[0])
            found_w.append(pairs[1])
        if not found_a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_a), self.order[np.concatenate(found_w)]

    def _verified(self, matrix: np.ndarray, who: np.ndarray, lo: int, hi: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ``who`` with the words lo to hi, compared letter by letter in blocks."""
        width, total = hi - lo, len(who) * (hi - lo)
        step = max(1, BLOCK_BYTES // self.matrix.shape[1])
        out_a, out_w = [], []
        for start in range(0, total, step):
            pair = np.arange(start, min(start + step, total))
            a, w = who[pair // width], lo + pair % width
            if same:
                ok = (matrix[a] != self.matrix[w]).sum(axis=1) == 1
            else:
                short, long = matrix[a], self.matrix[w]
                head = short == long[:, :-1]
                tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1)[:, ::-1]
                first = np.where(head.all(axis=1), head.shape[1], head.argmin(axis=1))
                rest = np.append(tail, np.ones((len(a), 1), bool), axis=1)
                ok = rest[np.arange(len(a)), first]
            out_a.append(a[ok])
            out_w.append(w[ok])
        return np.concatenate(out_a), np.concatenate(out_w)

    def _without_one(self, lo: int, hi: int, asking: list[bytes], who: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same pairs by words without one letter (and its place, for equal lengths)."""
        table = defaultdict(list)
        for w in range(lo, hi):
            word = self.words[w]
            for p in range(len(word)):
                table[(p if same else -1, word[:p] + word[p + 1:])].append(w)
        pairs = set()
        for i, word in zip(who.tolist(), asking):
            if same:
                for p in range(len(word)):
                    pairs.update((i, w) for w in table.get((p, word[:p] + word[p + 1:]), ()) if self.words[w] != word)
            else:
                pairs.update((i, w) for w in table.get((-1, word), ()))
        both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near pairs, each in both directions, from rows sorted by (KEY, part, kind)."""
    at, words, counts, trie = None, [], [], None
    for pdf in batches:
        head = pdf[[*KEY, "part", "kind"]].to_numpy()
        text = [w.encode("latin-1") for w in pdf["word"].tolist()]
        n = pdf["n"].tolist()
        ends = np.append(np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1, len(head)).tolist()
        out = []
        a = 0
        for b in ends:
            place, kind = tuple(head[a, :-1].tolist()), head[a, -1]
            if place != at:
                at, words, counts, trie = place, [], [], None
            if kind == 0:
                words += text[a:b]
                counts += n[a:b]
            elif words:
                trie = trie or CountTrie(words)
                for size in (place[0], place[0] - 1):
                    own = [i for i in range(a, b) if len(text[i]) == size]
                    if not own:
                        continue
                    for i, w in zip(*(x.tolist() for x in trie.near([text[i] for i in own]))):
                        i = own[i]
                        if kind == 2 or text[i] < words[w]:
                            x, y = text[i].decode("latin-1"), words[w].decode("latin-1")
                            out += [(x, n[i], y, counts[w]), (y, counts[w], x, n[i])]
            a = b
        yield pd.DataFrame(out, columns=["word", "n", "near", "near_n"])


def near_pairs(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of words (word, n) one letter apart."""
    sent = cut(routes(words), "routes")
    parts = sent.where("kind = 0").groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / part_words).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    asked = F.when(F.col("kind") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (sent.join(parts, KEY).select(*KEY, "kind", "word", "n", F.explode(asked).alias("part"))
            .repartition(n, *KEY, "part").sortWithinPartitions(*KEY, "part", "kind", "word")
            .mapInPandas(_search, "word string, n long, near string, near_n long"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms. The chain's known part doubles in each round; counts
    grow by a factor along it, so that it is short."""
    links = cut(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = cut(links.join(on, "root", "left"), "forms")
        moved = new.where("further is not null").limit(1).count()
        done = cut(new.select("word", F.coalesce("further", "root").alias("root")), "forms") if moved else new
        drop(links)
        if not moved:
            return new.select("word", "root")
        drop(new)
        links = done


def group_variants(docs: DataFrame, part_words: int = PART_WORDS, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts."""
    words = cut(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words, part_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= F.col("n") * ratio
    formed = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n")), "formed")
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
