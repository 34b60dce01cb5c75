"""Exact dedup with a cuckoo-filter index over digests of whole texts.

The index is split into buckets by digest; a bucket holds a cuckoo filter of
16-bit fingerprints and, as the stored content, its live digests with the
document that stays (largest id) and the number of copies. Every arriving
digest asks the filter first: a miss is new content, a hit is verified
against the stored digests, so a false positive never merges two texts.
Digests can be deleted again (that is what a cuckoo filter adds over a Bloom
filter). When an insertion finds no free slot the filter is rebuilt at twice
the size from the stored keys.

Hot texts: copies are reduced to one row per (digest, salt) before they reach
a bucket, so a third of all rows being one text costs a bucket ``SALTS``
rows. The number of buckets follows the number of documents, so a bucket is
bounded by about ``KEYS_PER_BUCKET`` digests.

Defined edge results: NULL text counts as empty (all empty texts are one
group); a NULL doc_id is kept as a member and loses against any id; repeated
rows count as members each; an empty table gives an empty result; other
columns are ignored. ``kept`` names documents, so rows that share the id that
stays are all marked; ``drop_copies`` lets exactly one row of a text stay.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.llm.common import cut, numbered

SALTS = 8
KEYS_PER_BUCKET = 50_000
MIN_BUCKETS = 256
SLOTS = 4
MAX_KICKS = 200


class Overflow(Exception):
    """An insertion found no free slot."""


class CuckooFilter:
    """Partial-key cuckoo filter, four 16-bit fingerprints to a bucket."""

    def __init__(self, n_buckets: int = 16, slots: bytes | None = None):
        self.n = n_buckets  # a power of two
        self.slots = array("H", slots) if slots is not None else array("H", bytes(2 * SLOTS * n_buckets))

    @staticmethod
    def fitting(n_keys: int) -> CuckooFilter:
        n = 16
        while n * SLOTS * 9 < n_keys * 10:
            n *= 2
        return CuckooFilter(n)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[:2], "little") or 1
        i = int.from_bytes(digest[2:10], "little") & (self.n - 1)
        return fp, i, self._other(i, fp)

    def _other(self, i: int, fp: int) -> int:
        return (i ^ (fp * 0x5BD1E995)) & (self.n - 1)

    def __contains__(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        s = self.slots
        return fp in s[i * SLOTS:(i + 1) * SLOTS] or fp in s[j * SLOTS:(j + 1) * SLOTS]

    def _put(self, i: int, fp: int) -> bool:
        for k in range(i * SLOTS, (i + 1) * SLOTS):
            if not self.slots[k]:
                self.slots[k] = fp
                return True
        return False

    def insert(self, digest: bytes) -> None:
        fp, i, j = self._places(digest)
        if self._put(i, fp) or self._put(j, fp):
            return
        at = j
        for kick in range(MAX_KICKS):  # push a resident to its other place
            k = at * SLOTS + kick % SLOTS
            fp, self.slots[k] = self.slots[k], fp
            at = self._other(at, fp)
            if self._put(at, fp):
                return
        raise Overflow

    def delete(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        for b in (i, j):
            for k in range(b * SLOTS, (b + 1) * SLOTS):
                if self.slots[k] == fp:
                    self.slots[k] = 0
                    return True
        return False


class Bucket:
    """The filter and the stored content of one bucket of the index."""

    def __init__(self, rows: pd.DataFrame):
        self.content: dict[bytes, tuple[int | None, int]] = {}
        self.filter, self.resizes, self.false_hits = CuckooFilter(), 0, 0
        for digest, keep, n, blob in zip(rows["digest"], rows["keep_id"], rows["group_size"], rows["filter"]):
            if blob is not None:
                self.filter = CuckooFilter(len(blob) // (2 * SLOTS), blob)
            else:
                self.content[digest] = (None if pd.isna(keep) else int(keep), int(n))

    def _add(self, digest: bytes) -> None:
        while True:
            try:
                self.filter.insert(digest)
                return
            except Overflow:  # rebuild from the stored keys, twice as large
                while True:
                    self.resizes += 1
                    bigger = CuckooFilter(self.filter.n * 2)
                    self.filter = bigger
                    try:
                        for d in self.content:
                            bigger.insert(d)
                        break
                    except Overflow:
                        continue

    def insert(self, digest: bytes, doc_id: int | None, n: int) -> None:
        if digest in self.filter:
            held = self.content.get(digest)  # verify the hit against the content
            if held is not None:
                ids = [x for x in (held[0], doc_id) if x is not None]
                self.content[digest] = (max(ids) if ids else None, held[1] + n)
                return
            self.false_hits += 1
        self._add(digest)
        self.content[digest] = (doc_id, n)

    def delete(self, digest: bytes) -> None:
        if digest in self.filter and digest in self.content:
            self.filter.delete(digest)
            del self.content[digest]

    def rows(self, bucket: int) -> pd.DataFrame:
        out = pd.DataFrame({"bucket": np.int32(bucket), "digest": list(self.content),
                            "keep_id": pd.array([k for k, _ in self.content.values()], "Int64"),
                            "group_size": [n for _, n in self.content.values()], "filter": None})
        own = pd.DataFrame({"bucket": [np.int32(bucket)], "digest": [None], "keep_id": pd.array([None], "Int64"),
                            "group_size": [len(self.content)], "filter": [self.filter.slots.tobytes()]})
        return pd.concat([out, own], ignore_index=True) if len(out) else own


INDEX_SCHEMA = "bucket int, digest binary, keep_id long, group_size long, filter binary"


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text_sha256) of every whole text, and the columns ``more``."""
    return docs.select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), *more)


def _partials(members: DataFrame, n_buckets: int) -> DataFrame:
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    d = F.unhex("text_sha256")
    return (members.groupBy("text_sha256", salt.alias("salt"))
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select(F.pmod(F.xxhash64(d), F.lit(n_buckets)).cast("int").alias("bucket"), d.alias("digest"),
                    "keep_id", "group_size"))


class DigestIndex:
    """The index as a table: per bucket one row with the filter and one row
    for each live digest. Updates return a new index (a new table)."""

    def __init__(self, table: DataFrame, n_buckets: int):
        self.table, self.n_buckets = table, n_buckets

    @staticmethod
    def empty(spark, n_docs: int) -> DigestIndex:
        # no rows by Spark itself: an empty list would be serialised by Python workers of their own, kept beside those of the operators
        table = spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in
                                            (field.split() for field in INDEX_SCHEMA.split(", "))])
        return DigestIndex(table, max(MIN_BUCKETS, -(-n_docs // KEYS_PER_BUCKET)))

    def _update(self, changes: DataFrame) -> DigestIndex:
        def step(key, held, new):
            b = Bucket(held)
            gone = new["gone"].to_numpy(bool)
            for digest in new["digest"][gone]:
                b.delete(digest)
            for digest, keep, n in zip(new["digest"][~gone], new["keep_id"][~gone], new["group_size"][~gone]):
                b.insert(digest, None if pd.isna(keep) else int(keep), int(n))
            return b.rows(key[0])

        table = (self.table.groupBy("bucket").cogroup(changes.groupBy("bucket"))
                 .applyInPandas(step, INDEX_SCHEMA))
        return DigestIndex(cut(table, "digest-index"), self.n_buckets)

    def insert(self, members: DataFrame) -> DigestIndex:
        """Add documents, given as (doc_id, text_sha256)."""
        return self._update(_partials(members, self.n_buckets).withColumn("gone", F.lit(False)))

    def delete(self, gone: DataFrame) -> DigestIndex:
        """Remove the digests in column text_sha256 (unknown ones are ignored)."""
        d = F.unhex("text_sha256")
        return self._update(gone.select("text_sha256").distinct().select(
            F.pmod(F.xxhash64(d), F.lit(self.n_buckets)).cast("int").alias("bucket"), d.alias("digest"),
            F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
            F.lit(True).alias("gone")))

    def content(self) -> DataFrame:
        """Live digests: text_sha256, keep_id, group_size."""
        return self.table.where("digest IS NOT NULL").select(
            F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size")

    def lookup(self, members: DataFrame) -> DataFrame:
        """Each member (doc_id, text_sha256) with keep_id and group_size of its
        digest; a digest that is not in the index has group_size 0. Only
        digests that occur more than once are joined: a digest with one
        member answers itself."""
        held = self.content()
        return members.join(held, "text_sha256", "left").withColumn("group_size", F.coalesce("group_size", F.lit(0)))


def _judged(members: DataFrame) -> DataFrame:
    """The members with keep_id, group_size (NULL: the only one) and kept."""
    index = DigestIndex.empty(members.sparkSession, members.count()).insert(members)
    multi = index.content().where("group_size > 1")
    # a group of one answers itself; only copies meet the index content
    out = members.join(multi, "text_sha256", "left")
    return out.withColumn("kept", F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(cut(digests(docs), "digests")).select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the largest (doc_id, row id), all columns."""
    rows, rid = numbered(docs)
    copies = cut(_judged(cut(digests(rows, rid), "digests")).where("group_size > 1").select(rid, "text_sha256", "kept"),
                 "copies")
    stays = copies.where("kept").groupBy("text_sha256").agg(F.max(rid).alias(rid)).select(rid)
    gone = cut(copies.select(rid).join(stays, rid, "left_anti"), "gone")
    return rows.join(gone, rid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
