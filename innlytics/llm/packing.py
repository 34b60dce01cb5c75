"""Packing along a space-filling curve.

Each document is hashed to a vector of word counts, projected to ``DIMS``
numbers by random signs, and gets the Hilbert key of its cell; documents with
similar words lie near each other on the curve. All documents are range-sorted
by that key and cut into sequences of ``seq_len`` ids along it, so neighbours
share sequences and only the very last sequence is padded.

Scale: the texts are tokenised once into a table (key, id count, ids). The
layout needs only key and count: sampled quantiles of the key split the
curve into ranges; each range is summed in its own window and a prefix over
the range totals gives every document its place. Equal keys (copies) are told
apart by a hash of the id inside the key, so a hot text spreads over ranges.
Then one join by row number brings ids and places together.

Words are tokenised through a bounded table of distinct words in the Python
worker: the tokenizer drops white space, so the ids of a text are those of
its words in order. Words that the table lacks are merged together, those of
about a megabyte of texts at once.

Defined edge results: NULL text counts as empty and holds the end id alone;
repeated rows are packed each; NULL ids are packed under NULL; an empty table
gives no pieces; other columns are ignored; long texts span sequences.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innlytics.llm.common import cut, mix64, small_batches, text_bytes, trimmed

DIMS, BITS, HASHED = 4, 7, 1024
TABLE_SIZE = 150_000  # words in each of two dicts, about 30 MB each
LONG_WORD = 64
GROUP_BYTES = 1 << 20
RUNS, NO_MERGE = 8192, np.int64(1 << 30)
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # those of Latin-1 too
DOCS_PER_RANGE = 20_000
MIN_RANGES = 256
_LOADED: dict[str, WordTable] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable bytes for themselves, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merges:
    """A byte-level BPE model for many runs of letters at once: every run has its places in one array, and each round
    does the next merge (lowest rank, leftmost) of all runs."""

    def __init__(self, tk):
        model = json.loads(tk.to_str())["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix")):
            raise ValueError("not plain merges")
        vocab, end, self.size = model["vocab"], model["end_of_word_suffix"] or "", tk.get_vocab_size() + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = np.argsort(code, kind="stable")
        self.code = code[self.rank]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        # of two letters, by their bytes; the second one may be the last
        pair = np.repeat(self.inner, 512), np.tile(np.r_[self.inner, self.last], 256)
        self.pairs = self._keys(np.int64(0), *pair) >> 32

    def _keys(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair (NO_MERGE if there is none), then its place."""
        code = left.astype(np.int64) * self.size + right
        i = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[i] == code, self.rank[i], NO_MERGE) << 32 | at

    def ids(self, runs: list[bytes], kind: type) -> dict[bytes, bytes]:
        """The packed ids of each run."""
        out, runs = {}, sorted(runs, key=len)
        for i in range(0, len(runs), RUNS):
            self._add(runs[i:i + RUNS], kind, out)
        return out

    def _add(self, runs: list, kind: type, out: dict) -> None:
        text = np.frombuffer(b" ".join(runs) + b" ", np.uint8)  # a place between two runs merges with nothing
        stop = np.cumsum([len(r) + 1 for r in runs]) - 1
        first = np.r_[0, stop[:-1] + 1]
        sym = self.inner[text]
        sym[stop - 1] = self.last[text[stop - 1]]
        sym[stop] = self.size - 1
        place = np.arange(len(sym))
        after, before = place + 1, place - 1
        pair = text[1:].astype(np.int64)
        pair[stop - 2] += 256  # its second letter is the last (a run of one letter sets a pair that the next line clears)
        key = self.pairs[(text[:-1].astype(np.int64) << 9) + pair] << 32 | place[:-1]
        key = np.append(key, NO_MERGE << 32)
        key[stop] = key[stop - 1] = NO_MERGE << 32
        alive = np.ones(len(sym), bool)
        alive[stop] = False
        while True:
            low = np.minimum.reduceat(key, first)
            low = low[low < NO_MERGE << 32]
            if not len(low):
                break
            at = low & 0xFFFFFFFF
            gone = after[at]
            sym[at], alive[gone], key[gone] = self.made[low >> 32], False, NO_MERGE << 32
            after[at], before[after[gone]] = after[gone], at
            key[at] = self._keys(at, sym[at], sym[after[at]])
            prior = before[at[before[at] >= 0]]
            key[prior] = self._keys(prior, sym[prior], sym[after[prior]])
        n = np.add.reduceat(alive, first, dtype=np.int64)
        packed, end = sym[alive].astype(kind).tobytes(), (np.cumsum(n) * kind().itemsize).tolist()
        for run, lo, hi in zip(runs, [0, *end], end):
            out[run] = packed[lo:hi]


class WordTable:
    """Ids of texts by a tokenizer that drops white space, word by word."""

    def __init__(self, tokenizer_file: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tk = Tokenizer.from_file(tokenizer_file)
        self.kind = np.uint16 if self.tk.get_vocab_size() <= 1 << 16 else np.uint32
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.merges = self._merges()

    def _merges(self) -> Merges | None:
        """The model's merges, if a run of letters and the marks after it are a piece each and they give its ids."""
        try:
            merges = Merges(self.tk)
        except (KeyError, TypeError, ValueError):  # another kind of model
            return None
        runs = [w.encode() for w in ("a", "the", "éàü", "straße", "abcdefghij", "internationalisation", "qxzzkw")]
        ids = merges.ids(runs, self.kind)
        fits = all(ids[r] + (self._whole(m) if m else b"") == self._whole(r + m)
                   for r in runs for m in (b"", b".", b",", b"'", b"***", b"$$$", b"-_!"))
        return merges if fits else None

    def _whole(self, word: bytes) -> bytes:
        ids = self.tk.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def _learn(self, words: set) -> None:
        """Put words that the young table lacks into it. Letters with marks after them are two pieces, and the letters
        of all such words are merged together."""
        young, old = self.young, self.old
        again = words & old.keys()
        young.update(zip(again, map(old.__getitem__, again)))
        runs, marked = set(), []
        for w in words - again:
            run = w.rstrip(MARKS)
            if self.merges and len(w) <= LONG_WORD and (run.isalpha() and run.islower() or LETTERS.fullmatch(run)):
                if not run.isascii():
                    run = run.decode().lower().encode()
                runs.add(run)
                if run != w:
                    marked.append((w, run))
            else:
                young[w] = self._whole(w)
        runs = [r for r in runs if r not in young]
        again = old.keys() & runs
        young.update(zip(again, map(old.__getitem__, again)))
        if runs:
            young.update(self.merges.ids([r for r in runs if r not in again], self.kind))
        for w, run in marked:
            marks = w[len(w.rstrip(MARKS)):]
            if marks and marks not in young:
                young[marks] = self._whole(marks)
            young[w] = young[run] + young[marks] if marks else young[run]

    def encode_all(self, texts: list) -> list[bytes]:
        """The ids of each text, packed; about ``GROUP_BYTES`` of texts are looked up at once."""
        out, group, size = [], [], 0
        for b in texts:
            group.append(b)
            size += len(b)
            if size >= GROUP_BYTES:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list) -> list[bytes]:
        if len(self.young) > TABLE_SIZE:
            self.old, self.young = self.young, {}
        # special tokens are told by case; all else is lower-cased anyway
        split = [(b if b"<|" in b else b.lower()).split() for b in texts]
        new = set().union(*split).difference(self.young)
        if new:
            self._learn(new)
        out = [b"".join(map(self.young.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONG_WORD:
                del self.young[w]
        return out

    def encode(self, b: bytes) -> bytes:
        """The ids of a text, packed."""
        return self.encode_all([b])[0]


def table(tokenizer_file: str) -> WordTable:
    if tokenizer_file not in _LOADED:
        _LOADED[tokenizer_file] = WordTable(tokenizer_file)
    return _LOADED[tokenizer_file]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of cells (rows) on the Hilbert curve: Skilling's transform
    turns the axes of every cell at once, then the bits are interleaved."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for shift in range(bits - 1, 0, -1):
        q = 1 << shift
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        q = 1 << shift
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    key = np.zeros_like(t)
    for shift in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> shift) & 1)
    return key


def curve_keys(counts: np.ndarray) -> np.ndarray:
    """Keys of documents from their hashed count vectors (rows): damped, of unit
    length, projected by random signs to DIMS numbers, each put on a grid."""
    v = np.log1p(counts)
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
    h = mix64(np.arange(1, HASHED + 1, dtype=np.uint64))
    signs = np.stack([np.where(h >> np.uint64(d) & np.uint64(1), 1.0, -1.0) for d in range(DIMS)], axis=1)
    place = 0.5 + 0.5 * np.tanh(v @ signs)  # unit vectors project to about a unit normal
    return hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenised(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """doc_id, key (curve position, then a hash that tells equal ones apart),
    n (ids with the end id), ids (packed, native width of the vocabulary)."""
    small_batches(docs.sparkSession)

    @trimmed
    def step(batches):
        t = table(tokenizer_file)
        for pdf in batches:
            if not len(pdf):
                continue
            end = t.kind(end_id).tobytes()
            packed = t.encode_all(pdf["b"].tolist())
            counts = np.array([np.bincount(np.frombuffer(x, t.kind) % HASHED, minlength=HASHED) for x in packed])
            width = t.kind().itemsize
            out = pd.DataFrame({"curve": curve_keys(counts), "n": [len(x) // width + 1 for x in packed],
                                "ids": [x + end for x in packed], "width": np.int32(width)})
            out.insert(0, "rid", pdf["rid"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield out

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                      text_bytes().alias("b")).mapInPandas(
        step, "doc_id long, rid long, curve long, n long, ids binary, width int")
    tie = F.pmod(F.xxhash64("doc_id", "rid"), F.lit(1 << 32))
    return got.withColumn("key", F.col("curve") * (1 << 32) + tie).drop("curve")


def layout(rows: DataFrame, n_ranges: int) -> DataFrame:
    """(rid, place): the ids that stand before each row along the curve. The
    rows are dealt into ranges of the key (sampled quantiles); the table that
    is written fixes each row's range."""
    tagged = cut(rows.select("rid", "key", "n").repartitionByRange(n_ranges, "key")
                 .withColumn("rng", F.spark_partition_id()), "ranges")
    totals = tagged.groupBy("rng").agg(F.sum("n").alias("total"))  # a row for each range
    first = totals.select("rng", F.coalesce(F.sum("total").over(
        Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = Window.partitionBy("rng").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(F.broadcast(first), "rng")  # n_ranges rows, a parameter
            .select("rid", (F.col("first") + F.col("before")).alias("place")))


PIECES = ("doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


def pack(docs: DataFrame, tokenizer_file: str, seq_len: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned little-endian
    32-bit), ids_crc32, doc_tokens, sequence_id, offset."""
    rows = cut(tokenised(docs, tokenizer_file, end_id), "tokens")
    n_docs = rows.count()
    places = layout(rows.select("rid", "key", "n"), max(MIN_RANGES, -(-n_docs // DOCS_PER_RANGE)))

    @trimmed
    def step(batches):
        for pdf in batches:
            out = []
            for doc, ids, width, place in zip(pdf["doc_id"], pdf["ids"], pdf["width"], pdf["place"]):
                a = np.frombuffer(ids, np.uint16 if width == 2 else np.uint32).astype("<u4")
                at, place = 0, int(place)
                while at < len(a):
                    seq, off = divmod(place + at, seq_len)
                    piece = a[at:at + seq_len - off].tobytes()
                    out.append((doc, at, len(piece) // 4, piece, zlib.crc32(piece), len(a), seq, off))
                    at += len(piece) // 4
            res = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
                                             "sequence_id", "offset"])
            res["doc_id"] = res["doc_id"].astype("Int64")
            yield res

    return (rows.select("rid", "doc_id", "ids", "width").join(places, "rid")
            .select("doc_id", "ids", "width", "place").mapInPandas(step, PIECES))


