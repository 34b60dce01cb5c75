"""Repeated passages by a distributed difference-cover suffix algorithm.

A byte goes if a ``LENGTH``-byte string (or of another ``length``) covers it that starts anywhere else
too, in the same text or another. Sorting all suffixes would move every byte
position many times. As in difference-cover construction, only a sample of
positions is named and sorted, and the other suffixes are merged from the
sample:

* Sample. The cover must hold a position at the same offset of any two equal
  strings. Here it is chosen by content: position p is sampled when its
  ``K``-byte tuple has the smallest hash in some window of ``LENGTH - K + 1``
  tuples. Both copies of a repeated string contain such windows, so both are
  sampled at the same offset (the property of a difference cover, with about
  2 / window of the positions instead of 8 % or more for a cover by residue).
* Names. A sampled tuple is named by its fingerprint; Spark groups equal names.
  A start is kept only if a sampled tuple in its string has an equal name
  elsewhere.
* Merge. The starts between two sampled neighbours share the string from the
  first to ``LENGTH - 1`` bytes beyond the second. If that string has an equal
  name elsewhere, all these starts repeat. One holder of it stays as a partner
  for others.
* Recursion. What is undecided (near the ends of repeats) goes on, with its
  possible partners, to a finer cover; the last level names every start that
  is left by its whole string, and equal neighbours are repeats.

Names that decide have 126 bits (one polynomial modulo 2^64, two modulo primes);
names that only select have 64. Groups are
counted with map-side combining and never collected, so a passage of any
frequency is no hot task. A level moves only what the last left undecided.

Defined edge results: NULL text is empty; texts shorter than ``LENGTH`` keep
all; every row is a document of its own by its place, whatever its id, so
equal rows repeat each other; an empty table gives an empty result; other columns are
kept by ``strip_repeats`` and ignored by ``repeats``; very long texts are cut
into overlapping slabs for naming, which changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.llm.common import cut, drop, fresh, mix64, numbered, small_batches, text_bytes, trimmed

LENGTH = 400
SLAB = 1 << 18

_RNG = np.random.default_rng(20240229)
_LETTERS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Primes and bases of the second name, whose halves have 31 bits each.
_PRIMES, _ROOTS = (2147483647, 2147483629), (1103515245, 1664525303)
_SMALL = _RNG.integers(1, 1 << 30, (2, 256), dtype=np.uint64)
_POWERS: dict = {}


def levels(length: int) -> tuple[int, int, int]:
    """Tuple lengths of the covers; the last level takes whole strings."""
    return length // 4, length * 3 // 4, length * 19 // 20


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64 (modulus 0) or a prime."""
    held = _POWERS.get((base, modulus))
    if held is None or len(held) < n:
        if modulus:
            held = np.ones(1, np.uint64)
            while len(held) < n:  # the second half is the first times a power
                step = np.uint64(pow(base, len(held), modulus))
                held = np.r_[held, held * step % np.uint64(modulus)]
        else:
            held = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        _POWERS[base, modulus] = held
    return held


class Names:
    """Fingerprints of any substring of a slab, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, b: bytes):
        a = np.frombuffer(b, np.uint8)
        self.back = _powers(pow(_BASE, -1, 1 << 64), 0, len(a) + 1)
        self.prefix = np.r_[np.uint64(0), np.cumsum(_LETTERS[a] * _powers(_BASE, 0, len(a) + 1)[:len(a)])]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of [start, end); they also tell the length."""
        x = (self.prefix[end] - self.prefix[start]) * self.back[start]
        return mix64(x + (end - start).astype(np.uint64))


class PrimeNames:
    """Second fingerprints: two polynomials modulo primes, so that strings built to have equal sums modulo powers
    of two (as the Thue-Morse words) are told apart."""

    def __init__(self, b: bytes):
        a, self.halves = np.frombuffer(b, np.uint8), []
        for prime, root, letters in zip(_PRIMES, _ROOTS, _SMALL):
            terms = letters[a] * _powers(root, prime, len(a) + 1)[:len(a)] % np.uint64(prime)
            back = _powers(pow(root, -1, prime), prime, len(a) + 1)
            self.halves.append((np.uint64(prime), np.r_[np.uint64(0), np.cumsum(terms)], back))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for prime, prefix, back in self.halves:
            out = (out << np.uint64(31)) | ((prefix[end] - prefix[start]) % prime * back[start] % prime)
        return out


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """Minimum or maximum of each window, by block prefixes and suffixes."""
    m = len(x) - w + 1
    blocks = np.r_[x, np.full(-len(x) % w, x[-1], x.dtype)].reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:m], ahead[w - 1:w - 1 + m])


class Chunk:
    """Several byte strings laid end to end, so that names and samples are
    computed for all of them at once; ``row`` tells where a position lies."""

    def __init__(self, texts: list, length: int):
        self.length, self.data = length, b"".join(texts)
        size = np.array([len(x) for x in texts])
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.row = np.repeat(np.arange(len(texts)), size)
        self.names = Names(self.data)

    def sampled(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, names) of the k-byte tuples with the smallest name in some
        window of ``length`` bytes inside one string (ties too)."""
        w, n = self.length - k + 1, len(self.data)
        at = np.arange(n - k + 1)
        h = self.names.of(at, at + k)
        low = _sliding(h, w, np.minimum)
        m = len(low)
        low[np.arange(m) + self.length > self.end[self.row[:m]]] = 0  # windows across a border choose nothing
        wide = np.r_[np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]
        p = np.flatnonzero(_sliding(wide, w, np.maximum) == h)
        return p, h[p]


def chunks(texts, length: int) -> Iterator[tuple[list, Chunk]]:
    """(indices, chunk) of the texts of at least ``length`` bytes, at most about
    a slab of bytes at once."""
    held, size = [], 0
    for i, b in enumerate(texts):
        if len(b) < length:
            continue
        if held and size + len(b) > SLAB + length:
            yield held, Chunk([texts[j] for j in held], length)
            held, size = [], 0
        held.append(i)
        size += len(b)
    if held:
        yield held, Chunk([texts[j] for j in held], length)


def _cover(intervals: np.ndarray, n: int) -> np.ndarray:
    """Mask of [0, n) under half-open intervals (rows of start, end)."""
    d = np.zeros(n + 1, np.int64)
    if len(intervals):
        np.add.at(d, np.clip(intervals[:, 0], 0, n), 1)
        np.add.at(d, np.clip(intervals[:, 1], 0, n), -1)
    return np.cumsum(d[:-1]) > 0


def _runs(mask: np.ndarray) -> np.ndarray:
    """Half-open intervals of the true runs of a mask."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return edge.reshape(-1, 2)


KEY = ["id"]  # the row's own id


class Columns:
    """Gathers equally long pieces of columns; one frame for a whole batch."""

    def __init__(self, *names: str):
        self.parts = {n: [] for n in names}

    def add(self, rows: int, /, **cols) -> None:
        if rows:
            for name, parts in self.parts.items():
                x = cols[name]
                parts.append(x if isinstance(x, np.ndarray) else np.full(rows, x))

    def frame(self) -> pd.DataFrame | None:
        if not next(iter(self.parts.values())):
            return None
        return pd.DataFrame({n: np.concatenate(x) for n, x in self.parts.items()})


def _progressions(pos: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text with a period samples the same tuple once a period. Runs of equal
    keys at equal steps become one row: (index of the first, step, length)."""
    m = len(pos)
    if m < 2:
        return np.arange(m), np.zeros(m, np.int64), np.ones(m, np.int64)
    gap = np.diff(pos)
    equal = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    goes_on = equal.copy()
    goes_on[1:] &= ~equal[:-1] | (gap[1:] == gap[:-1])
    first = np.flatnonzero(np.r_[True, ~goes_on])
    n = np.diff(np.r_[first, m])
    return first, np.where(n > 1, gap[np.minimum(first, m - 2)], 0), n


def _spread(pos: np.ndarray, step: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all members of progressions, and each one's place in its."""
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(pos, n) + np.repeat(step, n) * inside, inside


def _first_sample(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(name, id, pos, step, n) of the sampled tuples of every whole text."""
    @trimmed
    def step(batches):
        for pdf in batches:
            slabs = [(i, base, b[base:base + SLAB + length - 1]) for i, b in enumerate(pdf["b"])
                     for base in range(0, max(1, len(b) - length + 1), SLAB)]
            ids = pdf["id"].to_numpy()
            out = Columns("name", "id", "pos", "step", "n")
            for which, chunk in chunks([x[2] for x in slabs], length):
                p, h = chunk.sampled(k)
                r = chunk.row[p]
                first, gap, n = _progressions(p, h, r)
                p, h, r = p[first], h[first], r[first]
                text = np.array([slabs[i][0] for i in which])[r]
                base = np.array([slabs[i][1] for i in which])[r]
                out.add(len(p), name=h.view(np.int64), id=ids[text], pos=p - chunk.start[r] + base, step=gap, n=n)
            if (frame := out.frame()) is not None:
                yield frame

    return rows.mapInPandas(step, "name long, id long, pos long, step long, n long")


REGION = "id long, base long, b binary, state binary, lo long, hi long"


def _regions(i, base: int, b: bytes, status: np.ndarray, length: int) -> list:
    """Rows for the stretches of starts that go on (status 1 undecided, 2 a
    partner), each with the bytes its strings need."""
    out, runs = [], _runs(status > 0)
    if not len(runs):
        return out
    # stretches whose strings overlap stay together
    apart = np.flatnonzero(runs[1:, 0] - runs[:-1, 1] >= length) + 1
    firsts, lasts = np.r_[0, apart], np.r_[apart, len(runs)] - 1
    for lo, hi in zip(runs[firsts, 0].tolist(), runs[lasts, 1].tolist()):
        for s in range(lo, hi, SLAB):
            e = min(hi, s + SLAB)
            part = status[s:e]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            state = np.stack([cuts, part[cuts]], axis=1).astype(np.int32)
            out.append((i, base + s, b[s:e + length - 1], state.tobytes(), None, None))
    return out


def _status(state: bytes, n: int) -> np.ndarray:
    a = np.frombuffer(state, np.int32).reshape(-1, 2)
    return np.repeat(a[:, 1], np.diff(np.r_[a[:, 0], n])).astype(np.int8)


def _chunk_status(chunk: Chunk, states: list) -> np.ndarray:
    """The status of every position of a chunk (0 where no string starts)."""
    out = np.zeros(len(chunk.data), np.int8)
    for a, e, state in zip(chunk.start, chunk.end, states):
        out[a:e - chunk.length + 1] = _status(state, e - a - chunk.length + 1)
    return out


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "base", "b", "state", "lo", "hi"])
    for c in ("base", "lo", "hi"):
        out[c] = out[c].astype("Int64")
    return out


def _first_regions(rows: DataFrame, length: int, k: int) -> DataFrame:
    """Stretches of starts whose string holds a tuple named elsewhere too."""
    names = cut(_first_sample(rows, length, k), "suffix-names")
    again = cut(names.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"), "suffix-again")
    held = names.join(again, "name", "left_semi").groupBy(*KEY).agg(F.collect_list(F.struct("pos", "step", "n")).alias("hits"))
    held = held.select(*KEY, "hits.pos", "hits.step", "hits.n")

    @trimmed
    def step(batches):
        for pdf in batches:
            out = []
            for i, b, pos, gap, count in zip(pdf["id"], pdf["b"], pdf["pos"], pdf["step"], pdf["n"]):
                p, _ = _spread(*(np.asarray(x, np.int64) for x in (pos, gap, count)))
                n = len(b) - length + 1
                near = _cover(np.stack([p - (length - k), p + 1], axis=1), n)
                out += _regions(i, 0, b, near.astype(np.int8), length)
            if out:
                yield _frame(out)

    found = cut(rows.join(held, KEY).mapInPandas(step, REGION), "suffix-regions")
    drop(names)
    drop(again)
    return found


def _sample(regions: DataFrame, length: int, k: int) -> DataFrame:
    """Sampled tuples near starts that go on. (name; k1, k2: the string from
    here to length - 1 beyond the next sampled position, if next >= 0; step
    and n as in ``_progressions``)"""
    w = length - k + 1

    @trimmed
    def step(batches):
        for pdf in batches:
            texts, states = list(pdf["b"]), list(pdf["state"])
            ids, bases = pdf["id"].to_numpy(), pdf["base"].to_numpy()
            out = Columns("name", "k1", "k2", "id", "base", "pos", "next", "step", "n", "open")
            for which, chunk in chunks(texts, length):
                status = _chunk_status(chunk, [states[i] for i in which])
                p, h = chunk.sampled(k)
                r = chunk.row[p]
                nxt = np.append(p[1:], 0)[:len(p)]
                same_text = np.append(r[1:] == r[:-1], False)[:len(p)]
                nxt = np.where(same_text & (nxt + length - 1 <= chunk.end[r]), nxt, -1)
                goes_on, undecided = np.r_[0, np.cumsum(status > 0)], np.r_[0, np.cumsum(status == 1)]
                lo, hi = np.maximum(p - w + 1, chunk.start[r]), p + 1
                near = goes_on[hi] > goes_on[lo]
                p, h, r, nxt, lo, hi = (x[near] for x in (p, h, r, nxt, lo, hi))
                is_open = undecided[hi] > undecided[lo]
                end = np.where(nxt >= 0, nxt + length - 1, p)
                k1, k2 = chunk.names.of(p, end), PrimeNames(chunk.data).of(p, end)
                first, gap, m = _progressions(p, h, k1, k2, is_open, r)
                p, h, r, nxt, k1, k2, is_open = (x[first] for x in (p, h, r, nxt, k1, k2, is_open))
                text, at = np.array(which)[r], chunk.start[r]
                out.add(len(p), name=h.view(np.int64), k1=k1.view(np.int64), k2=k2.view(np.int64), id=ids[text],
                        base=bases[text], pos=p - at, next=np.where(nxt >= 0, nxt - at, -1), step=gap,
                        n=m, open=is_open)
            if (frame := out.frame()) is not None:
                yield frame

    return regions.select(*KEY, "base", "b", "state").mapInPandas(
        step, "name long, k1 long, k2 long, id long, base long, pos long, next long, step long, n long, "
              "open boolean")


def _level(regions: DataFrame, length: int, k: int) -> DataFrame:
    """One cover: rows with lo and hi are decided repeats (starts of a text),
    the others are the regions that go on."""
    w = length - k + 1
    names = cut(_sample(regions, length, k), "suffix-names")
    # as tables of their own, so that the join of a hot name can be split
    live = cut(names.groupBy("name").agg(F.sum("n").alias("n"), F.max("open").alias("o"))
               .where("n > 1 AND o").select("name", F.lit(True).alias("live")), "suffix-live")
    mine = F.struct("id", (F.col("base") + F.col("pos")).alias("at"))
    whole = cut(names.where("next >= 0").groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min(mine).alias("first"))
                .where("n > 1").select("k1", "k2", "first"), "suffix-whole")
    flags = ["pos", "next", "step", "n", "live", "same", "holder"]
    marked = (names.join(live, "name", "left").join(whole, ["k1", "k2"], "left")
              .select(*KEY, "base", "pos", "next", "step", "n", F.coalesce("live", F.lit(False)).cast("long").alias("live"),
                      (F.col("first").isNotNull() & (F.col("next") >= 0)).cast("long").alias("same"),
                      F.coalesce(F.col("first") == mine, F.lit(False)).cast("long").alias("holder"))
              .where("live = 1 OR same = 1"))
    held = marked.groupBy(*KEY, "base").agg(F.collect_list(F.struct(*flags)).alias("hits"))
    held = held.select(*KEY, "base", *[F.col(f"hits.{c}").alias(c) for c in flags])

    @trimmed
    def step(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                n = len(r.b) - length + 1
                status = _status(r.state, n)
                first, nxt, gap, m, live, same, holder = (
                    np.asarray(x, np.int64) for x in (r.pos, r.next, r.step, r.n, r.live, r.same, r.holder))
                pos, inside = _spread(first, gap, m)
                reach = np.repeat(nxt - first, m)
                live, same = np.repeat(live, m) == 1, np.repeat(same, m) == 1
                holder = (np.repeat(holder, m) == 1) & (inside == 0)  # one of equal strings stays as a partner
                stays = _cover(np.stack([pos[live] - w + 1, pos[live] + 1], axis=1), n)
                seg = np.stack([pos, pos + reach], axis=1)
                repeat = _cover(seg[same], n) & (status > 0)
                partner = _cover(seg[same & holder], n)
                out += [(r.id, None, None, None, r.base + lo, r.base + hi)
                        for lo, hi in _runs(repeat & (status == 1))]
                status[repeat] = np.where(partner[repeat], 2, 0)
                status[~stays] = 0
                out += _regions(r.id, r.base, r.b, status, length)
            if out:
                yield _frame(out)

    found = cut(regions.select(*KEY, "base", "b", "state").join(held, [*KEY, "base"]).mapInPandas(step, REGION),
                "suffix-level")
    for done in (names, live, whole):
        drop(done)
    return found


def _equal_rows(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first, group of each row, size of each group) of rows equal
    in all columns. Rows are grouped by a hash, and by the columns themselves
    where that puts different rows together."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed = mix64(mixed + c)
    _, first, at, n = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    if any((c != c[first][at]).any() for c in columns):
        _, first, at, n = np.unique(np.stack(columns, axis=1), axis=0, return_index=True, return_inverse=True,
                                    return_counts=True)
    return first, at.ravel(), n


def _last_level(regions: DataFrame, length: int) -> DataFrame:
    """(id, lo, hi): undecided starts whose whole string occurs again.
    Strings that occur twice inside one region are decided there; to the
    others they are partners, one row each."""
    @trimmed
    def step(batches):
        for pdf in batches:
            texts, states = list(pdf["b"]), list(pdf["state"])
            ids, bases = pdf["id"].to_numpy(), pdf["base"].to_numpy()
            out = Columns("k1", "k2", "id", "lo", "hi", "n", "open", "done")
            for which, chunk in chunks(texts, length):
                status, which = _chunk_status(chunk, [states[i] for i in which]), np.array(which)
                s = np.flatnonzero(status > 0)
                r = chunk.row[s]
                x, y = chunk.names.of(s, s + length), PrimeNames(chunk.data).of(s, s + length)
                first, at, n = _equal_rows(x, y, r.astype(np.uint64))  # equal strings of one region
                is_open = status[s] == 1
                f, lo = first, s - chunk.start[r] + bases[which[r]]
                out.add(len(f), k1=x[f].view(np.int64), k2=y[f].view(np.int64), id=ids[which[r[f]]], lo=lo[f], hi=lo[f] + 1, n=n, open=is_open[f] & (n == 1), done=False)
                twice = is_open & (n[at] > 1)
                gap = np.flatnonzero(twice[1:] & ~(twice[:-1] & (lo[1:] == lo[:-1] + 1) & (r[1:] == r[:-1]))) + 1
                begin = np.r_[np.flatnonzero(twice[:1]), gap]
                mask = np.append(twice[1:] & (lo[1:] == lo[:-1] + 1) & (r[1:] == r[:-1]), False)
                stop = np.flatnonzero(twice & ~mask)
                out.add(len(begin), k1=0, k2=0, id=ids[which[r[begin]]], lo=lo[begin], hi=lo[stop] + 1, n=0, open=False, done=True)
            if (frame := out.frame()) is not None:
                yield frame

    names = cut(regions.select(*KEY, "base", "b", "state").mapInPandas(
        step, "k1 long, k2 long, id long, lo long, hi long, n long, open boolean, done boolean"), "suffix-names")
    again = cut(names.where("NOT done").groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("open").alias("o"))
                .where("n > 1 AND o").select("k1", "k2"), "suffix-again")
    return names.where("open").join(again, ["k1", "k2"], "left_semi").select(*KEY, "lo", "hi").union(
        names.where("done").select(*KEY, "lo", "hi"))


def repeated_starts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, lo, hi): starts of strings of ``length`` bytes that occur again, as
    intervals; rows: (id, b), the ids all different."""
    small_batches(rows.sparkSession)
    first, *finer = levels(length)
    regions = _first_regions(rows, length, first)
    found = []
    for k in finer:
        step = _level(regions, length, k)
        found.append(step.where("lo IS NOT NULL").select(*KEY, "lo", "hi"))
        if len(found) == 1:
            drop(regions)
        regions = step.where("lo IS NULL")
    found.append(_last_level(regions, length))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def removed_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, lo, hi): per text the starts of repeated strings, gathered
    (at most a few for each repeat a text holds)."""
    return repeated_starts(rows, length).groupBy(*KEY).agg(
        F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))


def cut_out(b: bytes, lo, hi, length: int = LENGTH) -> tuple[bytes, np.ndarray]:
    """The bytes outside the strings that start in [lo, hi), and the maximal
    removed runs."""
    if lo is None or not len(lo):
        return b, np.empty((0, 2), np.int64)
    gone = _cover(np.stack([np.asarray(lo, np.int64), np.asarray(hi, np.int64) + length - 1], axis=1), len(b))
    return np.frombuffer(b, np.uint8)[~gone].tobytes(), _runs(gone)


def _joined(docs: DataFrame, length: int) -> tuple[DataFrame, str, str]:
    """docs with the starts of their repeats (every row stays), and the names of
    the two new columns. Rows are told apart by an id of their own."""
    rows, rid = numbered(docs)
    key, lo, hi = (fresh(rows, c) for c in ("span_of", "lo", "hi"))
    spans = cut(removed_spans(rows.select(F.col(rid).alias("id"), text_bytes().alias("b")), length)
                .select(F.col("id").alias(key), F.col("lo").alias(lo), F.col("hi").alias(hi)), "suffix-spans")
    return rows.join(spans, F.col(rid) == F.col(key), "left"), lo, hi


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (start, end),
    kept_sha256 of the bytes that stay."""
    @trimmed
    def step(batches):
        for pdf in batches:
            rows = []
            for b, lo, hi in zip(pdf["b"], pdf["lo"], pdf["hi"]):
                kept, runs = cut_out(b, lo, hi, length)
                rows.append((len(b), len(b) - len(kept), len(runs), [{"start": int(x), "end": int(y)} for x, y in runs],
                             hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield out

    got, lo, hi = _joined(docs, length)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b"), F.col(lo).alias("lo"),
                      F.col(hi).alias("hi")).mapInPandas(
        step, "doc_id long, n_bytes long, n_removed long, n_spans long, "
              "spans array<struct<start: long, end: long>>, kept_sha256 string")


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated bytes, all columns; a character
    of which bytes were removed goes whole; n_chars, if there, is set anew."""
    @F.pandas_udf("string")
    def kept(b: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([cut_out(x, s, e, length)[0].decode("utf-8", "ignore") for x, s, e in zip(b, lo, hi)], dtype=object)

    small_batches(docs.sparkSession)
    got, lo, hi = _joined(docs, length)
    new, whole = fresh(docs, "kept"), fresh(docs, "whole")
    out = got.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(lo).isNull().alias(whole),
                     F.when(F.col(lo).isNotNull(), kept(text_bytes(), F.col(lo), F.col(hi))).alias(new))
    cols = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "text":
            c = F.when(F.col(whole), c).otherwise(F.col(new)).alias("text")
        elif f.name == "n_chars":
            c = F.when(F.col(whole), c).otherwise(F.length(new)).cast(f.dataType).alias("n_chars")
        cols.append(c)
    return out.select(*cols)
