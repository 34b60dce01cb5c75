"""Quality classifier: random-indexing word vectors, pooled per document, and
a two-layer network with temperature-calibrated probabilities.

Random indexing: a token (a word, or the shape of a word) has a fixed sparse
ternary index vector drawn from its hash; its context vector is the sum of the
index vectors seen beside it. Tokens are hashed to ``TOKENS`` rows, so the
table of context vectors has a fixed size whatever the vocabulary. A document
is the mean context vector of all its tokens (whole text), joined with a
projection of its token shares.

The classifier (context vectors, network, temperature) is fitted on a bounded
sample of labelled rows: at most ``max_train`` documents, chosen by the hash
of their id among the rows whose crc32(doc_id) mod 3 is not 1 (those are held
out). Spark tasks sum the context vectors and pool the sample; only
``max_train`` pooled vectors reach the driver, where the network is trained
(numpy) on four fifths and its temperature is set on the rest. Scoring reads
every whole text once, in tasks that hold the table.

Defined edge results: NULL and empty texts get the score of the zero vector;
without labelled rows of both classes every score is the share of label 1 (or
0.5); repeated rows score alike; NULL ids are never held out and never
trained on; an empty table gives an empty result; other columns (also clashing
ones such as quality) are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innlytics.llm.common import cut, give_back, mix64, small_batches, text_bytes, trimmed, word_hashes

TOKENS = 1 << 14
DIM = 64
NONZERO = 6
HIDDEN = 32
MAX_TRAIN = 20_000
SHAPES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
                         b"A" * 26 + b"a" * 26 + b"0" * 10)
_RUNS = re.compile(rb"(.)\1+", re.S)


def token_rows(b: bytes) -> np.ndarray:
    """Token rows of a text in order: word, shape, word, shape, ..."""
    words = b.split()
    if not words:
        return np.empty(0, np.int64)
    shape = b.translate(SHAPES)
    shape = _RUNS.sub(rb"\1", shape).split()
    if len(shape) != len(words):  # runs of white space collapse too; the count of words stays
        shape = [_RUNS.sub(rb"\1", w.translate(SHAPES)) for w in words]
    out = np.empty(2 * len(words), np.uint64)
    out[0::2] = word_hashes(words) >> np.uint64(1)
    out[1::2] = (word_hashes(shape) >> np.uint64(1)) ^ np.uint64(0x5555)
    return (mix64(out) % np.uint64(TOKENS)).astype(np.int64)


def index_parts() -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of each token row's index vector lie, and their signs."""
    h = mix64(np.arange(TOKENS * NONZERO, dtype=np.uint64).reshape(TOKENS, NONZERO) + np.uint64(1))
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def index_vectors() -> np.ndarray:
    """The sparse ternary index vectors of all token rows (a fixed table)."""
    at, sign = index_parts()
    out = np.zeros((TOKENS, DIM), np.float32)
    np.add.at(out, (np.repeat(np.arange(TOKENS), NONZERO), at.ravel()), sign.ravel())
    return out


def context_counts(texts: list, at: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """For each token row the sum of the index vectors of its neighbours (two
    on either side among words and shapes) in some texts."""
    own, beside = [], []
    for b in texts:
        rows = token_rows(b)
        for gap in (1, 2):
            own += [rows[:-gap], rows[gap:]]
            beside += [rows[gap:], rows[:-gap]]
    own, beside = np.concatenate(own), np.concatenate(beside)
    into = np.zeros(TOKENS * DIM)
    for k in range(NONZERO):
        into += np.bincount(own * DIM + at[beside, k], weights=sign[beside, k], minlength=TOKENS * DIM)
    return into.reshape(TOKENS, DIM)


def context_table(sample: DataFrame) -> np.ndarray:
    """Context vectors from the sampled texts, summed over the tasks."""
    @trimmed
    def step(batches):
        at, sign = index_parts()
        into = np.zeros((TOKENS, DIM))
        for pdf in batches:
            if len(pdf):
                into += context_counts(list(pdf["b"]), at, sign)
        used = np.flatnonzero(np.abs(into).sum(axis=1))
        if len(used):
            yield pd.DataFrame({"token": used, "v": list(into[used])})

    small_batches(sample.sparkSession)
    parts = sample.select("b").mapInPandas(step, "token long, v array<double>")
    sums = parts.groupBy("token").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(DIM)]).alias("v"))
    table = np.zeros((TOKENS, DIM), np.float32)
    for r in sums.collect():  # at most TOKENS rows
        table[r["token"]] = r["v"]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.maximum(norm, 1e-9)
    unseen = norm[:, 0] == 0
    table[unseen] = 0
    return table


def pool(b: bytes, table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Mean context vector and mean index vector of a whole text's tokens."""
    rows = token_rows(b)
    if not len(rows):
        return np.zeros(2 * DIM + 1, np.float32)
    uniq, n = np.unique(rows, return_counts=True)
    w = (n / len(rows)).astype(np.float32)
    return np.concatenate([w @ table[uniq], w @ index[uniq], [np.log1p(len(rows)) / 10]]).astype(np.float32)


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id and the pooled vector; ``docs`` is (doc_id, b)."""
    small_batches(docs.sparkSession)

    @trimmed
    def step(batches):
        index = index_vectors()
        for pdf in batches:
            yield pdf[["doc_id", "y"]].assign(x=[pool(b, table, index).astype(np.float64) for b in pdf["b"]])

    return docs.mapInPandas(step, "doc_id long, y int, x array<double>")


class Network:
    """x -> relu(x W1 + b1) W2 + b2, divided by a temperature."""

    def __init__(self, dim: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w1, self.b1 = r.normal(0, dim ** -0.5, (dim, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = r.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0
        self.mean, self.scale, self.temperature = np.zeros(dim), np.ones(dim), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [self.w1, self.b1, self.w2, np.array([self.b2])]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        r, t = np.random.default_rng(11), 0
        for _ in range(epochs):
            order = r.permutation(len(z))
            for i in range(0, len(z), 128):
                zb, yb = z[order[i:i + 128]], y[order[i:i + 128]]
                a = zb @ p[0] + p[1]
                h = np.maximum(a, 0)
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - yb) / len(yb)
                dh = np.outer(d, p[2]) * (a > 0)
                g = [zb.T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = p[0], p[1], p[2], float(p[3][0])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on rows not trained on."""
        z = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


def remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


class QualityModel:
    """Fitted on (doc_id, text) and labels (doc_id, quality)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN):
        self.table, self.net, self.share = np.zeros((TOKENS, DIM), np.float32), None, 0.5
        rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
                .where("doc_id IS NOT NULL AND y IN (0, 1)").where(remainder() != 1)
                .groupBy("doc_id").agg(F.max("y").alias("y"))
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b"))
        # max_train rows of a few bytes each: the texts are not shuffled
        sample = cut(texts.join(F.broadcast(cut(rows, "train-ids")), "doc_id"), "train")
        self.table = context_table(sample)
        got = pooled(sample, self.table).orderBy("doc_id", "y").collect()  # at most max_train documents
        if not got:
            return
        x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
        self.share = float(y.mean())
        if 0 < self.share < 1:
            ids = np.array([r["doc_id"] for r in got], np.uint64)
            hold = (mix64(ids) % np.uint64(5)) == 0
            if hold.all() or not hold.any() or len(set(y[~hold])) < 2:
                hold = np.zeros(len(y), bool)
            self.net = Network(x.shape[1])
            self.net.fit(x[~hold], y[~hold])
            if hold.any():
                self.net.calibrate(x[hold], y[hold])

    def scores(self) -> Column:
        """Probability of label 1 of each whole text, as a column."""
        table, net, share = self.table, self.net, self.share

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            if net is None:
                return pd.Series(np.full(len(texts), share))
            index = _held_index()
            x = np.array([pool(b, table, index) for b in texts], np.float64).reshape(len(texts), 2 * DIM + 1)
            return pd.Series(net.score(x))

        return score(text_bytes())

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted for every whole text."""
        small_batches(docs.sparkSession)
        return docs.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"),
                           self.scores().alias("score")).withColumn(
            "predicted", (F.col("score") >= 0.5).cast("int"))


_INDEX: list = []


def _held_index() -> np.ndarray:
    if not _INDEX:
        _INDEX.append(index_vectors())
    return _INDEX[0]


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    return QualityModel(docs, labels, max_train).score(docs)


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents predicted 1, with all their columns."""
    model = QualityModel(docs, labels, max_train)
    give_back()  # the driver's training rows
    small_batches(docs.sparkSession)
    return docs.where(model.scores() >= 0.5)
