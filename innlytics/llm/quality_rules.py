"""Quality rules by weak supervision.

Each rule looks at simple counts of the whole text and votes good (1), bad
(-1) or abstains (0). Instead of asking a document to pass all rules, a
two-class model with conditionally independent rules is fitted by
expectation-maximisation: it estimates, from the votes alone, how often each
rule is right and how common good documents are, and gives each document a
posterior probability of being good.

Scale: the votes of all documents are reduced to counts per vote pattern (at
most 3**rules patterns, whatever the number of documents); only these counts
reach the driver, where EM runs. The posterior of a document is then a sum of
learned log-odds in plain SQL expressions. One pass reads the texts.

Defined edge results: NULL and empty texts have all counts 0, fail the base
and are not kept; repeated rows are judged alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innlytics.llm.common import cut, mix64, small_batches, text_bytes, word_hashes

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))  # bytes that do not start a code point
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
NO_LETTER = bytes(x for x in range(0x80) if not chr(x).isalpha())
TRIPLES = tuple(bytes([x]) * 3 for x in SYMBOLS)

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
            "n_bangs", "n_stops", "n_letters", "n_triples")


def repeat_words(words: list) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = word_hashes(words)
    k = np.uint64(0x9E3779B97F4A7C15)
    g = mix64((h[:-2] * k + h[1:-1]) * k + h[2:])
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(g), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def count_features(b: bytes) -> tuple:
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    n = len(b)
    return (len(words), len(b.translate(None, CONTINUATION + b" \t\n\v\f\r")), n - len(b.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), len(lines), n - len(b.translate(None, UPPER)),
            n - len(b.translate(None, LOWER)), b.count(b"!"), b.count(b".") + b.count(b",") + b.count(b"\xe3\x80\x82"),
            len(b.translate(None, CONTINUATION + NO_LETTER)), sum(map(b.count, TRIPLES)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    small_batches(docs.sparkSession)

    def step(batches):
        for pdf in batches:
            out = pd.DataFrame([count_features(b) for b in pdf["b"]], columns=list(FEATURES), dtype="int64")
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in FEATURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b")).mapInPandas(step, schema)


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` holds, else abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "n_symbols * 50 < n_words", "n_symbols * 10 > n_words"),
    Rule("letters", "n_letters * 100 > word_chars * 92", "n_letters * 100 < word_chars * 86"),
    Rule("symbol_runs", "n_triples = 0", "n_triples * 50 > n_words"),
    Rule("capitals", "n_upper * 8 < n_lower", "n_upper * 2 > n_lower AND n_upper > 20"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words",
         "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("lines", "n_lines > 3 AND n_dup_lines = 0", "n_dup_lines * 10 > 3 * n_lines AND n_lines > 3"),
    Rule("repeats", "n_repeat_words * 20 < n_words", "n_repeat_words * 5 > n_words * 2"),
    Rule("shouting", "n_bangs * 50 < n_words", "n_bangs * 10 > n_words"),
    Rule("stops", "n_stops * 60 > n_words", "n_stops * 300 < n_words AND n_words > 100"),
)


def votes(feats: DataFrame, rules=RULES) -> DataFrame:
    n0 = F.col("n_words") > 0
    cols = [F.when(n0 & F.expr(r.bad), F.lit(-1)).when(n0 & F.expr(r.good), F.lit(1)).otherwise(F.lit(0))
            .cast("int").alias(f"v_{r.name}") for r in rules]
    return feats.select("*", *cols)


@dataclass
class LabelModel:
    """Prior of good, and ``good_vote[rule, class]``: the chance that a rule
    which votes says good (class 0 bad, 1 good). Abstaining says nothing."""

    prior: float
    good_vote: np.ndarray

    def accuracies(self) -> np.ndarray:
        """Estimated share of right votes among each rule's votes."""
        return (1 - self.prior) * (1 - self.good_vote[:, 0]) + self.prior * self.good_vote[:, 1]

    def weights(self) -> np.ndarray:
        """Log-odds that a bad and a good vote of each rule add."""
        g = self.good_vote
        return np.stack([np.log((1 - g[:, 1]) / (1 - g[:, 0])), np.log(g[:, 1] / g[:, 0])], axis=1)

    def odds(self, patterns: np.ndarray) -> np.ndarray:
        w = self.weights()
        return (np.log(self.prior / (1 - self.prior)) + (patterns == -1) @ w[:, 0] + (patterns == 1) @ w[:, 1])


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = 500) -> LabelModel:
    """EM over vote patterns (rows of -1, 0, 1) with their counts. It starts
    from 'good unless a rule says bad'; pseudo-counts (a bad document gets a
    good vote in two of three cases, a good one in 19 of 20) keep the classes
    from swapping and every chance inside (0, 1)."""
    good, bad = (patterns == 1).astype(float), (patterns == -1).astype(float)
    q = np.where(bad.any(axis=1), 0.1, 0.95)
    model = LabelModel(0.8, np.full((patterns.shape[1], 2), 0.5))
    for _ in range(steps):
        prior = (float((counts * q).sum()) + 8) / (float(counts.sum()) + 10)
        chance = [((w @ good) + 10 * g) / (w @ (good + bad) + 10)
                  for w, g in ((counts * (1 - q), 2 / 3), (counts * q, 0.95))]
        model = LabelModel(prior, np.stack(chance, axis=1))
        new = 1 / (1 + np.exp(-np.clip(model.odds(patterns), -700, 700)))
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


def posterior(model: LabelModel, rules=RULES) -> Column:
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for r, (bad, good) in zip(rules, model.weights()):
        v = F.col(f"v_{r.name}")
        odds = odds + F.when(v == -1, F.lit(float(bad))).when(v == 1, F.lit(float(good))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rules=RULES, keep_at: float = 0.5) -> DataFrame:
    """One row per document: the counts, votes, base_failed, p_good, kept."""
    voted = cut(votes(features(docs), rules), "votes")
    names = [f"v_{r.name}" for r in rules]
    # at most 3**rules rows, whatever the number of documents
    seen = (voted.where("n_words >= 50").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))).collect()
    if seen:
        model = fit(np.array([[r[c] for c in names] for r in seen]), np.array([r["n"] for r in seen], float))
    else:
        model = fit(np.zeros((1, len(rules)), int), np.zeros(1))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (voted.withColumn("base_failed", base).withColumn("p_good", posterior(model, rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at)))
