"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from innlytics.llm import variants as V

AZ = str.maketrans(V.UPPER, V.LOWER)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    form, close = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        close[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, close[w], words.get(form[w]))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, word string, size int")
    out = V.group_variants(df, **kw).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}
    assert len(got) == len(out) and got == plain(rows)
    return got


@pytest.fixture()
def typed():
    """Words with letters added, left out and replaced, of falling counts, accents and capitals among them."""
    r = random.Random(9)
    rows, letters = [], "abcdeéßÿ×nrst"
    for _ in range(60):
        w = "".join(r.choice(letters) for _ in range(r.randint(6, 9)))
        n = 700
        while n >= 2:
            rows += [(r.randrange(10 ** 6), (w.capitalize() if k % 9 == 0 else w) + r.choice([" ", ",", "\n9"])) for k in range(n)]
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1:]])
            n //= r.choice([3, 5, 8])
    return rows


def test_forms_roots_and_counts_equal_all_pairs(spark, typed):
    got = check(spark, typed)
    assert any(r[0] and r[0] != r[1] for r in got.values())  # a chain


def test_split_shards_and_long_leaves_find_the_same(spark, typed, monkeypatch):
    check(spark, typed, part_words=2)
    monkeypatch.setattr(V, "LEAF_WORDS", 1)
    monkeypatch.setattr(V, "NODE_BYTES", 0)
    monkeypatch.setattr(V, "BLOCK_BYTES", 64)
    words = list(plain(typed))
    for size in {len(w) for w in words}:
        stored = [w.encode("latin-1") for w in words if len(w) == size]
        for ask in (size, size - 1):
            asking = [w for w in words if len(w) == ask]
            if asking:
                a, b = V.CountTrie(stored).near([w.encode("latin-1") for w in asking])
                got = sorted((asking[i], stored[j].decode("latin-1")) for i, j in zip(a, b))
                assert got == sorted((x, y.decode("latin-1")) for x in asking for y in stored if near(x, y.decode("latin-1")))


def test_words_of_equal_letter_counts(spark):
    """A leaf of permutations, larger than what is compared one by one."""
    r = random.Random(2)
    words = sorted({"".join(r.sample("abcdefgh", 8)) for _ in range(700)})
    trie = V.CountTrie([w.encode() for w in words])
    asking = [w[:3] + w[4:] for w in words[:50]]
    a, b = trie.near([w.encode() for w in asking])
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(
        (i, j) for i, x in enumerate(asking) for j, y in enumerate(words) if near(x, y))


def test_nulls_ties_repeated_rows_and_empty(spark, awkward):
    rows = [(None, None), (None, "letters letters"), (1, ""), (2, "lettres, letters; latters")] * 6
    rows += [(3, "bananas bananax")] * 5 + [(4, "bananay")] * 25 + [(5, "bananaz")] * 25
    rows += [(100 + i, t) for i, t in enumerate(awkward)] + [(7, "A" * 40_000), (8, "a" * 39_999)] * 5
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None)])


def test_damage_follows_the_rule(spark):
    rows = [(i, "Variant éclairs") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(r.word for r in V.spellings(df).collect())
    want = Counter()
    for i in range(2000):
        for w in ("variant", "éclairs"):
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w if h % 199 else w[:h % 7] + w[h % 7 + 1:]] += 1
    assert got == want and len(got) > 2
    assert V.routes(df.select(F.lit("variant").alias("word"), F.lit(1).alias("n")).limit(1)).where("kind = 0").count() == 1
