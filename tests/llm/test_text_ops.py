"""Rules, classifier, n-gram join, suffix dedup, packing and pieces against
brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from innlytics.llm import classifier, ngram_join, packing, pieces, quality_rules, suffix_dedup

P = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -------------------------------------------------------------- quality rules
def test_rule_counts(make_docs, awkward, prose):
    texts = awkward + prose(15) + ["a b c " * 40, "x\ny\n\nx\n \nx", "w w w w", "# $ % |\x85\xa0 é"]
    out = {r.doc_id: r for r in quality_rules.judge(make_docs(texts)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        where = defaultdict(list)
        for k in range(len(w) - 2):
            where[tuple(w[k:k + 3])].append(k)
        cover = {x for v in where.values() if len(v) > 1 for k in v for x in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_em_recovers_rule_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.8
    acc = np.array([0.95, 0.9, 0.8, 0.7, 0.9])
    votes = np.where(r.random((20_000, 5)) < acc, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[r.random((20_000, 5)) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - acc).max() < 0.03 and abs(model.prior - 0.8) < 0.03


def test_rules_keep_prose_and_reject_symbol_junk(make_docs, prose):
    clean = prose(60, seed=4)
    junk = [" ".join(w + "###" for w in t.split()) for t in prose(12, seed=5)]
    out = {r.doc_id: r.kept for r in quality_rules.judge(make_docs(clean + junk)).collect()}
    assert all(out[i] for i in range(60)) and not any(out[i] for i in range(60, 72))
    assert quality_rules.judge(make_docs([])).count() == 0


# ----------------------------------------------------------------- classifier
def _labelled(spark, make_docs, prose):
    clean, junk = prose(150, seed=1), [t.upper().replace(" ", "!! ") for t in prose(60, seed=2)]
    texts = clean + junk
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(len(texts))],
                                   "doc_id long, quality int, toxic int")
    return texts, make_docs(texts), labels


def test_classifier_held_out(spark, make_docs, prose):
    texts, docs, labels = _labelled(spark, make_docs, prose)
    out = {r.doc_id: r for r in classifier.classify(docs, labels).collect()}
    held = [i for i in out if out[i].held_out]
    assert held == [i for i in out if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([out[i].predicted == (i < 150) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_classifier_never_learns_held_out_labels(spark, make_docs, prose):
    texts, docs, labels = _labelled(spark, make_docs, prose)
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a = {r.doc_id: r.score for r in classifier.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in classifier.classify(docs, flipped).collect()}
    assert a == pytest.approx(b)


def test_classifier_edges(spark, make_docs, awkward):
    d = make_docs(awkward)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.classify(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, 1), (None, 0)], "doc_id long, quality int")
    assert classifier.classify(d, one).count() == len(awkward)
    two = spark.createDataFrame([(i, i % 2) for i in range(len(awkward))] * 2, "doc_id long, quality int")
    out = classifier.classify(d, two).collect()
    assert len(out) == len(awkward) and all(0 <= r.score <= 1 for r in out)
    kept = classifier.keep_good(d, two)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in out)
    assert classifier.classify(d.limit(0), two).count() == 0


# ---------------------------------------------------------------- n-gram join
def plain_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(ASCII))
        out.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def plain_components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def near_texts(prose, seed, n=40, edits=(0, 6)):
    r, out = random.Random(seed), []
    for t in prose(n, seed=seed, length=r.choice([8, 20, 60, 150])):
        w = t.split()
        for _ in range(r.randint(1, 5)):
            v = list(w)
            for _ in range(r.randint(*edits)):
                k = r.randrange(len(v))
                v[k:k + r.randint(0, 1)] = [str(r.random())] * r.randint(0, 1)
            out.append(" ".join(v))
            if r.random() < 0.5:
                w = v  # chains, where the ends are not linked
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_matches_all_pairs(make_docs, awkward, prose, seed):
    shared = prose(1, seed=99, length=60)[0]
    texts = near_texts(prose, seed) + awkward + [f"{t} {shared}" for t in prose(25, seed=seed + 50, length=70)]
    sets = plain_sets(texts)
    out = {r.doc_id: r for r in ngram_join.near_duplicates(make_docs(texts)).collect()}
    assert [out[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [out[i].component_id for i in range(len(texts))] == plain_components(sets)


def test_ngram_join_shared_signature_for_every_similar_pair():
    r = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 7, 9, 13, 20, 31, 60, 140, 500, 1500]:
        for _ in range(30):
            a = np.unique(r.integers(1, 1 << 63, n, dtype=np.uint64))
            drop = r.integers(0, n // 5 + 1)
            add = r.integers(0, n // 4 + 1)
            b = np.unique(np.r_[a[drop:], r.integers(1, 1 << 63, add, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            common = np.sort(r.permutation(a)[:int(len(a) * r.choice([0, 0.5, 0.95, 1]))])
            assert len(np.intersect1d(ngram_join.signatures(a, common), ngram_join.signatures(b, common)))


def test_ngram_join_edges(make_docs):
    d = make_docs(["a b c d e f", "a b c d e f", "A B C D E F", None, "q r s t u v"], [None, 7, 5, 6, 7])
    out = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(d).collect())
    assert out == Counter([(None, 2, None), (7, 2, 5), (5, 2, 5), (6, 0, 6), (7, 2, 5)])
    assert ngram_join.near_duplicates(make_docs([])).count() == 0
    kept = ngram_join.drop_near_copies(make_docs(["a b c d e f", "z", "a b c d e f"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]


# --------------------------------------------------------------- suffix dedup
def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), len(suffix_dedup._runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def passages(prose, seed):
    """Texts that share passages around the limit, at shifted places."""
    r = random.Random(seed)
    base = prose(12, seed=seed, length=250)
    out = list(base)
    for _ in range(40):
        parts = []
        for _ in range(r.randint(1, 4)):
            t = r.choice(base)
            s = r.randrange(len(t))
            parts.append(t[s:s + r.choice([200, 390, 399, 400, 401, 450, 700])])
            parts.append(str(r.random()) * r.randint(0, 3))
        out.append("".join(parts))
    return out + ["ab" * 500, "é" * 600, "z" * 399, "z" * 400, "q" * 401]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_matches_brute_force(make_docs, awkward, prose, seed):
    texts = passages(prose, seed) + [t for t in awkward if not t or len(t) < 4000]
    out = {r.doc_id: r for r in suffix_dedup.repeats(make_docs(texts)).collect()}
    want = plain_repeats(texts, suffix_dedup.LENGTH)
    got = [(out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256) for i in range(len(texts))]
    assert got == want


def test_suffix_dedup_edges(make_docs, awkward, prose, monkeypatch):
    long = awkward[9]
    out = {r.doc_id: r for r in suffix_dedup.repeats(make_docs([long, long, prose(1)[0]])).collect()}
    assert out[0].n_removed == out[1].n_removed == len(long) and out[2].n_removed == 0
    rows = suffix_dedup.repeats(make_docs([long[:900], long[:900], None], [None, None, 5])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(0, 0), (900, 900), (900, 900)]
    assert suffix_dedup.repeats(make_docs([])).count() == 0


def test_strip_repeats_keeps_columns_and_whole_characters(make_docs, prose):
    t = prose(1, seed=8, length=400)[0][:600]
    d = make_docs(["ü" + t, "head " + t + " tail é", None, "short"])
    out = suffix_dedup.strip_repeats(d)
    assert out.columns == d.columns
    got = {r.doc_id: (r.text, r.n_chars, r.lo, r.quality) for r in out.collect()}
    assert got[0] == ("ü", 1, "x", 1) and got[1] == ("head  tail é", 12, "x", 1)
    assert got[2] == (None, None, "x", 1) and got[3] == ("short", 5, "x", 1)


# -------------------------------------------------------------------- packing
def test_packing_round_trip(make_docs, awkward, prose):
    from tokenizers import Tokenizer
    name = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(name)
    odd = ["It's CAN'T we're <|endoftext|>a <|EndOfText|> İstanbul ΣΑΣ é  x y 123 4a.b, c., 'S", "..", "a.,"]
    texts = awkward + prose(40) + odd
    rows = packing.pack(make_docs(texts), name, seq_len=256).collect()
    ids = {i: np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in enumerate(texts)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert bytes(r.ids) == ids[r.doc_id][r.start:r.start + r.length].tobytes()
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for spans, total in [(by_doc[i], len(ids[i])) for i in ids] + [(s, 256) for k, s in by_seq.items() if k < max(by_seq)]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert packing.pack(make_docs([]), name).count() == 0


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing_repeated_rows(make_docs):
    rows = packing.pack(make_docs(["a b c"] * 300 + [None], [1] * 300 + [None]), P.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in rows) == 300 * 4 + 1


# --------------------------------------------------------------------- pieces
def test_pieces_equal_the_library(make_docs, awkward, prose):
    import sentencepiece
    name = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=name)
    r = random.Random(2)
    noise = ["".join(r.choice("ab  \n\t▁é😀́<s>\x00ﬁ中\r") for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts = awkward + prose(20) + noise + [" ", "  ", " a", "a ", "\n", "a\n b", "▁"]
    out = {x.doc_id: x for x in pieces.round_trip(make_docs(texts), name).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert out[i].n_tokens == len(ids), repr(t)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), repr(t)
        assert out[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    coded = pieces.encode(make_docs(["a b", None]), name)
    assert {x.doc_id: list(x.ids) for x in coded.collect()} == {0: sp.encode("a b"), 1: []}
    assert {x.doc_id: x.text for x in pieces.decode(coded, name).collect()} == {0: "a b", 1: ""}


def test_chunk_table_is_bounded(monkeypatch, prose):
    monkeypatch.setattr(pieces, "TABLE_SIZE", 50)
    t = pieces.ChunkTable(P.path("piece_bpe_32k.model"))
    for text in prose(30):
        assert list(t.encode(text)[0]) == t.sp.encode(text)
        assert len(t.old) < 700 and len(t.young) < 700
