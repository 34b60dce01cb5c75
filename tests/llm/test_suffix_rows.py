"""Suffix dedup: rows told apart by themselves, other lengths, and names of strings built to collide."""

import random
import zlib

import numpy as np

from innlytics.llm import suffix_dedup as SD

from .test_text_ops import plain_repeats


def key(n_bytes, n_removed, n_spans, sha):
    return (n_bytes, n_removed, n_spans, sha)


def results(df):
    return sorted(key(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def colliding_pair():
    """Two words of one length and one CRC-32."""
    r, seen = random.Random(11), {}
    while True:
        w = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
        other = seen.setdefault(zlib.crc32(w.encode()), w)
        if other != w:
            return other, w


def test_texts_of_one_id_and_one_checksum_stay_apart(make_docs, prose):
    a, b = colliding_pair()
    tail = prose(1, seed=21, length=200)[0]
    # equal ends keep the checksums equal, so the second text differs from the first in its 12 letters alone
    texts = [a + tail, b + tail, prose(1, seed=22, length=200)[0], prose(1, seed=23, length=200)[0], tail]
    assert zlib.crc32(texts[0].encode()) == zlib.crc32(texts[1].encode())
    for ids in ([None] * 5, [7] * 5, [1, 1, 2, 2, 3]):
        assert results(SD.repeats(make_docs(texts, ids))) == sorted(map(tuple, plain_repeats(texts, SD.LENGTH)))


def test_null_ids_and_repeated_rows_equal_brute_force(make_docs, prose, awkward):
    shared = prose(3, seed=5, length=150)
    texts = [p + shared[i % 3] + p[::-1] for i, p in enumerate(prose(20, seed=6))] + [shared[0]] * 4 + awkward
    got = SD.repeats(make_docs(texts, [None] * len(texts)))
    assert results(got) == sorted(map(tuple, plain_repeats(texts, SD.LENGTH)))


def test_other_lengths(make_docs, prose):
    shared = [p[:260] for p in prose(4, seed=8, length=150)]
    texts = [p[:k * 7] + shared[k % 4] + p for k, p in enumerate(prose(24, seed=9))]
    for length in (200, 255):
        assert results(SD.repeats(make_docs(texts), length)) == sorted(map(tuple, plain_repeats(texts, length)))
    stripped = [r.text for r in SD.strip_repeats(make_docs(texts), 200).collect()]
    assert all(s not in t for s in shared for t in stripped)
    assert results(SD.repeats(make_docs(texts))) == sorted(map(tuple, plain_repeats(texts, SD.LENGTH)))


def test_names_tell_thue_morse_words_apart():
    word = [0]
    while len(word) < 1024:
        word += [1 - x for x in word]
    a = bytes(97 + x for x in word)
    b = bytes(98 - x for x in word)
    at = np.array([0, 1024]), np.array([1024, 2048])
    x, y = SD.PrimeNames(a + b).of(*at)
    assert x != y
    same = SD.PrimeNames(b"xyz" + a + b"q" + a).of(np.array([3, 1028]), np.array([1027, 2052]))
    assert same[0] == same[1] == x


def test_equal_rows_survive_colliding_hashes(monkeypatch):
    cols = [np.array(c, np.uint64) for c in ([1, 2, 1, 3, 2], [5, 5, 5, 5, 6], [0, 0, 0, 0, 0])]
    want = [2, 1, 2, 1, 1]
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(SD, "mix64", lambda x: x * np.uint64(0))
        first, at, n = SD._equal_rows(*cols)
        assert n[at].tolist() == want
        assert all((c == c[first][at]).all() for c in cols)
