"""Exact dedup, sharding, URL filter and WARC against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from innlytics.llm import exact_dedup as ED
from innlytics.llm import sharding, url_filter, url_table, warc

from .url_held_out import ALLOW, BLOCK


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


# ---------------------------------------------------------------- exact dedup
def test_exact_dedup_matches_plain_grouping(make_docs, awkward, prose):
    texts = awkward + prose(20) + prose(20) + ["hot"] * 300
    out = ED.exact_dedup(make_docs(texts)).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[sha(t)].append(i)
    assert len(out) == len(texts)
    for r in out:
        g = groups[sha(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (
            max(g), len(g), r.doc_id == max(g), sha(texts[r.doc_id]))


def test_exact_dedup_null_ids_repeated_rows_and_empty(make_docs):
    out = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in
           ED.exact_dedup(make_docs(["a", "a", "a", "b", "b"], [None, 4, 4, None, None])).collect()}
    assert out == {(None, 4, 3, False), (4, 4, 3, True), (None, None, 2, True)}
    assert ED.exact_dedup(make_docs([])).count() == 0


def test_drop_copies_keeps_all_columns(make_docs):
    d = make_docs(["a", "b", "a", None, ""])
    kept = ED.drop_copies(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_cuckoo_filter_insert_delete_and_overflow():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    small = ED.CuckooFilter(16)
    with pytest.raises(ED.Overflow):
        for k in keys:
            small.insert(k)
    f = ED.CuckooFilter.fitting(len(keys))
    for k in keys:
        f.insert(k)
    assert all(k in f for k in keys)
    for k in keys[:1500]:
        assert f.delete(k)
    assert all(k in f for k in keys[1500:])
    assert sum(k in f for k in keys[:1500]) < 15  # only false positives


def test_digest_index_updates(spark, make_docs):
    first = ED.digests(make_docs(["a", "b", "b", "c"]))
    index = ED.DigestIndex.empty(spark, 4).insert(first)
    index = index.insert(ED.digests(make_docs(["a", "d"], [10, 11])))
    index = index.delete(ED.digests(make_docs(["c", "never seen"])))
    held = {r.text_sha256: (r.keep_id, r.group_size) for r in index.content().collect()}
    assert held == {sha("a"): (10, 2), sha("b"): (2, 2), sha("d"): (11, 1)}
    back = index.insert(ED.digests(make_docs(["c"], [77])))
    probe = {r.text_sha256: r.group_size for r in back.lookup(ED.digests(make_docs(["c", "e"]))).collect()}
    assert probe == {sha("c"): 1, sha("e"): 0}


def test_bucket_resizes_from_stored_keys():
    import pandas as pd
    b = ED.Bucket(pd.DataFrame({"digest": [], "keep_id": [], "group_size": [], "filter": []}))
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(2000)]
    for i, k in enumerate(keys):
        b.insert(k, i, 1)
    assert b.resizes > 0 and len(b.content) == 2000 and all(k in b.filter for k in keys)
    for k in keys:
        b.delete(k)
    assert not b.content and not any(b.filter.slots)


# ------------------------------------------------------------------- sharding
def _check_shards(rows, texts, n):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(n)]
    assert len(rows) == len(texts) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_law_and_links(make_docs, awkward):
    texts = awkward + [f"text {i % 150}" for i in range(600)] + [f"alone {i}" for i in range(400)]
    rows = sharding.shard_documents(make_docs(texts)).collect()
    _check_shards(rows, texts, 40)
    at = defaultdict(set)
    for r in rows:
        at[texts[r.doc_id]].add(r.shard)
    split = sum(len(at[f"text {i}"]) > 1 for i in range(150))
    assert split < 15  # groups of four start on about four shards each


def test_sharding_one_group_larger_than_shards(make_docs):
    texts = ["same"] * 500 + [str(i) for i in range(500)]
    _check_shards(sharding.shard_documents(make_docs(texts)).collect(), texts, 40)
    assert sharding.shard_documents(make_docs([])).count() == 0
    _check_shards(sharding.shard_documents(make_docs(["a"])).collect(), ["a"], 40)


# ----------------------------------------------------------------- URL filter
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block")]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m.group())
        path = re.match(r"[^?#]*", rest[m.end():]).group()
    best = None
    for text, says in RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(text) > len(best[0]):
                best = (text, says)
    return host, path, best


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.com/en/x?y#z",
            "http://sub.example.com/en/", "http://www.example.com/en/1", "http://x.www.example.com/en/1",
            "https://q.net/es/1", "https://net/fr/", "https://notnet/fr/", "http://É.net/es/?a=://b", "ftp://a#b/en/",
            "http://example.com/EN/", "http://e.net/" + "x" * 5000, "http://dup.org/", "http://dup.org/"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)],
                               "page_id long, url string, host string, says string")
    out = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = plain(u)
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert 0 <= r.score <= 1
        assert r.verdict == (best[1] if best else ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_model_tells_spam_from_the_rest(spark):
    bad = ["http://cheap-pills.example.org/x", "http://spam-farm.example.org/en/9", "https://casino-win.example.net/en/2"]
    good = ["http://therhen.example.org/en/31", "https://blog.onthe.example.net/en/5#top", "http://library.example.org/a"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df).collect()}
    assert [got[i] for i in range(6)] == ["block"] * 3 + ["allow"] * 3


def test_url_grams_are_three_to_five_characters(spark):
    text = "^abcdef/x$"
    grams = [text[i:i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]
    df = spark.createDataFrame([("abcdef", "/x", grams)], "host string, path string, grams array<string>")
    got = df.select(url_filter.grams().alias("g"), F.transform("grams", lambda x: F.pmod(
        F.xxhash64(x), F.lit(url_filter.BUCKETS)).cast("int")).alias("want")).first()
    assert got.g == got.want


def test_url_model_on_held_out_shapes(spark):
    trained = {re.split("[/:]+", u)[1] for u, _ in url_table.rows()}
    assert not any(re.split("[/:]+", u)[1] in trained for u in BLOCK + ALLOW)
    df = spark.createDataFrame(list(enumerate(BLOCK + ALLOW)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, rules=()).collect()}
    missed = sum(got[i] == "allow" for i in range(len(BLOCK)))
    wrong = sum(got[i] == "block" for i in range(len(BLOCK), len(got)))
    assert missed <= len(BLOCK) // 4 and wrong <= len(ALLOW) // 4


def test_url_plan_is_native(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_filter.judge_urls(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


# ----------------------------------------------------------------------- WARC
def test_warc_round_trip_rejects_magic_in_payloads(spark):
    r = random.Random(5)
    big = "<p>" + "word " * 400
    trap = ("WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" * 40)
    htmls = [None, "", "tiny", "tiny", big, big, big, trap, trap, "é" * 700, "x" * 200_000, "WARC/1.0\r\n", "\r\n\r\n"]
    htmls += ["".join(r.choice("ab\r\n") for _ in range(r.randint(0, 2000))) for _ in range(200)]
    df = spark.createDataFrame([(i, f"http://a/{i}\r\nx", h, 1) for i, h in enumerate(htmls)],
                               "page_id long, url string, html string, begin int")
    path = warc.write_warc(df.repartition(3))
    out = {r.page_id: r for r in warc.read_warc(spark, path, payloads=True).collect()}
    best = {}
    for i, h in enumerate(htmls):
        best[h or ""] = i
    assert len(out) == len(htmls)
    for i, h in enumerate(htmls):
        raw, o = (h or "").encode(), out[i]
        first = best[h or ""]
        revisit = len(raw) >= 1000 and first != i
        assert (o.payload_bytes, o.payload_digest, o.record_type, o.refers_to, o.intact) == (
            len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None, True)
        assert bytes(o.payload) == (b"" if revisit else raw)


def test_warc_null_ids_repeated_rows_and_empty(spark):
    big = "y" * 1500
    df = spark.createDataFrame([(None, None, big), (3, None, big), (3, None, big), (2, "u", big)],
                               "page_id long, url string, html string")
    out = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_pages(df).collect())
    assert out == [("2", "revisit", 3), ("3", "response", None), ("3", "response", None), ("None", "revisit", 3)]
    assert warc.archive_pages(df.limit(0)).count() == 0
