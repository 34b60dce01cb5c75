"""The pipeline against a plain replay of its stages on a small fixture."""

import random

import pytest

import corpus_pipeline as C
from innlytics.llm import classifier
from innlytics.plans.checkpoint import cut

from .test_text_ops import plain_components, plain_repeats, plain_sets

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    prose = [" ".join(r.choice(words) for _ in range(r.randint(80, 200))).capitalize() + "." for _ in range(120)]
    passage = " ".join(r.choice(words) for _ in range(90))
    junk = [t.upper().replace(" ", "!! ") for t in prose[:40]]
    copies = prose[5:15] + [t + " tail" for t in prose[20:30]] + [t + " " + passage for t in prose[40:44]]
    texts = prose + junk + copies + [None, "", "  "]
    docs = [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < 120), 0) for i in range(160)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_follow_each_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "exact_copies", "near_copies", "repeated_passages", "packed"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in classifier.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    out = []
    for name, stage in C.STAGES:
        docs = cut(stage(spark, docs, folder), name)
        if name != "packed":
            assert docs.columns == columns
            out.append({r.doc_id: r.text for r in docs.collect()})
    good, unique, apart, stripped = out
    assert set(good) == {i for i, p in scores.items() if p == 1}
    assert sum(i in good for i in range(120)) >= 118 and not any(i in good for i in range(120, 160))
    last = {}
    for i in sorted(good):
        last[good[i] or ""] = i
    assert set(unique) == set(last.values())
    ids = sorted(unique)
    roots = plain_components(plain_sets([unique[i] for i in ids]))
    assert set(apart) == {i for k, i in enumerate(ids) if roots[k] == k}
    ids = sorted(apart)
    for i, (_, removed, _, _) in zip(ids, plain_repeats([apart[i] for i in ids], 400)):
        assert len((apart[i] or "").encode()) - len((stripped[i] or "").encode()) == removed
    assert sum(texts[i] != stripped[i] for i in stripped) >= 4
    total = {}
    for r in docs.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= 4096
    assert set(total) == set(stripped)


def test_run_returns_the_last_stage(spark, folder):
    assert C.run(spark, folder).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert C.ORACLE_SQL is None


@pytest.mark.parametrize("written", [False, True])
def test_one_row_of_equal_texts_stays_whatever_its_id(spark, make_docs, prose, tmp_path, written):
    a, b, c, d, e, f = prose(6, seed=4)
    near = a.replace(a.split()[9], "other", 1)
    docs = make_docs([a, a, near, b, b, c, d, e, f, f + " tail"], [None, None, None, 7, 7, 8, 8, 9, 5, None])
    if written:
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    unique = cut(C.exact_copies(spark, docs, ""), "unique")
    assert sorted(r.text for r in unique.collect()) == sorted([a, near, b, c, d, e, f, f + " tail"])
    apart = cut(C.near_copies(spark, unique, ""), "apart")
    got = [(r.doc_id, r.text) for r in apart.collect()]
    assert len(got) == 6 and {(7, b), (8, c), (8, d), (9, e), (5, f)} < set(got)  # two texts of id 8 are two rows
    assert sum(i is None and t in (a, near) for i, t in got) == 1
    stripped = C.repeated_passages(spark, apart, "")
    assert apart.columns == docs.columns and sorted(r.text for r in stripped.collect()) == sorted(t for _, t in got)
