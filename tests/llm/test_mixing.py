"""Source mix against a plain queue, and its targets against resharing by hand."""

import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest

from innlytics.llm import mixing


def resharing(sizes, weights, repeats):
    """Targets by rounds: shares by weight; what is above the cap goes to the rest."""
    held, left = {}, Fraction(sum(sizes.values()))
    while True:
        units = sum(w for s, w in weights.items() if s not in held)
        share = {s: left * w / units for s, w in weights.items() if s not in held} if units else {}
        above = [s for s, x in share.items() if x > repeats * sizes[s]]
        if not above:
            return {**held, **share}
        for s in above:
            held[s] = Fraction(repeats * sizes[s])
            left -= held[s]


def plain(rows):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    by = defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        by[s].append(i)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size[i] for i in by[s]) for s in names}
    target = resharing(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 3)
    key = lambda i: hashlib.md5(f"{'' if rows[i][0] is None else rows[i][0]}:{hashlib.md5((rows[i][1] or '').encode()).hexdigest()}".encode()).hexdigest()  # noqa: E731,E501
    taken = [0] * len(rows)
    for s in names:
        sent, order = 0, sorted(by[s], key=lambda i: (key(i), i))
        for i in order * 3:
            taken[i] += max(0, min(size[i], int(target[s]) - sent))
            sent += size[i]
    return [(size[i], sizes[rows[i][2]], float(target[rows[i][2]]), taken[i]) for i in range(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows],
                                 "doc_id long, text string, source string, size int, place int")


@pytest.fixture()
def rows(prose, awkward):
    texts = prose(150, seed=4) + awkward + ["same words here"] * 40
    names = ["src1", "src10", "src2", "é", "Z", None, "tiny", ""]
    out = [(i, t, "src1" if i % 3 else names[i % len(names)]) for i, t in enumerate(texts)]
    out += [(7, "repeated row", "Z")] * 30 + [(None, "no id", None)] * 5 + [(500, "one word", "tiny"), (501, None, "silent")]
    return out


def test_taken_words_equal_a_plain_queue(spark, rows):
    got = mixing.mix_documents(frame(spark, rows)).collect()
    want = plain(rows)
    pairs = lambda xs: sorted(((str(a), b, c, round(d, 6), e) for a, b, c, d, e in xs))
    assert pairs((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == pairs(
        (rows[i][0], *w) for i, w in enumerate(want))
    assert all(r.taken <= 3 * r.size and (r.first_position is None) == (r.taken == 0) for r in got)


def test_mix_is_gapless_in_order_of_finish_and_fills_the_budget(spark, rows):
    queued = mixing.queue(frame(spark, rows))
    out = sorted(mixing.mix(queued).collect(), key=lambda r: r.position)
    at = 0
    for a, b in zip(out, out[1:]):
        assert a.finish <= b.finish
    for r in out:
        assert r.position == at
        at += r.words
    total = sum(len((t or "").encode().split()) for _, t, _ in rows)
    assert total - 10 <= at <= total


def test_small_buckets_change_nothing(spark, rows, monkeypatch):
    whole = sorted(map(tuple, mixing.mix_documents(frame(spark, rows)).collect()), key=str)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    monkeypatch.setattr(mixing, "SPAN_BUCKETS", 3)
    assert sorted(map(tuple, mixing.mix_documents(frame(spark, rows).repartition(7)).collect()), key=str) == whole


def test_targets_are_shared_again_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 500, "e": 7, "f": 100}
    out = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = resharing(sizes, dict(zip("abcdef", (5, 2, 1, 5, 2, 1))), 3)
    assert {r.source: round(r.target, 6) for r in out} == {s: round(float(x), 6) for s, x in want.items()}
    assert (want["a"], want["c"], want["e"]) == (30, 9, 21) and sum(want.values()) == 1620


def test_one_source_empty_table_and_wordless_documents(spark):
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_documents(frame(spark, [(1, "a b c", "x")])).collect()] == [3]
    assert [(r.taken, r.target) for r in mixing.mix_documents(frame(spark, [(1, None, None), (2, " ", "y")])).collect()] == [(0, 0.0)] * 2


def test_no_python_in_the_plan(spark, rows):
    plan = mixing.mix_documents(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
