"""Counts over intervals against comparing every pair."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from innlytics.plans import intervals as IV

BASE = dt.date(1969, 11, 1)


def day(n):
    return None if n is None else BASE + dt.timedelta(days=n)


@pytest.mark.parametrize("seed, span", [(1, 40), (2, 400), (3, 12_000)])
def test_overlap_count_of_any_dates(spark, seed, span):
    """Turned, empty, NULL and very long ranges on both sides; NULL rooms; hot days."""
    r = random.Random(seed)
    def ranges(n):
        out = []
        for i in range(n):
            a = r.choice([None, r.randrange(span), r.randrange(span), span // 2])
            b = r.choice([None, r.randrange(span), (a or 0) + r.randrange(4), (a or 0) - r.randrange(4)])
            out.append((i, r.choice([1, 1, 1, 2, None]), a, b))
        return out
    stays, asked = ranges(150), ranges(120)
    frame = lambda rows: spark.createDataFrame([(i, k, day(a), day(b)) for i, k, a, b in rows],
                                               "id long, room long, ci date, co date")
    got = {x["id"]: x["n"] for x in IV.overlap_count(frame(stays), frame(asked), ["room"], "id", "ci", "co").collect()}
    for i, k, a, b in asked:
        want = sum(k is not None and s == k and None not in (a, b, c, d) and c < b and d > a for _, s, c, d in stays)
        assert got.get(i, 0) == want
    whole = {x["id"]: x["n"] for x in IV.overlap_count(frame(stays), frame(asked), [], "id", "ci", "co").collect()}
    for i, _, a, b in asked:
        assert whole.get(i, 0) == sum(None not in (a, b, c, d) and c < b and d > a for _, _, c, d in stays)


@pytest.mark.parametrize("top", [0, 2, 12])
def test_count_inside_at_every_length(spark, monkeypatch, top):
    monkeypatch.setattr(IV, "TOP_LEVEL", top)
    r = random.Random(top)
    points = [(r.choice(["a", "b"]), x, x + r.choice([0, 0, 1, 3, 20]), r.randint(1, 3)) for x in (r.randrange(-40, 90) for _ in range(120))]
    asked = [(i, r.choice(["a", "b", "c"]), lo, lo + r.choice([0, 1, 2, 3, 9, 33, 70])) for i, lo in
             enumerate(r.randrange(-50, 60) for _ in range(90))]
    p = spark.createDataFrame([(k, day(x), day(y), w) for k, x, y, w in points], "k string, x date, y date, w long")
    q = spark.createDataFrame([(i, k, day(a), day(b)) for i, k, a, b in asked], "id long, k string, lo date, hi date")
    got = {x["id"]: x["cnt"] for x in IV.count_inside(p, q, ["k"], "x", "y", "w", "id", "lo", "hi").collect()}
    for i, k, a, b in asked:
        assert got.get(i, 0) == sum(w for s, x, y, w in points if s == k and a < x and y < b)
    assert IV.count_inside(p, q.limit(0), ["k"], "x", "y", "w", "id", "lo", "hi").count() == 0


def test_a_long_range_costs_few_rows(spark):
    """No row per day: twenty years take a few dozen blocks."""
    q = spark.createDataFrame([(1, "a", dt.date(2000, 1, 2), dt.date(2019, 12, 30))], "id long, k string, lo date, hi date")
    p = spark.createDataFrame([("a", dt.date(2001, 1, 1) + dt.timedelta(days=i), dt.date(2001, 1, 2) + dt.timedelta(days=i), 1)
                               for i in range(0, 6000, 7)], "k string, x date, y date, w long")
    out = IV.count_inside(p, q, ["k"], "x", "y", "w", "id", "lo", "hi")
    assert out.collect()[0]["cnt"] == 858
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in text and F.lit(1) is not None


@pytest.mark.parametrize("seed, span", [(1, 30), (2, 9000)])
def test_earliest_overlap_against_all_pairs(spark, seed, span):
    r = random.Random(seed)
    make = lambda n, base: [(base + i, r.choice([1, 1, 2]), a, a + r.choice([1, 2, 5, span // 2])) for i, a in
                            enumerate(r.randrange(-span, span) for _ in range(n))]
    items, asked = make(80, 0), make(60, 40)
    schema = "n long, k int, a int, b int"
    got = {x["n"]: x["first"] for x in IV.earliest_overlap(
        spark.createDataFrame(items, schema), spark.createDataFrame(asked, schema), "k", "a", "b", "n").collect()}
    for n, k, a, b in asked:
        assert got.get(n) == min((m for m, s, c, d in items if s == k and c < b and d > a), default=None)
