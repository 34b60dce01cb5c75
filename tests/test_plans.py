"""Physical-plan properties the scale design relies on."""

from innlytics.operators import booking as B
from innlytics.operators import dashboard as D
from innlytics.operators import reports as R
from innlytics.sources import standins

SMOKE = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_day_filter_and_as_of_bound_reach_the_scan(spark):
    t = standins.load(spark, SMOKE)
    p = _plan(R.daily_payments(t, "1996-01-02"))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-02T00:00)" in p
    p3 = _plan(D.recent_revenue(t, "1998-08-31"))
    assert "GreaterThanOrEqual(o_orderdate,1998-02-28T00:00)" in p3


def test_stay_key_window_pruned_when_unused(spark):
    t = standins.load(spark, SMOKE)
    assert "row_number" not in _optimized(R.occupancy_by_month(t))
    assert "row_number" in _optimized(t.detail_reservasi.select("id_detail"))


def test_overlap_has_no_stay_self_join(spark):
    t = standins.load(spark, SMOKE)
    p = _plan(B.overlapping_stays(t))
    # the only windows run over per-(room, day) summaries; stays are joined
    # to their own summary row on the equi-key (room, day), never to stays
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "Window" in p


def test_no_registered_query_pairs_rows_blindly(spark):
    # no cartesian product anywhere, and no nested-loop join that broadcasts
    # the data side (one-row values are scalar subqueries instead)
    import importlib.util
    import os
    from conftest import ROOT
    spec = importlib.util.spec_from_file_location("spark_entry_plans", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    bad = []
    for name, fn in mod.queries().items():
        if name in mod._training_data()[0]:
            continue  # they have tests of their own
        p = _plan(fn(spark, SMOKE))
        if "CartesianProduct" in p or "NestedLoopJoin BuildLeft" in p:
            bad.append(name)
    assert bad == []


def test_lookup_broadcast_is_size_checked(spark):
    from innlytics.plans import joins
    small = spark.range(3)
    big = spark.range(50)
    assert joins.fits(small, 10) and not joins.fits(big, 10)
    assert joins.lookup(big, 10) is big
    assert "broadcast" in _optimized(joins.lookup(small, 10).join(big, "id")).lower()


def test_scans_read_only_needed_columns(spark):
    t = standins.load(spark, SMOKE)
    p = _plan(R.revenue_by_month(t))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in p
