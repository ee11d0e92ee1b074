"""Physical-plan shape: pushdown, hash aggregation, no pair explosion."""

from flowlens.operators import packets as PO
from flowlens.operators import rules as R
from flowlens.plans import flows as FL
from flowlens.plans import rules as RL
from flowlens.sources import fixtures as fx

SMOKE = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_incremental_scan_pushes_the_id_filter(spark):
    rows, _ = PO.fetch_new_packets(fx.packets(spark, SMOKE), last_id=500)
    p = plan(rows)
    assert "PushedFilters" in p and "GreaterThan(event_id,500)" in p


def test_flow_features_hash_aggregate_single_sweep(spark):
    p = plan(FL.flow_features_78(spark, SMOKE))
    assert "SortAggregate" not in p and "HashAggregate" in p
    # no hot keys at this size: one plain sweep
    assert p.count("MapInPandas") == 1


def test_enforcement_has_no_cartesian_or_nested_loop(spark):
    f = FL._flows(spark, SMOKE).select(*FL.KEY5, "seg_no", "start_us")
    p = plan(R.mark_blocked(f, RL.rules_mixed(spark, SMOKE)))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
