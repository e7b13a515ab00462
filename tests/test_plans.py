"""Physical-plan shape: the choices that matter at scale."""

import __spark_entry__ as E
from conftest import SMOKE
from quire.operators.dedup import dedup_first
from quire.plans.fixtures import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_has_no_global_window(spark):
    df = E.queries()["paper_listing"](spark, SMOKE)
    df.collect()
    p = plan(df)
    assert "TakeOrderedAndProject" in p and "Window" not in p
    assert "Subquery" in p and "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_group_limit_before_shuffle(spark):
    p = plan(E.queries()["cap_per_task"](spark, SMOKE))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_dedup_is_partial_aggregate(spark):
    ev = table(spark, SMOKE, "events")
    p = plan(dedup_first(ev, ["event_type", "user_id"], ["ts", "event_id"]))
    assert "partial_min_by" in p


def test_scan_prunes_columns(spark):
    df = E.queries()["distinct_sites"](spark, SMOKE)
    df.collect()
    p = plan(df)
    assert "ReadSchema: struct<source:string>" in p


def test_seq_has_no_single_partition_window_over_rows(spark):
    q = E.queries()["assign_seq"](spark, SMOKE)
    p = plan(q)
    assert "rangepartitioning" in p
    # the only window runs on the per-partition counts behind a broadcast
    assert p.count("Window") <= 1 and "BroadcastExchange" in p


def test_small_batch_ledger_join_is_broadcast(spark):
    df = E.queries()["new_vs_ledger_broadcast"](spark, SMOKE)
    df.collect()
    p = plan(df)
    assert "BroadcastHashJoin" in p and "LeftAnti" in p and "LeftSemi" in p
    assert "SortMergeJoin" not in p


def test_bucketed_ledger_is_not_shuffled(spark):
    from quire.operators.dedup import new_vs_ledger
    from quire.plans.harvest_queries import _ledger_of_events
    batch, ledger = _ledger_of_events(spark, SMOKE)
    df = new_vs_ledger(batch, ledger.hint("merge"))
    df.collect()
    p = plan(df)
    final = p[:p.index("== Initial Plan ==")] if "== Initial Plan ==" in p else p
    assert "SortMergeJoin" in final and "LeftAnti" in final
    # one exchange, that of the batch; the ledger side is a bucketed scan
    assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final
    side = final[final.index("quire_ledger_") - 400:]
    assert "Exchange" not in side[side.index("FileScan"):]


def test_hot_group_spreads_over_range_partitions(spark):
    from pyspark.sql import functions as F
    from quire.operators.seq import assign_seq
    d = table(spark, "/root/testdata/sf0.01", "documents").select("lang", "doc_id")
    out = assign_seq(d, ["lang", "doc_id"], 0, partitions=8)
    parts = out.where(F.col("lang") == "en").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 3   # the 60% group is not in one task
