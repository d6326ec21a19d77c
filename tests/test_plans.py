"""Shapes of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from casetrail.operators import ingest, reconcile, shards
from casetrail.operators.reconcile import ReconcileOptions
from casetrail.plans import catalog, domain

WRITES = re.compile("stream|roundtrip|aliases|dataset_scan|log_|_log|report_files|job_documents|job_manifest_csv|extract|cursor_store|_files|sidecar|landing_json|marker_disc|declared|mixed")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalog.load_all()[0] if not WRITES.search(n)))
def test_no_python_no_nested_loops_no_global_window(spark, small, name):
    plan = plan_of(queries()[name](spark, small))
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for line in plan.splitlines():
        if re.search(r"[-+] Window ", line):
            assert "], [" in line, f"window without partitioning: {line}"


def test_reconciliation_shuffles_rows_once(spark, small):
    source, collected = domain.source_manifest(spark, small), domain.collected_manifest(spark, small)
    plan = plan_of(reconcile.discrepancies(source, collected, ReconcileOptions(), F.lit(None).cast("timestamp")))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_filters_reach_the_scan(spark, small):
    plan = plan_of(queries()["verification_due"](spark, small))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    narrow = plan_of(queries()["manifest_totals"](spark, small))
    assert "l_shipdate" not in narrow and "l_partkey" not in narrow


def test_range_join_is_an_equi_join(spark, small):
    windows = shards.shard_windows(domain.shard_requests(spark, small))
    plan = plan_of(shards.assign_items(domain.dated_items(spark, small), windows))
    assert re.search(r"(BroadcastHash|SortMerge|ShuffledHash)Join \[custodian#\d+, __item_bin#\d+L\]", plan)


def test_cut_off_ranks_few_rows_per_task(spark):
    frame = spark.createDataFrame([], "dataset string, record_index long, outcome string, bytes_fetched long")
    frame = frame.unionByName(spark.range(10).selectExpr("'d' AS dataset", "id AS record_index", "'Failed' AS outcome", "id AS bytes_fetched"))
    plan = ingest.cut_off(frame, "dataset", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
