"""Plans stay on the JVM, scan only what they use and never form cross products."""

import pytest

import __spark_entry__ as entry_point
from workload.registry import QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = [
    "dead_link_report", "link_statistics", "link_validation", "link_fix_candidates", "note_quality_checks",
    "validation_scores", "health_summary", "page_notes", "page_index", "snapshot_diff", "rebuild_set", "expired_backups",
    "module_summary", "module_dependency_graph", "repository_profile", "parallelism_estimate", "run_bottlenecks",
    "task_statistics", "error_report", "debounced_changes",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_product_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # Operator names: the error texts in a plan may well hold the word Python.
    for node in ("PythonUDF", "EvalPython", "MapInArrow", "InPandas"):
        assert node not in text


def test_scans_are_pruned(spark):
    text = plan(QUERIES["module_summary"](spark, SF))
    assert "p_retailprice" not in text and "l_extendedprice" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["expired_backups"](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["hub_notes"](spark, SF))


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0
