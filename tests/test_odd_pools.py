"""Metrics over pools that belong to no task's step, and over elements with an unknown operation."""

import pytest

from pagetrail.plans import runs


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    pools = [("a:0", "1", [None, "CLICK"], 0.5), ("a:0", "2", ["CLICK"], 0.4), ("a:1", "3", [None], 0.5)]
    pools += [(p, "4", ["CLICK"], 0.9) for p in ("portal-home", "", "a:", ":2", "a:99999999999", "live:a:0", None)]
    spark.createDataFrame(pools, "pool_id string, id string, ops array<string>, score double").write.parquet(f"{d}/candidates.parquet")
    case = "case_id bigint, task_id string, step int, gold_op string, gold_id string, valid_gold boolean, gold_in_shortlist boolean, drop_reason string"
    rows = [(n, "a", n, "CLICK", gold, True, True, None) for n, gold in enumerate(["1", "3", "4"])]
    spark.createDataFrame(rows, case).write.parquet(f"{d}/step_cases.parquet")
    return d


def test_micro_metrics(spark, sf):
    got = runs.micro_metrics(spark, sf).first()
    assert (got.steps, got.scored, got.op_acc, got.element_acc_given_op, got.step_success_scored) == (3, 3, 0.6667, 0.3333, 0.3333)


def test_macro_metrics(spark, sf):
    got = runs.macro_metrics(spark, sf).first()
    assert (got.tasks, got.op_acc_macro, got.element_acc_macro, got.success_rate) == (1, 0.6667, 0.3333, 0.0)
