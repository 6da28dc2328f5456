"""Task ids count as one task in whatever spelling an exporter wrote them."""

import pytest
from pyspark.sql import functions as F

from pagetrail.functions import text as X
from pagetrail.operators import rank as R
from pagetrail.plans import pools, runs

HEX = "2e4e47b6b401d657af2890c0e4d8416a"
DASHED = "2e4e47b6-b401-d657-af28-90c0e4d8416a"
SPELLINGS = [DASHED, HEX, DASHED.upper(), DASHED.replace("-", "_"), "{" + DASHED + "}", "task_" + DASHED, "m2w/" + HEX, DASHED + ".json", f" {HEX} "]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """One task whose steps are spelled differently in each case row; every step has a pool of two elements."""
    d = str(tmp_path_factory.mktemp("ids"))
    n = len(SPELLINGS)
    cand = "cand_row bigint, pool_id string, id string, label string, role string, value string, ops array<string>, hints string, doc_order int, score double, captured_at timestamp"
    rows = [(2 * s + k, f"{DASHED}:{s}", str(k), "Go", "button", "", ["CLICK"], "", k, 1.0 - k, None) for s in range(n) for k in (0, 1)]
    spark.createDataFrame(rows, cand).write.parquet(f"{d}/candidates.parquet")
    case = "case_id bigint, task_id string, step int, website string, gold_op string, gold_id string, valid_gold boolean, gold_in_shortlist boolean, drop_reason string"
    rows = [(s, t, s, "a.example", "CLICK", "0", True, True, None) for s, t in enumerate(SPELLINGS)]
    spark.createDataFrame(rows, case).write.parquet(f"{d}/step_cases.parquet")
    spark.createDataFrame([(0, DASHED, "go", [0] * n)], "task_row bigint, annotation_id string, confirmed_task string, actions array<int>").write.parquet(f"{d}/tasks.parquet")
    spark.createDataFrame([], "page_id string, run_id bigint").write.parquet(f"{d}/page_snapshots.parquet")
    spark.createDataFrame([], "run_id bigint, goal string").write.parquet(f"{d}/live_runs.parquet")
    return d


def test_pool_key(spark):
    names = [f"{t}:3" for t in SPELLINGS] + [f"live:{DASHED}", "live:7", "plain:1", "plain"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "x string").select(X.pool_key(F.col("x"))).collect()]
    assert got == [f"{HEX}:3"] * len(SPELLINGS) + [f"live:{DASHED}", "live:7", "plain:1", "plain"]


def test_gold_in_every_spelling_is_ranked(spark, sf):
    n = len(SPELLINGS)
    assert {r.steps for r in pools.recall_at_k(spark, sf).collect()} == {n}
    lift = pools.role_lift(spark, sf).collect()
    assert [(r.n_pool, r.n_gold) for r in lift] == [(2 * n, n)]


def test_sweep_counts_every_spelling(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "VARIANTS", R.VARIANTS[:1])
    assert {r.steps for r in pools.variant_sweep(spark, sf).collect()} == {len(SPELLINGS)}


def test_metrics_are_over_whole_tasks(spark, sf):
    micro = runs.micro_metrics(spark, sf).first()
    assert (micro.scored, micro.step_success_scored) == (len(SPELLINGS), 1.0)
    macro = runs.macro_metrics(spark, sf).first()
    assert (macro.tasks, macro.step_success_macro, macro.success_rate) == (1, 1.0, 1.0)


def test_task_sample_takes_every_spelling_of_a_task(spark, tmp_path):
    rows = [(30 * s + k, t.replace("2e4e47b6", f"{k:08x}").replace("2E4E47B6", f"{k:08X}")) for s, t in enumerate(SPELLINGS) for k in range(30)]
    spark.createDataFrame(rows, "case_id bigint, task_id string").write.parquet(f"{tmp_path}/step_cases.parquet")
    got = runs.task_sample(spark, str(tmp_path)).collect()
    assert len({r.case_id % 30 for r in got}) == 25 and len(got) == 25 * len(SPELLINGS)
    assert {(r.case_id, r.task_id) for r in got} <= set(rows)
