"""Queries with a cap stop where the reference stops, not before."""

from pagetrail.plans import extras, runs

TASKS = "task_row bigint, actions array<struct<cleaned_html: string>>"
STEP = "operation: string, action: string, text: string, url_before: string, url_after: string, page_changed: boolean"


def test_visible_text_stops_at_6000(spark, tmp_path):
    pages = [[f"{i:02d}" + "x" * 98 for i in range(n)] for n in (50, 70)]
    html = ["<html><body>" + "".join(f"<p>{line}</p>" for line in lines) + "</body></html>" for lines in pages]
    spark.createDataFrame([(k, [(h,)]) for k, h in enumerate(html)], TASKS).write.parquet(f"{tmp_path}/tasks.parquet")
    got = {r.page_key: r.text for r in extras.visible_text(spark, str(tmp_path)).collect()}
    assert got == {"0:0": "\n".join(pages[0]), "1:0": "\n".join(pages[1][:60])[:6000]}


def test_char_budget_is_1600(spark, tmp_path):
    rows = [("a", i, "x" * 80) for i in range(30)] + [("b", i, "x" * 40) for i in range(30)]
    spark.createDataFrame(rows, "pool_id string, cand_row bigint, label string").write.parquet(f"{tmp_path}/candidates.parquet")
    got = {r.pool_id: (r.kept, r.chars) for r in runs.char_budget(spark, str(tmp_path)).collect()}
    assert got == {"a": (20, 1600), "b": (25, 1000)}


def test_budget_actions_is_60(spark, tmp_path):
    rows = [(n, [("CLICK", f"b{i}", None, "u", "u", True) for i in range(n)]) for n in (5, 60, 70)]
    spark.createDataFrame(rows, f"run_id bigint, steps array<struct<{STEP}>>").write.parquet(f"{tmp_path}/live_runs.parquet")
    assert {r.run_id: r.n for r in runs.budget_actions(spark, str(tmp_path)).collect()} == {5: 5, 60: 60, 70: 60}
