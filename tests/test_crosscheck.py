"""The cross-check of pools looks at interactive elements of every kind, not at links only."""

from pagetrail.plans import extras

CAND = "array<struct<tag: string, backend_node_id: string, attributes: string>>"


def test_all_interactive_elements_are_compared(spark, tmp_path):
    html = '<html><body><a href="/x" backend_node_id="1">A</a><button backend_node_id="2">B</button><input type="text" backend_node_id="3"><p backend_node_id="4">t</p></body></html>'
    pos, neg = [("a", "1", '{"href": "/x"}')], [("input", "3", '{"type": "text"}'), ("select", "5", "{}"), ("button", "6", None), ("p", "7", "{}"), None]
    schema = f"task_row bigint, actions array<struct<cleaned_html: string, pos_candidates: {CAND}, neg_candidates: {CAND}>>"
    spark.createDataFrame([(0, [(html, pos, neg)])], schema).write.parquet(f"{tmp_path}/tasks.parquet")
    assert {r.side: r.n for r in extras.pool_crosscheck(spark, str(tmp_path)).collect()} == {"page": 1, "candidates": 2}
