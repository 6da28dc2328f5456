"""Hint words come from all seven attributes of positive and negative candidates."""

import json

from pagetrail.plans import pools

CAND = "array<struct<tag: string, backend_node_id: string, attributes: string>>"


def test_hint_words(spark, tmp_path):
    def cand(**attrs):
        return ("a", "1", json.dumps(attrs))

    every = {"id": "mainNav", "name": "q_box", "class": "big-button", "title": "Go", "alt": "logo", "placeholder": "City", "aria_label": "find", "href": "unused"}
    actions = [
        ([cand(**every)], [cand(**{"class": "big"}), cand(title=""), None]),
        (None, [cand(placeholder="x" * 299 + " cut")]),
        ([cand(name="-solo")], None),
        (None, None),
    ]
    rows = [(0, actions), (1, None), (2, [None])]
    schema = f"task_row bigint, actions array<struct<pos_candidates: {CAND}, neg_candidates: {CAND}>>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/tasks.parquet")
    got = {r.word: r.n for r in pools.hint_words(spark, str(tmp_path)).collect()}
    assert got == {"main": 1, "Nav": 1, "q": 1, "box": 1, "big": 2, "button": 1, "Go": 1, "logo": 1, "City": 1, "find": 1, "x" * 299: 1, "solo": 1}
