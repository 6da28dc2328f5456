import json

import pytest
from pyspark.sql import functions as F

from pagetrail.functions import text as X
from pagetrail.functions import urls as U
from pagetrail.operators import guards
from pagetrail.sources import json_io


def col(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_text_functions(spark):
    assert col(spark, ["Gödel's  Straße!", "ﬁne", None, ""], lambda c: X.normalised(c)) == ["godel s strasse", "fine", None, ""]
    assert col(spark, ["Wörld ﬁ x 12"], lambda c: X.tokens(X.ascii_lower(c))) == [["world", "fi", "12"]]
    assert col(spark, ["types", "bus", "this", "classes"], lambda c: X.stem_s(c)) == ["type", "bus", "thi", "classe"]
    assert col(spark, ["walking", "going", "red", "boxes", "only", "its"], lambda c: X.stem_light(c)) == ["walk", "going", "red", "box", "only", "its"]
    assert col(spark, ["mainNav-item_big.x"], lambda c: X.split_identifier(c)) == ["main Nav item big x"]
    assert col(spark, [" a  b c "], lambda c: X.first_words(c, 2)) == ["a b"]
    assert col(spark, ["a b", "x"], lambda c: X.squash(c, 2)) == ["a ", "x"]
    raws = ['<think>{"no": 1}</think> {"a": {"b": 1}}', '```json\n{"a": 1}\n```', "text {oops", "[1, 2]", None, 'so {"a": 1} end']
    assert col(spark, raws, lambda c: X.json_object(c)) == ['{"a": {"b": 1}}', '{"a": 1}', None, None, None, '{"a": 1}']
    import hashlib

    hosts = ["a.test", "portal.example", ""]
    assert col(spark, hosts, lambda c: X.md5_mod(c, 20)) == [int(hashlib.md5(h.encode()).hexdigest(), 16) % 20 for h in hosts]
    assert col(spark, ["a2V0dGxl", "a2V0dGxlcw", "a", None], lambda c: X.base64url_contains(c, "kettle")) == [True, True, False, False]
    pairs = col(spark, [["click", "nfl", "scores", "nfl"], ["one"], []], lambda c: X.query_bigrams(c), "array<string>")
    assert pairs == [["nfl scores", "scores nfl"], [], []]


def test_urls(spark):
    urls = ["https://WWW.A.test/x//?q=a+b#f", "not a url", None, "http://b.test"]
    assert col(spark, urls, lambda c: U.canonical(c)) == ["a.test/x", None, None, "b.test"]
    assert col(spark, urls, lambda c: U.query_value(c, "q")) == ["a b", None, None, None]
    goal = F.lit("find it")
    hrefs = ["/w?action=edit", "/w/edit/2", "/edition", "/w?x=action=history&action=history", None]
    assert col(spark, hrefs, lambda c: U.is_detour(c, goal)) == [True, True, False, True, False]
    assert col(spark, hrefs, lambda c: U.is_detour(c, F.lit("show the revision"))) == [False] * 5
    assert col(spark, ["https://a.test/#", "javascript:x", "http://a.test/#top"], lambda c: U.merges(c)) == [False, False, True]


def test_json_round_trip(spark, tmp_path):
    task = {"annotation_id": "t1", "website": "w", "domain": "d", "confirmed_task": "Zürich", "actions": [{"action_uid": "u", "cleaned_html": "<a>", "operation": {"op": "CLICK", "original_op": "CLICK", "value": ""}, "pos_candidates": [], "neg_candidates": [None]}]}
    (tmp_path / "train_0.json").write_text(json.dumps([task, {**task, "annotation_id": "t2", "actions": None}]))
    df = json_io.read_splits(spark, {"train": str(tmp_path / "train_*.json")})
    assert sorted(r.annotation_id for r in df.collect()) == ["t1", "t2"] and df.first().split == "train"
    (tmp_path / "dev_0.json").write_text("[]")
    with pytest.raises(ValueError, match="dev"):
        json_io.read_splits(spark, {"dev": str(tmp_path / "dev_*.json")})
    out = str(tmp_path / "lines")
    json_io.write_lines(df.select("annotation_id", "confirmed_task", "actions"), out)
    text = "".join(p.read_text() for p in (tmp_path / "lines").glob("*.json"))
    assert "Zürich" in text and '"actions":null' in text
    assert json_io.read_lines(spark, out, "annotation_id string, confirmed_task string").count() == 2
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "b.json").write_text('{"task": "b"}')
    (runs / "a.json").write_text('{\n"task": "a"}')
    (runs / "bench_x.json").write_text('{"task": "no"}')
    got = json_io.read_run_dir(spark, str(runs), "task string", excluding="bench_").orderBy("file").collect()
    assert [r.task for r in got] == ["a", "b"]


def test_guards(spark):
    pages = spark.createDataFrame([("p", "m1"), ("q", "m2")], "page string, mark string")
    decisions = spark.createDataFrame([(1, "p", "m1"), (1, "p", "m1"), (2, "p", "old"), (3, "q", "m2")], "decision_id int, page string, mark string")
    assert sorted(r.decision_id for r in guards.fresh(decisions, pages, "page", "mark").collect()) == [1, 3]
    f = lambda a, b: guards.fingerprint(F.lit(a).cast("string"), F.lit(b).cast("string"), names=["b", "a"])
    r = spark.range(1).select(f("x", None), f("x", None), f(None, "x")).first()
    assert r[0] == r[1] != r[2]
    memo = spark.createDataFrame([("g", None, "t1"), ("g", "u", "t2")], "goal string, url string, text string")
    req = spark.createDataFrame([(1, "g", None), (2, "h", "u")], "i int, goal string, url string")
    assert {x.i: x.text for x in guards.reused(req, memo, ["goal", "url"], "text").collect()} == {1: "t1", 2: None}
