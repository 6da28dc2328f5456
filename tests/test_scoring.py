import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import calibrate, evaluate, route, sample, summarize
from pagetrail.operators.asof import asof_join
from pagetrail.operators.cases import context_text, drop_reason, history_line, one_hot, option_text, parsed_option, with_history

CASE = "task_id string, step int, gold_op string, gold_id string, valid_gold boolean, gold_in_shortlist boolean, drop_reason string, pool_size int"
PRED = "task_id string, step int, operation string, targets map<string,string>, error string"


def metrics(spark, cases, preds):
    rows = evaluate.outcomes(spark.createDataFrame(cases, CASE), spark.createDataFrame(preds, PRED))
    return evaluate.micro(rows).first().asDict() | evaluate.macro(rows).first().asDict()


def test_metrics(spark):
    ok = [("t", 0, "CLICK", "1", True, True, None, 3), ("t", 1, "TYPE_TEXT", "2", True, True, None, 3)]
    perfect = [("t", 0, "CLICK", {"CLICK": "1"}, None), ("t", 1, "TYPE_TEXT", {"TYPE_TEXT": "2"}, None)]
    m = metrics(spark, ok, perfect)
    assert (m["op_acc"], m["step_success_overall"], m["success_rate"], m["tasks"]) == (1.0, 1.0, 1.0, 1)
    lexical = [("t", 0, "CLICK", {"CLICK": "1", "TYPE_TEXT": "2"}, None), ("t", 1, "CLICK", {"CLICK": "9", "TYPE_TEXT": "2"}, None)]
    m = metrics(spark, ok, lexical)
    assert (m["op_acc"], m["element_acc_given_op"], m["step_success_scored"], m["success_rate"]) == (0.5, 1.0, 0.5, 0.0)
    m = metrics(spark, ok, [("t", 0, None, None, "boom"), ("t", 1, None, None, "boom")])
    assert m["errors"] == 2 and m["op_acc"] == 0.0
    hard = [("t", 0, "CLICK", "1", True, True, "trivial", 1), ("u", 0, "CLICK", None, False, False, "no_gold", 3), ("u", 1, "CLICK", "5", True, False, "gold_not_shortlisted", 40)]
    m = metrics(spark, hard, [])
    assert m["step_success_macro"] == 0.5 and m["success_rate"] == 0.5 and m["valid_gold"] == 2
    m = metrics(spark, [], [])
    assert m["steps"] == 0 and m["op_acc"] is None and m["success_rate"] is None


def test_predictors(spark):
    top = spark.createDataFrame([("t", 0, "CLICK", "1"), ("t", 0, "SELECT", "2")], "task_id string, step int, op string, id string")
    assert evaluate.baseline_predictions(top).first().targets == {"CLICK": "1", "SELECT": "2"}
    answers = spark.createDataFrame(
        [("t", 0, None, ["CLICK"], {"CLICK": "7"}, {"CLICK": "1", "SELECT": "4"}, None), ("t", 1, None, ["CLICK", "SELECT"], None, None, None)],
        "task_id string, step int, operation string, ops_available array<string>, chosen map<string,string>, sole map<string,string>, error string",
    )
    got = {r.step: r for r in evaluate.answered_predictions(answers).collect()}
    assert got[0].operation == "CLICK" and got[0].targets == {"CLICK": "7", "SELECT": "4"} and got[1].operation is None and got[1].targets == {}


def one(spark, *cols, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(*cols).first()


def test_texts(spark):
    r = one(
        spark, option_text(F.lit(" A  b "), F.lit("link"), F.lit("v" * 30)).alias("a"), option_text(F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string")).alias("b"),
        parsed_option(F.lit("Buy (now) (button, =3)")).alias("c"), parsed_option(F.lit("plain")).alias("d"), history_line(F.lit("CLICK"), F.lit("Go"), F.lit("")).alias("e"),
        history_line(F.lit("TYPE_TEXT"), F.lit("City"), F.lit("Bern")).alias("f"), context_text(F.lit("main"), F.lit("News"), F.lit("r " * 50)).alias("g"), one_hot(F.array(F.lit("x"), F.lit("y")), F.lit("y")).alias("h"),
        x=1,
    )
    assert r.a == "A b (link, =" + "v" * 20 + ")" and r.b == "unnamed" and tuple(r.c) == ("Buy (now)", "button", "3") and tuple(r.d) == ("plain", "", "")
    assert r.e == "CLICK Go" and r.f == "TYPE_TEXT City = Bern" and r.g.startswith("main > News · row: r r") and [x.p for x in r.h] == [0.0, 1.0]
    reasons = spark.createDataFrame([(None,) * 5, (True, None, None, None, None), (True, True, False, None, None), (True, True, True, False, True), (True, True, True, True, False), (True,) * 5], "a boolean, b boolean, c boolean, d boolean, e boolean")
    got = [x[0] for x in reasons.select(drop_reason(*map(F.col, "abcde"))).collect()]
    assert got == ["no_gold", "gold_not_interactive", "op_not_allowed", "gold_not_shortlisted", "trivial", None]
    h = with_history(spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c"), (1, 3, "d")], "t int, s int, line string"), "t", ["s"], "line", 2)
    assert [list(x.history) for x in h.orderBy("s").collect()] == [[], ["a"], ["a"], ["c"]]


def test_resolver(spark):
    els = spark.createDataFrame(
        [("p", "1", "Search flights", None), ("p", "2", "Söarch!", ["Find"]), ("p", "3", "Dates", None), ("p", "4", "Dates", None), ("p", "5", None, None), ("q", "1", "Find", None)],
        "page string, id string, label string, aliases array<string>",
    )
    wants = spark.createDataFrame([("p", 1, "search FLIGHTS"), ("p", 2, "find"), ("p", 3, "dates"), ("p", 4, "flights"), ("p", 5, ""), ("p", 6, None), ("p", 7, "none"), ("p", 8, "soarch")], "page string, want_id int, target string")
    got = {r.want_id: (r.id, r.how) for r in route.resolve(wants, els).collect()}
    assert got == {1: ("1", "resolver"), 2: ("2", "resolver"), 3: (None, None), 4: ("1", "resolver_fuzzy"), 7: (None, None), 8: ("2", "resolver")}


def test_cascade_and_validation(spark):
    rows = [(0, "resolver", "a", "b", 0.9, "c"), (3, "resolver", "a", "b", 0.9, "c"), (3, None, None, "b", 0.5, "c"), (3, None, None, "b", 0.4, "c"), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n int, how string, r string, a string, conf double, p string")
    got = [tuple(x[0]) for x in df.select(route.cascade(*map(F.col, ("n", "how", "r", "a", "conf", "p")))).collect()]
    assert got == [("no_candidates", None, 0.0), ("resolver", "a", 1.0), ("actor", "b", 0.5), ("planner_pick", "c", 0.4), ("planner_none", None, 0.0)]
    nan, inf = math.nan, math.inf
    bad = [("z", 0.6, {"x": 0.6, "y": 0.4}), ("x", 0.6, {"x": 0.6}), ("x", 0.6, {"x": 0.6, "y": 0.2}), ("y", 0.4, {"x": 0.6, "y": 0.4}), ("x", nan, {"x": 0.6, "y": 0.4}), ("x", 0.6, {"x": inf, "y": 0.4}), ("x", 0.6, None), ("x", None, {"x": 0.6, "y": 0.4})]
    df = spark.createDataFrame([("x", 0.6, {"x": 0.6, "y": 0.4}), *bad], "c string, f double, p map<string,double>")
    got = [x[0] for x in df.select(route.valid_choice(F.col("c"), F.col("f"), F.col("p"), F.array(F.lit("x"), F.lit("y")))).collect()]
    assert got == [True] + [False] * len(bad)
    texts = spark.createDataFrame([("ok",), (" None ",), ("",), (None,), ("x" * 2001,), ("true story",)], "t string")
    assert [x[0] for x in texts.select(route.valid_text(F.col("t"))).collect()] == [True, False, False, False, False, True]
    steps = [("CLICK", "Go", "", "press"), ("TYPE_TEXT", "Bern", "", "type it"), ("TYPE_TEXT", "", "False", "x"), ("FLY", "a", "", "x"), ("CLICK", " ", "", "x"), ("SELECT", "", "", "x"), ("GOTO", "u", "", "x"), ("CLICK", "a", "", " " * 3), (None, None, None, None), ("CLICK", "a", None, "w " * 30)]
    df = spark.createDataFrame(steps, "o string, t string, v string, i string")
    got = [x[0] for x in df.select(route.plan_step(F.col("o"), F.col("t"), F.col("v"), F.col("i"), F.lit(False))).collect()]
    assert [g.error for g in got] == [None, None, "literal value", "unknown operation", "no target", "no value", "address not allowed", "no instruction", "unknown operation", None]
    assert (got[1].target, got[1].value) == ("", "Bern") and len(got[9].instruction.split()) == 20
    lines = spark.createDataFrame([("p", i, "x" * n) for i, n in enumerate((50, 30, 40, 5))], "p string, r int, l string")
    assert route.within_chars(lines, "p", "r", "l", 85, 25).count() == 2 and route.within_chars(lines, "p", "r", "l", 10, 25).count() == 1


def test_summaries(spark):
    rng = random.Random(2)
    xs = [("a", rng.randint(0, 30)) for _ in range(101)] + [("b", 4), ("c", None)]
    got = {r.g: r for r in summarize.nearest_rank(spark.createDataFrame(xs, "g string, x int"), "x", [0.9, 0.99], ["g"]).collect()}
    s = sorted(v for g, v in xs if g == "a")
    assert (got["a"].p90, got["a"].p99, got["a"].median, got["a"].n) == (s[int(0.9 * 100)], s[int(0.99 * 100)], statistics.median(s), 101) and got["b"].p90 == 4 and "c" not in got
    p = spark.createDataFrame([(7, 4), (0, 0), (5, 5), (900, 800)], "b long, c long").select(summarize.mcnemar_p(F.col("b"), F.col("c"))).collect()
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
    assert [x[0] for x in p] == [pytest.approx(v, rel=1e-9) for v in (exact(7, 4), 1.0, exact(5, 5), exact(900, 800))]
    conf = spark.createDataFrame([(0.9, True), (0.8, True), (0.8, False), (0.3, True), (0.2, False), (None, True)], "c double, ok boolean")
    assert summarize.threshold(conf, "c", "ok", 0.75).first()[0] == 0.3 and summarize.threshold(conf, "c", "ok", 1.0).first()[0] == 0.9
    assert summarize.threshold(conf.where("c < 0.25"), "c", "ok", 0.5).first()[0] == 1.01 and summarize.threshold(conf.where("false"), "c", "ok", 0.5).first()[0] == 1.01
    dec = "array<struct<route:string,latency_ms:int,actor_ms:int>>"
    runs = spark.createDataFrame(
        [(True, 12.0, [1, 2], [("resolver", 1000, None), ("actor", 1400, 750)], [(2000, None)]), (False, 8.0, [1, 2], [("planner_pick", 1200, 0), None], [(2500, "bad")]), (None, None, None, None, None)],
        f"success boolean, seconds double, steps array<int>, decisions {dec}, planner_calls array<struct<latency_ms:int,error:string>>",
    )
    r = summarize.run_summary(runs).first()
    assert tuple(r) == (1, 3, 1200.0, 750.0, 2250.0, 1, 5.0)
    assert summarize.run_summary(runs.where("false")).first().wall_s_per_action is None


def test_samples(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k").withColumn("g", F.col("k") % 17)
    a = sample.sample_rows(df, "k", 20).collect()
    assert len(a) == 20 and a == sample.sample_rows(df.repartition(5), "k", 20).collect()
    g = sample.sample_groups(df, "g", 3)
    assert g.select("g").distinct().count() == 3 and g.count() == df.join(g.select("g").distinct(), "g").count()
    assert [r.k for r in sample.stride(df, "k", 50).orderBy("k").collect()] == [r.k for r in df.orderBy("k").collect()][::7]
    shards = [sample.shard(df, "k", 4, i).count() for i in range(4)]
    assert shards == [83] * 4
    df2 = spark.createDataFrame([("example.test",), (None,)], "w string")
    assert [r[0] for r in df2.select(sample.held_out(F.col("w"), 1)).collect()] == [True, False]


def test_calibration(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(800):
        z = [rng.gauss(0, 1) for _ in range(4)]
        w = [math.exp(x) for x in z]
        y = rng.choices(range(4), w)[0]
        rows.append(("choice:3-5", [x * 2.5 for x in z], [float(i == y) for i in range(4)]))
    rows += [("choice:2", [0.1, 0.2], [1.0, 0.0])] * 5 + [("choice:2", None, None), ("choice:2", [1.0], [0.5, 0.5])]
    got = {r.b: (r.n, r.temperature) for r in calibrate.fit_temperatures(spark.createDataFrame(rows, "b string, z array<double>, y array<double>"), "b", "z", "y").collect()}
    assert got["choice:3-5"][0] == 800 and got["choice:3-5"][1] == pytest.approx(2.5, rel=0.15) and got["choice:2"] == (5, 1.0)
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 0.0],)], "z array<double>")
    p = [r[0] for r in df.select(calibrate.softmax(F.col("z"))).collect()]
    assert p[0] == pytest.approx([0.0900306, 0.2447285, 0.6652410], abs=1e-6) and p[1] == [1.0, 0.0]
    t = spark.createDataFrame([([2.0, 2.0], 2), ([0.0, 0.0], 2), ([1.0], 2)], "y array<double>, k int").select(calibrate.item_target(F.col("y"), F.col("k"))).collect()
    assert tuple(t[0][0]) == ([0.5, 0.5], 0) and t[1][0] is None and t[2][0] is None
    b = calibrate.batches(spark.createDataFrame([(i, list(range(i + 1))) for i in range(5)], "k int, ids array<int>"), "k", 2, "ids")
    got = {r.k: (r.batch, list(r.ids), list(r["mask"])) for r in b.collect()}
    assert got[0] == (0, [0, 0], [1, 0]) and got[2] == (1, [0, 1, 2, 0], [1, 1, 1, 0]) and got[4][0] == 2


def test_asof(spark):
    rng = random.Random(9)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(0, 500_000, 7)])) for i in range(300)]
    right = [(rng.choice(["a", "a", "c", None]), rng.randrange(0, 500_000, 11), i) for i in range(200)]
    right += [("a", right[0][1], 900), ("a", None, 901)]
    ts = lambda c: F.timestamp_seconds(c).alias(c)
    l = spark.createDataFrame(left, "i int, k string, t long").select("i", "k", ts("t"))
    r = spark.createDataFrame(right, "k string, t long, v int").select("k", ts("t"), "v")
    got = {x.i: x.v for x in asof_join(l, r, "k", "t", ["v"], "v").collect()}
    for i, k, t in left:
        best = max(((rt, v) for rk, rt, v in right if rk == k and rt is not None and t is not None and rt <= t), default=(None, None)) if k else (None, None)
        assert got[i] == best[1], i
