from pyspark.sql import functions as F

from pagetrail.operators import request as Q

STEPS = "steps array<struct<action: string, text: string>>, upto int"


def test_recent_fields(spark):
    rows = [([(str(i), None if i % 2 else "t") for i in range(9)], 8), ([None, ("a", "b"), None], 3), ([], 4), (None, 1), ([("a", None)], 0), ([("a", None)], None)]
    got = [r[0] for r in spark.createDataFrame(rows, STEPS).select(Q.recent_fields(F.col("steps"), F.col("upto"))).collect()]
    assert got == [["2=t", "3=", "4=t", "5=", "6=t", "7="], ["a=b"], [], None, [], []]


def test_segments(spark):
    rows = [("A → B → C",), ("plain",), ("",), (None,), (" → x",), ("y" * 50_000,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "label string").select(Q.first_segment(F.col("label")), Q.after_arrow(F.col("label"))).collect()]
    assert got == [("A", "B → C"), ("plain", "plain"), ("", ""), (None, None), ("", "x"), ("y" * 50_000, "y" * 50_000)]


def test_sole_trust(spark):
    rows = [("p", "a", "CLICK"), ("p", "a", "CLICK"), ("p", "b", "SELECT"), ("q", "a", "CLICK"), ("q", "b", "CLICK"), (None, "z", "SELECT"), ("r", None, "CLICK")]
    df = spark.createDataFrame(rows, "pool string, id string, op string").withColumn("trust", F.lit("clash"))
    assert {tuple(r) for r in Q.sole_trust(df, "pool", "id", "op").collect()} == {("p", "CLICK", "a", 0.0), ("p", "SELECT", "b", 1.0), (None, "SELECT", "z", 1.0)}
    assert Q.sole_trust(df.limit(0), "pool", "id", "op").count() == 0


def test_picks_and_order(spark):
    rows = [("a", ["a", "b"]), ("c", ["a"]), (None, ["a"]), ("a", None), ("a", [])]
    assert [r[0] for r in spark.createDataFrame(rows, "c string, o array<string>").select(Q.valid_pick(F.col("c"), F.col("o"))).collect()] == ["a", None, None, None, None]
    answers = [([("x", 0.2), None, ("y", None), ("z", 0.9), ("w", 0.2)],), (None,), ([],)]
    df = spark.createDataFrame(answers, "a array<struct<choice: string, confidence: double>>").select(Q.by_confidence(F.col("a")).alias("a"))
    assert [None if r.a is None else [x.choice for x in r.a] for r in df.collect()] == [["z", "x", "w", "y"], None, []]


def test_notes(spark):
    rows = [("r", 0, "u", "CLICK", "A", True), ("r", 1, "u", "CLICK", "B", True), ("r", 2, "u", "CLICK", "A", True), ("r", 3, "u", "CLICK", "C", False), ("r", 4, "v", "CLICK", "C", False)]
    tried = spark.createDataFrame(rows, "run_id string, step int, url string, operation string, display string, failed boolean")
    assert [tuple(r) for r in Q.notes(tried).collect()] == [("r", "u", ["CLICK A", "CLICK B"])]
