import random

from pyspark.sql import functions as F

from pagetrail.keys import distributed_rank, hot_keys, running_sums, skew_join


def test_skew_join_equals_join(spark):
    big = spark.createDataFrame([("h", i) for i in range(900)] + [(f"k{i % 50}", i) for i in range(300)] + [(None, 5)], "k string, v int")
    small = spark.createDataFrame([("h", 1), *((f"k{i}", i) for i in range(40))], "k string, w int")
    assert [tuple(r) for r in hot_keys(big, "k", 100).collect()] == [("h", 900)]
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew_join(big, small, "k", how, 100).collect()), key=str)
        assert got == sorted(map(tuple, big.join(small, "k", how).collect()), key=str)


def test_distributed_rank_is_a_permutation(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 5))
    rows = distributed_rank(df, ["g"], F.col("id"), 7).collect()
    by = {}
    for r in rows:
        by.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def test_running_sums(spark):
    rng = random.Random(1)
    values = sorted({round(rng.random() * 50, 2) for _ in range(200)})
    df = spark.createDataFrame([("a", v, 2) for v in values] + [("b", 1.0, 3)], "g string, v double, n int")
    for down in (False, True):
        got = {(r.g, r.v): r.n_upto for r in running_sums(df, ["g"], "v", ["n"], descending=down, buckets=13).collect()}
        order = values[::-1] if down else values
        assert got == {("a", v): 2 * (i + 1) for i, v in enumerate(order)} | {("b", 1.0): 3}
    assert running_sums(df.where("false"), [], "v", ["n"]).count() == 0
