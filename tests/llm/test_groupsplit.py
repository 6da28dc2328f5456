import random
from collections import Counter

from pyspark.sql import functions as F

from pagetrail.llm import groupsplit as G


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(5, 5), (500, 500), (7, 8), (8, 7)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(200)]  # a long path and a star
    nodes = {x for p in pairs for x in p}
    got = {r.node: r.root for r in G.components(spark.createDataFrame([*pairs, (None, 3)], "u long, v long")).collect()}
    assert got == union_find(pairs, nodes)
    assert G.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_connected_records(spark):
    rng = random.Random(2)
    names = [None, *(f"e{i}" for i in range(60))]
    rows = [(i, rng.choice(names), rng.choice([None] * 4 + names)) for i in range(300)] + [(300 + i, "e1", None) for i in range(200)] + [(600, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string").withColumn("record", F.lit("clash")).withColumn("e", F.lit(1))
    got = {r.record: r.first for r in G.connected_records(df, "id", [F.col("a"), F.col("b")]).collect()}
    pairs = []
    seen = {}
    for i, a, b in rows:
        for e in (a, b):
            if e is not None:
                pairs.append((i, seen.setdefault(e, i)))
    assert got == union_find(pairs, [r[0] for r in rows])
    assert G.connected_records(df.where("false"), "id", [F.col("a")]).count() == 0


def test_spellings(spark):
    d = "0781aab1871ac9f18586b615f59984fa"
    h = f"{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:]}"
    forms = [d, h, h.upper(), f"{{{h}}}", f" {h} ", f"task_{h}", f"m2w/{h}", f"{h}.json", h.replace("-", "_"), f"urn:uuid:{h}", "Other ", "", "  ", None, d + "a"]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "x string").select(G.entity_key(F.col("x"))).collect()]
    assert got == [d] * 10 + ["other", None, None, None, d + "a"]


def test_splits_keep_groups_and_shares(spark):
    shares = spark.createDataFrame([("train", 8.0), ("test", 1.0), ("validation", 1.0), ("none", 0.0), ("bad", None)], "split_name string, share double")
    rows = spark.range(20_000).withColumn("first", F.floor(F.col("id") / 2))
    got = G.assign_splits(rows, "first", shares)
    assert got.groupBy("first").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    n = Counter(r.split for r in got.collect())
    assert set(n) == {"train", "test", "validation"} and abs(n["train"] / 20_000 - 0.8) < 0.01 and abs(n["test"] / 20_000 - 0.1) < 0.01
