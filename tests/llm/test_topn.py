import math
import random

import pytest
from pagetrail.llm.topn import top_n_per_group

SCHEMA = "pool string, id string, score double, o int, at int, row int, rank int, _n string, _salt string"


def brute(rows, n):
    last = {}
    for r in rows:
        k = (r[0], r[1])
        if k not in last or ((-1 if r[4] is None else r[4]), r[5]) > ((-1 if last[k][4] is None else last[k][4]), last[k][5]):
            last[k] = r
    out = {}
    for r in last.values():
        if r[2] is not None and not math.isnan(r[2]):
            out.setdefault(r[0], []).append(r)
    key = lambda r: (-r[2], r[3] is None, r[3] or 0, r[1] is None, (r[1] or "").encode())
    return {(p, r[1], i + 1) for p, rs in out.items() for i, r in enumerate(sorted(rs, key=key)[:n])}


def run(spark, rows, n=5, parts=6):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = top_n_per_group(df, "pool", "id", "score", ["o", "id"], ["at", "row"], n)
    out = [(r.pool, r.id, r["rank"]) for r in got.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_random_with_ties_nulls_and_hot_groups(spark, parts):
    rng = random.Random(parts)
    pools = ["hot"] * 6 + ["a", "b", None, None, "Ä"]
    rows = []
    for i in range(1500):
        score = rng.choice([None, math.nan, math.inf, -math.inf, *[x / 4 for x in range(12)]])
        rows.append((rng.choice(pools), rng.choice([None, *(f"i{k}" for k in range(90)), "É", "z" * 5000]), score, rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2, 3]), i, 9, "x", "y"))
    rows += [(r[0], r[1], r[2], r[3], r[4], r[5] + 5000, 9, "x", "y") for r in rows[:100]]
    assert run(spark, rows, parts=parts) == brute(rows, 5)


def test_every_partition_cuts_by_its_own_bound_before_each_shuffle(spark):
    df = spark.createDataFrame([("p", str(i), float(i), i, 1, i, 0, "", "") for i in range(50)], SCHEMA)
    plan = top_n_per_group(df, "pool", "id", "score", ["o", "id"], ["at", "row"], 5)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Partial") == 2 and "BroadcastExchange" not in plan


def test_small_groups_and_empty(spark):
    rows = [("p", "a", 1.0, None, 1, 1, 0, "", ""), ("p", "b", None, 1, 1, 2, 0, "", "")]
    assert run(spark, rows) == {("p", "a", 1)}
    assert run(spark, []) == set()
    # the latest row counts even if its score doesn't
    assert run(spark, [("p", "a", 5.0, 1, 1, 1, 0, "", ""), ("p", "a", math.nan, 1, 2, 2, 0, "", "")]) == set()
