import random
import re

import pytest
from pyspark.sql import functions as F

from pagetrail.llm import mixing, packing, tokens


def test_token_count(spark):
    texts = ["Größe_1 + x²!!", "", None, " \t\xa0　", "don't", "日本 語", "a-b", "€5,00", "x" * 50_000, "�� ok"]
    py = lambda t: len(re.findall(r"\w+|[^\w\s]+", t or ""))
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.token_count(F.col("t"))).collect()]
    assert got == [py(t) for t in texts]


def pack(spark, sizes, capacity, **more):
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], "doc long, n long, container string")
    return packing.pack(df, "doc", F.col("n"), capacity, **more).collect()


@pytest.mark.parametrize("capacity,bucket", [(512, 100_000), (16, 10)])
def test_pack_is_exact_and_tight(spark, capacity, bucket):
    rng = random.Random(capacity)
    sizes = [rng.choice([0, None, -3, rng.randint(1, capacity), rng.randint(1, capacity // 4), rng.randint(1, 3 * capacity), capacity]) for _ in range(2000)] + [5] * 800
    rows = pack(spark, sizes, capacity, rows_per_bucket=bucket)
    load, parts, slots = {}, {}, set()
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r["size"]
        parts.setdefault(r.doc, []).append((r.part, r.start, r["size"], r.parts))
        assert (r.container, r.slot) not in slots
        slots.add((r.container, r.slot))
    assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
    for i, s in enumerate(sizes):
        if not s or s < 0:
            assert i not in parts
            continue
        ps = sorted(parts[i])
        assert sum(p[2] for p in ps) == s and len(ps) == -(-s // capacity) == ps[0][3]
        assert all(p[1] == k * capacity for k, p in enumerate(ps)) and (s > capacity or len(ps) == 1)
    least = -(-sum(s for s in sizes if s and s > 0) // capacity)
    assert len(load) <= least * 1.02 + 1
    groups = {}
    for r in rows:
        groups.setdefault(r.step_group, {})[r.container] = load[r.container]
    means = [sum(g.values()) / len(g) for g in groups.values()]
    assert max(means) - min(means) < 0.1 * capacity


def test_pack_small_cases(spark):
    assert pack(spark, [], 8) == [] and pack(spark, [None, 0], 8) == []
    assert len({r.container for r in pack(spark, [5, 3, 4, 4], 8)}) == 2
    assert packing.plan_containers({8: 2, 3: 1, 5: 1}, 8) == [(2, [8]), (1, [5, 3])]
    with pytest.raises(ValueError):
        packing.plan_containers({9: 1}, 8)
    one = packing.fill_report(packing.pack(spark.createDataFrame([], "doc long, n long"), "doc", F.col("n"), 8), 8).first()
    assert one.containers == 0 and one.unused_share is None


def mixture(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc long, source string, size int, weight double").withColumn("repeats", F.lit("clash"))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, "doc", "source", "size", "weight", buckets=8)
    return m.collect(), {r.source: r for r in mixing.shares_reached(m, d, t, "source", "size").collect()}


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["Big", " big ", "BIG", "small", "tiny", None, "other"]), rng.choice([None, 0, *range(1, 30)]), rng.choice([None, 0.1, 0.5, 1.0])) for i in range(3000)]
    targets = [("big", 0.3, 2), ("small", 0.3, 1), ("tiny", 0.38, 9), ("gone", 0.02, 5)]
    rows, reached = mixture(spark, docs, targets)
    key = lambda s: (s or "").strip().lower()
    have = {s: sum(d[2] or 0 for d in docs if key(d[1]) == s) for s in ("big", "small", "tiny")}
    total = sum(have.values())
    used = {}
    for r in rows:
        assert 0 < r.repeats <= dict((t[0], t[2]) for t in targets)[r.source]
        used.setdefault(r.source, {})[r.doc] = r.repeats
    for name, share, most in targets[:3]:
        budget = min(share * total, most * have[name])
        size = {d[0]: d[2] for d in docs}
        got = sum(size[i] * n for i, n in used[name].items())
        assert budget - 30 <= got <= budget and reached[name].used == got
        full = min(int(budget // have[name]), most)
        assert set(used[name].values()) <= {full, full + 1}  # complete passes come before the selection
        assert reached[name].short == (share * total > most * have[name])
    assert reached["gone"].short and reached["gone"].used == 0 and sum(r.share for r in reached.values()) == pytest.approx(1)


def test_mix_prefers_weight(spark):
    docs = [(i, "a", 10, 1.0 if i % 2 else 0.1) for i in range(2000)] + [(5000, "b", 20_000, 1.0)]
    rows, _ = mixture(spark, docs, [("a", 0.2, 1), ("b", 0.8, 1)])
    chosen = [r.doc % 2 for r in rows if r.source == "a"]
    assert 750 < len(chosen) <= 801 and sum(chosen) / len(chosen) > 0.8


def test_mix_empty(spark):
    rows, reached = mixture(spark, [], [("a", 1.0, 2)])
    assert rows == [] and reached["a"].share is None and not reached["a"].short


def test_tiers_change_the_plan():
    sizes = {200: 4, 56: 4, 112: 2}
    one, many = packing.plan_hierarchy(sizes, 512, [512]), packing.plan_hierarchy(sizes, 512)
    assert [w for _, ws in one for w in ws] != [w for _, ws in many for w in ws]
    assert {c for _, ws in many for c, _ in ws} == {256, 128} and {c for _, ws in one for c, _ in ws} == {512}
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([8, 64, 512])
        histogram = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        seen = {}
        for times, windows in packing.plan_hierarchy(histogram, capacity):
            assert times > 0 and sum(sum(w) for _, w in windows) <= capacity
            for context, window in windows:
                assert sum(window) <= context
                for s in window:
                    seen[s] = seen.get(s, 0) + times
        assert seen == histogram


def test_windows_keep_to_their_context(spark):
    rng = random.Random(5)
    windows = {}
    for r in pack(spark, [rng.randint(1, 600) for _ in range(800)], 512):
        windows.setdefault((r.container, r.window, r.context), []).append(r["size"])
    assert all(sum(w) <= context for (_, _, context), w in windows.items()) and len({c for _, _, c in windows}) > 1


def test_mix_buckets_are_even_at_low_weight(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc"), F.lit("a").alias("source"), F.lit(1).alias("size"), F.when(F.col("id") % 4 == 0, 1.0).otherwise(0.1).alias("weight"))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.mix(docs, targets, "doc", "source", "size", "weight", buckets=50)
    assert plan.count() == 20_000
    keyed = mixing.keyed_documents(docs, mixing.budgets(docs, targets, "source", "size").select("source", "_k", "full", "rest", "max_repeats"), "doc", "source", "size", "weight", 0, 50)
    counts = [r["count"] for r in keyed.groupBy("_b").count().collect()]
    assert len(counts) == 50 and max(counts) < 3 * 20_000 / 50


def test_mix_compensates_short_sources(spark):
    docs = spark.createDataFrame([(i, "a" if i < 20 else "b", 10, 1.0) for i in range(1000)], "doc long, source string, size int, weight double")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets, "doc", "source", "size", "weight", compensate=True)
    used = {r.source: r.used for r in mixing.shares_reached(mixed, docs, targets, "source", "size").collect()}
    assert used == {"a": 400, "b": 9600}
