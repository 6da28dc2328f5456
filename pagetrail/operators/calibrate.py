"""Logits to probabilities, temperature fitting per bucket, padding of batches and training items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SAMPLES, LOW, HIGH = 10, 0.1, 10.0


def log_softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Log-probabilities of an array of logits at a temperature; the largest logit is subtracted first."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda z: (z - top) / t)
    log_sum = F.log(F.aggregate(shifted, F.lit(0.0), lambda a, z: a + F.exp(z)))
    return F.transform(shifted, lambda z: z - log_sum)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    return F.transform(log_softmax(logits, temperature), F.exp)


def option_bucket(qtype: Column, options: Column) -> Column:
    """``qtype:2``, ``3-5``, ``6-10`` or ``11+`` by the number of options."""
    size = F.when(options <= 2, "2").when(options <= 5, "3-5").when(options <= 10, "6-10").otherwise("11+")
    return F.concat(qtype, F.lit(":"), size)


def grid(low: float, high: float, n: int) -> list[float]:
    """n temperatures at equal ratios."""
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def fit_temperatures(df: DataFrame, bucket: str, logits: str, target: str, rounds: int = 3, points: int = 25) -> DataFrame:
    """(bucket, n, temperature): the temperature between 0.1 and 10 with the least mean cross entropy.

    The loss is convex in 1/T, so a grid that is narrowed around its best point ``rounds`` times finds it. One
    pass per round computes the losses of all grid points of all buckets as aggregates with map-side
    combining; no bucket is gathered. Buckets of fewer than 10 rows get 1.0. Rows with null or empty logits,
    or targets of another length, are left out.
    """
    rows = df.where((F.size(logits) > 0) & (F.size(logits) == F.size(target))).select(bucket, F.col(logits).alias("z"), F.col(target).alias("y"))
    ranges: dict = {}
    best: dict = {}
    for _ in range(rounds):
        at = None
        if ranges:
            spans = df.sparkSession.createDataFrame([(b, lo, hi) for b, (lo, hi) in ranges.items()], f"{bucket} string, lo double, hi double")
            at = rows.join(F.broadcast(spans), bucket)
        else:
            at = rows.withColumn("lo", F.lit(LOW)).withColumn("hi", F.lit(HIGH))
        temps = [F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.lit(i / (points - 1))) for i in range(points)]
        loss = [-F.aggregate(F.zip_with(log_softmax(F.col("z"), t), "y", lambda lp, y: lp * y), F.lit(0.0), lambda a, x: a + x) for t in temps]
        got = at.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("from_t"), F.max("hi").alias("to_t"), *[F.avg(c).alias(f"l{i}") for i, c in enumerate(loss)]).limit(10_001).collect()
        if len(got) > 10_000:
            raise ValueError("more than 10,000 buckets")
        for r in got:
            ts = grid(r["from_t"], r["to_t"], points)
            i = min(range(points), key=lambda j, r=r: r[f"l{j}"])
            best[r[bucket]] = (r["n"], ts[i])
            ranges[r[bucket]] = (ts[max(0, i - 1)], ts[min(points - 1, i + 1)])
    out = [(b, n, t if n >= LEAST_SAMPLES else 1.0) for b, (n, t) in best.items()]
    return df.sparkSession.createDataFrame(out, f"{bucket} string, n long, temperature double")


def padded(array: Column, length: Column, fill: Column) -> Column:
    """An array filled up to ``length``; longer ones stay as they are."""
    return F.concat(array, F.array_repeat(fill, F.greatest(length - F.size(array), F.lit(0)).cast("int")))


def batches(items: DataFrame, order: str, size: int, ids: str, pad: int = 0) -> DataFrame:
    """Items in batches of ``size`` by ``order``, padded to their batch's longest: adds batch, ids and mask."""
    from pagetrail.operators.sample import _placed

    placed = _placed(items, order).withColumn("batch", F.floor(F.col("_place") / size).cast("long")).drop("_place")
    longest = placed.groupBy("batch").agg(F.max(F.size(ids)).alias("_len"))
    rows = placed.join(longest, "batch")
    mask = padded(F.transform(ids, lambda x: F.lit(1)), F.col("_len"), F.lit(0))
    return rows.withColumn("mask", mask).withColumn(ids, padded(F.col(ids), F.col("_len"), F.lit(pad))).drop("_len")


def item_target(target: Column, options: Column) -> Column:
    """struct(target, label): a distribution scaled to sum 1 and its first largest place; null if it has no mass or another length."""
    total = F.aggregate(target, F.lit(0.0), lambda a, x: a + x)
    ok = (F.size(target) == options) & (total > 0)
    scaled = F.transform(target, lambda x: x / total)
    return F.when(ok, F.struct(scaled.alias("target"), (F.array_position(scaled, F.array_max(scaled)) - 1).cast("int").alias("label")))
