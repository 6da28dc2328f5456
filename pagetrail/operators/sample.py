"""Splits and samples that a rerun repeats: by hash, never by row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions.text import md5_mod


def held_out(website: Column, mod: int = 20) -> Column:
    """Whether a website belongs to the held-out split; with mod 0 none does. A null website doesn't."""
    return F.lit(False) if mod == 0 else F.coalesce(md5_mod(website, mod) == 0, F.lit(False))


def hash_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (all if there are fewer, or if n is 0) in hash order of ``key``; a bounded sort, no full one."""
    return df if n <= 0 else df.orderBy(hash_key(F.col(key), seed), key).limit(n)


def sample_groups(df: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of n groups in hash order; no group is split. A null group isn't sampled."""
    if n <= 0:
        return df
    chosen = df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(hash_key(F.col(group), seed), group).limit(n)
    return df.join(F.broadcast(chosen) if n <= 100_000 else chosen, group, "left_semi")


def stride(df: DataFrame, order: str, most: int) -> DataFrame:
    """Every k-th row in order, with the smallest k that leaves at most ``most``.

    Places come from ranks within ranges of ``order`` plus the sizes of earlier ranges, so nothing is sorted as
    a whole in one task; ``order`` must be unique and numeric.
    """
    n = df.count()
    step = max(1, -(-n // most))
    return _placed(df, order).where(F.col("_place") % step == 0).drop("_place")


def shard(df: DataFrame, order: str, world: int, rank: int) -> DataFrame:
    """Shard ``rank`` of ``world`` equal ones, dealt in order; the rows left over at the end are in none."""
    n = df.count() // world * world
    return _placed(df, order).where((F.col("_place") < n) & (F.col("_place") % world == rank)).drop("_place")


def _placed(df: DataFrame, order: str) -> DataFrame:
    span = df.agg(F.min(order).cast("double").alias("lo"), F.max(order).cast("double").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    buckets = min(10_000, 16 + span["n"] // 100_000)
    lo, width = span["lo"] or 0.0, ((span["hi"] or 0.0) - (span["lo"] or 0.0)) + 1.0
    b = df.withColumn("_b", F.floor((F.col(order).cast("double") - lo) / width * buckets).cast("int"))
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return b.withColumn("_r", within).join(F.broadcast(offsets), "_b").withColumn("_place", F.col("_r") + F.col("_o") - 1).drop("_b", "_r", "_o")
