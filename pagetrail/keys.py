"""Building blocks against skewed keys: hot-key detection, skew joins, distributed ranks and prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most this many keys can be hot: a hot key holds more than 1/MAX_HOT of all rows.
MAX_HOT = 1000


def hot_limit(total: int, least_rows: int) -> int:
    """Rows above which a key is hot. By arithmetic fewer than MAX_HOT keys can exceed total/MAX_HOT rows."""
    return max(least_rows, total // MAX_HOT)


def hot_keys(df: DataFrame, key: str, least_rows: int = 20_000, nulls: bool = False) -> DataFrame:
    """``(key, n)`` for keys with more rows than ``hot_limit``; never more than MAX_HOT rows. Null is a key only with ``nulls``.

    One count per key with map-side combining; only the hot ones reach the driver.
    """
    counts = (df if nulls else df.where(F.col(key).isNotNull())).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_rows)
    found = counts.orderBy(F.desc("n"), key).limit(MAX_HOT).collect()
    if found:
        limit = hot_limit(df.count(), least_rows)
        found = [r for r in found if r["n"] > limit]
    return df.sparkSession.createDataFrame([tuple(r) for r in found], counts.schema)


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", least_rows: int = 100_000) -> DataFrame:
    """Equi-join of ``big`` with ``small`` (one row per key), safe when one key holds a large share of ``big``.

    Hot keys (fewer than MAX_HOT, see ``hot_keys``) are joined by broadcasting their rows of ``small``; all
    other keys by an ordinary shuffle join. ``how`` is ``inner`` or ``left``. The columns of ``small`` other
    than ``key`` must not occur in ``big``. Null keys match nothing. ``big`` is counted
    per key first: hand in what is cheap to read twice.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    hot = hot_keys(big, key, least_rows).select(key)
    hot_values = [r[0] for r in hot.collect()]
    if not hot_values:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot_values), F.lit(False))
    few = F.broadcast(small.where(is_hot))
    return big.where(~is_hot).join(small.where(~is_hot), key, how).unionByName(big.where(is_hot).join(few, key, how))


def bounded_broadcast_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", max_rows: int = 50_000) -> DataFrame:
    """Join with a side that is expected to be small: it is broadcast only if a count proves at most ``max_rows`` rows.

    Beyond that, an ordinary join lets AQE split skewed partitions.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, list(keys), how)


def distributed_rank(df: DataFrame, group: Sequence[str], key: Column, buckets: int, name: str = "rank") -> DataFrame:
    """A unique 1-based rank of every row within its group, without sorting a whole group in one task.

    Rows are hashed into ``buckets`` by ``key``; the rank is the rank within the bucket plus the rows of lower
    buckets. The order is that of (bucket, key), fixed for fixed keys but otherwise arbitrary.
    """
    cols = df.columns
    b = df.withColumn("_k", key).withColumn("_b", F.pmod(F.xxhash64("_k"), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(*group, "_b").orderBy("_k")
    ranked = b.withColumn("_r", F.row_number().over(within))
    return ranked.join(offsets, [*group, "_b"]).select(*cols, (F.col("_r") + F.col("_o")).alias(name))


def running_sums(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], descending: bool = False, buckets: int = 1024) -> DataFrame:
    """Adds ``<c>_upto`` for every c of ``sums``: its sum over rows of the group up to this row's ``value``, ties included once.

    ``df`` has one row per (group, value); values are numbers without null and NaN. The range of a group's
    values is cut into ``buckets``; sums run within a bucket, and the totals of earlier buckets are added, so
    no group is ordered in one task.
    """
    sign = -1 if descending else 1
    o = df.withColumn("_v", F.col(value).cast("double") * sign)
    if by:
        o = o.join(o.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), list(by))
    else:
        span = o.agg(F.min("_v"), F.max("_v")).first()
        o = o.withColumn("_lo", F.lit(span[0] or 0.0)).withColumn("_hi", F.lit(span[1] or 0.0))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    o = o.withColumn("_b", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int"))
    totals = o.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    within = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    o = o.select("*", *[F.sum(c).over(within).alias(f"_w{i}") for i, c in enumerate(sums)]).join(starts, [*by, "_b"])
    return o.select(*df.columns, *[(F.col(f"_w{i}") + F.col(f"_s{i}")).alias(f"{c}_upto") for i, c in enumerate(sums)])
