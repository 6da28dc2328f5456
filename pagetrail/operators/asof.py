"""As-of join: for every row the latest row of another table at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str], tie: str, bucket: Column | None = None) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` with the same key and a time at or before its own.

    Of right rows at the same time the one with the largest ``tie`` counts. No match gives nulls; null keys and
    times match nothing. Both sides are put in one order and the last right row is carried on. ``bucket`` (by
    default the day) cuts a key's history into pieces that are ordered separately; the last right row of each
    piece is carried into the later ones, so a key with most of the rows isn't sorted in one task.
    """
    spare = [c for c in left.columns if c not in (key, time)]
    cut = bucket if bucket is not None else F.date_trunc("day", F.col(time))
    mine = F.struct(*[F.col(c) for c in spare]).alias("_l")
    theirs = F.struct(*[F.col(c) for c in values]).alias("_r")
    a = left.select(key, time, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), mine)
    b = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), theirs)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_b", cut)
    within = Window.partitionBy(key, "_b").orderBy(time, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_seen", F.last("_r", ignorenulls=True).over(within)).where("_side = 1")
    lasts = b.withColumn("_b", cut).groupBy(key, "_b").agg(F.max_by("_r", F.struct(time, "_tie")).alias("_last"))
    pieces = both.select(key, "_b").distinct().join(lasts, [key, "_b"], "left")
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    out = here.join(carried, (here[key] == carried["_k"]) & (here["_b"] == carried["_kb"]), "left")
    found = F.when(F.col(key).isNotNull() & F.col(time).isNotNull(), F.coalesce("_seen", "_carry"))
    return out.withColumn("_found", found).select(key, time, *[F.col(f"_l.{c}").alias(c) for c in spare], *[F.col(f"_found.{c}").alias(c) for c in values])
