"""Top N items within every group, by lower bounds that every partition applies to itself before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, ties: Sequence[str], version: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best items of every group: ``(group, item, score, rank)``.

    Of several rows with the same (group, item) only the first in the order ``version`` (descending, nulls last)
    counts; of those, rows with a null or NaN score are left out. Order: score descending, then ``ties``
    ascending, nulls last. Groups with fewer items give them all. Null groups and null items are values of
    their own. An empty table gives no rows. ``version`` and ``ties`` must make the order total, else equal rows
    are interchangeable. Extra columns are ignored.

    First the newest row per (group, item): every partition keeps its own newest before rows are hashed by
    (group, item), so neither a large group nor an item sent again and again meets in one task. Items are then
    final and spread evenly. Each partition's N-th best item of a group is a lower bound for the group's N-th
    best: the partition drops what is below its own bound before the second shuffle (a partial WindowGroupLimit in
    the plan), so a group sends at most ``n`` items from each partition, however large it is. There they are
    ranked, by which the largest bound cuts the rest: joining the maximum first would shuffle the same rows by
    the same key. This is the same at every size: no group is looked up, collected or broadcast.
    """
    columns = list(dict.fromkeys([group, item, score, *ties]))
    rows = df.select(*dict.fromkeys([*columns, *version]))
    newest = Window.partitionBy(group, item).orderBy(*[F.col(c).desc_nulls_last() for c in version])
    order = [F.col(score).desc(), *[F.col(c).asc_nulls_last() for c in ties]]
    final = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*columns)
    final = final.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = Window.partitionBy(group).orderBy(*order)
    ranked = final.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.select(*dict.fromkeys([group, item, score]), "rank")
