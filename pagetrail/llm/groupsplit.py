"""Train, validation and test splits that keep connected records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.functions.text import entity_key  # noqa: F401  (callers name it here)
from pagetrail.keys import skew_join
from pagetrail.session import cut


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components ``(node, root)`` of undirected ``edges(u long, v long)``; root is the smallest node.

    Alternating large-star and small-star: every round points nodes at the smallest neighbour they know, until
    nothing changes. Only minima per node are aggregated (with map-side combining) and joined back, so no
    neighbourhood is ever collected. Self-loops, repeated edges and an empty table are allowed; nodes that
    occur only in self-loops are their own root. Each round is checkpointed, so it survives lost executors.
    Raises if ``max_rounds`` don't suffice (rounds grow with the logarithm of the number of nodes).
    """
    edges = cut(edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    pairs = edges.where("u > v")
    seen = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # used for the minima, the search for hot keys and both branches of the join, so it is made once
        large = cut(skew_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, low, "u")
        pairs = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            roots = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        seen = now
    raise RuntimeError("components didn't settle")


def connected_records(df: DataFrame, record: str, names: list[Column]) -> DataFrame:
    """``(record, first)`` for every row: the smallest record id of the rows it hangs together with.

    Two rows belong together if an entity named by one (any of ``names``, null names nothing) is named by the
    other, and that carries over. ``record`` must be a unique long. Every entity is represented by the smallest
    record that names it, so the graph is over longs and has an edge only where a row names several entities.
    Rows that name nothing stand alone; an empty table gives no rows.
    """
    named = df.select(F.col(record).alias("record"), F.array_distinct(F.array_compact(F.array(*names))).alias("es"))
    links = named.select("record", F.explode("es").alias("e"))
    entities = cut(links.groupBy("e").agg(F.min("record").alias("rep")))
    several = named.where(F.size("es") > 1).select(F.explode(F.sequence(F.lit(1), F.size("es") - 1)).alias("i"), "es")
    bridges = several.select(F.element_at("es", F.col("i")).alias("a"), F.element_at("es", F.col("i") + 1).alias("b")).distinct()
    half = skew_join(bridges.withColumnRenamed("a", "e"), entities, "e").select(F.col("b").alias("e"), F.col("rep").alias("u"))
    edges = skew_join(half, entities.withColumnRenamed("rep", "v"), "e").select("u", "v")
    roots = components(edges)
    of_entity = entities.join(roots, entities["rep"] == roots["node"], "left").select("e", F.coalesce("root", "rep").alias("root"))
    member = skew_join(named.select("record", F.try_element_at("es", F.lit(1)).alias("e")), of_entity, "e", "left")
    member = member.select("record", F.coalesce("root", "record").alias("root"))
    first = member.groupBy("root").agg(F.min("record").alias("first"))
    return skew_join(member, first, "root").select("record", "first")


def assign_splits(members: DataFrame, group: str, shares: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``split``: the hash of ``group`` falls into one of the ranges that the ``(split_name, share)`` rows cut.

    Shares are scaled to sum to 1 and taken in the order of split_name; null, negative and zero shares get
    nothing. ``shares`` is a hand-made table of at most 100 rows (checked). The hash has 2^53 steps.
    """
    rows = shares.where("share > 0").orderBy("split_name").limit(101).collect()
    if not rows or len(rows) > 100:
        raise ValueError("between 1 and 100 splits with a positive share are needed")
    total = sum(r["share"] for r in rows)
    u = F.shiftrightunsigned(F.xxhash64(F.col(group), F.lit(seed)), 11) / F.lit(float(1 << 53))
    split = F.lit(rows[-1]["split_name"])
    for i in reversed(range(len(rows) - 1)):
        upto = sum(r["share"] for r in rows[: i + 1]) / total
        split = F.when(u < upto, F.lit(rows[i]["split_name"])).otherwise(split)
    return members.withColumn("split", split)
