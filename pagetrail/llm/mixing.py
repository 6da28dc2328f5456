"""Mixing sources to target shares of all tokens with capped repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space around a source name.
AROUND = r"(?U)^\s+|\s+$"


def source_key(source: Column) -> Column:
    """A source name without regard to case and to white space around it; null stays null."""
    return F.lower(F.regexp_replace(source, AROUND, ""))


def budgets(docs: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """Per target source: its tokens, the total T over all target sources, the wanted and the reachable budget.

    ``docs`` has ``source`` and ``size``; ``targets`` has source, target_share and max_repeats. Sources without
    documents have 0 tokens. A null share counts as 0, null repeats as 0. ``full`` whole passes come before the
    ``rest`` that is selected; ``short`` tells that the share can't be reached at size T.
    """
    have = docs.groupBy(source_key(F.col(source)).alias("_k")).agg(F.sum(size).cast("long").alias("tokens"))
    wanted = targets.select(
        "source", source_key(F.col("source")).alias("_k"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).cast("long").alias("max_repeats"),
    )
    each = wanted.join(have, "_k", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    total = each.withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    budget = F.col("target_share") * F.col("_all")
    most = F.col("max_repeats") * F.col("tokens")
    out = total.select("*", budget.alias("budget"), (budget > most).alias("short"), F.least(budget, most.cast("double")).alias("usable"))
    full = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("usable") / F.col("tokens")), F.col("max_repeats"))).otherwise(F.lit(0)).cast("long")
    return out.withColumn("full", full).withColumn("rest", F.col("usable") - F.col("full") * F.col("tokens"))


def quality_weight(text: Column) -> Column:
    """A document's weight between 0.1 and 1: the share of letters among its visible characters, squared."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    visible = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    share = F.coalesce(F.try_divide(letters, visible), F.lit(0.0))
    return F.greatest(F.lit(0.1), share * share)


#: Weights are told apart in steps of 1/WEIGHT_STEPS to cut a source's keys into buckets of even size.
WEIGHT_STEPS = 32


def _compensated(plan: DataFrame) -> DataFrame:
    """``plan`` with the tokens that short sources lack given to the others by their target shares, up to their caps.

    The plan has one row per target source, a hand-made table: at most 10,000 rows, which is checked.
    """
    rows = plan.select("_k", "target_share", "tokens", "max_repeats", "usable", "_all").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target sources")
    usable = {r["_k"]: r["usable"] for r in rows}
    room = {r["_k"]: r["max_repeats"] * r["tokens"] - r["usable"] for r in rows}
    share = {r["_k"]: max(r["target_share"], 0.0) for r in rows}
    size = rows[0]["_all"] if rows else 0
    for _ in rows:  # each pass fills what is missing or brings a source to its cap
        missing = min(1.0, sum(share.values())) * size - sum(usable.values())
        takers = [k for k in usable if room[k] > 1e-9 and share[k] > 0]
        if missing <= 1e-9 * max(size, 1) or not takers:
            break
        weight = sum(share[k] for k in takers)
        for k in takers:
            more = min(room[k], missing * share[k] / weight)
            usable[k] += more
            room[k] -= more
    levels = plan.sparkSession.createDataFrame([(k, float(v)) for k, v in usable.items() if k is not None], "_k string, _usable double")
    full = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("usable") / F.col("tokens")), F.col("max_repeats"))).otherwise(F.lit(0)).cast("long")
    out = plan.drop("full", "rest").join(F.broadcast(levels), "_k", "left").withColumn("usable", F.coalesce("_usable", "usable")).drop("_usable")
    return out.withColumn("full", full).withColumn("rest", F.col("usable") - F.col("full") * F.col("tokens"))


def keyed_documents(docs: DataFrame, plan: DataFrame, doc: str, source: str, size: str, weight: str, seed: int, buckets: int) -> DataFrame:
    """Documents of the plan's sources with their exponential key ``_e`` and its bucket ``_b``."""
    sized = docs.where(F.col(size) > 0).select(F.col(doc), F.col(size), F.coalesce(F.col(weight), F.lit(0.1)).alias("_w"), source_key(F.col(source)).alias("_k"))
    steps = sized.groupBy("_k", (F.round(F.col("_w") * WEIGHT_STEPS) / WEIGHT_STEPS).alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    steps = steps.groupBy("_k").agg(F.collect_list(F.struct("_step", "_n")).alias("_steps"), F.sum("_n").alias("_rows"))
    plan = plan.join(steps, "_k", "left")
    small = F.broadcast(plan) if plan.limit(10_001).count() <= 10_000 else plan
    u = (F.shiftrightunsigned(F.xxhash64(F.col(doc), F.lit(seed)), 11) + F.lit(1)) / F.lit(float((1 << 53) + 1))
    keyed = sized.join(small, "_k").withColumn("_e", -F.log(u) / F.col("_w"))
    below = F.aggregate("_steps", F.lit(0.0), lambda a, s: a + (F.lit(1.0) - F.exp(-F.col("_e") * F.greatest(s["_step"], F.lit(0.5 / WEIGHT_STEPS)))) * s["_n"])
    return keyed.withColumn("_b", F.least(F.lit(buckets - 1), F.floor(below / F.col("_rows") * buckets)).cast("int")).drop("_steps")


def mix(
    docs: DataFrame, targets: DataFrame, doc: str, source: str, size: str, weight: str, seed: int = 0, buckets: int | None = None, compensate: bool = False,
) -> DataFrame:
    """``(source, doc, size, repeats)``: how often each document of a target source is used (0 rows are left out).

    Whole passes over a source come first (``full`` repeats of every document); the rest of the budget goes to
    the documents with the smallest exponential keys ``-ln(u) / weight`` (Efraimidis-Spirakis sampling without
    replacement) until the next one would go over it. u is a hash of the id, so a run can be repeated. No
    document is used more than max_repeats times, and a source never exceeds its budget. With ``compensate``
    the tokens that sources at their cap lack are shared out to the others, so the mix keeps its size where
    that is feasible. Documents of size 0 or null are left out, null weights count as 0.1, an empty table gives
    no rows.

    Prefix sums are made in two steps, so a source that holds most rows isn't sorted in one task: keys are cut
    into ``buckets`` (by default one per 100,000 rows of the table), whose sums give each bucket's start. The
    share of a source's keys below e is the mean of ``1 - exp(-weight * e)`` over its weights, so equal ranges
    of that mean are buckets of even size, whatever the weights. The weights are counted in at most 33 steps a
    source. ``docs`` is read several times: hand in a checkpoint if its columns are costly.
    """
    buckets = buckets or max(16, docs.count() // 100_000)
    plan = budgets(docs, targets, source, size)
    plan = (_compensated(plan) if compensate else plan).select("source", "_k", "full", "rest", "max_repeats")
    keyed = keyed_documents(docs, plan, doc, source, size, weight, seed, buckets)
    sums = keyed.groupBy("_k", "_b").agg(F.sum(size).alias("_s"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_k", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_k", "_b").orderBy("_e", doc).rowsBetween(Window.unboundedPreceding, 0)
    running = keyed.withColumn("_run", F.sum(size).over(within)).join(starts, ["_k", "_b"])
    chosen = (F.col("_start") + F.col("_run") <= F.col("rest")) & (F.col("full") < F.col("max_repeats"))
    repeats = F.col("full") + F.when(chosen, 1).otherwise(0)
    return running.select("source", doc, size, repeats.cast("long").alias("repeats")).where("repeats > 0")


def shares_reached(mixed: DataFrame, docs: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """Per target source: wanted share, share of the mixed tokens, tokens due, used and had, whether it falls short."""
    used = mixed.groupBy("source").agg(F.sum(F.col(size) * F.col("repeats")).cast("long").alias("used"))
    each = budgets(docs, targets, source, size).join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    total = F.sum("used").over(Window.partitionBy(F.lit(1)))
    return each.select("source", "target_share", "max_repeats", "tokens", "budget", "used", F.try_divide(F.col("used").cast("double"), total).alias("share"), "short")
