"""Run summaries, nearest-rank percentiles, votes over repeated runs and paired comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.keys import running_sums


def nearest_rank(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Per group n, the median and for each share the value at place floor(share * (n - 1)) of the ordered values.

    Equal values are counted first, so a running count over distinct values finds the place and no group's rows
    are sorted in one task. Nulls are left out; groups without values have no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = running_sums(counts, by, value, ["_c"])
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    rows = upto.join(totals, list(by)) if by else upto.withColumn("_n", F.lit(totals.first()["_n"]))
    rows = rows.withColumnRenamed("_c_upto", "_to")

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_to") > place, F.col(value)))

    last = F.col("_n") - 1
    outs = [at(F.floor(F.lit(s) * last)).alias(f"p{round(s * 100)}") for s in shares]
    middle = ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median")
    return rows.groupBy(*by).agg(F.max("_n").alias("n"), middle, *outs)


def run_summary(runs: DataFrame) -> DataFrame:
    """One row over live runs: passed, n, medians of decision, actor (above 0) and planner times, planner errors, seconds per action.

    Times are medians over all decisions of all runs; null elements, arrays and times are left out, a run
    without actions adds its seconds only. Seconds per action is a ratio of sums, null without actions.
    """
    def flat(column: str) -> DataFrame:
        return runs.select(F.explode(column).alias("x")).where("x is not null")

    d, p = flat("decisions"), flat("planner_calls")  # each gives one row; the three are put side by side below
    head = runs.agg(
        F.count_if(F.coalesce("success", F.lit(False))).alias("passed"), F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("seconds", F.lit(0.0))).alias("_s"), F.sum(F.coalesce(F.array_size("steps"), F.lit(0))).alias("_a"),
    )
    dec = d.agg(F.median("x.latency_ms").alias("median_decision_ms"), F.median(F.when(F.col("x.actor_ms") > 0, F.col("x.actor_ms"))).alias("median_actor_ms"))
    pla = p.agg(F.median("x.latency_ms").alias("median_planner_ms"), F.count("x.error").alias("planner_errors"))
    one = head.unionByName(dec, allowMissingColumns=True).unionByName(pla, allowMissingColumns=True)
    one = one.agg(*[F.max(c).alias(c) for c in one.columns])
    return one.select(
        "passed", "n", "median_decision_ms", "median_actor_ms", "median_planner_ms", "planner_errors", F.bround(F.try_divide("_s", "_a"), 2).alias("wall_s_per_action")
    )


def route_counts(runs: DataFrame, *by: str) -> DataFrame:
    """Decisions per route; a missing route is "none"."""
    rows = runs.select(*by, F.explode("decisions").alias("d")).where("d is not null")
    return rows.groupBy(*by, F.coalesce(F.nullif("d.route", F.lit("")), F.lit("none")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def majority(runs: DataFrame, *by: str) -> DataFrame:
    """Per task whether more than half of its runs passed; a null success is a failure."""
    g = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.coalesce("success", F.lit(False))).alias("passed"))
    return g.withColumn("majority", F.col("passed") * 2 > F.col("runs"))


def discordant(left: DataFrame, right: DataFrame, key: str, result: str) -> DataFrame:
    """One row of counts over tasks that both sides have: both pass, only left, only right, neither, and the exact McNemar p."""
    j = left.select(key, F.col(result).alias("_l")).join(right.select(key, F.col(result).alias("_r")), key)
    c = j.agg(
        F.count_if(F.col("_l") & F.col("_r")).alias("both"), F.count_if(F.col("_l") & ~F.col("_r")).alias("only_left"),
        F.count_if(~F.col("_l") & F.col("_r")).alias("only_right"), F.count_if(~F.col("_l") & ~F.col("_r")).alias("neither"),
    )
    return c.withColumn("p", mcnemar_p(F.col("only_left"), F.col("only_right")))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of discordant counts; 1 if there are none. Terms are added in logarithms, so counts may be large."""
    n = (b + c).cast("double")
    k = F.least(b, c).cast("int")
    step = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1))), lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.log((n - i + 1) / i)))
    logs = F.slice(step, 1, k + 1)
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("s"))
    total = F.aggregate(logs, zero, lambda a, x: F.struct((a["l"] + x).alias("l"), (a["s"] + F.exp(a["l"] + x - n * F.log(F.lit(2.0)))).alias("s")))["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), total * 2))


def threshold(df: DataFrame, confidence: str, correct: str, target: float) -> DataFrame:
    """One row: the lowest confidence whose accepted rows (that confidence or more) are right often enough; 1.01 if none is."""
    tied = df.where(F.col(confidence).isNotNull()).groupBy(confidence).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(F.col(correct), F.lit(False))).alias("_k"))
    run = running_sums(tied, [], confidence, ["_k", "_n"], descending=True)
    ok = run.where(F.col("_k_upto") / F.col("_n_upto") >= target)
    return ok.agg(F.coalesce(F.min(confidence), F.lit(1.01)).alias("threshold"))


def top_counts(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values, the smaller of equally frequent ones first."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(value).asc_nulls_last()).limit(n)
