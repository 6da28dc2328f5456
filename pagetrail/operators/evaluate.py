"""Scoring predictions over case rows: micro metrics over steps and macro metrics over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.functions.text import rounded_rate


def forced(reason: Column) -> Column:
    """The outcome of a row that no predictor is asked about: right if trivial, wrong if it was dropped; null if it is asked."""
    return F.when(reason == "trivial", True).when(reason.isNotNull(), False)


def outcomes(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Case rows with ``op_ok``, ``element_ok``, ``step_ok`` and ``error`` of their prediction.

    ``cases`` has task_id, step, gold_op, gold_id, valid_gold, gold_in_shortlist, drop_reason; ``predictions``
    one row per (task_id, step) with operation, targets (map of operation to element) and error (null if it
    worked). A missing, failed or null prediction is wrong. Rows with the same task and step share a prediction.
    """
    p = predictions.select("task_id", "step", "operation", "targets", F.col("error").isNotNull().alias("error"))
    rows = cases.join(p, ["task_id", "step"], "left")
    works = ~F.coalesce("error", F.lit(False))
    op_ok = F.coalesce(works & (F.col("operation") == F.col("gold_op")), F.lit(False))
    element_ok = F.coalesce(works & (F.try_element_at("targets", F.col("gold_op")) == F.col("gold_id")), F.lit(False))
    rows = rows.withColumn("error", F.coalesce("error", F.lit(False))).withColumn("op_ok", op_ok).withColumn("element_ok", element_ok)
    return rows.withColumn("step_ok", F.col("op_ok") & F.col("element_ok")).drop("operation", "targets")


def micro(scored: DataFrame) -> DataFrame:
    """One row of counts and rates over steps; a rate over nothing is null."""
    valid = F.coalesce("valid_gold", F.lit(False))
    asked = valid & F.coalesce("gold_in_shortlist", F.lit(False))

    def hits(c: str) -> Column:
        return F.count_if(asked & F.col(c))

    n_asked, n_valid = F.count_if(asked), F.count_if(valid)
    return scored.agg(
        F.count(F.lit(1)).alias("steps"), n_valid.alias("valid_gold"), n_asked.alias("scored"), F.count_if(asked & F.col("error")).alias("errors"),
        rounded_rate(hits("op_ok"), n_asked).alias("op_acc"), rounded_rate(hits("element_ok"), n_asked).alias("element_acc_given_op"),
        rounded_rate(hits("element_ok"), n_valid).alias("element_acc_overall"), rounded_rate(hits("step_ok"), n_asked).alias("step_success_scored"),
        rounded_rate(hits("step_ok"), n_valid).alias("step_success_overall"),
    )


def macro(scored: DataFrame) -> DataFrame:
    """One row: means over tasks of the tasks' own means, all rows of a task included; success means every step is right."""
    asked = F.coalesce(F.col("valid_gold") & F.col("gold_in_shortlist"), F.lit(False))
    values = {n: F.coalesce(forced(F.col("drop_reason")), asked & F.col(c)) for n, c in (("element", "element_ok"), ("op", "op_ok"), ("step", "step_ok"))}
    tasks = scored.select("task_id", *[v.alias(n) for n, v in values.items()]).groupBy("task_id").agg(
        *[F.avg(F.col(n).cast("double")).alias(n) for n in values], F.bool_and("step").cast("double").alias("all_right")
    )
    return tasks.agg(
        F.count(F.lit(1)).alias("tasks"), F.bround(F.avg("element"), 4).alias("element_acc_macro"), F.bround(F.avg("op"), 4).alias("op_acc_macro"),
        F.bround(F.avg("step"), 4).alias("step_success_macro"), F.bround(F.avg("all_right"), 4).alias("success_rate"),
    )


def case_summary(cases: DataFrame) -> DataFrame:
    """One row: steps, valid and usable ones, recall of the shortlist, median pool size."""
    valid = F.coalesce("valid_gold", F.lit(False))
    return cases.agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(valid).alias("valid_gold"), F.count_if(F.col("drop_reason").isNull()).alias("usable_for_training"),
        rounded_rate(F.count_if(valid & F.col("gold_in_shortlist")), F.count_if(valid)).alias("recall_at_k"), F.median("pool_size").alias("median_pool_size"),
    )


def baseline_predictions(top: DataFrame) -> DataFrame:
    """The model-free baseline: always CLICK, and for each operation the best ranked element. ``top`` has task_id, step, op, id; a null op has no target."""
    targets = F.map_from_entries(F.collect_list(F.when(F.col("op").isNotNull(), F.struct("op", "id"))))
    return top.groupBy("task_id", "step").agg(targets.alias("targets")).select(
        "task_id", "step", F.lit("CLICK").alias("operation"), "targets", F.lit(None).cast("string").alias("error")
    )


def answered_predictions(answers: DataFrame) -> DataFrame:
    """Predictions from a model's answers: the chosen operation, else the only one offered (or none); the chosen
    target per operation, else its sole candidate. ``answers`` has task_id, step, operation, ops_available,
    chosen (map), sole (map), error."""
    op = F.coalesce("operation", F.when(F.size("ops_available") == 1, F.get("ops_available", 0)))
    empty = F.create_map().cast("map<string,string>")
    chosen = F.coalesce("chosen", empty)
    rest = F.map_filter(F.coalesce("sole", empty), lambda k, v: ~F.map_contains_key(chosen, k))
    return answers.select("task_id", "step", op.alias("operation"), F.map_concat(rest, chosen).alias("targets"), "error")
