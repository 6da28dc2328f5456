"""What was tried on each page of a run: attempts, failures, exclusions, streaks, blocked and stalled runs.

Input is a history table, one row per executed action in the order of ``step``: (run_id, step, operation,
kind, action, text, url_before, url, page_changed, role, tool_ok). Nulls keep their meaning: an unknown
``page_changed`` counts as no change for the outcome, but not as "false" for the block rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import text as X
from pagetrail.functions import urls as U
from pagetrail.operators.html import EDITABLE_ROLES

REPEAT_LIMIT, BLOCK_ACTIONS, STALL_ACTIONS = 2, 3, 4


def outcome(url_before: Column, url: Column, page_changed: Column) -> Column:
    """url_changed if the address before is known and another now (a missing address now is another), else page_changed or no_change."""
    moved = url_before.isNotNull() & ~F.equal_null(url_before, url)
    return F.when(moved, "url_changed").when(F.coalesce(page_changed, F.lit(False)), "page_changed").otherwise("no_change")


def attempts(history: DataFrame) -> DataFrame:
    """(run_id, step, url, operation, label, display, value, outcome, failed, completed), and planned if ``history`` has it.

    ``url`` is the page the action ran on, without fragment; ``label`` the folded action label. A tool's own
    verdict decides if it failed; else no change is a failure, except for typing and for clicks on editable
    fields. A completed tool action must also have changed the page.
    """
    here = U.without_fragment(F.coalesce(F.nullif("url_before", F.lit("")), F.col("url"), F.lit("")))
    rows = history.select(
        "run_id", "step", here.alias("url"), F.coalesce(F.nullif("operation", F.lit("")), F.upper("kind"), F.lit("")).alias("operation"),
        X.normalised(F.coalesce("action", F.lit(""))).alias("label"), F.coalesce("action", F.lit("")).alias("display"), F.coalesce("text", F.lit("")).alias("value"),
        outcome(F.col("url_before"), F.col("url"), F.col("page_changed")).alias("outcome"), F.coalesce("role", F.lit("")).alias("role"), "tool_ok",
        *(["planned"] if "planned" in history.columns else []),
    )
    still = F.col("outcome") == "no_change"
    focus = (F.col("operation") == "CLICK") & F.col("role").isin(EDITABLE_ROLES)
    failed = F.when(F.col("tool_ok").isNotNull(), ~F.col("tool_ok")).otherwise(still & (F.col("operation") != "TYPE_TEXT") & ~focus)
    rows = rows.withColumn("failed", failed)
    return rows.withColumn("completed", ~F.col("failed") & (F.col("tool_ok").isNull() | ~still)).drop("tool_ok")


def exclusions(tried: DataFrame) -> DataFrame:
    """Per (run_id, url, operation, label) why it isn't offered again: any failure on the page ("no effect"), else
    two or more attempts ("repeated"). A later success clears nothing. The display label is that of the last
    failure, else of the first attempt."""
    g = tried.groupBy("run_id", "url", "operation", "label").agg(
        F.bool_or("failed").alias("any_failed"), F.count(F.lit(1)).alias("n"),
        F.max_by("display", F.when(F.col("failed"), F.col("step"))).alias("last_failed"), F.min_by("display", "step").alias("first"),
    )
    kept = g.where(F.col("any_failed") | (F.col("n") >= REPEAT_LIMIT))
    reason = F.when(F.col("any_failed"), "no effect").otherwise("repeated")
    return kept.select("run_id", "url", "operation", "label", F.when(F.col("any_failed"), F.col("last_failed")).otherwise(F.col("first")).alias("display"), reason.alias("reason"))


def usable(elements: DataFrame, excluded: DataFrame) -> DataFrame:
    """Elements (run_id, url, operation, label) that aren't excluded; labels are compared as they are in both."""
    return elements.join(excluded.select("run_id", "url", "operation", "label"), ["run_id", "url", "operation", "label"], "left_anti")


def streaks(tried: DataFrame) -> DataFrame:
    """Per action the ``streak`` of actions up to it without a change of address, ``done``, the completed so far, and
    ``planned_done``, those of them that a plan asked for (all, if ``tried`` has no column ``planned``)."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("step"))
    rows = tried.withColumn("_n", n).withColumn("done", F.count_if("completed").over(w))
    planned = F.coalesce("planned", F.lit(False)) if "planned" in tried.columns else F.lit(True)
    rows = rows.withColumn("planned_done", F.count_if(F.col("completed") & planned).over(w))
    last_move = F.max(F.when(F.col("outcome") == "url_changed", F.col("_n"))).over(w)
    return rows.withColumn("streak", F.col("_n") - F.coalesce(last_move, F.lit(0)))


def stalled(streaked: DataFrame) -> DataFrame:
    """Adds ``stalled``: four actions or more without a change of address and no planned one completed in the last four."""
    w = Window.partitionBy("run_id").orderBy("step")
    before = F.coalesce(F.lag("planned_done", STALL_ACTIONS).over(w), F.lit(0))
    return streaked.withColumn("stalled", (F.col("streak") >= STALL_ACTIONS) & (F.col("_n") >= STALL_ACTIONS) & (F.col("planned_done") == before)).drop("_n")


def blocked(history: DataFrame) -> DataFrame:
    """Adds ``blocked``: this and the two actions before it were seen to change nothing, and none was a wait."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(1 - BLOCK_ACTIONS, 0)
    idle = F.coalesce(~F.col("page_changed"), F.lit(False)) & (F.coalesce("kind", F.lit("")) != "wait")
    return history.withColumn("blocked", F.count_if(idle).over(w) == BLOCK_ACTIONS)


def within_budget(history: DataFrame, actions: int) -> DataFrame:
    """The first ``actions`` actions of every run."""
    return history.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("step"))).where(F.col("_n") <= actions).drop("_n")
