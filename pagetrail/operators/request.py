"""Assembling what is asked of a model, and reading back what it picked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much of a page and of the past goes with a question about a field.
PAGE_TEXT_CHARS, FIELD_ACTIONS = 6000, 6
ARROW = " → "


def target_question(operation: Column) -> Column:
    """The name of the question that asks for an operation's target."""
    return F.concat(F.lower(operation), F.lit("_target"))


def step_goal(instruction: Column, goal: Column) -> Column:
    """A step's own instruction is the goal of its request; a null or blank one leaves the run's goal."""
    return F.coalesce(F.nullif(F.trim(instruction), F.lit("")), goal)


def recent_fields(steps: Column, upto: Column, n: int = FIELD_ACTIONS) -> Column:
    """``action=text`` of the last ``n`` steps among the first ``upto``, oldest first; null steps are skipped, null texts are empty, null ``upto`` is none."""
    past = F.filter(F.slice(steps, F.lit(1), F.greatest(upto, F.lit(0))), lambda s: s.isNotNull())
    last = F.slice(past, F.greatest(F.size(past) - (n - 1), F.lit(1)), F.lit(n))
    return F.transform(last, lambda s: F.concat(F.coalesce(s["action"], F.lit("")), F.lit("="), F.coalesce(s["text"], F.lit(""))))


def sole_trust(pool: DataFrame, group: str, item: str, operation: str) -> DataFrame:
    """``(group, operation, item, trust)`` where an operation has one candidate: a lone field is trusted, a lone click target isn't.

    Repeated rows of an item count once; null items count as none. Counted with map-side combining.
    """
    per = pool.groupBy(group, operation).agg(F.min(item).alias(item), F.max(item).alias("_most"))
    sole = per.where(F.col(item) == F.col("_most"))
    return sole.select(group, operation, item, F.when(F.col(operation) == "CLICK", 0.0).otherwise(1.0).alias("trust"))


def valid_pick(choice: Column, offered: Column) -> Column:
    """The choice if it was offered, else null; nothing offered or a null choice is null."""
    return F.when(F.array_contains(F.coalesce(offered, F.array().cast("array<string>")), choice), choice)


def by_confidence(answers: Column) -> Column:
    """Answers from the most to the least confident; null confidences last, equal ones in their order, null answers left out."""
    keyed = F.transform(answers, lambda a, i: F.struct(F.coalesce(-a["confidence"], F.lit(float("inf"))).alias("c"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(F.filter(keyed, lambda k: k["a"].isNotNull())), lambda k: k["a"])


def first_segment(label: Column) -> Column:
    """A label up to its first arrow."""
    return F.substring_index(label, ARROW, 1)


def after_arrow(label: Column) -> Column:
    """A label from behind its first arrow on; without one, the whole label."""
    at = F.instr(label, ARROW)
    return F.when(at > 0, F.substr(label, at + len(ARROW))).otherwise(label)


def notes(tried: DataFrame) -> DataFrame:
    """``(run_id, url, notes)``: what failed on a page, each ``OPERATION label`` once, in the order of its first failure.

    A page's notes are bounded by its run's steps. Pages without a failure have no row.
    """
    note = F.concat_ws(" ", "operation", "display")
    first = tried.where("failed").groupBy("run_id", "url", note.alias("note")).agg(F.min("step").alias("step"))
    listed = first.groupBy("run_id", "url").agg(F.array_sort(F.collect_list(F.struct("step", "note"))).alias("l"))
    return listed.select("run_id", "url", F.transform("l", lambda x: x["note"]).alias("notes"))
