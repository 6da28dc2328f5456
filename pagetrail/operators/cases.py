"""Trajectory steps to labelled case rows: history lines, requests, gold distributions and drop reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions.text import squash

MAX_LABEL, MAX_VALUE, RECENT = 70, 20, 3
OPERATIONS = ("CLICK", "TYPE_TEXT", "SELECT")
#: The source's operation names.
OP_NAMES = {"CLICK": "CLICK", "TYPE": "TYPE_TEXT", "SELECT": "SELECT"}


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def option_text(label: Column, role: Column, value: Column, context: Column | None = None) -> Column:
    """``label (role, =value) [context]``; an empty label falls back to the role, then to "unnamed"."""
    name = F.coalesce(F.nullif(squash(_blank(label), MAX_LABEL), F.lit("")), F.nullif(_blank(role), F.lit("")), F.lit("unnamed"))
    short = squash(_blank(value), MAX_VALUE)
    extras = F.concat_ws(", ", F.nullif(_blank(role), F.lit("")), F.when(short != "", F.concat(F.lit("="), short)))
    text = F.when(extras != "", F.concat(name, F.lit(" ("), extras, F.lit(")"))).otherwise(name)
    return text if context is None else F.when(_blank(context) != "", F.concat(text, F.lit(" ["), context, F.lit("]"))).otherwise(text)


def parsed_option(text: Column) -> Column:
    """The inverse of ``option_text`` as struct(label, role, value); text of another form is all label."""
    pattern = r"(?s)^(.*) \(([^(),=]+)(?:, =([^()]*))?\)$"
    fits = text.rlike(pattern)
    return F.struct(
        F.when(fits, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("label"),
        F.when(fits, F.regexp_extract(text, pattern, 2)).otherwise("").alias("role"),
        F.when(fits, F.regexp_extract(text, pattern, 3)).otherwise("").alias("value"),
    )


def context_text(landmark: Column, section: Column, row: Column) -> Column:
    """``landmark > section · row: row`` with the section up to 40 and the row up to 60 characters."""
    head = F.concat_ws(" > ", F.nullif(_blank(landmark), F.lit("")), F.nullif(squash(_blank(section), 40), F.lit("")))
    tail = squash(_blank(row), 60)
    return F.when(tail != "", F.concat(head, F.lit(" · row: "), tail)).otherwise(head)


def history_line(op: Column, label: Column, value: Column) -> Column:
    """``OP label = value``; without a value just ``OP label``."""
    line = F.concat(op, F.lit(" "), squash(_blank(label), MAX_LABEL))
    return F.when(_blank(value) != "", F.concat(line, F.lit(" = "), squash(_blank(value), MAX_LABEL))).otherwise(line)


def with_history(steps: DataFrame, task: str, order: list[str], line: str, last: int | None = None) -> DataFrame:
    """Adds ``history``: the lines of all earlier rows of the task (or the ``last`` of them), oldest first; null lines are skipped."""
    w = Window.partitionBy(task).orderBy(*order).rowsBetween(Window.unboundedPreceding if last is None else -last, -1)
    return steps.withColumn("history", F.collect_list(line).over(w))


def drop_reason(has_gold: Column, interactive: Column, allowed: Column, shortlisted: Column, asked: Column) -> Column:
    """Why a step can't be used, the first that holds: no gold, gold not interactive, operation not allowed, gold
    not shortlisted, nothing to ask (trivial); null for a usable step."""
    return (
        F.when(~F.coalesce(has_gold, F.lit(False)), "no_gold")
        .when(~F.coalesce(interactive, F.lit(False)), "gold_not_interactive")
        .when(~F.coalesce(allowed, F.lit(False)), "op_not_allowed")
        .when(~F.coalesce(shortlisted, F.lit(False)), "gold_not_shortlisted")
        .when(~F.coalesce(asked, F.lit(False)), "trivial")
    )


def one_hot(ids: Column, gold: Column) -> Column:
    """A distribution over ids with all its mass on ``gold``, in the order of ids (maps wouldn't keep it)."""
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.coalesce((i == gold).cast("double"), F.lit(0.0)).alias("p")))


def parsed_steps(tasks: DataFrame) -> DataFrame:
    """Every action of ``tasks`` as (task_row, step, op, value, gold_id, gold_interactive, pool_size, drop_reason).

    The pool holds the distinct interactive candidates; the gold element is the first interactive positive,
    else the first positive. Roles come from the raw attributes, a JSON object in a string (null: none). Null
    actions and candidates are left out; a null operation keeps op null; unknown operations are kept as they
    are but never allowed.
    """
    from pagetrail.operators.html import is_interactive, ops_of, role_of

    acts = tasks.select("task_row", F.posexplode("actions").alias("step", "a")).where("a is not null")

    def seen(arr: str) -> Column:
        def one(c):
            attrs = F.from_json(c["attributes"], "map<string,string>")
            return F.struct(
                c["backend_node_id"].alias("id"), is_interactive(c["tag"], attrs).alias("ok"), ops_of(c["tag"], role_of(c["tag"], attrs)).alias("ops"),
            )

        return F.transform(F.filter(F.coalesce(F.col(f"a.{arr}"), F.array()), lambda c: c.isNotNull()), one)

    rows = acts.select(
        "task_row", "step", F.coalesce(*[F.when(F.col("a.operation.op") == k, v) for k, v in OP_NAMES.items()], F.col("a.operation.op")).alias("op"),
        F.coalesce("a.operation.value", F.lit("")).alias("value"), seen("pos_candidates").alias("p"), seen("neg_candidates").alias("n"),
    )
    good = F.filter("p", lambda c: c["ok"])
    gold = F.coalesce(F.get(good, 0), F.get("p", 0))
    pool = F.array_distinct(F.transform(F.filter(F.concat("p", "n"), lambda c: c["ok"]), lambda c: c["id"]))
    rows = rows.withColumn("g", gold).withColumn("pool_size", F.size(pool))
    reason = F.when(F.col("g").isNull(), "no_gold").when(~F.col("g.ok"), "gold_not_interactive").when(~F.coalesce(F.array_contains("g.ops", F.col("op")), F.lit(False)), "op_not_allowed")
    return rows.select("task_row", "step", "op", "value", F.col("g.id").alias("gold_id"), F.coalesce("g.ok", F.lit(False)).alias("gold_interactive"), "pool_size", reason.alias("drop_reason"))
