"""Resolving what a step means, routing it through a cascade, and validating model output, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.functions import text as X
from pagetrail.functions import urls as U

TOP_N, TAU = 5, 0.5
LITERALS = ["false", "true", "null", "none"]


def resolve(wants: DataFrame, elements: DataFrame) -> DataFrame:
    """``wants(page, want_id, target)`` against ``elements(page, id, label, aliases)``: (page, want_id, id, how).

    The only element that bears the wanted name (``resolver``); if none does, the only one with a name that
    holds all its words (``resolver_fuzzy``). Several bearers of the name stop the search. Names are folded;
    an empty target resolves to nothing. Word containment is a join on words with a count, never a product of
    wants and elements.
    """
    w = wants.select("page", "want_id", X.normalised(F.coalesce("target", F.lit(""))).alias("want")).where("want <> ''")
    names = F.array_compact(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    e = elements.select("page", "id", F.posexplode(names).alias("k", "name")).withColumn("name", X.normalised(F.col("name")))
    same = w.join(e, (w["page"] == e["page"]) & (w["want"] == e["name"])).select(w["page"], "want_id", "id").distinct()
    exact = same.groupBy("page", "want_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    w_words = w.select("page", "want_id", F.explode(F.array_distinct(F.split("want", " "))).alias("word"), F.size(F.array_distinct(F.split("want", " "))).alias("need"))
    e_words = e.select("page", "id", "k", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    shared = w_words.join(e_words, ["page", "word"]).groupBy("page", "want_id", "id", "k").agg(F.count(F.lit(1)).alias("hit"), F.max("need").alias("need"))
    inside = shared.where("hit = need").select("page", "want_id", "id").distinct()
    fuzzy = inside.groupBy("page", "want_id").agg(F.count(F.lit(1)).alias("n_f"), F.min("id").alias("id_f"))
    out = w.join(exact, ["page", "want_id"], "left").join(fuzzy, ["page", "want_id"], "left")
    how = F.when(F.col("n") == 1, "resolver").when(F.col("n").isNull() & (F.col("n_f") == 1), "resolver_fuzzy")
    return out.select("page", "want_id", F.when(how == "resolver", F.col("id")).when(how == "resolver_fuzzy", F.col("id_f")).alias("id"), how.alias("how"))


def cascade(n_pool: Column, how: Column, resolved: Column, actor: Column, confidence: Column, picked: Column, tau: float = TAU) -> Column:
    """struct(route, id, confidence): no candidates, then the resolver, then a sure enough actor, then the planner's pick, else none."""
    sure = actor.isNotNull() & (F.coalesce(confidence, F.lit(0.0)) >= tau)
    route = (
        F.when(F.coalesce(n_pool, F.lit(0)) == 0, "no_candidates").when(how.isNotNull(), how).when(sure, "actor").when(picked.isNotNull(), "planner_pick").otherwise("planner_none")
    )
    target = F.when(route.startswith("resolver"), resolved).when(route == "actor", actor).when(route == "planner_pick", picked)
    trust = F.when(route == "no_candidates", 0.0).when(route.startswith("resolver"), 1.0).otherwise(F.coalesce(confidence, F.lit(0.0)))
    return F.struct(route.alias("route"), target.alias("id"), trust.alias("confidence"))


def top_probabilities(probabilities: Column, n: int = TOP_N) -> Column:
    """The n most probable of array<struct<id, p>>, the earlier of equals first."""
    placed = F.transform(probabilities, lambda x, i: F.struct((-x["p"]).alias("m"), i.alias("i"), x["id"].alias("id"), x["p"].alias("p")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda x: F.struct(x["id"].alias("id"), x["p"].alias("p")))


def valid_choice(choice: Column, confidence: Column, probabilities: Column, offered: Column) -> Column:
    """Whether an answer can be trusted: the choice was offered, exactly the offered ids have a probability, all
    numbers are finite and within [0, 1], they add up to 1 (within 0.02), and none beats the choice's.
    ``probabilities`` is a map, ``offered`` an array; anything missing is invalid."""
    ps = F.map_values(probabilities)
    numbers = F.concat(ps, F.array(confidence))
    ok = (
        F.array_contains(offered, choice)
        & (F.array_sort(F.map_keys(probabilities)) == F.array_sort(F.array_distinct(offered)))
        & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
        & (F.abs(F.aggregate(ps, F.lit(0.0), lambda a, x: a + x) - 1) < 0.02)
        & (F.element_at(probabilities, choice) >= F.array_max(ps) - 1e-6)
    )
    return F.coalesce(ok, F.lit(False))


def valid_text(value: Column) -> Column:
    """A text that a person would type: not null or blank, up to 2,000 characters, no literal of a programming language."""
    ok = value.rlike(r"(?U)\S") & (F.length(value) <= 2000) & ~F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")).isin(LITERALS)
    return F.coalesce(ok, F.lit(False))


PLAN_OPERATIONS = ["CLICK", "TYPE_TEXT", "SELECT", "SCROLL_TO_TEXT", "GOTO"]
VALUE_OPERATIONS = ["TYPE_TEXT", "SELECT"]


def plan_step(operation: Column, target: Column, value: Column, instruction: Column, allowed_goto: Column) -> Column:
    """struct(operation, target, value, instruction, error) of one planned step; error is null for a valid one.

    For typing and selecting, a value put into the target by mistake moves to where it belongs. Other
    operations need a target, and every step an instruction, which is cut to 20 words. Literals aren't values;
    addresses must be among the allowed ones.
    """
    takes_value = operation.isin(VALUE_OPERATIONS)
    t, v, said = (F.trim(F.coalesce(c, F.lit(""))) for c in (target, value, instruction))
    swap = takes_value & (v == "") & (t != "")
    t2, v2 = F.when(swap, "").otherwise(t), F.when(swap, t).otherwise(v)
    error = (
        F.when(operation.isNull() | ~operation.isin(PLAN_OPERATIONS), "unknown operation")
        .when(~takes_value & (t2 == ""), "no target")
        .when(takes_value & (v2 == ""), "no value")
        .when(takes_value & F.lower(v2).isin(LITERALS), "literal value")
        .when((operation == "GOTO") & ~F.coalesce(allowed_goto, F.lit(False)), "address not allowed")
        .when(said == "", "no instruction")
    )
    return F.struct(operation.alias("operation"), t2.alias("target"), v2.alias("value"), X.first_words(said, 20).alias("instruction"), error.alias("error"))


def evidence_shown(evidence: Column, page_text: Column, title: Column) -> Column:
    """Whether a quote, folded, occurs in the page's text or title; an empty quote never does."""
    q = X.normalised(F.coalesce(evidence, F.lit("")))
    inside = F.contains(X.normalised(F.coalesce(page_text, F.lit(""))), q) | F.contains(X.normalised(F.coalesce(title, F.lit(""))), q)
    return (q != "") & inside


def first_valid(*attempts: Column) -> Column:
    """The first attempt that isn't null: a retry counts only if what came before was invalid."""
    return F.coalesce(*attempts)


def allowed_goto(url: Column, templates: DataFrame) -> Column:
    """Whether ``url`` is a rendered search template; ``templates`` has template, at most 1,000 rows (checked)."""
    rows = templates.select("template").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("too many templates")
    import re

    ok = F.lit(False)
    for r in rows:
        head, _, tail = r["template"].partition("{q}")
        ok = ok | url.rlike(f"^{re.escape(head)}[^&#\\s]+{re.escape(tail)}$")
    return ok


def element_line(index: Column, label: Column, role: Column, ops: Column, landmark: Column, section: Column, row: Column, value: Column, in_viewport: Column) -> Column:
    """One element as ``index | label | role | ops | landmark > section | row: … | value: … | offscreen``; empty parts are left out."""
    context = F.concat(F.coalesce(landmark, F.lit("")), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" > "), F.left(section, F.lit(30)))).otherwise(""))
    parts = [
        index, F.left(label, F.lit(50)), role, F.array_join(ops, "/"), context,
        F.when(F.coalesce(row, F.lit("")) != "", F.concat(F.lit("row: "), F.left(row, F.lit(40)))),
        F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit("value: "), F.left(value, F.lit(20)))),
        F.when(~in_viewport, "offscreen"),
    ]
    return F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts])


def within_chars(lines: DataFrame, group: str, rank: str, line: str, budget: int, most: int) -> DataFrame:
    """The first lines of every group that fit a budget of characters: the first always, then up to the first that
    goes over it, and no more than ``most``."""
    from pyspark.sql import Window

    few = lines.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(rank))).where(F.col("_n") <= most)
    run = F.sum(F.length(line)).over(Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("_run", run).where((F.col("_n") == 1) | (F.col("_run") <= budget)).drop("_n", "_run")


def matches_host(url: Column) -> Column:
    return F.lower(U.part(url, "HOST"))
