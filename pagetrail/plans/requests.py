"""Queries that assemble requests and read back picks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.operators import html as H
from pagetrail.operators import memory
from pagetrail.operators import request as Q
from pagetrail.plans import runs, runs_sql
from pagetrail.plans.pools import pages
from pagetrail.sources.tables import nested_table, table


def actor_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per step of a run: its instruction as goal, the target of its operation, the three lines before it."""
    past = runs.history_last3(spark, sf_dir).select("run_id", "step", F.col("history").alias("recent"))
    rows = table(spark, sf_dir, "live_runs", "run_id", "goal", F.posexplode("steps").alias("step", "s")).where("s is not null")
    asked = rows.select("run_id", "step", Q.step_goal(F.col("s.instruction"), F.col("goal")).alias("goal"), Q.target_question(F.col("s.operation")).alias("question"))
    return asked.where(F.col("question").isin("click_target", "type_text_target", "select_target")).join(past, ["run_id", "step"])


def field_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with a question about a field: goal, page title, page text up to 6,000 characters and the last six actions."""
    page = table(spark, sf_dir, "page_snapshots").select("page_id", "run_id", "step", "page.title", "page.text").where("step is not null")
    of_run = nested_table(spark, sf_dir, "live_runs", {"run_id", "goal", "steps", "action", "text"})
    joined = page.join(of_run, "run_id")
    recent = F.array_join(F.coalesce(Q.recent_fields(F.col("steps"), F.col("step")), F.array().cast("array<string>")), "|")
    return joined.select("page_id", "goal", "title", F.left("text", F.lit(Q.PAGE_TEXT_CHARS)).alias("text"), recent.alias("recent"))


def sole_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with one candidate in their pool, and whether it is trusted."""
    rows = table(spark, sf_dir, "candidates", "pool_id", "id", F.explode("ops").alias("operation"))
    return Q.sole_trust(rows, "pool_id", "id", "operation")


def pick_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision's choice if one of its answers offers it. Adapter: the choices of the answers are what was offered."""
    rows = table(spark, sf_dir, "live_runs", "run_id", F.posexplode("decisions").alias("decision", "d")).where("d is not null")
    return rows.select("run_id", "decision", Q.valid_pick(F.col("d.choice"), F.col("d.answers.choice")).alias("pick"))


def answers_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every decision from the most to the least confident."""
    rows = table(spark, sf_dir, "live_runs", "run_id", F.posexplode("decisions").alias("decision", "d")).where("d.answers is not null")
    shown = F.transform(Q.by_confidence(F.col("d.answers")), lambda a: F.concat(F.coalesce(a["question"], F.lit("")), F.lit(":"), F.coalesce(a["choice"], F.lit(""))))
    return rows.select("run_id", "decision", F.array_join(shown, "|").alias("answers"))


def label_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels before and behind their first arrow. Adapter: the label of an option is "label → value" of its element."""
    rows = table(spark, sf_dir, "candidates", "cand_row", "label", "value").where("label is not null")
    shown = F.when(F.col("value") != "", F.concat("label", F.lit(Q.ARROW), "value")).otherwise(F.col("label"))
    return rows.select("cand_row", Q.first_segment(shown).alias("first"), Q.after_arrow(shown).alias("rest"))


def dom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every raw candidate among the page's nodes; one that isn't in the page comes after all of them."""
    nodes = H.elements(pages(spark, sf_dir).select("page_key", "html")).where("node_id is not null").select("page_key", "node_id", "pos")
    first = nodes.groupBy("page_key", "node_id").agg(F.min("pos").alias("pos"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("page_key").orderBy("pos")) - 1)
    sizes = first.groupBy("page_key").agg(F.count(F.lit(1)).cast("int").alias("n"))
    tasks = nested_table(spark, sf_dir, "tasks", {"task_row", "actions", "pos_candidates", "neg_candidates", "backend_node_id"})
    acts = tasks.select("task_row", F.posexplode("actions").alias("step", "a"))
    both = F.flatten(F.array(*[F.coalesce(F.col(f"a.{arr}.backend_node_id"), F.array().cast("array<string>")) for arr in ("pos_candidates", "neg_candidates")]))
    raw = acts.select(F.concat_ws(":", "task_row", "step").alias("page_key"), F.explode(F.array_distinct(both)).alias("node_id")).where("node_id is not null")
    joined = raw.join(placed.drop("pos"), ["page_key", "node_id"], "left").join(sizes, "page_key", "left")
    return joined.select("page_key", "node_id", F.coalesce("place", "n", F.lit(0)).alias("place"))


def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed on each page of a run, once each. Adapter: failed actions stand for steps that found no element."""
    rows = Q.notes(memory.attempts(runs.history(spark, sf_dir)))
    return rows.select("run_id", "url", F.array_join("notes", "|").alias("notes"))


QUERIES = {f.__name__: f for f in (actor_requests, field_context, sole_picks, pick_validation, answers_ordered, label_segments, dom_order, page_notes)}

_DECISIONS = """d0 AS (SELECT run_id, unnest(range(len(decisions))) AS decision, decisions FROM live_runs),
d AS (SELECT run_id, CAST(decision AS INT) AS decision, decisions[decision + 1] AS d FROM d0)"""

SQL = {
    "actor_requests": f"""WITH past AS ({runs_sql.SQL["history_last3"]}),
s0 AS (SELECT run_id, goal, unnest(range(len(steps))) AS step, steps FROM live_runs),
s AS (SELECT run_id, goal, CAST(step AS INT) AS step, steps[step + 1] AS s FROM s0)
SELECT s.run_id, s.step, coalesce(nullif(trim(s.s.instruction), ''), s.goal) AS goal, lower(s.s.operation) || '_target' AS question, past.history AS recent
FROM s JOIN past ON past.run_id = s.run_id AND past.step = s.step WHERE s.s.operation IN ('CLICK', 'TYPE_TEXT', 'SELECT')""",
    "field_context": """WITH p AS (SELECT page_id, run_id, step, page.title AS title, page.text AS text FROM page_snapshots WHERE step IS NOT NULL),
j AS (SELECT page_id, goal, title, text, list_filter(steps[1:greatest(step, 0)], lambda x: x IS NOT NULL) AS past FROM p JOIN live_runs USING (run_id))
SELECT page_id, goal, title, left(text, 6000) AS text,
  coalesce(array_to_string(list_transform(past[greatest(len(past) - 5, 1):], lambda x: coalesce(x.action, '') || '=' || coalesce(x.text, '')), '|'), '') AS recent FROM j""",
    "sole_picks": """WITH o AS (SELECT pool_id, id, unnest(ops) AS operation FROM candidates)
SELECT pool_id, operation, min(id) AS id, CASE WHEN operation = 'CLICK' THEN 0.0 ELSE 1.0 END::DOUBLE AS trust FROM o GROUP BY pool_id, operation HAVING count(DISTINCT id) = 1""",
    "pick_validation": f"""WITH {_DECISIONS}
SELECT run_id, decision, CASE WHEN list_contains(list_transform(d.answers, lambda a: a.choice), d.choice) THEN d.choice END AS pick FROM d WHERE d IS NOT NULL""",
    "answers_ordered": f"""WITH {_DECISIONS},
a0 AS (SELECT run_id, decision, d.answers AS answers FROM d WHERE d.answers IS NOT NULL),
a1 AS (SELECT run_id, decision, unnest(range(len(answers))) AS i, answers FROM a0),
a2 AS (SELECT run_id, decision, string_agg(coalesce(answers[i + 1].question, '') || ':' || coalesce(answers[i + 1].choice, ''), '|'
  ORDER BY answers[i + 1].confidence DESC NULLS LAST, i) AS answers FROM a1 WHERE answers[i + 1] IS NOT NULL GROUP BY 1, 2)
SELECT a0.run_id, a0.decision, coalesce(a2.answers, '') AS answers FROM a0 LEFT JOIN a2 USING (run_id, decision)""",
    "label_segments": """WITH l AS (SELECT cand_row, CASE WHEN value <> '' THEN label || ' → ' || value ELSE label END AS x FROM candidates WHERE label IS NOT NULL)
SELECT cand_row, split_part(x, ' → ', 1) AS first, CASE WHEN contains(x, ' → ') THEN substr(x, instr(x, ' → ') + 3) ELSE x END AS rest FROM l""",
    "dom_order": r"""WITH a AS (SELECT task_row, unnest(range(len(actions))) AS step, actions FROM tasks),
acts AS (SELECT task_row || ':' || step AS page_key, actions[step + 1] AS act FROM a),
n0 AS (SELECT page_key, act, coalesce(regexp_extract_all(act.cleaned_html, '\sbackend_node_id="([^"]*)"', 1), []) AS ids FROM acts),
raw AS (SELECT DISTINCT page_key, unnest(list_concat(coalesce(list_transform(act.pos_candidates, lambda c: c.backend_node_id), []),
  coalesce(list_transform(act.neg_candidates, lambda c: c.backend_node_id), []))) AS node_id FROM n0),
ids AS (SELECT page_key, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS ids FROM n0)
SELECT page_key, node_id, CAST(coalesce(list_position(ids, node_id) - 1, len(ids), 0) AS INT) AS place FROM raw JOIN ids USING (page_key) WHERE node_id IS NOT NULL""",
    "page_notes": f"""WITH {runs_sql._ATTEMPTS},
f AS (SELECT run_id, url, operation || ' ' || display AS note, min(step) AS step FROM att WHERE failed GROUP BY 1, 2, 3)
SELECT run_id, url, string_agg(note, '|' ORDER BY step) AS notes FROM f GROUP BY 1, 2""",
}
