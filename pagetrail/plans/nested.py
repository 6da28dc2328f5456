"""Queries that flatten the nested tables (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.operators.shred import adjacency, entity_table, last_ordinal
from pagetrail.sources.tables import nested_table

CANDIDATES = ("pos_candidates", "neg_candidates")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-null element of the four arrays with its parent and place."""
    tasks = nested_table(spark, sf_dir, "tasks", {"task_row", "actions", *CANDIDATES, "backend_node_id"})
    runs = nested_table(spark, sf_dir, "live_runs", {"run_id", "decisions", "steps", "choice", "n"})
    of_tasks = entity_table(adjacency(tasks, "task_row", ["actions"]), CANDIDATES, ["backend_node_id"])
    of_runs = entity_table(adjacency(runs, "run_id", ["decisions", "steps"]), ["decisions", "steps"], ["choice", "n"])
    candidates = of_tasks.select(
        F.col("record").alias("parent_id"), F.col("label").alias("arr"), last_ordinal("parent").alias("parent_pos"),
        F.col("ordinal").alias("pos"), F.coalesce("backend_node_id", F.lit("")).alias("child_id"),
    )
    child = F.when(F.col("label") == "decisions", F.col("choice")).otherwise(F.col("n"))
    others = of_runs.select(
        F.col("record").alias("parent_id"), F.col("label").alias("arr"), F.lit(-1).alias("parent_pos"),
        F.col("ordinal").alias("pos"), F.coalesce(child, F.lit("")).alias("child_id"),
    )
    return candidates.unionByName(others)


def p4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of candidates with all their fields, linked to task row and action."""
    tasks = nested_table(spark, sf_dir, "tasks", {"task_row", "actions", *CANDIDATES, "tag", "backend_node_id", "attributes"})
    rows = entity_table(adjacency(tasks, "task_row", ["actions"]), CANDIDATES, ["tag", "backend_node_id", "attributes"])
    return rows.select(
        F.col("record").alias("task_row"), last_ordinal("parent").alias("action_pos"), F.col("label").alias("arr"),
        F.col("ordinal").alias("pos"), "tag", "backend_node_id", "attributes",
    )


DECISION = {"choice": "string", "operation": "string", "target": "string", "confidence": "double", "latency_ms": "int", "actor_ms": "int", "route": "string"}
STEP = {
    "n": "int", "operation": "string", "action": "string", "text": "string", "policy_ms": "int", "page_changed": "boolean",
    "url_before": "string", "url_after": "string", "route": "string", "instruction": "string",
}


def _of_runs(spark: SparkSession, sf_dir: str, array: str, fields: dict[str, str]) -> DataFrame:
    runs = nested_table(spark, sf_dir, "live_runs", {"run_id", array, *fields})
    rows = entity_table(adjacency(runs, "run_id", [array]), array, list(fields))
    return rows.select(F.col("record").alias("run_id"), F.col("ordinal").alias("pos"), *[F.col(f).cast(t).alias(f) for f, t in fields.items()])


def p4_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of decisions with all their fields; their answers and usage are tables of their own."""
    return _of_runs(spark, sf_dir, "decisions", DECISION)


def p4_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of steps with all their fields."""
    return _of_runs(spark, sf_dir, "steps", STEP)


def p4_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of actions with their operation; their candidates are a table of their own."""
    tasks = nested_table(spark, sf_dir, "tasks", {"task_row", "actions", "action_uid", "cleaned_html", "operation", "op", "original_op", "value"})
    nodes = adjacency(tasks, "task_row", ["actions"])
    acts = entity_table(nodes, "actions", ["action_uid", "cleaned_html"]).select("record", "node", "ordinal", "action_uid", "cleaned_html")
    done = entity_table(nodes, "operation", ["op", "original_op", "value"]).select("record", F.col("parent").alias("node"), "op", "original_op", "value")
    return acts.join(done, ["record", "node"], "left").select(
        F.col("record").alias("task_row"), F.col("ordinal").alias("pos"), "action_uid", "cleaned_html", "op", "original_op", "value",
    )


def p4_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third level: the answers inside decisions, linked to run and decision."""
    runs = nested_table(spark, sf_dir, "live_runs", {"run_id", "decisions", "answers", "question", "choice", "confidence"})
    rows = entity_table(adjacency(runs, "run_id", ["decisions"]), "answers", ["question", "choice", "confidence"])
    return rows.select(
        F.col("record").alias("run_id"), last_ordinal("parent").alias("decision_pos"), F.col("ordinal").alias("pos"),
        "question", "choice", F.col("confidence").cast("double").alias("confidence"),
    )


def p4_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct inside an array: token usage per decision; decisions without one have no row."""
    runs = nested_table(spark, sf_dir, "live_runs", {"run_id", "decisions", "usage", "prompt_tokens", "completion_tokens"})
    rows = entity_table(adjacency(runs, "run_id", ["decisions"]), "usage", ["prompt_tokens", "completion_tokens"])
    return rows.select(
        F.col("record").alias("run_id"), last_ordinal("parent").alias("decision_pos"),
        F.col("prompt_tokens").cast("int").alias("prompt_tokens"), F.col("completion_tokens").cast("int").alias("completion_tokens"),
    )


QUERIES = {
    "p4_found": p4_found, "p4_decisions": p4_decisions, "p4_steps": p4_steps, "p4_actions": p4_actions, "p4_candidates": p4_candidates, "p4_answers": p4_answers, "p4_usage": p4_usage,
}

SQL = {
    "p4_found": """
WITH a AS (SELECT task_row, unnest(range(len(actions))) AS i, actions FROM tasks),
acts AS (SELECT task_row, i, actions[i + 1] AS act FROM a),
c AS (SELECT task_row, i, 'pos_candidates' AS arr, act.pos_candidates AS els FROM acts
      UNION ALL SELECT task_row, i, 'neg_candidates', act.neg_candidates FROM acts),
ce AS (SELECT task_row, i, arr, unnest(range(len(els))) AS j, els FROM c),
d AS (SELECT run_id, unnest(range(len(decisions))) AS j, decisions FROM live_runs),
s AS (SELECT run_id, unnest(range(len(steps))) AS j, steps FROM live_runs)
SELECT task_row AS parent_id, arr, CAST(i AS INT) AS parent_pos, CAST(j AS INT) AS pos, coalesce(els[j + 1].backend_node_id, '') AS child_id
FROM ce WHERE els[j + 1] IS NOT NULL
UNION ALL SELECT run_id, 'decisions', -1, CAST(j AS INT), coalesce(decisions[j + 1].choice, '') FROM d WHERE decisions[j + 1] IS NOT NULL
UNION ALL SELECT run_id, 'steps', -1, CAST(j AS INT), coalesce(CAST(steps[j + 1].n AS VARCHAR), '') FROM s WHERE steps[j + 1] IS NOT NULL""",
    "p4_decisions": f"""
WITH d AS (SELECT run_id, unnest(range(len(decisions))) AS j, decisions FROM live_runs)
SELECT run_id, CAST(j AS INT) AS pos, {", ".join(f"decisions[j + 1].{f} AS {f}" for f in DECISION)} FROM d WHERE decisions[j + 1] IS NOT NULL""",
    "p4_steps": f"""
WITH s AS (SELECT run_id, unnest(range(len(steps))) AS j, steps FROM live_runs)
SELECT run_id, CAST(j AS INT) AS pos, {", ".join(f"steps[j + 1].{f} AS {f}" for f in STEP)} FROM s WHERE steps[j + 1] IS NOT NULL""",
    "p4_actions": """
WITH a AS (SELECT task_row, unnest(range(len(actions))) AS i, actions FROM tasks), e AS (SELECT task_row, i, actions[i + 1] AS a FROM a)
SELECT task_row, CAST(i AS INT) AS pos, a.action_uid AS action_uid, a.cleaned_html AS cleaned_html, a.operation.op AS op,
  a.operation.original_op AS original_op, a.operation.value AS value FROM e WHERE a IS NOT NULL""",
    "p4_candidates": """
WITH a AS (SELECT task_row, unnest(range(len(actions))) AS i, actions FROM tasks),
acts AS (SELECT task_row, i, actions[i + 1] AS act FROM a),
c AS (SELECT task_row, i, 'pos_candidates' AS arr, act.pos_candidates AS els FROM acts
      UNION ALL SELECT task_row, i, 'neg_candidates', act.neg_candidates FROM acts),
ce AS (SELECT task_row, i, arr, unnest(range(len(els))) AS j, els FROM c)
SELECT task_row, CAST(i AS INT) AS action_pos, arr, CAST(j AS INT) AS pos, els[j + 1].tag AS tag, els[j + 1].backend_node_id AS backend_node_id,
       els[j + 1].attributes AS attributes
FROM ce WHERE els[j + 1] IS NOT NULL""",
    "p4_answers": """
WITH d AS (SELECT run_id, unnest(range(len(decisions))) AS i, decisions FROM live_runs),
da AS (SELECT run_id, i, decisions[i + 1].answers AS els FROM d),
e AS (SELECT run_id, i, unnest(range(len(els))) AS j, els FROM da)
SELECT run_id, CAST(i AS INT) AS decision_pos, CAST(j AS INT) AS pos, els[j + 1].question AS question, els[j + 1].choice AS choice,
       els[j + 1].confidence AS confidence
FROM e WHERE els[j + 1] IS NOT NULL""",
    "p4_usage": """
WITH d AS (SELECT run_id, unnest(range(len(decisions))) AS i, decisions FROM live_runs)
SELECT run_id, CAST(i AS INT) AS decision_pos, decisions[i + 1].usage.prompt_tokens AS prompt_tokens,
       decisions[i + 1].usage.completion_tokens AS completion_tokens
FROM d WHERE decisions[i + 1].usage IS NOT NULL""",
}
