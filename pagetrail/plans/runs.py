"""Queries over runs, cases and events: memory, routing, metrics, summaries, samples, calibration.

Where the tables lack a column of an operator's input, an adapter is named in the query's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.functions import text as X
from pagetrail.functions import urls as U
from pagetrail.operators import asof, calibrate, cases, evaluate, memory, route, sample, summarize
from pagetrail.sources.tables import nested_table, table, utc


def history(spark: SparkSession, sf_dir: str, planned: bool = False) -> DataFrame:
    """Adapter: a run's steps as its history, in array order; kind from the operation (WAIT is a wait), no role, no tools."""
    runs = table(spark, sf_dir, "live_runs", "run_id", "steps")
    rows = runs.select("run_id", F.posexplode("steps").alias("step", "s")).where("s is not null")
    kind = F.when(F.col("s.operation") == "WAIT", "wait").when(F.col("s.operation") == "TYPE_TEXT", "fill").otherwise("click")
    return rows.select(
        "run_id", "step", F.col("s.operation").alias("operation"), kind.alias("kind"), F.col("s.action").alias("action"), F.col("s.text").alias("text"),
        F.col("s.url_before").alias("url_before"), F.col("s.url_after").alias("url"), F.col("s.page_changed").alias("page_changed"),
        F.lit("").alias("role"), F.lit(None).cast("boolean").alias("tool_ok"),
        *([F.coalesce(F.trim("s.instruction") != "", F.lit(False)).alias("planned")] if planned else []),
    )


def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.attempts(history(spark, sf_dir)).select("run_id", "step", "url", "operation", "label", "outcome", "failed", "completed")


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.exclusions(memory.attempts(history(spark, sf_dir)))


def usable_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the labels that a run acted on are its elements; those not excluded stay usable."""
    tried = memory.attempts(history(spark, sf_dir))
    offered = tried.select("run_id", "url", "operation", "label").distinct()
    return memory.usable(offered, memory.exclusions(tried))


def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory.streaks(memory.attempts(history(spark, sf_dir)))
    return rows.select("run_id", "step", F.col("streak").cast("long").alias("streak"), "done")


def blocked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory.blocked(history(spark, sf_dir)).where("blocked")
    return rows.groupBy("run_id").agg(F.min("step").alias("first_step"))


def stalled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First step at which a run was stalled. Adapter: a step with an instruction was planned."""
    rows = memory.stalled(memory.streaks(memory.attempts(history(spark, sf_dir, planned=True)))).where("stalled")
    return rows.groupBy("run_id").agg(F.min("step").alias("first_step"))


def step_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address before every step: that after the step before, or the run's first address."""
    runs = table(spark, sf_dir, "live_runs", "run_id", F.col("url").alias("start"), "steps")
    rows = runs.select("run_id", "start", F.posexplode("steps").alias("step", "s")).where("s is not null")
    before = F.coalesce(F.lag("s.url_after").over(Window.partitionBy("run_id").orderBy("step")), F.col("start"))
    return rows.select("run_id", "step", before.alias("url_before"), F.col("s.url_after").alias("url"))


def budget_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions per run within a budget of sixty."""
    return memory.within_budget(history(spark, sf_dir), 60).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def history_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step's line and all lines before it."""
    rows = history(spark, sf_dir).withColumn("line", cases.history_line(F.coalesce(F.nullif("operation", F.lit("")), F.upper("kind")), F.col("action"), F.col("text")))
    return cases.with_history(rows, "run_id", ["step"], "line").select("run_id", "step", "line", F.array_join("history", "|").alias("history"))


def history_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).withColumn("line", cases.history_line(F.col("operation"), F.col("action"), F.col("text")))
    return cases.with_history(rows, "run_id", ["step"], "line", 3).select("run_id", "step", F.array_join("history", "|").alias("history"))


def parsed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = {"task_row", "actions", "operation", "op", "value", "pos_candidates", "neg_candidates", "tag", "backend_node_id", "attributes"}
    return cases.parsed_steps(nested_table(spark, sf_dir, "tasks", keep))


def case_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps per operation and reason."""
    return parsed_steps(spark, sf_dir).groupBy("op", "drop_reason").agg(F.count(F.lit(1)).alias("n"), F.avg("pool_size").alias("mean_pool"))


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.case_summary(table(spark, sf_dir, "step_cases"))


def step_cases(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Case rows with their task id in one spelling, and ``columns``."""
    return table(spark, sf_dir, "step_cases", X.entity_key(F.col("task_id")).alias("task_id"), *columns)


def _scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the predictor clicks always, and takes for each operation the pool's element with the best recorded score."""
    rows = table(spark, sf_dir, "candidates", X.pool_key(F.col("pool_id")).alias("pool_id"), "id", "ops", "score").where("score is not null and not isnan(score)")
    one = rows.select("pool_id", "id", "score", F.explode("ops").alias("op"))
    best = one.groupBy("pool_id", "op").agg(F.min_by("id", F.struct((-F.col("score")).alias("m"), "id")).alias("id"))
    # a pool that isn't named <task id>:<step> belongs to no case row
    name = r"(?s)^(.*):([0-9]+)$"
    top = best.where(~F.col("pool_id").startswith("live:")).select(F.regexp_extract("pool_id", name, 1).alias("task_id"), F.regexp_extract("pool_id", name, 2).try_cast("int").alias("step"), "op", "id")
    scored = step_cases(spark, sf_dir, "step", "gold_op", "gold_id", "valid_gold", "gold_in_shortlist", "drop_reason")
    return evaluate.outcomes(scored, evaluate.baseline_predictions(top.where("step is not null")))


def micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.micro(_scored_cases(spark, sf_dir))


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro(_scored_cases(spark, sf_dir))


def _wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: what a run's step acted on, looked for among the elements of the page captured at that step."""
    page = table(spark, sf_dir, "page_snapshots", "page_id", "run_id", "step").where("run_id is not null")
    steps = history(spark, sf_dir).select("run_id", (F.col("step") + 1).alias("step"), "operation", "action")
    return page.join(steps, ["run_id", "step"]).select(F.concat(F.lit("live:"), F.col("page_id")).alias("page"), F.col("page_id").alias("want_id"), "operation", F.col("action").alias("target"))


def _page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidates", F.col("pool_id").alias("page"), "id", "label", "ops").where("startswith(page, 'live:')")
    return rows.groupBy("page", "id").agg(F.min("label").alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ops")))).alias("ops")).withColumn("aliases", F.array().cast("array<string>"))


def resolver_exact_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.resolve(_wants(spark, sf_dir), _page_elements(spark, sf_dir))


def router_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of all wants. Adapter: the actor's answer is the decision recorded at that place of the run, the planner picks what it recorded as planner_pick."""
    wants, els = _wants(spark, sf_dir), _page_elements(spark, sf_dir)
    pool = els.select("page", F.explode("ops").alias("operation")).groupBy("page", "operation").agg(F.count(F.lit(1)).alias("n_pool"))
    found = route.resolve(wants, els).select("want_id", F.col("id").alias("resolved"), "how")
    page = table(spark, sf_dir, "page_snapshots", F.col("page_id").alias("want_id"), "run_id", (F.col("step") - 1).alias("place"))
    decided = table(spark, sf_dir, "live_runs", "run_id", "decisions").select("run_id", F.posexplode("decisions").alias("place", "d")).where("d is not null")
    said = page.join(decided, ["run_id", "place"]).select("want_id", F.col("d.target").alias("actor"), F.col("d.confidence").alias("confidence"), F.when(F.col("d.route") == "planner_pick", F.col("d.target")).alias("picked"))
    rows = wants.join(pool, ["page", "operation"], "left").join(found, "want_id", "left").join(said, "want_id", "left")
    r = route.cascade(F.col("n_pool"), F.col("how"), F.col("resolved"), F.col("actor"), F.col("confidence"), F.col("picked"))
    return rows.select("want_id", r.alias("r")).select("want_id", "r.route", "r.id", "r.confidence")


def choice_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: an answer's probabilities are its confidence for the choice and the rest for "other"."""
    rows = table(spark, sf_dir, "live_runs", "run_id", "decisions").select("run_id", F.posexplode("decisions").alias("place", "d")).where("d is not null")
    p = F.create_map(F.coalesce("d.choice", F.lit("")), F.col("d.confidence"), F.lit("other"), F.lit(1.0) - F.col("d.confidence"))
    ok = route.valid_choice(F.col("d.choice"), F.col("d.confidence"), p, F.array(F.col("d.choice"), F.lit("other")))
    return rows.select("run_id", "place", ok.alias("valid"))


def text_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.count_if(route.valid_text(F.col("text"))).alias("valid"))


def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: recorded steps as planned ones. Addresses are never allowed."""
    rows = table(spark, sf_dir, "live_runs", "run_id", "steps").select("run_id", F.posexplode("steps").alias("step", "s")).where("s is not null")
    p = route.plan_step(F.col("s.operation"), F.col("s.action"), F.col("s.text"), F.col("s.instruction"), F.lit(False))
    return rows.select("run_id", "step", p.alias("p")).select("run_id", "step", "p.target", "p.value", "p.instruction", "p.error")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a JSON object, by language; the object runs from the first to the last brace."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text").where(F.contains("text", F.lit("{")))
    return rows.select("doc_id", X.json_object(F.col("text")).isNotNull().alias("is_object"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "url").where("url is not null")
    u = F.col("url")
    return rows.select("doc_id", U.canonical(u).alias("canonical"), U.without_fragment(u).alias("page"), F.lower(U.part(u, "HOST")).alias("host"))


def evidence_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a run's final title as evidence on the page of its final text."""
    rows = table(spark, sf_dir, "live_runs", "run_id", "final_title", "final_text")
    title = F.substring_index(F.col("final_title"), " | ", 1)
    return rows.select("run_id", route.evidence_shown(title, F.col("final_text"), F.lit("")).alias("shown"))


def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page's outline pool that fit 1,600 characters, of 25 at most, by place."""
    rows = table(spark, sf_dir, "candidates", "pool_id", "cand_row", "label").where("label is not null")
    kept = route.within_chars(rows, "pool_id", "cand_row", "label", 1600, 25)
    return kept.groupBy("pool_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.length("label")).alias("chars"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize.run_summary(table(spark, sf_dir, "live_runs"))


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "live_runs", F.coalesce("category", F.lit("")).alias("category"), "success")
    return rows.groupBy("category").agg(F.count_if(F.coalesce("success", F.lit(False))).alias("passed"), F.count(F.lit(1)).alias("n"))


def route_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize.route_counts(table(spark, sf_dir, "live_runs", "category", "decisions"), "category")


def nearest_rank_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of decisions per operation: n, median, and the values at 0.5, 0.9 and 0.99 of the order."""
    rows = table(spark, sf_dir, "live_runs", F.explode("decisions").alias("d")).where("d is not null").select(F.col("d.operation").alias("operation"), F.col("d.latency_ms").alias("ms"))
    return summarize.nearest_rank(rows.where("operation is not null"), "ms", [0.5, 0.9, 0.99], ["operation"])


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the runs of a website and category are repeated runs of one task."""
    return summarize.majority(table(spark, sf_dir, "live_runs", "website", "category", "success").where("website is not null and category is not null"), "website", "category")


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: majorities of odd and even runs of a website as two systems."""
    rows = table(spark, sf_dir, "live_runs", "run_id", "website", "success").where("website is not null")
    odd, even = (summarize.majority(rows.where(F.col("run_id") % 2 == k), "website") for k in (1, 0))
    return summarize.discordant(odd, even, "website", "majority").withColumn("p", F.round("p", 6))


def threshold_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a decision is right if its run succeeded."""
    rows = table(spark, sf_dir, "live_runs", "success", F.explode("decisions").alias("d")).where("d is not null").select(F.col("d.confidence").alias("confidence"), "success")
    return summarize.threshold(rows, "confidence", "success", 0.62)


def frequent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent action labels."""
    return summarize.top_counts(history(spark, sf_dir).select("action"), "action", 8)


def dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sites", "website").select("website", X.md5_mod(F.col("website"), 20).cast("int").alias("bucket"), sample.held_out(F.col("website")).alias("dev"))


def task_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of 25 tasks, whatever the spelling of their ids, which the rows keep."""
    rows = table(spark, sf_dir, "step_cases", "case_id", "task_id").withColumn("_task", X.entity_key(F.col("task_id")))
    return sample.sample_groups(rows, "_task", 25).select("case_id", "task_id")


def row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_rows(table(spark, sf_dir, "step_cases", "case_id", "step"), "case_id", 40)


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.stride(table(spark, sf_dir, "step_cases", "case_id", "step"), "case_id", 100)


def rank_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard 1 of 4."""
    return sample.shard(table(spark, sf_dir, "step_cases", "case_id", "step"), "case_id", 4, 1)


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the first entries of an embedding as logits, as many as its label allows (3 to 10), the label as target."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    n = F.col("label") % 8 + 3
    z = F.transform(F.slice("embedding", F.lit(1), n), lambda x: x.cast("double"))
    y = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i == F.col("label") % n).cast("double"))
    return rows.select("vec_id", F.lit("choice").alias("qtype"), z.alias("logits"), y.alias("target"))


def softmax_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = calibrate.softmax(F.col("logits"), 1.2)
    return _logits(spark, sf_dir).select("vec_id", F.round(F.array_max(p), 9).alias("top"), F.round(F.element_at(p, 1), 9).alias("first"))


def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).withColumn("bucket", calibrate.option_bucket(F.col("qtype"), F.size("logits")))
    return calibrate.fit_temperatures(rows, "bucket", "logits", "target")


def item_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).select("vec_id", calibrate.item_target(F.transform("target", lambda x: x * 3), F.size("logits")).alias("t"))
    return rows.select("vec_id", F.col("t.label").alias("label"), F.element_at("t.target", F.col("t.label") + 1).alias("mass"))


def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(1), F.size("logits")), lambda i: i.cast("int")).alias("ids"))
    return calibrate.batches(rows, "vec_id", 16, "ids").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("ids")).alias("length"), F.sum(F.aggregate("mask", F.lit(0), lambda a, x: a + x)).alias("real"))


def asof_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every purchase the user's latest view at or before it (``events`` as a frame log; an extension)."""
    ev = utc(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value"), "ts")
    left = ev.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    right = ev.where("event_type = 'view'").select("ts", "user_id", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof.asof_join(left, right, "user_id", "ts", ["view_id", "view_value"], "view_id").select("event_id", "user_id", "view_id", "view_value")


QUERIES = {f.__name__: f for f in (
    attempt_outcomes, exclusions, usable_anti, streak, blocked_runs, stalled_runs, step_urls, budget_actions, history_all, history_last3, parsed_steps,
    case_drop_reasons, case_summary, micro_metrics, macro_metrics, resolver_exact_fuzzy, router_cascade, choice_validation, text_validation, plan_validation,
    json_extract, url_canonical, evidence_shown, char_budget, run_summary, category_summary, route_histogram, nearest_rank_p90, majority_vote, mcnemar, threshold_fit,
    frequent_actions, dev_split, task_sample, row_sample, stride_sample, rank_shards, softmax_temperature, temperature_fit, item_targets, padded_batches, asof_frame,
)}
