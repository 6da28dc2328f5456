"""Queries for the remaining operators: requests, views, caps, URL checks, guards, reclaiming and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.functions import text as X
from pagetrail.functions import urls as U
from pagetrail.operators import cases, guards, route, summarize
from pagetrail.operators import html as H
from pagetrail.plans.pools import described, pages
from pagetrail.sources.tables import table, utc
from pagetrail.streaming import memory_stream


def request_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target questions of every pool and operation: how many options they offer (only those with more than one are asked)."""
    rows = table(spark, sf_dir, "candidates", "pool_id", "id", F.explode("ops").alias("op"))
    per = rows.groupBy("pool_id", "op").agg(F.countDistinct("id").alias("options"))
    return per.select("pool_id", F.concat(F.lower("op"), F.lit("_target")).alias("question"), "options").where("options > 1")


def operation_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools that offer more than one operation, with the operations in their fixed order."""
    rows = table(spark, sf_dir, "candidates", "pool_id", F.explode("ops").alias("op")).groupBy("pool_id").agg(F.collect_set("op").alias("s"))
    ops = F.filter(F.array(*map(F.lit, cases.OPERATIONS)), lambda o: F.array_contains("s", o))
    return rows.select("pool_id", F.array_join(ops, ",").alias("ops")).where(F.size(F.split("ops", ",")) > 1)


def gold_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot gold distributions over the operations, as text."""
    rows = table(spark, sf_dir, "step_cases", "case_id", "gold_op").where("gold_op is not null")
    hot = cases.one_hot(F.array(*map(F.lit, cases.OPERATIONS)), F.col("gold_op"))
    return rows.select("case_id", F.array_join(F.transform(hot, lambda x: F.concat(x["id"], F.lit("="), x["p"].cast("int").cast("string"))), ",").alias("gold"))


def element_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactive elements of pages as lines for a planner, with where they are on the page."""
    rows = described(spark, sf_dir).where("interactive and node_id is not null")
    line = route.element_line(F.col("node_id"), F.col("label"), F.col("role"), F.col("ops"), F.col("landmark"), F.col("section"), F.col("row_text"), F.col("value"), F.lit(None).cast("boolean"))
    return rows.select("page_key", "node_id", line.alias("line"))


def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links sit: landmark and section, counted."""
    rows = H.elements(pages(spark, sf_dir)).where("tag = 'a'")
    return rows.select(cases.context_text(F.col("landmark"), F.col("section"), F.col("row_text")).alias("context")).groupBy("context").agg(F.count(F.lit(1)).alias("n"))


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes of a page until 6,000 characters are reached, joined and cut there."""
    return H.visible_texts(pages(spark, sf_dir).select("page_key", "html"), 6000)


def capped_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools capped to 400 rows by place, with the number left out."""
    rows = table(spark, sf_dir, "candidates", "pool_id").groupBy("pool_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("pool_id", F.least("n", F.lit(400)).cast("long").alias("kept"), F.greatest(F.col("n") - 400, F.lit(0)).cast("long").alias("omitted"))


def top_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most confident answers of every decision, the earlier of equals first."""
    rows = table(spark, sf_dir, "live_runs", "run_id", "decisions").select("run_id", F.posexplode("decisions").alias("place", "d")).where("size(d.answers) > 0")
    ps = F.transform(F.filter("d.answers", lambda a: a.isNotNull() & a["confidence"].isNotNull()), lambda a: F.struct(F.coalesce(a["choice"], F.lit("")).alias("id"), a["confidence"].alias("p")))
    top = route.top_probabilities(ps, 2)
    return rows.select("run_id", "place", F.array_join(F.transform(top, lambda x: x["id"]), ",").alias("ids"))


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose final address matches their task's address, and any visited one, by regular expression on host and path."""
    runs = table(spark, sf_dir, "live_runs", "run_id", "url", "final_url", "steps").where("url is not null")
    host = F.replace(F.regexp_replace(F.lower(U.part(F.col("url"), "HOST")), "^www[.]", ""), F.lit("."), F.lit("[.]"))
    visited = F.transform(F.filter(F.coalesce("steps", F.array()), lambda s: s.isNotNull()), lambda s: F.coalesce(s["url_after"], F.lit("")))
    via = F.exists(visited, lambda u: F.regexp(U.canonical(u), F.concat(F.lit("^"), host, F.lit("/."))))
    return runs.select("run_id", F.coalesce(U.matches_url(F.col("final_url"), F.concat(F.lit("^"), host)), F.lit(False)).alias("at_site"), F.coalesce(via, F.lit(False)).alias("via_page"))


def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search addresses for every run's goal by its website's template, and whether they pass the allow-list."""
    runs = table(spark, sf_dir, "live_runs", "run_id", "website", "goal").where("goal is not null")
    templates = table(spark, sf_dir, "sites", "website").select("website", F.concat(F.lit("https://"), "website", F.lit("/s?q={q}")).alias("template"))
    query = F.left(F.trim("goal"), F.lit(80))
    rows = runs.join(F.broadcast(templates), "website").select("run_id", U.search_url(F.col("template"), query).alias("search_url"))
    return rows.withColumn("allowed", route.allowed_goto(F.col("search_url"), templates))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates among candidate values in the forms a page may show them."""
    rows = table(spark, sf_dir, "candidates", "cand_row", "value").where(F.col("value").rlike(r"^\d{4}-\d\d-\d\d$"))
    d = F.try_to_date("value", "yyyy-MM-dd")
    return rows.select("cand_row", F.date_format(d, "MMM d").alias("short"), F.date_format(d, "MMMM d").alias("long"))


def base64_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a label, sent as unpadded base64url, holds a word when decoded."""
    rows = table(spark, sf_dir, "candidates", "cand_row", "label").where("label is not null")
    token = F.regexp_replace(F.translate(F.base64(F.encode("label", "UTF-8")), "+/", "-_"), "=+$", "")
    return rows.select("cand_row", X.base64url_contains(token, "kettle").alias("kettle"))


def control_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run without targets does next: wait, unless it just waited, then scroll down, then give up."""
    from pagetrail.plans.runs import history

    w = Window.partitionBy("run_id").orderBy("step")
    rows = history(spark, sf_dir).withColumn("before", F.lag("operation").over(w))
    rule = F.when(F.coalesce("before", F.lit("")) == "SCROLL_DOWN", "BLOCKED").when(F.coalesce("before", F.lit("")) == "WAIT", "SCROLL_DOWN").otherwise("WAIT")
    return rows.select("run_id", "step", rule.alias("control"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of runs: done only if a verdict says so and gives a reason, which is cut to 300 characters."""
    rows = table(spark, sf_dir, "live_runs", "run_id", F.posexplode("verdicts").alias("place", "v")).where("v is not null")
    ok = F.coalesce(F.col("v.done"), F.lit(False)) & F.coalesce(F.trim("v.reason") != "", F.lit(False))
    return rows.select("run_id", "place", ok.alias("done"), F.left(F.coalesce("v.reason", F.lit("")), F.lit(300)).alias("reason"))


def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and time per method; ``events`` stand in for the call log."""
    return table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("ms"))


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs per category and status, statuses as columns."""
    rows = table(spark, sf_dir, "live_runs", F.coalesce("category", F.lit("")).alias("category"), "status")
    return rows.groupBy("category").pivot("status", ["done", "blocked", "error"]).agg(F.count(F.lit(1))).na.fill(0)


def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of odd and even runs side by side; a side without the task is null."""
    rows = table(spark, sf_dir, "live_runs", "run_id", "website", "success").where("website is not null")
    odd, even = (summarize.majority(rows.where(F.col("run_id") % 2 == k), "website").select("website", F.col("majority").alias(n)) for k, n in ((1, "odd"), (0, "even")))
    return odd.join(even, "website", "full_outer")


def reclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where clicks on text nodes land: kind and distance to the nearest interactive element, counted (distances from 5 up as one)."""
    rows = described(spark, sf_dir)
    found = H.nearest_interactive(rows.select("page_key", "pos", "depth", "subtree_end", "interactive"), rows.where("tag = 'text'"))
    return found.groupBy("kind", F.least("distance", F.lit(5)).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def pool_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of interactive elements by the HTML parser that aren't among a page's interactive raw candidates, and the other way round; distinct pairs."""
    ours = described(spark, sf_dir).where("interactive and node_id is not null").select("page_key", F.col("node_id").alias("id"))
    tasks = table(spark, sf_dir, "tasks", "task_row", "actions").select("task_row", F.posexplode("actions").alias("step", "a"))
    both = F.concat(F.coalesce("a.pos_candidates", F.array()), F.coalesce("a.neg_candidates", F.array()))
    theirs = tasks.select(F.concat_ws(":", "task_row", "step").alias("page_key"), F.explode(both).alias("c"))
    theirs = theirs.where(H.is_interactive(F.col("c.tag"), F.from_json("c.attributes", "map<string,string>"))).select("page_key", F.col("c.backend_node_id").alias("id"))
    # one pass over both sides; subtracting each from the other would parse every page twice
    sides = ours.withColumn("side", F.lit("page")).unionByName(theirs.withColumn("side", F.lit("candidates")))
    only = sides.groupBy("page_key", "id").agg(F.min("side").alias("side"), F.max("side").alias("_other")).where("side = _other")
    return only.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def fresh_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that were made again unchanged: pages per fingerprint of url, text, outline and scroll, more than one."""
    rows = table(spark, sf_dir, "page_snapshots", "page_id", "page")
    names = ["url", "text", "outline", "scroll"]
    mark = guards.fingerprint(*[F.col(f"page.{n}") for n in names], names=names)
    per = rows.where("page is not null").groupBy(mark.alias("mark")).agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
    return per.where("n > 1").select("first_page", "n")


def reused_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typing steps whose text was typed before in the same context (goal, action and address), by run."""
    runs = table(spark, sf_dir, "live_runs", "run_id", "goal", "steps").select("run_id", "goal", F.posexplode("steps").alias("step", "s")).where("s.operation = 'TYPE_TEXT'")
    rows = runs.select("run_id", "step", "goal", F.col("s.action").alias("action"), F.col("s.url_before").alias("url"), F.col("s.text").alias("text")).where("text is not null")
    first = rows.groupBy("goal", "action", "url").agg(F.min_by("text", F.struct("run_id", "step")).alias("memo"))
    again = guards.reused(rows.select("run_id", "step", "goal", "action", "url"), first, ["goal", "action", "url"], "memo")
    return again.select("run_id", "step", "memo")


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner sees of a page: title, outline up to 400 and text up to 600 characters."""
    rows = table(spark, sf_dir, "page_snapshots", "page_id", "page")
    p = {n: F.coalesce(F.col(f"page.{n}"), F.lit("")) for n in ("title", "outline", "text")}
    return rows.select("page_id", p["title"].alias("title"), F.left(p["outline"], F.lit(400)).alias("outline"), F.left(p["text"], F.lit(600)).alias("visible_text"))


def label_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs in labels, stop words left out, by the number of labels."""
    rows = table(spark, sf_dir, "candidates", "label").where("label is not null").select(X.tokens(X.ascii_lower(F.col("label"))).alias("t"))
    return rows.select(F.explode(X.query_bigrams(F.col("t"))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def light_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light stems of goal words and how many words share them."""
    rows = table(spark, sf_dir, "tasks", "confirmed_task").where("confirmed_task is not null").select(X.tokens(X.ascii_lower(F.col("confirmed_task"))).alias("t"))
    words = rows.select(F.explode("t").alias("w")).distinct()
    return words.groupBy(X.stem_light(F.col("w")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, as the streaming view counts them (an extension)."""
    counts = memory_stream.event_counts(table(spark, sf_dir, "events", "ts", "event_type"))
    return counts.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with at most 30 minutes between events (an extension)."""
    s = memory_stream.user_sessions(utc(table(spark, sf_dir, "events", "ts", "user_id"), "ts"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (
    request_options, operation_question, gold_distribution, element_lines, context_texts, visible_text, capped_actions, top_answers, url_checks, search_urls, date_forms,
    base64_tokens, control_rule, verdicts, call_stats, status_pivot, paired_runs, reclaimed, pool_crosscheck, fresh_pages, reused_texts, page_views, label_bigrams, light_stems,
    event_windows, event_sessions,
)}
