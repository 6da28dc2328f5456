"""Queries over element pools: parsing pages, merging links, ranking, shortlists and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.functions import text as X
from pagetrail.functions import urls as U
from pagetrail.operators import html as H
from pagetrail.operators import rank as R
from pagetrail.session import cut
from pagetrail.sources.tables import nested_table, table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_key, task_row, step, html): the page of every action."""
    tasks = nested_table(spark, sf_dir, "tasks", {"task_row", "actions", "cleaned_html"})
    shown = tasks.select("task_row", F.posexplode("actions.cleaned_html").alias("step", "html")).where("html is not null and html <> ''")
    return shown.select(F.concat_ws(":", "task_row", "step").alias("page_key"), "task_row", "step", "html")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.described(H.elements(pages(spark, sf_dir).select("page_key", "html")))


def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.elements(pages(spark, sf_dir)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def interactive_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactive elements of every page with role, operations, label and value."""
    rows = described(spark, sf_dir).where("interactive and node_id is not null")
    return rows.select("page_key", "node_id", "tag", "role", F.array_join("ops", ",").alias("ops"), "label", "value")


def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading texts per page, joined in page order."""
    rows = H.elements(pages(spark, sf_dir)).where(F.col("tag").isin("h1", "h2", "h3") & (F.col("text") != ""))
    listed = rows.groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("h"))
    return listed.select("page_key", F.left(F.array_join(F.transform("h", lambda x: x["text"]), " | "), F.lit(1000)).alias("outline"))


def section_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per section heading above them."""
    return H.elements(pages(spark, sf_dir)).where("tag = 'a'").groupBy("section").agg(F.count(F.lit(1)).alias("links"))


def link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page to one address: the first label, and the other labels in page order as aliases.

    Only http(s) addresses that don't end in "#" merge; every other link stays a row of its own. Addresses from
    the root of a site are completed by the website that the page is from.
    """
    links = described(spark, sf_dir).where("tag = 'a'").select("page_key", "pos", "label", F.element_at("attrs", "href").alias("link")).where("link is not null")
    sites = table(spark, sf_dir, "tasks", F.col("task_row").cast("string").alias("task"), "website")
    links = links.withColumn("task", F.substring_index("page_key", ":", 1)).join(sites, "task", "left")
    here = F.when(F.col("link").startswith("/") & (F.col("website") != ""), F.concat(F.lit("https://"), "website", "link"))
    links = links.withColumn("href", F.coalesce(here, F.col("link")))
    own = F.when(~U.merges(F.col("href")), F.col("pos")).otherwise(F.lit(-1))
    grouped = links.groupBy("page_key", "href", own.alias("own"))
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("l"), F.count(F.lit(1)).alias("n"))
    labels = F.transform("l", lambda x: x["label"])
    first = F.element_at(labels, 1)
    aliases = F.array_except(F.filter(F.array_distinct(labels), lambda x: x != ""), F.array(first))
    return listed.select("page_key", "href", first.alias("label"), F.array_join(aliases, "|").alias("aliases"), "n")


def detour_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that runs visited, and how many of them are detours for their goal."""
    runs = table(spark, sf_dir, "live_runs", "website", "goal", "final_url").where("final_url is not null")
    return runs.groupBy("website").agg(F.count(F.lit(1)).alias("n"), F.count_if(U.is_detour(F.col("final_url"), F.col("goal"))).alias("detours"))


def elements_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a pool that are the same element become one, with its operations in order and how often it came."""
    rows = table(spark, sf_dir, "candidates", "pool_id", "id", "ops", "cand_row", "captured_at")
    ops = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("ops", F.array().cast("array<string>"))))))
    return rows.groupBy("pool_id", "id").agg(F.min("cand_row").alias("first_row"), F.count(F.lit(1)).alias("n"), F.array_join(ops, ",").alias("ops"))


def latest_pool(spark: SparkSession, sf_dir: str, keyed: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """The last row of every element of a pool, in page order: (pool, id, label, value, role, ops, hints, i, n).

    With ``wanted(pool, gold_op)`` only the elements of these pools that allow the operation are kept, and their
    places and number are those within the operation's pool.

    With ``keyed``, pools are named by ``pool_key``, and those that differ in the spelling of their task id only are one.
    """
    rows = table(spark, sf_dir, "candidates", "pool_id", "id", "label", "value", "role", "ops", "hints", "doc_order", "captured_at", "cand_row")
    if keyed:
        rows = rows.withColumn("pool_id", X.pool_key(F.col("pool_id")))
    w = Window.partitionBy("pool_id", "id").orderBy(F.col("captured_at").desc_nulls_last(), F.desc("cand_row"))
    last = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumnRenamed("pool_id", "pool")
    if wanted is not None:
        last = last.join(wanted.select("pool", "gold_op"), "pool").where(F.array_contains("ops", F.col("gold_op")))
    placed = R.page_positions(last.select("pool", "id", "label", "value", "role", "ops", "hints", "doc_order"), "pool", F.col("doc_order"), F.col("id"))
    return placed.drop("doc_order")


def task_queries(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """One goal per pool of a task's step: (pool, goal, history); with ``keyed``, pools are named by ``pool_key``."""
    tasks = table(spark, sf_dir, "tasks", "task_row", "annotation_id", "confirmed_task", F.size("actions").alias("n"))
    if keyed:
        tasks = tasks.withColumn("annotation_id", X.entity_key(F.col("annotation_id")))
    first = tasks.groupBy("annotation_id").agg(F.min_by(F.struct("confirmed_task", "n"), "task_row").alias("t")).where("t.n > 0")
    steps = first.select("annotation_id", F.col("t.confirmed_task").alias("goal"), F.explode(F.sequence(F.lit(0), F.col("t.n") - 1)).alias("step"))
    return steps.select(F.concat_ws(":", "annotation_id", "step").alias("pool"), "goal", F.array().cast("array<string>").alias("history"))


def live_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One goal per pool of a captured page, that of its run."""
    page = table(spark, sf_dir, "page_snapshots", "page_id", "run_id")
    runs = table(spark, sf_dir, "live_runs", "run_id", "goal")
    joined = page.join(runs, "run_id")
    return joined.select(F.concat(F.lit("live:"), F.col("page_id")).alias("pool"), "goal", F.array().cast("array<string>").alias("history"))


def _queries(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    return task_queries(spark, sf_dir, keyed).unionByName(live_queries(spark, sf_dir))


def scored_pools(spark: SparkSession, sf_dir: str, variant: R.Variant = R.PRODUCTION) -> DataFrame:
    return R.scored(latest_pool(spark, sf_dir), _queries(spark, sf_dir), variant)


def shortlist_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortlist of every pool, with page place and rank."""
    return R.shortlist(scored_pools(spark, sf_dir)).select("pool", "id", "i", "rank", F.round("points", 6).alias("points"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold element per step: (pool, gold_id, gold_op, dev), one per pool as named by ``pool_key``; dev by the website's hash."""
    cases = table(spark, sf_dir, "step_cases", "case_id", "task_id", "step", "website", "gold_op", "gold_id", "valid_gold")
    cases = cases.where("valid_gold and task_id is not null and gold_id is not null")
    cases = cases.withColumn("task", X.entity_key(F.col("task_id"))).where("task is not null")
    one = cases.withColumn("pool", F.concat_ws(":", "task", "step")).groupBy("pool").agg(F.min_by(F.struct("gold_id", "gold_op", "website"), "case_id").alias("g"))
    return one.select("pool", "g.gold_id", "g.gold_op", (X.md5_mod(F.col("g.website"), 20) == 0).alias("dev"))


def _gold_pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pools of the gold elements' operations, with their queries and gold: only these are ranked; they are read, reduced and placed once."""
    gold = cut(_gold(spark, sf_dir).where("gold_op is not null"))
    pool = cut(latest_pool(spark, sf_dir, keyed=True, wanted=gold))
    queries = cut(_queries(spark, sf_dir, keyed=True).join(gold.select("pool"), "pool", "left_semi"))
    return pool, queries, gold


def recall_at_k(spark: SparkSession, sf_dir: str, variant: R.Variant = R.PRODUCTION) -> DataFrame:
    """Recall at 20, 30, 40 and 60 by split and scope (all steps, clicks only), each step ranked within its operation's pool."""
    pool, queries, gold = _gold_pools(spark, sf_dir)
    ranks = R.gold_ranks(R.scored(pool, queries, variant), gold)
    scoped = ranks.withColumn("scope", F.explode(F.when(F.col("gold_op") == "CLICK", F.array(F.lit("all"), F.lit("click"))).otherwise(F.array(F.lit("all")))))
    return R.recall(scoped, by=("dev", "scope"))


def variant_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of every ranking recipe over all pools."""
    pool, queries, gold = _gold_pools(spark, sf_dir)
    out = None
    for v in R.VARIANTS:
        one = R.recall(R.gold_ranks(R.scored(pool, queries, v), gold)).select(F.lit(v.name).alias("variant"), "k", "steps", "recall")
        out = one if out is None else out.unionByName(one)
    return out


def role_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per role: elements, gold elements and their rate, over pools that have a gold element."""
    pool = latest_pool(spark, sf_dir, keyed=True).select("pool", "id", "role")
    gold = _gold(spark, sf_dir).where("not dev").select("pool", "gold_id")
    joined = pool.join(gold, "pool")
    per = joined.groupBy("role").agg(F.count(F.lit(1)).alias("n_pool"), F.count_if(F.col("id") == F.col("gold_id")).alias("n_gold"))
    return per.withColumn("rate", X.rounded_rate(F.col("n_gold"), F.col("n_pool")))


def pool_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every label word per pool."""
    pool = latest_pool(spark, sf_dir)
    w = X.words(X.tokens(X.ascii_lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("value", F.lit(""))))))
    return pool.select("pool", F.explode(w).alias("term")).groupBy("pool", "term").agg(F.count(F.lit(1)).alias("df"))


def pool_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of tokens of a pool's elements, repeats counted."""
    t = X.tokens(X.ascii_lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("value", F.lit("")))))
    return latest_pool(spark, sf_dir).groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size(t)), 9).alias("avg_length"))


def option_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as option texts: label (role, =value)."""
    from pagetrail.operators.cases import option_text

    rows = table(spark, sf_dir, "candidates", "cand_row", "label", "role", "value")
    return rows.select("cand_row", option_text(F.col("label"), F.col("role"), F.col("value")).alias("option"))


def option_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option texts taken apart again: how many come back with their role."""
    from pagetrail.operators.cases import option_text, parsed_option

    rows = table(spark, sf_dir, "candidates", "label", "role", "value")
    back = rows.select("role", parsed_option(option_text(F.col("label"), F.col("role"), F.col("value"))).alias("o"))
    return back.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o.role") == F.col("role")).alias("same_role"))


#: The attributes that a hint is made of, in the reference's order, and the characters taken of each.
HINT_FIELDS = ("id", "name", "class", "title", "alt", "placeholder", "aria_label")
MAX_HINT = 300


def hint_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier pieces in the hint attributes of all raw candidates, positive and negative, with their counts."""
    tasks = nested_table(spark, sf_dir, "tasks", {"task_row", "actions", "pos_candidates", "neg_candidates", "attributes"})
    none = F.array().cast(tasks.schema["actions"].dataType.elementType["neg_candidates"].dataType)
    both = F.transform("actions", lambda a: F.concat(F.coalesce(a["pos_candidates"], none), F.coalesce(a["neg_candidates"], none)))
    raw = tasks.select(F.explode(F.flatten(F.filter(both, lambda x: x.isNotNull()))).alias("c")).select(F.from_json("c.attributes", "map<string,string>").alias("a"))
    hints = F.concat_ws(" ", *[X.split_identifier(F.left(F.element_at("a", f), F.lit(MAX_HINT))) for f in HINT_FIELDS])
    return raw.select(F.explode(F.split(hints, " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    html_tag_counts, interactive_elements, page_outline, section_heading, link_merge, detour_filter, elements_grouped, shortlist_top20, recall_at_k,
    variant_sweep, role_lift, pool_terms, pool_lengths, option_render, option_parse, hint_words,
)}
