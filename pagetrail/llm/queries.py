"""Queries of the training-data operators over the project's tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.llm import groupsplit, mixing, overlap, packing, quality, residue, tokens, topn, truncation
from pagetrail.session import cut
from pagetrail.sources.tables import nested_table, table

CAPACITY = 512


def _top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidates", "pool_id", "id", "score", "doc_order", "captured_at", "cand_row")
    return topn.top_n_per_group(rows, "pool_id", "id", "score", ["doc_order", "id"], ["captured_at", "cand_row"], 5)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best elements of every pool."""
    return _top5(spark, sf_dir).select("pool_id", "id")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with score and rank."""
    return _top5(spark, sf_dir)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts of runs and pages as (src, rec_id, field, website, text)."""
    runs = table(spark, sf_dir, "live_runs", "run_id", "website", "final_text", "final_title")
    pages = table(spark, sf_dir, "page_snapshots").select("page_id", "website", "page.text")
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("final_text", "final_title")]))
    of_runs = runs.select(F.lit("live_runs").alias("src"), F.col("run_id").alias("rec_id"), "website", pairs)
    of_pages = pages.select(F.lit("page_snapshots").alias("src"), F.col("page_id").alias("rec_id"), "website", F.lit("page_text").alias("field"), "text")
    return of_runs.unionByName(of_pages)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with placeholders, filler, error messages or demands to allow scripts."""
    return residue.residue(_texts(spark, sf_dir)).select("src", "rec_id", "field")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases per source, field and kind."""
    return residue.residue(_texts(spark, sf_dir)).groupBy("src", "field", "kind").agg(F.count(F.lit(1)).alias("n"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields fit for further use: not null or blank and no case."""
    texts = _texts(spark, sf_dir).where(F.col("text").rlike(r"(?U)\S"))
    keys = ["src", "rec_id", "field"]
    return texts.join(residue.residue(texts).select(*keys), keys, "left_anti").select(*keys, "text")


FIELDS = ("label", "hints", "value")


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "candidates", "cand_row", "source", *FIELDS), "cand_row", "source", FIELDS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened fields."""
    return _cuts(spark, sf_dir).where("cut").select(F.col("key").alias("cand_row"), "field")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and field: texts, shortened ones and their share."""
    per = _cuts(spark, sf_dir).groupBy("source", "field").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"))
    return per.withColumn("share", F.try_divide("n_cut", "n_texts"))


def p3_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storage limits that the lengths expose."""
    rows = table(spark, sf_dir, "candidates", "source", *FIELDS)
    long = rows.select("source", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])))
    long = long.where(F.col("text").rlike(r"(?U)\S")).select("source", "field", *[c.alias(e) for e, c in truncation.encoded_lengths(F.col("text")).items()])
    return truncation.storage_limits(long).select("source", "field", "encoding", "limit")


def _overlaps(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per field the links between classes of rows, and which rows they hold."""
    tasks = spark.read.parquet(f"{sf_dir}/tasks.parquet")
    train = (F.col("split") == "train").alias("train")
    goals = tasks.select(F.col("task_row").alias("row_id"), train, F.col("confirmed_task").alias("text"))
    shown = nested_table(spark, sf_dir, "tasks", {"task_row", "split", "actions", "cleaned_html"})
    pages = shown.select(F.col("task_row").alias("row_id"), train, F.col("actions.cleaned_html").alias("pages"))
    return {"confirmed_task": overlap.request_links(goals), "cleaned_html": overlap.page_links(pages)}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training row and another row with the same request or page."""
    found = [overlap.expand(*classes).select(F.lit(field).alias("field"), "row_a", "row_b") for field, classes in _overlaps(spark, sf_dir).items()]
    return found[0].unionByName(found[1])


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and website: pairs, and evaluation rows that have any; counted by classes."""
    tasks = table(spark, sf_dir, "tasks", "task_row", "split", "website")
    per = [overlap.counts(*classes).select(F.lit(field).alias("field"), F.col("row_id").alias("task_row"), "n") for field, classes in _overlaps(spark, sf_dir).items()]
    return per[0].unionByName(per[1]).join(tasks, "task_row").groupBy("field", "split", "website").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_rows"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "step_cases", "case_id", "task_id", "rerun_of")
    names = [groupsplit.entity_key(F.col(c)) for c in ("task_id", "rerun_of")]
    return groupsplit.connected_records(rows, "case_id", names)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that isn't the first of its group, with the first."""
    return _members(spark, sf_dir).where("record <> first").select(F.col("first").alias("first_case_id"), F.col("record").alias("case_id"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row."""
    split = groupsplit.assign_splits(_members(spark, sf_dir), "first", table(spark, sf_dir, "split_targets"))
    return split.select(F.col("record").alias("case_id"), "split")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and shares per split."""
    split = groupsplit.assign_splits(_members(spark, sf_dir), "first", table(spark, sf_dir, "split_targets"))
    per = split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("record") == F.col("first")).alias("n_groups"))
    # one row per split, so the window over all of them is small
    return per.withColumn("share", F.try_divide("n_rows", F.sum("n_rows").over(Window.partitionBy(F.lit(1)))))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, "doc_id", tokens.token_count(F.col("text")), CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be divided."""
    return _packed(spark, sf_dir).where("parts > 1 and part = 0").select("doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document or part of one."""
    return _packed(spark, sf_dir)


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the packing per document: its parts, their tokens together, and the fullest of its containers within the capacity."""
    packed = _packed(spark, sf_dir)
    used = packed.groupBy("container").agg(F.sum("size").alias("used"))
    per = packed.join(used, "container").groupBy("doc_id")
    return per.agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("tokens"), F.bool_and(F.col("used") <= CAPACITY).alias("fits"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(_packed(spark, sf_dir), CAPACITY)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and weight of every document, read and counted once."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return cut(docs.select("doc_id", "source", tokens.token_count(F.col("text")).alias("size"), mixing.quality_weight(F.col("text")).alias("weight")))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The mixture, and the report on the shares reached."""
    docs, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    mixed = mixing.mix(docs, targets, "doc_id", "source", "size", "weight", compensate=True)
    return mixed, mixing.shares_reached(mixed, docs, targets, "source", "size")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their share at the size of all tokens: those that the mix uses to less than they are due, checked exactly."""
    report = _mixed(spark, sf_dir)[1]
    return report.where((F.col("used") < F.col("budget")) & F.col("short")).select("source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares actually reached."""
    return _mixed(spark, sf_dir)[1].drop("budget")


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the mixture per source: no document above max_repeats, no source without one; documents used and whether all of a short source is."""
    mixed, report = _mixed(spark, sf_dir)
    most = mixed.groupBy("source").agg(F.max("repeats").alias("most"), F.count(F.lit(1)).alias("n"))
    each = report.join(most, "source", "left")
    return each.select(
        "source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"),
        F.when(F.col("short"), F.col("used")).alias("used_of_short"), F.when(F.col("short"), F.coalesce("n", F.lit(0))).alias("documents_of_short"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "doc_labels"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return _judged(spark, sf_dir).where("kind <> 'prose'").select("doc_id")


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of every document and what it is."""
    return _judged(spark, sf_dir)


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five basic statistics of every document."""
    docs = quality.statistics(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return docs.select("doc_id", "word_count", "mean_word_length", "symbol_share", "punct_line_share", "common_share")


QUERIES = {
    "p1_found": p1_found, "p1_ranked": p1_ranked,
    "p2_found": p2_found, "p2_kinds": p2_kinds, "p2_clean": p2_clean,
    "p3_found": p3_found, "p3_shares": p3_shares, "p3_limits": p3_limits,
    "p5_found": p5_found, "p5_counts": p5_counts,
    "p6_found": p6_found, "p6_splits": p6_splits, "p6_shares": p6_shares,
    "p7_found": p7_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_documents": p7_documents,
    "p8_found": p8_found, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_limits": p8_limits,
    "p9_found": p9_found, "p9_kinds": p9_kinds, "p9_statistics": p9_statistics,
}

_TOP5 = """
SELECT {columns} FROM (
  SELECT pool_id, id, score, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC, doc_order ASC NULLS LAST, id ASC NULLS LAST) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY pool_id, id ORDER BY captured_at DESC NULLS LAST, cand_row DESC) AS n FROM candidates)
  WHERE n = 1 AND score IS NOT NULL AND NOT isnan(score))
WHERE rank <= 5"""

_SIZE = f"coalesce(len(regexp_extract_all(text, '{tokens.TOKEN}')), 0)"
_KEY = r"lower(regexp_replace(source, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'))"
_HEX = "coalesce(nullif(regexp_replace(regexp_extract({c}, '[0-9a-f]([-_ ]?[0-9a-f]){{31}}'), '[-_ ]', '', 'g'), ''), nullif(trim({c}), ''))"

_SPACE = tokens.SPACE
_WORDS = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)

SQL = {
    "p1_found": _TOP5.format(columns="pool_id, id"),
    "p1_ranked": _TOP5.format(columns="pool_id, id, score, CAST(rank AS INT) AS rank"),
    "p6_found": f"""
WITH RECURSIVE n AS (SELECT case_id, {_HEX.format(c="lower(task_id)")} AS a, {_HEX.format(c="lower(rerun_of)")} AS b FROM step_cases),
e AS (SELECT DISTINCT a, b FROM n WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT DISTINCT b, a FROM n WHERE a IS NOT NULL AND b IS NOT NULL),
r(x, y) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
root AS (SELECT x, min(y) AS root FROM r GROUP BY x),
m AS (SELECT case_id, coalesce(root, coalesce(a, b), 'row ' || case_id) AS root FROM n LEFT JOIN root ON x = coalesce(a, b)),
f AS (SELECT case_id, min(case_id) OVER (PARTITION BY root) AS first_case_id FROM m)
SELECT first_case_id, case_id FROM f WHERE case_id <> first_case_id""",
    "p7_found": f"SELECT doc_id FROM documents WHERE {_SIZE} > 512",
    "p7_documents": f"""
SELECT doc_id, CAST(ceil({_SIZE} / 512.0) AS BIGINT) AS parts, CAST({_SIZE} AS BIGINT) AS tokens, true AS fits FROM documents WHERE {_SIZE} > 0""",
    "p8_limits": f"""
WITH h AS (SELECT {_KEY} AS k, sum({_SIZE}) AS tokens, count(*) FILTER (WHERE {_SIZE} > 0) AS docs FROM documents GROUP BY 1),
t AS (SELECT m.source, target_share, max_repeats, coalesce(tokens, 0) AS tokens, coalesce(docs, 0) AS docs FROM mix_targets m LEFT JOIN h ON h.k = {_KEY.replace("source", "m.source")}),
s AS (SELECT *, target_share * (SELECT sum(tokens) FROM t) > max_repeats * tokens AS short FROM t)
SELECT source, true AS repeats_kept, CAST(CASE WHEN short THEN max_repeats * tokens END AS BIGINT) AS used_of_short,
  CASE WHEN short THEN docs END AS documents_of_short FROM s""",
    "p8_found": f"""
WITH h AS (SELECT {_KEY} AS k, sum({_SIZE}) AS tokens FROM documents GROUP BY 1),
t AS (SELECT m.source, target_share, max_repeats, coalesce(tokens, 0) AS tokens FROM mix_targets m LEFT JOIN h ON h.k = {_KEY.replace("source", "m.source")})
SELECT source FROM t WHERE target_share * (SELECT sum(tokens) FROM t) > max_repeats * tokens""",
    "p9_statistics": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+(?:[''’][\\p{{L}}]+)?') AS ws,
      list_filter(string_split_regex(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls,
      length(regexp_replace(t, '[\\x09-\\x0d\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '', 'g')) AS v FROM d)
SELECT doc_id, CAST(len(ws) AS DOUBLE) AS word_count,
  coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS DOUBLE) / nullif(len(ws), 0), 0.0) AS mean_word_length,
  coalesce(CAST(length(t) - length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\t\\n\\x0b\\f\\r ]+', '', 'g')) AS DOUBLE) / nullif(v, 0), 0.0) AS symbol_share,
  coalesce(CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…:;。！？]["''”’»)\\]]*\\s*$'))) AS DOUBLE) / nullif(len(ls), 0), 0.0) AS punct_line_share,
  coalesce(CAST(len(list_filter(ws, lambda x: lower(x) IN ({_WORDS}))) AS DOUBLE) / nullif(len(ws), 0), 0.0) AS common_share
FROM w""",
}
