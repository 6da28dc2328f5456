"""Lexical ranking of a pool's elements against a goal, its variants, and recall.

Only the words that a pool shares with its query are ever exploded, so the term join is small: query words are
a handful per pool, while elements may be millions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import text as X
from pagetrail.keys import skew_join

DEFAULT_K = 20
#: Weights by which unmatched elements are told apart.
ROLE_PRIOR = {"textbox": 1.0, "searchbox": 1.0, "combobox": 1.0, "button": 0.5, "option": 0.5, "tab": 0.5, "checkbox": 0.5, "spinbutton": 0.5, "switch": 0.5}


@dataclass(frozen=True)
class Variant:
    """A ranking recipe; the defaults are the plain sum of inverse document frequencies."""

    name: str
    hints: float = 0.0
    idf: str = "inv"
    norm: str = "none"
    b: float = 0.75
    k1: float = 1.2
    bigram: float = 0.0
    both_forms: bool = False
    light: bool = False
    role_w: float = 0.0
    pos_w: float = 0.0


PRODUCTION = Variant("production", norm="ratio", role_w=0.4, pos_w=0.3)
#: The recipes that the study compares.
VARIANTS = (
    Variant("V0"), Variant("V1 hints", hints=1.0), Variant("V1 hints x0.5", hints=0.5), Variant("V2 bm25 idf", idf="bm25"),
    Variant("V2 bm25 len-norm", norm="bm25", b=1.0), Variant("V2 ratio len-norm", norm="ratio"), Variant("V2 bigram", bigram=1.0),
    Variant("V2 raw+stem", both_forms=True), Variant("V2 light stem", light=True), Variant("V2 role prior", role_w=0.4),
    Variant("V2 position prior", pos_w=0.3), Variant("V3 ratio+role+pos", norm="ratio", role_w=0.4, pos_w=0.3),
    Variant("V3 + bigram", norm="ratio", role_w=0.4, pos_w=0.3, bigram=1.0), Variant("V3 + raw+stem", norm="ratio", role_w=0.4, pos_w=0.3, both_forms=True),
    Variant("V3 + hints", norm="ratio", role_w=0.4, pos_w=0.3, hints=1.0),
)


def role_prior(role: Column) -> Column:
    out = F.lit(0.0)
    for r, w in ROLE_PRIOR.items():
        out = F.when(role == r, w).otherwise(out)
    return out


def page_positions(pool: DataFrame, group: str, order: Column, tie: Column, buckets: int | None = None) -> DataFrame:
    """Adds ``i`` (0-based place in the pool by ``order``, nulls last, then ``tie``) and ``n`` (size of the pool).

    A pool of any size is ordered without sorting it in one task: its range of ``order`` is cut into buckets,
    rows are numbered within a bucket, and the sizes of earlier buckets are added. By default there are 16
    buckets and one more per 100,000 rows of the table.
    """
    cols = pool.columns
    buckets = buckets or 16 + pool.count() // 100_000
    o = pool.withColumn("_o", order.cast("double")).withColumn("_tie", tie)
    span = o.groupBy(group).agg(F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))
    o = skew_join(o, span, group)
    place = F.floor((F.col("_o") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * buckets)
    o = o.withColumn("_b", F.coalesce(place, F.lit(buckets)).cast("int"))
    counts = o.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group)
    offsets = counts.select(
        group, "_b", F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("n")
    )
    within = Window.partitionBy(group, "_b").orderBy(F.col("_o").asc_nulls_last(), F.col("_tie").asc_nulls_last())
    numbered = o.withColumn("_r", F.row_number().over(within)).join(offsets, [group, "_b"])
    return numbered.select(*cols, (F.col("_before") + F.col("_r") - 1).cast("int").alias("i"), F.col("n").cast("long").alias("n"))


def scored(pools: DataFrame, queries: DataFrame, v: Variant = PRODUCTION) -> DataFrame:
    """Adds ``points`` to every row of ``pools``.

    ``pools`` has pool, i, n (see ``page_positions``), label, value, role and, for hint variants, hints;
    ``queries`` one row per pool with goal and history (array). An element's points are the weights of the
    words it shares with the goal and history, normalised by its length, plus priors for its role and place.
    Document frequencies and the mean length are per pool. Pools without a query keep their priors; null texts
    count as empty. Points are rounded to nine places, as sums of the same weights may differ in the last bit.
    """
    text = F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("value", F.lit("")))
    toks = X.tokens(X.ascii_lower(text))
    q_text = F.concat_ws(" ", F.coalesce("goal", F.lit("")), F.coalesce(F.col("history"), F.array().cast("array<string>")))
    parts = F.concat(F.array(F.coalesce("goal", F.lit(""))), F.coalesce(F.col("history"), F.array().cast("array<string>")))
    lines = X.ascii_lower(F.array_join(F.transform(parts, lambda p: F.translate(p, "\n", " ")), "\n"))
    q = queries.withColumn("_qt", X.tokens(X.ascii_lower(q_text))).withColumn("_ql", F.split(lines, "\n") if v.bigram else F.lit(None))
    q = q.select("pool", X.query_words("_qt", v.light, v.both_forms).alias("_q"), *([_query_pairs(F.col("_ql")).alias("_qb")] if v.bigram else []))
    base = pools.withColumn("_t", toks).withColumn("_len", F.size("_t").cast("double"))
    base = base.withColumn("_w", X.words("_t", v.light, v.both_forms))
    if v.hints:
        hint = X.words(X.tokens(X.ascii_lower(F.coalesce("hints", F.lit("")))), v.light, v.both_forms)
        base = base.withColumn("_h", F.array_except(hint, "_w"))
    if v.bigram:
        base = base.withColumn("_lt", X.tokens(X.ascii_lower(F.coalesce("label", F.lit(""))))).withColumn("_g", X.bigrams(F.col("_lt")))
    asked = skew_join(base, q, "pool", "left")
    empty = F.array().cast("array<string>")
    shared = {"w": F.coalesce(F.array_intersect("_w", "_q"), empty)}
    if v.hints:
        shared["h"] = F.coalesce(F.array_intersect("_h", "_q"), empty)
    if v.bigram:
        shared["g"] = F.coalesce(F.array_intersect("_g", "_qb"), empty)
    asked = asked.select(*pools.columns, "_len", *[c.alias(f"_s{k}") for k, c in shared.items()])

    terms = F.array_union("_sw", "_sh") if v.hints else F.col("_sw")
    seen = asked.select("pool", F.explode(F.transform(terms, lambda t: F.concat(F.lit("w:"), t))).alias("t"))
    if v.bigram:
        seen = seen.union(asked.select("pool", F.explode(F.transform("_sg", lambda t: F.concat(F.lit("g:"), t)))))
    df = seen.groupBy("pool", "t").agg(F.count(F.lit(1)).alias("df"))
    per_pool = df.groupBy("pool").agg(F.map_from_entries(F.collect_list(F.struct("t", "df"))).alias("_df"))
    means = asked.groupBy("pool").agg(F.avg("_len").alias("_avg")).join(per_pool, "pool", "left")
    full = skew_join(asked, means, "pool")

    def weight(kind: str, t: Column) -> Column:
        d = F.element_at("_df", F.concat(F.lit(kind + ":"), t)).cast("double")
        return F.lit(1.0) / d if v.idf == "inv" else F.log1p((F.col("n") - d + 0.5) / (d + 0.5))

    def total(shared_terms: str, kind: str) -> Column:
        return F.aggregate(F.array_sort(shared_terms), F.lit(0.0), lambda a, t: a + weight(kind, t))

    lexical = total("_sw", "w")
    if v.hints:
        lexical = lexical + F.lit(v.hints) * total("_sh", "w")
    avg = F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(F.lit(1.0)) if v is not PRODUCTION else F.col("_avg")
    if v.norm == "ratio":
        lexical = lexical * avg / F.greatest(F.col("_len"), F.lit(1.0))
    elif v.norm == "bm25":
        lexical = lexical * (v.k1 + 1.0) / (F.lit(1.0) + v.k1 * (F.lit(1.0 - v.b) + v.b * F.col("_len") / avg))
    if v.bigram:
        lexical = lexical + F.lit(v.bigram) * total("_sg", "g")
    place = F.lit(1.0) - F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    points = lexical + F.lit(v.role_w) * role_prior(F.col("role")) + F.lit(v.pos_w) * place
    return full.select(*pools.columns, F.round(points, 9).alias("points"))


def _query_pairs(lines: Column) -> Column:
    """Bigrams of the goal and of every history line, none across lines."""
    return F.array_distinct(F.flatten(F.transform(lines, lambda p: X.query_bigrams(X.tokens(p)))))


def ranked(points: DataFrame, k: int | None = None) -> DataFrame:
    """Adds the 0-based ``rank`` by points, then place; with ``k`` only ranks below it are kept, cut before the shuffle."""
    w = Window.partitionBy("pool").orderBy(F.desc("points"), "i")
    out = points.withColumn("_rn", F.row_number().over(w))
    return (out.where(F.col("_rn") <= k) if k else out).withColumn("rank", F.col("_rn") - 1).drop("_rn")


def shortlist(points: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The k best of every pool; pools of up to k elements as a whole. ``i`` gives back the page order."""
    return ranked(points, k)


def gold_ranks(points: DataFrame, gold: DataFrame) -> DataFrame:
    """``gold(pool, gold_id, ...)`` with the pool size and the gold element's 0-based rank.

    The rank is the number of elements that beat it, so no pool is sorted.
    """
    aim = points.join(gold, (points["pool"] == gold["pool"]) & (points["id"] == gold["gold_id"])).select(gold["*"], F.col("points").alias("_gp"), F.col("i").alias("_gi"), "n")
    beaten = skew_join(points.select("pool", "points", "i"), aim.select("pool", "_gp", "_gi"), "pool")
    ahead = beaten.groupBy("pool").agg(F.count_if((F.col("points") > F.col("_gp")) | ((F.col("points") == F.col("_gp")) & (F.col("i") < F.col("_gi")))).alias("rank"))
    return aim.drop("_gp", "_gi").join(ahead, "pool")


def recall(ranks: DataFrame, ks: tuple[int, ...] = (20, 30, 40, 60), by: tuple[str, ...] = ()) -> DataFrame:
    """Share of gold elements within the first k, for each k; a pool of up to k elements always counts as a hit."""
    each = ranks.select(*by, F.explode(F.array(*map(F.lit, ks))).alias("k"), "n", "rank")
    hit = ((F.col("n") <= F.col("k")) | (F.col("rank") < F.col("k"))).cast("double")
    return each.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("steps"), F.avg(hit).alias("recall"))
