"""Per-document text statistics and a learned rule list that tells prose from lists, tables and junk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common function words of two letters or more of English, German, French and Spanish.
COMMON = {
    "en": "the of and to in is that it for on with as was be by this are at from or an which but not you have if when so because while until one we who had their there will can what all",
    "de": "der die das und in zu den ist mit von nicht es ein eine auf für im dem sich auch als an nach wie aus bei oder war wir sie wird dass aber vor einen einem denn doch wer",
    "fr": "le la les de des et en un une du dans que qui pour pas sur plus au avec ce il est ne se par nous vous mais ou donc car si cette aux",
    "es": "el los las que del con para por una su como al se lo más pero sin sobre este esta hay ha si no todos pues aunque",
}
COMMON_WORDS = sorted({w for words in COMMON.values() for w in words.split()})

KINDS = ("junk", "table", "list")
#: Feature columns the rules may use.
FEATURES = (
    "word_count", "mean_word_length", "symbol_share", "punct_line_share", "common_share", "digit_share", "capital_share",
    "distinct_share", "bullet_line_share", "delimiter_line_share", "words_per_line", "odd_share", "longest_run",
)


def statistics(df: DataFrame, doc: str, text: str, only: Sequence[str] = FEATURES) -> DataFrame:
    """``(doc, blank, *only)`` for every row, all native expressions over the whole text.

    Words are runs of letters, digits, underscores and inner apostrophes. Shares are of visible characters
    (symbol, digit, odd), of non-blank lines (punct, bullet, delimiter) or of words (common, capital,
    distinct); a share of nothing is 0. ``odd`` characters are control and replacement characters and the
    marks of wrongly decoded text. Null and blank text has ``blank`` true and 0 everywhere; texts of any
    length, repeated rows and extra columns are fine.
    """
    base = df.select(F.col(doc), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    blank = ~F.col("_t").rlike(r"(?U)\S")
    words = F.regexp_extract_all("_t", F.lit(r"[\p{L}\p{M}\p{N}_]+(?:['’][\p{L}]+)?"), 0)
    lines = F.filter(F.split("_t", r"\R"), lambda x: x.rlike(r"(?U)\S"))
    seen = base.select(doc, "_t", blank.alias("blank"), words.alias("_w"), lines.alias("_l"), F.length(F.regexp_replace("_t", r"(?U)\s+", "")).alias("_v"))
    nw, nl = F.size("_w"), F.size("_l")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    def chars(pattern: str) -> Column:
        return F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))

    def lines_like(pattern: str) -> Column:
        return share(F.size(F.filter("_l", lambda x: x.rlike(pattern))), nl)

    folded = F.transform("_w", F.lower)
    length = F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    longest = F.aggregate(F.split("_t", r"(?U)\s+"), F.lit(0), lambda a, w: F.greatest(a, F.length(w)))
    out = [
        nw.cast("double").alias("word_count"),
        share(length, nw).alias("mean_word_length"),
        share(chars(r"[^\p{L}\p{N}\p{M}\s]+"), F.col("_v")).alias("symbol_share"),
        lines_like(r"[.!?…:;。！？][\"'”’»)\]]*\s*$").alias("punct_line_share"),
        share(F.size(F.filter(folded, lambda w: w.isin(COMMON_WORDS))), nw).alias("common_share"),
        share(chars(r"\p{N}+"), F.col("_v")).alias("digit_share"),
        share(F.size(F.filter("_w", lambda w: F.left(w, F.lit(1)) != F.lower(F.left(w, F.lit(1))))), nw).alias("capital_share"),
        share(F.size(F.array_distinct(folded)), nw).alias("distinct_share"),
        lines_like(r"^\s*(?:[-*•>+·–]|\(?\d{1,4}[.)])\s").alias("bullet_line_share"),
        lines_like(r"[|;\t]|,\S*,|\S {3,}\S|^[^.:]{1,40}: ").alias("delimiter_line_share"),
        share(nw, nl).alias("words_per_line"),
        share(chars(r"[\x00-\x08\x0e-\x1b�﻿ÃÂâ€œ™¤¶]+"), F.col("_v")).alias("odd_share"),
        longest.cast("double").alias("longest_run"),
    ]
    kept = [c for c, name in zip(out, FEATURES, strict=True) if name in only]
    # by way of a generator each statistic is evaluated once: a filter on it isn't pushed below and repeated
    return seen.select(doc, F.inline(F.array(F.struct("blank", *kept))))


@dataclass(frozen=True)
class Rule:
    """If all ``conditions`` (feature, ``<=`` or ``>``, threshold) hold, the text is of ``kind``."""

    conditions: tuple[tuple[str, str, float], ...]
    kind: str

    def sql(self) -> str:
        return "WHEN " + " AND ".join(f"{f} {op} {t!r}D" for f, op, t in self.conditions) + f" THEN '{self.kind}'"


def _covers(conditions, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, op, t in conditions:
        hit &= x[:, j] <= t if op == "<=" else x[:, j] > t
    return hit


def _grow(x: np.ndarray, pos: np.ndarray, cuts: list[list[tuple[float, float]]]):
    """Add the condition with the most FOIL gain until no negative is covered; of equal gains the widest gap wins."""
    conditions: list[tuple[int, str, float]] = []
    hit = np.ones(len(x), bool)
    while (hit & ~pos).any() and (hit & pos).any() and len(conditions) < 6:
        p0, n0 = (hit & pos).sum(), (hit & ~pos).sum()
        now, best = np.log2(p0 / (p0 + n0)), (1e-9, 0.0, None)
        for j, values in enumerate(cuts):
            for t, gap in values:
                for op in ("<=", ">"):
                    c = hit & (x[:, j] <= t if op == "<=" else x[:, j] > t)
                    p, n = (c & pos).sum(), (c & ~pos).sum()
                    gain = (round(p * (np.log2(p / (p + n)) - now), 9) if p else 0.0, gap)
                    if gain > best[:2]:
                        best = (*gain, (j, op, float(t)))
        if best[2] is None:
            break
        conditions.append(best[2])
        hit = _covers(conditions, x)
    return conditions


def _prune(conditions, x: np.ndarray, pos: np.ndarray):
    """The prefix of the rule with the best (p - n) / (p + n) on held-out rows; the shorter of equals."""
    best, value = conditions, -2.0
    for k in range(1, len(conditions) + 1):
        hit = _covers(conditions[:k], x)
        p, n = (hit & pos).sum(), (hit & ~pos).sum()
        if p + n and (v := (p - n) / (p + n)) > value:
            best, value = conditions[:k], v
    return best, value


def induce(x: np.ndarray, kinds: np.ndarray, seed: int = 0, cuts_per_feature: int = 48) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning; what no rule covers is prose.

    Kinds are learned rarest first, each against all rows not yet covered. A rule is grown on two thirds of
    the rows and pruned on the rest; it is kept if it is right more often than not there (or, where the rest
    has no row to tell, on the rows it was grown on). A kind is done when all its rows are covered or four
    rules, each from another third, failed. Deterministic for a given order of rows.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    rng = np.random.default_rng(seed)
    for kind in sorted(KINDS, key=lambda k: ((kinds == k).sum(), k)):
        failed = 0
        while failed < 4 and (left & (kinds == kind)).any():
            rows = np.flatnonzero(left)
            grow = rng.random(len(rows)) < 2 / 3
            g, h = rows[grow], rows[~grow]
            if not (kinds[g] == kind).any():
                g, h = rows, rows
            cuts = []
            for j in range(x.shape[1]):
                values = np.unique(x[g, j])
                gaps, mids = np.diff(values), (values[:-1] + values[1:]) / 2
                spread = (values[-1] - values[0]) or 1.0
                if len(mids) > cuts_per_feature:
                    keep = np.unique(np.concatenate([np.argsort(-gaps)[: cuts_per_feature // 2], np.linspace(0, len(mids) - 1, cuts_per_feature // 2).astype(int)]))
                    gaps, mids = gaps[keep], mids[keep]
                cuts.append(list(zip(mids, gaps / spread, strict=True)))
            conditions = _grow(x[g], kinds[g] == kind, cuts)
            if not conditions:
                failed += 1
                continue
            conditions, value = _prune(conditions, x[h], kinds[h] == kind)
            if value == -2.0:
                value = _prune(conditions, x[g], kinds[g] == kind)[1]
            hit = _covers(conditions, x) & left
            if value <= 0 or not (hit & (kinds == kind)).any():
                failed += 1
                continue
            rules.append(Rule(tuple((FEATURES[j], op, t) for j, op, t in conditions), kind))
            left &= ~hit
    return rules


def learn(features: DataFrame, labels: DataFrame, doc: str, kind: str, max_labelled: int = 20_000, seed: int = 0) -> list[Rule]:
    """Rules from labelled rows of ``features``. At most ``max_labelled`` of them, in hash order of ``doc``, are fetched.

    Labels other than prose, list, table and junk, labels of unknown documents and blank texts are ignored; of
    several labels of a document the alphabetically first counts. Without labels there are no rules.
    """
    known = labels.where(F.col(kind).isin("prose", *KINDS)).groupBy(doc).agg(F.min(kind).alias("_kind"))
    known = known.orderBy(F.xxhash64(doc, F.lit(seed)), doc).limit(max_labelled)
    rows = features.where("not blank").join(F.broadcast(known), doc).select(doc, "_kind", *FEATURES).toPandas()
    rows = rows.drop_duplicates(doc).sort_values(doc)
    return induce(rows[list(FEATURES)].to_numpy(float), rows["_kind"].to_numpy(str), seed) if len(rows) else []


def case_expression(rules: list[Rule]) -> str:
    """The rule list as one SQL CASE over the feature columns; null for blank text."""
    return "CASE WHEN blank THEN NULL " + " ".join(r.sql() for r in rules) + " ELSE 'prose' END"


def classify(df: DataFrame, labels: DataFrame, doc: str, text: str, kind: str = "kind", max_labelled: int = 20_000) -> DataFrame:
    """``statistics`` of every row with ``kind``: prose, list, table, junk, or null for null and blank text.

    The rules are learned from a bounded sample of labelled rows (``max_labelled``); statistics and the
    learned CASE expression run natively over all rows.
    """
    told = labels.where(F.col(kind).isin("prose", *KINDS)).select(doc).distinct().orderBy(F.xxhash64(doc, F.lit(0)), doc).limit(max_labelled)
    labelled = df.join(F.broadcast(told), doc, "left_semi")
    rules = learn(statistics(labelled, doc, text), labels, doc, kind, max_labelled)
    return statistics(df, doc, text).withColumn("kind", F.expr(case_expression(rules)))
