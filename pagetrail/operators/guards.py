"""Fingerprints of observations, freshness of decisions and reuse of texts, as joins on hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*fields: Column, names: Sequence[str]) -> Column:
    """SHA-256 of the fields as JSON in the order of their names; equal observations have equal fingerprints, nulls included."""
    ordered = sorted(zip(names, fields, strict=True), key=lambda p: p[0])
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in ordered]), {"ignoreNullFields": "false"}), 256)


def fresh(decisions: DataFrame, pages: DataFrame, page: str, mark: str) -> DataFrame:
    """Decisions whose page still has the fingerprint they were made on; each decision_id counts once."""
    return decisions.dropDuplicates(["decision_id"]).join(pages.select(page, mark).distinct(), [page, mark], "left_semi")


def reused(requests: DataFrame, memo: DataFrame, context: Sequence[str], value: str) -> DataFrame:
    """Requests with the memo's value where the whole context is the same (null where it is new); of several the first by value."""
    known = memo.groupBy(fingerprint(*[F.col(c) for c in context], names=context).alias("_f")).agg(F.min(value).alias(value))
    return requests.withColumn("_f", fingerprint(*[F.col(c) for c in context], names=context)).join(known, "_f", "left").drop("_f")
