"""Unicode folding as Arrow UDFs (Spark has no NFKD built in)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(text: str) -> str:
    """NFKD, without combining marks, case-folded."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold() if not text.isascii() else text.lower()


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """``fold`` of every text; null stays null."""
    return texts.map(fold, na_action="ignore")
