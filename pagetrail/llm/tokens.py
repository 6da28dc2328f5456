"""Sizes in tokens: longest runs of word characters, or of characters that are neither word nor white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C to U+001F; for Java's regex and for RE2.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Letters, digits (numbers of any kind) and the underscore.
WORD = r"\p{L}\p{N}_"
TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]+"


def token_count(text: Column) -> Column:
    """Tokens in ``text``; 0 for null and blank text."""
    # every token becomes one letter, so what is left is letters and white space; no array of tokens is built
    marked = F.regexp_replace(text, TOKEN, "a")
    return F.coalesce(F.length(marked) - F.length(F.replace(marked, F.lit("a"), F.lit(""))), F.lit(0))
