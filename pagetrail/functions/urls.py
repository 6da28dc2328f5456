"""URL functions as column expressions; invalid URLs give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(url: Column, what: str) -> Column:
    return F.try_parse_url(url, F.lit(what))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def query_value(url: Column, key: str) -> Column:
    """The decoded value of a query parameter."""
    raw = F.regexp_extract(F.coalesce(part(url, "QUERY"), F.lit("")), rf"(?:^|&){key}=([^&]*)", 1)
    return F.nullif(F.try_url_decode(raw), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path in lower case, without scheme, "www.", query, fragment and trailing slashes."""
    host = F.regexp_replace(F.lower(part(url, "HOST")), "^www[.]", "")
    return F.concat(host, F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/+$", ""))


#: Views of a page beside its content, and the words of goals that want them.
SIDE_VIEWS = ("edit", "history", "raw", "info")
SIDE_GOALS = ("edit", "history", "revision", "revisions", "source")


def is_detour(href: Column, goal: Column) -> Column:
    """Links to edit, history, raw or info views, unless the goal asks for such pages."""
    # any word that begins with "edit", and the other words as they are
    said = F.regexp_extract_all(F.lower(F.coalesce(goal, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)
    asked = F.exists(said, lambda w: w.startswith(SIDE_GOALS[0]) | w.isin(*SIDE_GOALS))
    address = F.substring_index(F.coalesce(href, F.lit("")), "#", 1)
    query = F.split(F.when(F.contains(address, F.lit("?")), F.regexp_replace(address, r"^[^?]*[?]", "")).otherwise(""), "&")
    path = F.split(F.regexp_replace(F.substring_index(address, "?", 1), r"^[a-z][a-z0-9+.-]*://[^/]*", ""), "/")
    views = F.array(*[F.lit(f"action={v}") for v in SIDE_VIEWS])
    return ~asked & (F.arrays_overlap(query, views) | F.array_contains(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(1))), "edit"))


def merges(href: Column) -> Column:
    """Only real destinations merge: http(s) and not ending in "#"."""
    return href.rlike("^https?://") & ~href.endswith("#")


def navigates(href: Column, here: Column) -> Column:
    """A link leads elsewhere: http(s) and not to a fragment of the page it is on."""
    return href.rlike("^https?://") & (without_fragment(href) != without_fragment(here))


def search_url(template: Column, query: Column) -> Column:
    """A search template with {q} replaced by the encoded query."""
    return F.replace(template, F.lit("{q}"), F.url_encode(query))


def matches_url(url: Column, pattern: Column) -> Column:
    """Regex match; the fragment takes part only if the pattern has one."""
    return F.when(F.contains(pattern, F.lit("#")), F.regexp(url, pattern)).otherwise(F.regexp(canonical(url), pattern))
