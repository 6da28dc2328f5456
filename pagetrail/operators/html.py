"""HTML pages to element rows, by a tolerant event parser (no recursion, any depth of nesting)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Regions of a page by tag and by role.
LANDMARK_TAGS = {tag: tag for tag in ("nav", "header", "footer", "aside", "main", "form", "dialog")}
LANDMARK_ROLES = {
    "navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "main": "main", "form": "form", "search": "form", "dialog": "dialog",
}
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
SKIPPED = frozenset({"script", "style"})

ELEMENTS = (
    "page_key string, pos int, node_id string, tag string, attrs map<string,string>, text string, parent int, depth int, "
    "subtree_end int, landmark string, section string, row_text string"
)


class _Elements(HTMLParser):
    """Collects one record per element in document order; a record knows its parent's place and where its subtree ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.texts: list[list[str]] = []
        self.section = ""

    def handle_starttag(self, tag, attrs):
        here = len(self.rows)
        parent = self.open[-1] if self.open else -1
        up = self.rows[parent] if parent >= 0 else None
        values = {k: v or "" for k, v in attrs}
        landmark = up["within"] if up else "main"  # the region of its ancestors; an element isn't in its own
        self.rows.append(
            {"tag": tag, "attrs": values, "parent": parent, "depth": len(self.open), "landmark": landmark, "end": here,
             "within": LANDMARK_ROLES.get(values.get("role")) or LANDMARK_TAGS.get(tag) or landmark,
             "section": "" if landmark in ("nav", "header", "footer") else self.section, "row": here if tag in ("li", "tr") else (up["row"] if up else -1)}
        )
        self.texts.append([])
        if tag not in VOID:
            self.open.append(here)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]]["tag"] == tag:
                closed = self.open[i:]
                del self.open[i:]
                for n in reversed(closed):
                    self._close(n)
                break

    def _close(self, n: int) -> None:
        row = self.rows[n]
        row["end"] = len(self.rows) - 1
        if row["tag"] in HEADINGS and row["landmark"] not in ("nav", "header", "footer"):
            self.section = " ".join("".join(self.texts[n]).split())[:80] or self.section
        if row["parent"] >= 0 and row["tag"] not in SKIPPED:
            self.texts[row["parent"]].extend(self.texts[n])

    def handle_data(self, data):
        if self.open:
            self.texts[self.open[-1]].append(data)

    def finish(self) -> None:
        self.close()
        while self.open:
            self._close(self.open.pop())


def parse(page: str) -> list[tuple]:
    """Element rows of one page without its key; an unparsable or empty page has none."""
    p = _Elements()
    p.feed(page)
    p.finish()
    text = [" ".join("".join(t).split()) for t in p.texts]
    for n, r in enumerate(p.rows):  # void elements were never opened, so their text is their own
        r["text"] = text[n]
    return [
        (n, r["attrs"].get("backend_node_id"), r["tag"], r["attrs"], r["text"], r["parent"], r["depth"], r["end"], r["landmark"], r["section"],
         text[r["row"]][:80] if 0 <= r["row"] < n else "")
        for n, r in enumerate(p.rows)
    ]


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    for pdf in batches:
        rows = [(key, *r) for key, page in zip(pdf["page_key"], pdf["html"], strict=True) if page for r in parse(page)]
        yield pd.DataFrame(rows, columns=names)


def elements(pages: DataFrame) -> DataFrame:
    """One row per element of ``pages(page_key, html)`` in document order.

    ``pos`` is the place in the page, ``parent`` the parent's place (-1 at the root), ``subtree_end`` the place
    of the last descendant, so "x is inside y" is ``x.pos between y.pos + 1 and y.subtree_end``. ``section`` is
    the last heading before the element (none inside nav, header and footer), ``row_text`` the text of the
    nearest enclosing list item or table row. Null and empty pages have no rows. Filter pages before this: no
    predicate can be pushed through the Python parser.
    """
    return pages.select(F.col("page_key").cast("string"), "html").where("html is not null").mapInPandas(_batches, ELEMENTS)


#: Elements whose text a page never shows.
UNSHOWN = frozenset({"script", "style", "noscript", "template", "title"})


class _Texts(HTMLParser):
    """Collects the text nodes of a page in document order, squashed, until ``limit`` characters are reached."""

    def __init__(self, limit: int) -> None:
        super().__init__(convert_charrefs=True)
        self.limit, self.length = limit, 0
        self.lines: list[str] = []
        self.open: list[str] = []
        self.hidden: int | None = None  # the place in ``open`` of the outermost element that isn't shown
        self.node: list[str] = []

    def _end_node(self) -> None:
        text = " ".join("".join(self.node).split()) if self.node else ""
        self.node = []
        if text and self.hidden is None and self.length < self.limit:
            self.lines.append(text)
            self.length += len(text)

    def handle_starttag(self, tag, attrs):
        self._end_node()
        if tag not in VOID:
            if self.hidden is None and tag in UNSHOWN:
                self.hidden = len(self.open)
            self.open.append(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] == tag:
                self._end_node()
                del self.open[i:]
                if self.hidden is not None and self.hidden >= i:
                    self.hidden = None
                break

    def handle_data(self, data):
        self.node.append(data)

    def handle_comment(self, data):
        self._end_node()

    def finish(self) -> str:
        self.close()
        self._end_node()
        return "\n".join(self.lines)[: self.limit]


def shown_text(page: str, limit: int) -> str:
    p = _Texts(limit)
    p.feed(page)
    return p.finish()


def visible_texts(pages: DataFrame, limit: int) -> DataFrame:
    """The text of ``pages(page_key, html)``: their text nodes, whatever element they are in, until ``limit`` characters
    are reached, joined by line breaks and cut there. Scripts, styles and the like show no text; where an element is on
    the screen isn't known. Pages without text have no row."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(key, shown_text(page, limit)) for key, page in zip(pdf["page_key"], pdf["html"], strict=True) if page]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["page_key", "text"])

    return pages.select(F.col("page_key").cast("string"), "html").where("html is not null").mapInPandas(batches, "page_key string, text string")


#: What counts as interactive.
INTERACTIVE_TAGS = ["a", "button", "input", "textarea", "select", "summary"]
ROLES = ["button", "link", "checkbox", "radio", "switch", "tab", "menuitem", "menuitemradio", "option", "gridcell", "combobox", "textbox", "searchbox", "spinbutton"]
EDITABLE_ROLES = ["textbox", "searchbox", "spinbutton", "combobox"]
MAX_LABEL = 200


def is_interactive(tag: Column, attrs: Column) -> Column:
    role, edit = F.try_element_at(attrs, F.lit("role")), F.try_element_at(attrs, F.lit("contenteditable"))
    return F.coalesce(tag.isin(INTERACTIVE_TAGS), F.lit(False)) | F.coalesce(role.isin(ROLES), F.lit(False)) | F.coalesce(edit == "true", F.lit(False))


def role_of(tag: Column, attrs: Column) -> Column:
    """A known explicit role, else by tag, and for inputs by type (text if there is none); other tags are their own role."""
    role = F.try_element_at(attrs, F.lit("role"))
    kind = F.coalesce(F.try_element_at(attrs, F.lit("type")), F.lit("text"))
    by_type = (
        F.when(kind.isin("checkbox", "radio"), kind)
        .when(kind.isin("button", "submit", "reset", "image"), "button")
        .when(kind == "search", "searchbox")
        .when(kind == "number", "spinbutton")
        .otherwise("textbox")
    )
    return (
        F.when(role.isin(ROLES), role)
        .when(tag.isin("button", "summary"), "button")
        .when(tag == "a", "link")
        .when(tag == "select", "combobox")
        .when(tag == "textarea", "textbox")
        .when(tag == "input", by_type)
        .otherwise(tag)
    )


def ops_of(tag: Column, role: Column) -> Column:
    """Allowed operations, sorted."""
    return (
        F.when(tag == "select", F.array(F.lit("SELECT")))
        .when((tag == "textarea") | role.isin(EDITABLE_ROLES), F.array(F.lit("CLICK"), F.lit("TYPE_TEXT")))
        .otherwise(F.array(F.lit("CLICK")))
    )


def label_of(attrs: Column, text: Column) -> Column:
    """The first that isn't empty of aria_label, text, alt, title, placeholder, value and name, up to 200 characters."""
    values = [F.try_element_at(attrs, F.lit(n)) if n else text for n in ("aria_label", "", "alt", "title", "placeholder", "value", "name")]
    return F.left(F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit("")), F.lit(MAX_LABEL))


def described(rows: DataFrame) -> DataFrame:
    """``elements`` with interactive, role, ops, label (the role if there is none) and value."""
    tag, attrs = F.col("tag"), F.col("attrs")
    out = rows.withColumn("role", role_of(tag, attrs)).withColumn("interactive", is_interactive(tag, attrs))
    out = out.withColumn("ops", ops_of(tag, F.col("role"))).withColumn("label", F.coalesce(F.nullif(label_of(attrs, F.col("text")), F.lit("")), F.col("role")))
    value = F.left(F.coalesce(F.try_element_at(attrs, F.lit("input_value")), F.lit("")), F.lit(MAX_LABEL))
    return out.withColumn("value", F.when(F.array_contains("ops", "TYPE_TEXT"), value).otherwise(""))


def nearest_interactive(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where a click on a non-interactive element lands: ``(page_key, pos, to_pos, kind, distance)``.

    ``wanted`` has page_key and pos. The shallowest interactive descendant, the first in page order of equals;
    else the nearest interactive ancestor; elements with neither are left out. Range conditions on pos replace
    walking the tree; both joins are within a page.
    """
    base = rows.select("page_key", "pos", "depth", "subtree_end")
    live = rows.where("interactive").select("page_key", F.col("pos").alias("to_pos"), F.col("depth").alias("to_depth"), F.col("subtree_end").alias("to_end"))
    own = wanted.select("page_key", "pos").distinct().join(base, ["page_key", "pos"])
    pairs = own.join(live, "page_key").where("(to_pos > pos and to_pos <= subtree_end) or (to_pos < pos and to_end >= pos)")
    inside = F.col("to_pos") > F.col("pos")
    best = F.min(F.struct((~inside).alias("up"), F.abs(F.col("to_depth") - F.col("depth")).alias("distance"), "to_pos"))
    found = pairs.groupBy("page_key", "pos").agg(best.alias("b"))
    return found.select("page_key", "pos", F.col("b.to_pos").alias("to_pos"), F.when(F.col("b.up"), "ancestor").otherwise("descendant").alias("kind"), F.col("b.distance").alias("distance"))
