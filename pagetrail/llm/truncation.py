"""Texts that were cut at a storage limit or mid-transfer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.keys import bounded_broadcast_join
from pagetrail.llm.quality import COMMON_WORDS
from pagetrail.session import cut

#: Ways in which a text may have been measured when its limit was applied; of equal ones the first wins.
ENCODINGS = ("chars", "utf16", "utf8", "html", "json", "crlf")


def encoded_lengths(text: Column) -> dict[str, Column]:
    """Length of ``text`` in characters, UTF-16 units, UTF-8 bytes, HTML-escaped, JSON-escaped and with CR LF line ends.

    A replacement character at the end is what is left of a split character, so it isn't counted.
    """
    whole = F.when(F.endswith(text, F.lit("�")), F.regexp_replace(text, "�+$", "")).otherwise(text)
    n = F.length(whole)

    def count(chars: str) -> Column:
        return n - F.length(F.translate(whole, chars, ""))

    special = whole.rlike("[&<>\"'\\\\\\n\\r\\t]")
    return {
        "chars": n,
        "utf16": F.when(F.octet_length(whole) == n, n).otherwise(F.octet_length(F.encode(whole, "UTF-16BE")) / 2).cast("int"),
        "utf8": F.octet_length(whole),
        "html": F.when(special, n + count("&") * 4 + count("<>") * 3 + count('"') * 5 + count("'") * 4).otherwise(n).cast("int"),
        "json": F.when(special, n + count('"\\\n\r\t')).otherwise(n).cast("int"),
        "crlf": F.when(special, n + count("\n")).otherwise(n).cast("int"),
    }


def storage_limits(texts: DataFrame, least_rows: int = 6, spike: float = 4.0, beyond: float = 0.02) -> DataFrame:
    """``(source, field, encoding, limit, lengths)``: the hidden limit of each source and field that has one.

    ``texts`` has source, field and the six lengths. A length is a limit if it holds at least ``spike`` times
    the rows of the lengths a little below it (and ``least_rows``), and next to nothing (``beyond`` of it) is
    longer. The encoding with the clearest spike wins; of spikes within 5 % of it, that of the simplest encoding. ``lengths`` are the limit and those up to three below
    it that stand out too: cut texts that lost a trailing space or half a character. Only counts per length
    are shuffled.
    """
    return limits_of(length_counts(texts), least_rows, spike, beyond)


def length_counts(texts: DataFrame) -> DataFrame:
    """``(source, field, *lengths, n)``: how many texts have these lengths."""
    return texts.groupBy("source", "field", *ENCODINGS).agg(F.count(F.lit(1)).alias("n"))


def limits_of(counts: DataFrame, least_rows: int = 6, spike: float = 4.0, beyond: float = 0.02) -> DataFrame:
    """``storage_limits`` of ``length_counts``."""
    each = counts.select("source", "field", "n", F.inline(F.array(*[F.struct(F.lit(e).alias("encoding"), F.lit(i).alias("place"), F.col(e).alias("len")) for i, e in enumerate(ENCODINGS)])))
    by_len = each.groupBy("source", "field", "encoding", "place", "len").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("source", "field", "encoding").orderBy("len")
    below = F.coalesce(F.sum("n").over(w.rangeBetween(-15, -5)), F.lit(0)) / 11
    above = F.coalesce(F.sum("n").over(w.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    near = F.collect_list(F.struct("len", "n")).over(w.rangeBetween(-3, 0))
    found = by_len.select("*", below.alias("below"), above.alias("above"), near.alias("near"))
    found = found.where((F.col("n") >= F.greatest(F.lit(least_rows), F.col("below") * spike)) & (F.col("above") <= F.col("n") * beyond))
    rise = F.col("n") - F.col("below")
    found = found.withColumn("top", F.max(rise).over(Window.partitionBy("source", "field"))).where(rise >= 0.95 * F.col("top"))
    best = Window.partitionBy("source", "field").orderBy("place", F.desc(rise))
    lengths = F.transform(F.filter("near", lambda x: x["n"] >= F.greatest(F.lit(3), F.col("below") * 2.5)), lambda x: x["len"])
    return found.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("source", "field", "encoding", F.col("len").alias("limit"), lengths.alias("lengths"))


#: A mark that a cut may leave.
MARK = r"(?:…|\.\.\.)$"
#: A sentence that ended, or a colon, before more text.
SENTENCE = r"[.?!:] \S"
_TERMINAL = r"[.?!。！？][\"'”’»)\]]*$"


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, evaluated once each: by way of a generator they aren't merged into what uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _with_endings(df: DataFrame) -> DataFrame:
    """Adds what tells how a text ends: its form and class, and the pieces whose frequency shows if such an ending is usual.

    Digits are masked by 9; of a number only the digits after its first run keep their count ("9.99", "9-99-99").
    """
    text, bare = F.col("text"), F.col("bare")
    form = F.when(text.rlike(r"^\s*[{\[]"), "json").when(F.contains(text, F.lit("://")) & text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "url").otherwise("text")
    df = _step(df, marked=F.endswith(text, F.lit("…")) | F.endswith(text, F.lit("...")), form=form)
    df = _step(df, bare=F.when(F.col("marked"), F.regexp_replace(text, MARK, "")).otherwise(text))
    df = _step(df, digits=bare.rlike(r"\d"), terminal=bare.rlike(_TERMINAL), sentence=bare.rlike(SENTENCE), last=F.substring_index(F.rtrim(bare), " ", -1))
    masked = F.regexp_replace(F.regexp_replace(bare, r"\d", "9"), r"(?<![9.,:-])9+", "9")
    df = _step(df, masked=F.when(F.col("digits"), masked).otherwise(bare))
    is_text, masked = F.col("form") == "text", F.col("masked")
    last_field = F.when(bare.rlike(r"[?&]"), F.regexp_extract(masked, r"[?&]([^?&]*)$", 1)).otherwise(F.regexp_extract(masked, r"([^/]*)$", 1))
    return _step(
        df,
        url=F.when(F.col("form") == "url", last_field),
        tail=F.when(is_text & F.contains(bare, F.lit(", ")), F.substring_index(masked, ", ", -1)),
        word=F.when(is_text, F.col("last")),
        whole=F.when(is_text & (F.substring_index(text, " ", 4) == text), text),
        shape=F.when(is_text & F.col("digits"), F.regexp_replace(F.regexp_replace(masked, r"\p{Lu}[\p{L}\p{M}]*", "A"), r"\p{Ll}[\p{L}\p{M}]*", "a")),
        lower_end=F.col("last").rlike(r"^[\p{Ll}]|^[^\p{L}\p{N}]*$|[\p{Ll}][(/-]$"),
    )


#: Kinds of endings whose frequency is counted.
ENDINGS = ("url", "tail", "word", "whole", "shape")


def _usual(common: DataFrame) -> DataFrame:
    """``(field, kind, value)`` of usual endings, without words that only begin a far more frequent one. The caller bounds their number."""
    known: dict[tuple[str, str], dict[str, int]] = {}
    for r in common.select("field", "kind", "value", "n").collect():
        known.setdefault((r["field"], r["kind"]), {})[r["value"]] = r["n"]
    out = []
    for (field, kind), values in known.items():
        ordered = sorted(values)
        for i, v in enumerate(ordered):
            longer = False
            if kind == "word":
                for other in ordered[i + 1 :]:
                    if not other.startswith(v) or longer:
                        break
                    longer = values[other] > 5 * values[v]
            if not longer:
                out.append((field, kind, v))
    return common.sparkSession.createDataFrame(out, "field string, kind string, value string")


def truncated(df: DataFrame, key: str, source: str, fields: Sequence[str], usual: float = 0.0003) -> DataFrame:
    """``(key, source, field, limited, cut)`` for every non-blank text of ``fields``: whether it is only a beginning.

    First the lengths under six encodings expose each source's limit per field (``storage_limits``). Then
    endings are inspected. A text at its source's limit is cut unless it ends as complete texts do. Any other
    text is cut if it ends in a half character, in an unclosed JSON value, inside a URL's last parameter, in a
    sentence without its end, in a phrase, word or number form that no complete text ends with. What endings
    are usual is counted over all texts that aren't at a limit: as many as ``usual`` of all the field's texts
    (three at least) must end so. Dots at the end alone say nothing, as pages write them too.

    Null and blank texts are left out; a null source is a source of its own; repeated rows are judged alike;
    other columns are ignored; an empty table gives no rows.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields]))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"), pairs).where(F.col("text").rlike(r"(?U)\S"))
    rows = rows.select("*", *[c.alias(e) for e, c in encoded_lengths(F.col("text")).items()])
    counts = cut(length_counts(rows))
    limits = cut(limits_of(counts))
    told = bounded_broadcast_join(rows, limits.select("source", "field", "encoding", "lengths"), ["source", "field"])
    length = F.coalesce(*[F.when(F.col("encoding") == e, F.col(e)) for e in ENCODINGS])
    told = told.select("key", "source", "field", "text", F.coalesce(F.array_contains("lengths", length), F.lit(False)).alias("limited"))
    told = _with_endings(told)

    # frequencies of endings among texts that aren't at a limit; a piece is counted only where a text's judgement may ask for it
    open_end = ~F.col("terminal") | F.col("marked")
    doubtful = open_end & (F.col("lower_end") | F.col("shape").isNotNull() | F.col("tail").isNotNull() | F.col("marked") | F.col("sentence"))
    asked = {"url": F.lit(True), "tail": open_end, "word": open_end & F.col("lower_end"), "whole": doubtful, "shape": open_end}
    endings = told.where("not limited").select("field", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.when(asked[k], F.col(k)).alias("value")) for k in ENDINGS])))
    counted = endings.where("value is not null").groupBy("field", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("field").agg(F.sum("n").alias("all"))
    common = counted.join(F.broadcast(sizes), "field").where(F.col("n") >= F.greatest(F.lit(3), F.col("all") * usual))
    # fewer than 1/usual endings of a kind can be that usual, so this table has at most fields x kinds / usual rows
    known = cut(_usual(common))
    for k in ENDINGS:
        of_kind = known.where(F.col("kind") == k).select("field", F.col("value").alias(k), F.lit(True).alias(f"usual_{k}"))
        told = told.join(F.broadcast(of_kind), ["field", k], "left")
    return _step(told, cut=_is_cut()).select("key", "source", "field", "limited", "cut")


def _is_cut() -> Column:
    text, form, limited, marked, sentence = F.col("text"), F.col("form"), F.col("limited"), F.col("marked"), F.col("sentence")
    url, tail, word, whole, shape = (F.coalesce(F.col(f"usual_{k}"), F.lit(False)) for k in ENDINGS)
    phrase = F.col("tail").isNotNull()
    function_word = F.lower(F.col("last")).isin(COMMON_WORDS)
    plain_cut = (
        F.when(F.col("terminal") & ~marked, False)
        .when(whole, False)
        .when(sentence, True)
        .when(phrase, ~tail)
        .when(F.col("shape").isNotNull(), ~shape)
        .when(F.col("lower_end"), ~word | function_word)
        .otherwise(False)
    )
    at_limit = F.when(F.col("terminal") & ~marked, False).when(whole, False).when(marked, True).when(phrase, ~tail).when(F.col("shape").isNotNull(), ~shape).otherwise(True)
    return (
        F.when(text.rlike("�$"), True)
        .when(form == "json", ~text.rlike(r"[}\]]\s*$"))
        .when(form == "url", ~url)
        .when(limited, at_limit)
        .otherwise(plain_cut)
    )
