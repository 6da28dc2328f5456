"""Same or nearly same requests and pages across splits."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrail.functions.fold import fold
from pagetrail.keys import bounded_broadcast_join, skew_join
from pagetrail.session import cut

#: Month names, number words, words of politeness.
MONTHS = "january february march april may june july august september october november december".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
POLITE = "please kindly task goal hi hello thanks thank".split()
OPENINGS = ["i want to", "i would like to", "i d like to", "id like to", "i need to", "i wish to", "could you", "can you", "would you", "will you", "help me to", "help me"]
#: Words after which the next word belongs to one wish: what follows must stay with them in any order of wishes.
ANCHORS = "by in from to at the for under over on least most a an after before".split()
#: Tens from thirty on.
TENS = "thirty forty fifty sixty seventy eighty ninety".split()
UNITS = {"eur": "euros", "euro": "euros", "usd": "dollars", "dollar": "dollars", "persons": "people", "person": "people"}


def _anagram(word: str) -> str:
    """The letters of a word in order, so that swapped neighbours don't matter; numbers stay as they are."""
    return word if any(c.isdigit() for c in word) else "".join(sorted(word))


_WORDS = {_anagram(w): w for w in [*MONTHS, *NUMBERS, *TENS, *POLITE, *ANCHORS, *UNITS, *UNITS.values(), "and", "with", "people", *[m[:3] for m in MONTHS if m != "may"], "sept"]}
_SHORT = {m[:3]: m for m in MONTHS} | {"sept": "september"}
_LOW = (1 << 64) - 1
#: Words between which phrases break.
_BREAKS = {*ANCHORS, "and", "with", "a", "an", "the", ",", "sorted", "delivered", "together"}
_OPEN = [tuple(o.split()) for o in OPENINGS]


def _tidy(text: str) -> str:
    low = fold(text).replace("&", " and ").replace("€", " euros ").replace("$", " dollars ")
    return re.sub(r"([^\W\d_])[,;.]([^\W\d_])(?=\s|$)", r"\1\2 ", low)  # "collectio,n": a comma swapped with a letter


def _words(tokens: list[str]) -> list[str]:
    """Words with months, number words and units in one spelling; openings and words of politeness dropped; "," stays."""
    words = [_WORDS.get(_anagram(w), w) for w in tokens]
    begun = True
    while begun and words:
        begun = False
        if words[0] in POLITE or words[0] == ",":
            words, begun = words[1:], True
        for o in _OPEN:
            if tuple(words[: len(o)]) == o and len(words) > len(o):
                words, begun = words[len(o) :], True
    out: list[str] = []
    tens = False
    for w in words:
        if w in POLITE:
            continue
        w = UNITS.get(w, _SHORT.get(w, w))
        if w in NUMBERS:
            n = NUMBERS.index(w)
            if tens and 0 < n < 10:  # "twenty five"
                out[-1] = str(int(out[-1]) + n)
                tens = False
                continue
            w, tens = str(n), n == 20
        elif w in TENS:
            w, tens = str(TENS.index(w) * 10 + 30), True
        else:
            tens = False
        out.append(w)
    return out


def _units(words: list[str]) -> list[tuple[str, str]]:
    """``(head, word)`` of every word but "and": the anchor before it ("in X"), or for "by" the word before it."""
    out: list[tuple[str, str]] = []
    before = ""
    for w in words:
        if w in ("and", ","):
            continue
        out.append((_anagram(before) if w == "by" else before if before in ANCHORS else "", w))
        before = w
    return out


def request_words(text: str | None) -> list[str]:
    """The words of a request in their order and one spelling, with "," between phrases."""
    return _words(re.findall(r"\w+|,", re.sub(r"[;:.!?()]+", ",", _tidy(text)))) if text else []


def request_key(text: str | None) -> str | None:
    """A hash that is equal for texts making the same request, and for some others (``same_request`` tells).

    Case, accents, punctuation and white space are dropped; "&" is "and"; months, number words and units get
    one spelling; words of politeness and "and" are dropped; the order of a word's letters doesn't matter
    (also a letter swapped with a comma), but a digit never may change. The remaining words are taken without
    order, each together with the anchor before it ("in X", "by Y"), so wishes may come in any order while
    names can't change places. None for null, blank or wordless text.
    """
    units = _units(request_words(text))
    return hashlib.md5("|".join(sorted(f"{h} {_anagram(w)}" for h, w in units)).encode()).hexdigest() if units else None


def request_blocks(words: list[str]) -> list[int]:
    """Keys of which two requests share one if their words, whatever their order, are the same but for the order of
    letters, and but for one word with a letter lost, doubled, added or wrong. Words with digits are never varied.

    One key for the words as they are; for each word of five letters or more, one for the others with the word,
    and with the word less any one letter.
    """
    units = [(f"{h} {_anagram(w)}", h, w) for h, w in _units(words)]
    if not units:
        return []
    hashes = [xxhash.xxh3_64_intdigest(u) for u, _, _ in units]
    total = sum(hashes)
    keys = {total & _LOW}
    for h, (_, head, w) in zip(hashes, units, strict=True):
        if len(w) >= 5 and not any(c.isdigit() for c in w):
            rest = f"{(total - h) & _LOW} {head} "
            keys.update(xxhash.xxh3_64_intdigest(rest + v) for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))})
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def slip(a: str, b: str) -> str | None:
    """What slip of the pen makes of two different words: swapped (neighbours), lost (or added) or wrong letter; else None."""
    if any(c.isdigit() for c in a + b):
        return None
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        if a[i + 1 :] == b[i + 1 :]:
            return "wrong"
        if sorted(a) != sorted(b):
            return None
        # the least swaps of neighbours that turn a into b; two slips of one longer word are two swaps apart
        rest, swaps = list(a), 0
        for c in b:
            at = rest.index(c)
            swaps += at
            del rest[at]
        return "swapped" if swaps == 1 or (swaps == 2 and len(a) > 5) else None
    return "lost" if len(b) == len(a) + 1 and a[i:] == b[i + 1 :] else None


def _pairs(words: list[str]) -> dict[str, set[str]]:
    """Neighbours within a phrase: what follows a word, if neither is an anchor and no break is between."""
    out: dict[str, set[str]] = {}
    for x, y in zip(words, words[1:], strict=False):
        if not {x, y} & _BREAKS:
            out.setdefault(x, set()).add(y)
    return out


def same_request(a: list[str], b: list[str]) -> list[tuple[str, str, str]] | None:
    """The slips ``(kind, word, word)`` by which two requests differ, or None if they ask for different things.

    Every word of one must be in the other under the same head, or be a single slip of such a word; and no two
    words may have exchanged what follows them in their phrases ("red lamp, green sofa", "green lamp, red sofa").
    """
    ua, ub = Counter(_units(a)), Counter(_units(b))
    left, other = list((ua - ub).elements()), list((ub - ua).elements())
    if len(left) != len(other):
        return None
    slips, renamed = [], {}
    for head, w in left:
        for i, (h, v) in enumerate(other):
            kind = slip(w, v) if w != v else "same"
            # the word before "by" may itself hold a slip, and an anchor is matched by its letters
            if kind and (h == head or slip(h, head) or _anagram(h) == _anagram(head)):
                if kind != "same":
                    slips.append((kind, *sorted((w, v))))
                    renamed[w] = v
                del other[i]
                break
        else:
            return None
    pa, pb = _pairs([renamed.get(w, w) for w in a]), _pairs(b)
    moved = {x: (pa[x], pb[x]) for x in pa.keys() & pb.keys() if not pa[x] & pb[x]}
    exchanged = any(x < y and before & moved[y][1] and moved[y][0] & after for x, (before, after) in moved.items() for y in moved)
    return None if exchanged else slips


_PARSED = T.StructType([T.StructField("canon", T.StringType()), T.StructField("blocks", T.ArrayType(T.LongType()))])


@F.pandas_udf(_PARSED)
def parsed_requests(texts: pd.Series) -> pd.DataFrame:
    """The request in one spelling and its blocks; null for texts without words."""
    words = [request_words(t) for t in texts]
    words = [w if _units(w) else None for w in words]
    return pd.DataFrame({"canon": [" ".join(w) if w else None for w in words], "blocks": [request_blocks(w) if w else None for w in words]})


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "one", "two")])))
def request_slips(one: pd.Series, two: pd.Series) -> pd.Series:
    """``same_request`` of two canonical requests; null if they differ in more than slips."""
    found = (same_request(a.split(" "), b.split(" ")) for a, b in zip(one, two, strict=True))
    return pd.Series([None if f is None else [{"kind": k, "one": a, "two": b} for k, a, b in f] for f in found], dtype=object)


_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|template|noscript|head)\b[^>]*>.*?</\1\s*>")
_TAG = re.compile(r"<[^>]*>")


def visible_words(page: str) -> list[str]:
    """The words of a page's visible text, folded and without markup, comments, scripts and styles."""
    if "<!--" in page or "<s" in page or "<t" in page or "<n" in page or "<he" in page or "<S" in page:
        page = _HIDDEN.sub(" ", page)
    text = _TAG.sub(" ", page)
    return re.findall(r"\w+", fold(html.unescape(text) if "&" in text else text))


SHINGLE, BANDS, ROWS = 5, 32, 4
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def page_signature(words: list[str], hashes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys of 32 bits, 64-bit hashes of the words with their how-manieth occurrence) of one page's words."""
    if len(hashes) > 500_000:
        hashes.clear()
    ids = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = hashes.get(w)
        if h is None:
            h = hashes[w] = xxhash.xxh3_64_intdigest(w)
        ids[i] = h
    n = max(1, len(ids) - SHINGLE + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(ids))):
        shingles += _mix(ids[k : k + n] * _MIX[k])
    least = _mix(np.unique(shingles)[:, None] * _A + _B).min(axis=0).reshape(BANDS, ROWS)
    bands = _mix((least * _MIX[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    start = np.r_[True, s[1:] != s[:-1]]
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
    bag = _mix(s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (bands >> np.uint64(32)).astype(np.uint32).view(np.int32), bag.view(np.int64)


_PAGES = "row_id long, train boolean, sid binary, pid binary, bands array<int>, bag array<long>"


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes: dict[str, int] = {}
    for pdf in batches:
        out = []
        for row_id, train, pages in zip(pdf["row_id"], pdf["train"], pdf["pages"], strict=True):
            seen = {}
            for page in pages:
                words = visible_words(page)
                if words:
                    pid = hashlib.md5(" ".join(words).encode()).digest()
                    if pid not in seen:
                        seen[pid] = page_signature(words, hashes)
            sid = hashlib.md5(b"".join(sorted(seen))).digest()
            out += [(row_id, train, sid, pid, *signature) for pid, signature in seen.items()]
        yield pd.DataFrame(out, columns=["row_id", "train", "sid", "pid", "bands", "bag"])


#: Rows of a key that one task joins with as many of the other side.
BLOCK = 1000


def _in_blocks(side: DataFrame, hot: DataFrame, key: str, row: str, mine: str, theirs: str) -> DataFrame:
    """Rows of hot keys with the block of each within its key, once for every block that the key has on the other side."""
    joined = bounded_broadcast_join(side, hot.select(key, F.col(f"_n{mine}").alias("_mine"), F.col(f"_n{theirs}").alias("_theirs")), [key], "inner")
    numbered = joined.withColumn(mine, F.pmod(F.xxhash64(row), F.col("_mine")).cast("int"))
    return numbered.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("_theirs") - 1))).drop("_mine", "_theirs")


def blocked_join(train: DataFrame, other: DataFrame, key: str, row_t: str, row_e: str) -> DataFrame:
    """Equi-join of two sides on ``key``. A key of more than BLOCK x BLOCK pairs is joined block by block, so no task makes more of them at once.

    Blocks are hashes of the rows, of about ``BLOCK`` rows each. Sizes of keys are counted with map-side
    combining. Both sides are read twice: hand in what is cheap to read.
    """
    n_t = train.groupBy(key).agg(F.count(F.lit(1)).alias("_t"))
    n_e = other.groupBy(key).agg(F.count(F.lit(1)).alias("_e"))
    hot = cut(n_t.join(n_e, key).where(F.col("_t") * F.col("_e") > BLOCK * BLOCK).select(key, *[F.ceil(F.col(f"_{s}") / BLOCK).cast("int").alias(f"_n_b{s}") for s in "te"]))
    if hot.isEmpty():
        return train.join(other, key)
    cold = train.join(hot, key, "left_anti").join(other, key)
    t, e = _in_blocks(train, hot, key, row_t, "_bt", "_be"), _in_blocks(other, hot, key, row_e, "_be", "_bt")
    return cold.unionByName(t.join(e, [key, "_bt", "_be"]).drop("_bt", "_be"))


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(row_a, row_b)``, row_a < row_b, for ``links(class_t, class_e)`` and ``members(row_id, train, class)``."""
    train = members.where("train").select(F.col("class").alias("class_t"), F.col("row_id").alias("train_row"))
    other = members.where("not train").select(F.col("class").alias("class_e"), F.col("row_id").alias("eval_row"))
    linked = blocked_join(train, links, "class_t", "train_row", "class_e").select("train_row", "class_e")
    pairs = blocked_join(linked, other, "class_e", "train_row", "eval_row")
    return pairs.select(F.least("train_row", "eval_row").alias("row_a"), F.greatest("train_row", "eval_row").alias("row_b"))


def counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(row_id, n)``: with how many training rows each row of the other side overlaps, from class sizes, without any pair of rows."""
    sizes = members.where("train").groupBy(F.col("class").alias("class_t")).agg(F.count(F.lit(1)).alias("n"))
    of_class = links.join(sizes, "class_t").groupBy(F.col("class_e").alias("class")).agg(F.sum("n").alias("n"))
    return skew_join(members.where("not train").select("row_id", "class"), of_class, "class").select("row_id", "n")


def request_links(rows: DataFrame, rare: int = 2, often: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(links, members)`` of rows of ``(row_id, train, text)`` on different sides that make the same request.

    Requests in one spelling are classes. Classes of the two sides that share a block (``request_blocks``) are
    compared word by word (``same_request``). Two words are one if two neighbouring letters are swapped. One
    letter more makes another word only if both are usual, neither in at most ``rare`` requests nor twenty times
    rarer than the other. A wrong letter is a slip only if one word is in at least ``often`` requests and twenty
    times as usual as the other, else it is another name.
    A row with null ``train`` takes no part; null, blank and wordless texts match nothing; row ids must be unique.
    """
    seen = rows.where("train is not null and text is not null").select("row_id", "train", parsed_requests("text").alias("p"))
    seen = cut(seen.where("p.canon is not null").select("row_id", "train", F.md5("p.canon").alias("class"), "p.canon", "p.blocks"))
    members = seen.select("row_id", "train", "class")
    classes = seen.groupBy("train", "class").agg(F.first("canon").alias("canon"), F.first("blocks").alias("blocks"))
    block = classes.select("train", "class", F.explode("blocks").alias("block"))
    t = block.where("train").select("block", F.col("class").alias("class_t"))
    e = block.where("not train").select("block", F.col("class").alias("class_e"))
    pairs = cut(blocked_join(t, e, "block", "class_t", "class_e").select("class_t", "class_e").distinct())
    exact = pairs.where("class_t = class_e")
    canon = seen.select("class", "canon").dropDuplicates(["class"])
    both = pairs.where("class_t <> class_e").join(canon.select(F.col("class").alias("class_t"), F.col("canon").alias("one")), "class_t")
    both = both.join(canon.select(F.col("class").alias("class_e"), F.col("canon").alias("two")), "class_e")
    told = cut(both.select("class_t", "class_e", request_slips("one", "two").alias("slips")).where("slips is not null"))
    doubtful = told.select("class_t", "class_e", F.inline("slips")).where("kind <> 'swapped'")
    wanted = doubtful.select(F.explode(F.array("one", "two")).alias("word")).distinct()
    words = canon.select("class", F.explode(F.array_distinct(F.split("canon", " "))).alias("word"))
    known = words.join(wanted, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    judged = doubtful.join(known.select(F.col("word").alias("one"), F.col("n").alias("n1")), "one").join(known.select(F.col("word").alias("two"), F.col("n").alias("n2")), "two")
    low, high = F.least("n1", "n2"), F.greatest("n1", "n2")
    unlike = low * 20 > high
    wrong = F.when(F.col("kind") == "wrong", unlike | (high < often)).otherwise(unlike & (low > rare))
    refused = judged.where(wrong).select("class_t", "class_e").distinct()
    near = told.select("class_t", "class_e").join(refused, ["class_t", "class_e"], "left_anti")
    return cut(exact.unionByName(near)), members


def same_requests(rows: DataFrame) -> DataFrame:
    """``(row_a, row_b)`` of ``request_links``: one row for every pair of rows."""
    return expand(*request_links(rows))


def page_links(rows: DataFrame, least_agree: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """``(links, members)`` of rows of ``(row_id, train, pages array<string>)`` on different sides that show the same page.

    Rows with the same set of pages are a class. Pages are compared by the words of their visible text. Equal
    texts are joined by hash. Nearly equal ones share a band of a 128-value MinHash of their five-word shingles
    (32 bands of 4; pages that agree in 0.8 of their shingles are missed once in 10^7) and are then verified:
    at least ``least_agree`` of the words of the longer text, counted with repetition and compared by 64-bit
    hashes, must be in the other. Each page is compared once a side. Null arrays, null and empty pages and
    pages without visible words match nothing.
    """
    # a page shown by successive actions is read once; only rows that take part and have pages reach Python
    few = rows.where("train is not null and pages is not null").select("row_id", "train", F.array_distinct(F.filter("pages", lambda p: F.length(p) > 0)).alias("pages"))
    shown = cut(few.where(F.size("pages") > 0).mapInPandas(_pages, _PAGES))
    members = shown.select("row_id", "train", F.col("sid").alias("class")).distinct()
    sets = shown.select("train", "sid", "pid").distinct()
    t = sets.where("train").select(F.col("pid").alias("pid_t"), F.col("sid").alias("class_t"))
    e = sets.where("not train").select(F.col("pid").alias("pid_e"), F.col("sid").alias("class_e"))

    # each page once per side; the words are fetched only for pages that share a band
    sides = shown.select("train", "pid", "bands").dropDuplicates(["train", "pid"]).select("train", "pid", F.posexplode("bands").alias("band", "key"))
    sides = sides.select("train", "pid", F.xxhash64("band", "key").alias("band"))
    bt = sides.where("train").select("band", F.col("pid").alias("pid_t"))
    be = sides.where("not train").select("band", F.col("pid").alias("pid_e"))
    candidates = cut(blocked_join(bt, be, "band", "pid_t", "pid_e").select("pid_t", "pid_e").distinct())
    unequal = candidates.where("pid_t <> pid_e")
    wanted = unequal.select(F.col("pid_t").alias("pid")).union(unequal.select("pid_e")).distinct()
    bags = cut(shown.join(wanted, "pid", "left_semi").select("pid", "bag").dropDuplicates(["pid"]))
    both = unequal.join(bags.select(F.col("pid").alias("pid_t"), F.col("bag").alias("bag_t")), "pid_t")
    both = both.join(bags.select(F.col("pid").alias("pid_e"), F.col("bag").alias("bag_e")), "pid_e")
    agree = F.size(F.array_intersect("bag_t", "bag_e")) / F.greatest(F.size("bag_t"), F.size("bag_e"))
    alike = cut(both.where(agree >= least_agree).select("pid_t", "pid_e").unionByName(candidates.where("pid_t = pid_e")))
    linked = blocked_join(t, alike, "pid_t", "class_t", "pid_e").select("class_t", "pid_e")
    return cut(blocked_join(linked, e, "pid_e", "class_t", "class_e").select("class_t", "class_e").distinct()), members


def same_pages(rows: DataFrame, least_agree: float = 0.9) -> DataFrame:
    """``(row_a, row_b)`` of ``page_links``: one row for every pair of rows."""
    return expand(*page_links(rows, least_agree))
