import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.llm import quality, residue, truncation

CASES = {
    "Hello {{name}}, your order ${order.id} is ready": "placeholder", "__site__ | Portal": "placeholder", "[Your company name] - [Your slogan]": "placeholder",
    "Menu %%CITY%% and more": "placeholder", "<%= user.name %>": "placeholder", "[[query]]": "placeholder", "Track [orderId] order": "placeholder",
    "Lorem ipsum dolor sit amet": "filler", "lorem ipsum " * 20_000: "filler", "x" * 90_000: "filler", "Labore et dolore lorem elit.": "filler", "xxxx xxx xx": "filler", "Sample text sample text sample text": "filler", "TODO: write copy": "filler",
    "Texte à remplacer, texte à remplacer.": "filler", "Your title goes here": "filler",
    "404 Not Found": "error", "HTTP 504 - Gateway Timeout": "error", "Page not found": "error", "Your session has expired. Please sign in again.": "error", "Error": "error",
    "The request has timed out. Go back to the start page.": "error", "Seite nicht gefunden": "error", "Le serveur ne répond pas. Revenez plus tard.": "error",
    "Fatal error: Uncaught TypeError in /srv/app.php on line 3": "error", "Se ha producido un error en el servidor.": "error", "ACCESS DENIED": "error",
    "Please enable JavaScript to continue.": "scripts", "Diese Anwendung benötigt aktivierte Skripte.": "scripts", "Votre navigateur bloque les scripts.": "scripts",
    "Esta aplicación requiere scripts habilitados.": "scripts", "noscript: turn js on": "scripts",
}
OTHERS = [
    "To greet readers, write {{name}} in the mail editor and we swap in the real name.", "The quote keeps its spelling [sic] and cites 3 sources [1].", "Members pay $10 a month, which is 20% off.",
    "How to design a friendly 404 page", "Room 404 at Hotel X", "JavaScript for beginners: 30 lessons", "Lorem ipsum generator compared with 5 others", "Not Found: a short film from Bern",
    "The survey asks for the standard error of each reading.", "The shop opens at nine.", "", "   \n", None, "Browsers let you disable JavaScript per site, and this article compares 5 ways to do it.",
    "The new release fixes a bug where large baskets returned error 500 for some shoppers in Bern.", "The shop opens at nine. " * 10_000, "ipsum kettle lamp tent sofa " * 20_000,
]


def found(spark, rows):
    df = spark.createDataFrame(rows, "src string, rec_id long, field string, website string, text string").withColumn("kind", F.lit("clash")).withColumn("line", F.lit(1))
    return {(r.rec_id, r.field): r.kind for r in residue.residue(df).collect()}


def test_residue_rules(spark):
    texts = [*CASES, *OTHERS]
    got = found(spark, [("s", i, "text", f"w{i % 3}", t) for i, t in enumerate(texts)])
    assert {texts[i]: k for (i, _), k in got.items()} == CASES


def test_menu_words_and_headings(spark):
    menus = [("s", 1000 + i, "text", f"w{i}.test", f"Home\nContact\nArticle {i}\nThe team of shop {i} repairs old radios for everyone.") for i in range(20)]
    rows = [
        ("s", 1, "text", "w1.test", "Home\nPage not found\nContact"), ("s", 2, "text", "w1.test", "Home\nPage not found\nThe team repairs old radios every day."),
        ("s", 3, "text", "w1.test", "Green kettle Bern\nPage not found"), ("s", 4, "text", "w1.test", "Green kettle Bern\nLorem ipsum dolor\nSample text sample text"),
        ("s", 5, "title", "w1.test", "Access Denied | Portal"), ("s", 6, "title", None, "Green kettle | Portal"), ("s", 1, "title", "w", "Error 500"),
    ]
    assert found(spark, menus + rows) == {(1, "text"): "error", (4, "text"): "filler", (5, "title"): "error", (1, "title"): "error"}
    assert found(spark, []) == {}
    assert found(spark, [rows[6]] * 2) == {(1, "title"): "error"}


@pytest.fixture(scope="module")
def cut_rows():
    """Texts of five sources: cut at 40 characters, at 64 bytes, at 30 with a mark, mid-transfer, and never."""
    rng = random.Random(5)
    nouns, verbs, ends = "kettle lamp tent drill sofa desk".split(), "loads keeps shows".split(), ["in the upper corner", "from any device", "before you pay", "on the following page"]
    ui = ["Add to basket", "Load more…", "Number of guests", "Next page"]
    rows, truth = [], set()
    for i in range(6000):
        n, v = rng.choice(nouns), rng.choice(verbs)
        kind = rng.random()
        if kind < 0.3:
            t = rng.choice(ui)
        elif kind < 0.6:
            t = f"Grüne {n} {''.join(rng.choice('aeioulmn') for _ in range(rng.randint(3, 9))).title()}, {rng.randint(1, 400)}.{rng.randint(10, 99)} EUR, {rng.choice(ends)}"
        else:
            t = " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} {rng.choice(["é", "e", "éé", "a"])} {rng.choice(ends)}." for _ in range(rng.randint(1, 3)))
        source = ["chars", "bytes", "marked", "stream", "whole"][i % 5]
        full = t
        if source == "chars":
            t = t[:40].rstrip()
        elif source == "bytes":
            t = t.encode()[:64].decode(errors="replace")
        elif source == "marked" and len(t) > 30:
            t = t[:29].rstrip() + "…"
        elif source == "stream" and rng.random() < 0.05 and len(t) > 12:
            t = t[: rng.randint(8, len(t) - 3)]
        rows.append((i, source, t, "clash"))
        if t != full:
            truth.add(i)
    return rows, truth


def test_truncation(spark, cut_rows):
    rows, truth = cut_rows
    df = spark.createDataFrame(rows, "k long, source string, t string, field string")
    got = {r.key for r in truncation.truncated(df, "k", "source", ["t"]).where("cut").collect()}
    hard = {i for i in truth if rows[i][1] == "stream"}
    assert len(got & truth) / len(got) > 0.97 and len(got & (truth - hard)) / len(truth - hard) > 0.95 and len(got & hard) / len(hard) > 0.7
    long = df.select("source", F.lit("t").alias("field"), *[c.alias(e) for e, c in truncation.encoded_lengths(F.col("t")).items()])
    limits = {r.source: (r.encoding, r.limit) for r in truncation.storage_limits(long).collect()}
    assert limits == {"chars": ("chars", 40), "bytes": ("utf8", 64), "marked": ("chars", 30)}


def test_encodings(spark):
    texts = ["a&b<c>\"d'", "é😀\n", "x��", "plain"]
    got = [r.asDict() for r in spark.createDataFrame([(t,) for t in texts], "t string").select(*[c.alias(e) for e, c in truncation.encoded_lengths(F.col("t")).items()]).collect()]
    assert got[0] == {"chars": 9, "utf16": 9, "utf8": 9, "html": 28, "json": 10, "crlf": 9}
    assert got[1] == {"chars": 3, "utf16": 4, "utf8": 7, "html": 3, "json": 4, "crlf": 4}
    assert set(got[2].values()) == {1} and set(got[3].values()) == {5}


def test_truncation_edges(spark):
    rows = [(1, None, None), (2, "s", " "), (3, None, '{"a": 1'), (4, "s", '{"a": 1}'), (5, "s", "half�"), (6, "s", "w " * 30_000 + "end.")]
    df = spark.createDataFrame(rows, "k long, source string, t string")
    assert {r.key: r.cut for r in truncation.truncated(df, "k", "source", ["t"]).collect()} == {3: True, 4: False, 5: True, 6: False}
    assert truncation.truncated(df.where("false"), "k", "source", ["t"]).count() == 0


def docs(rng, n):
    names = lambda: "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(3)).title()
    out = []
    for i in range(n):
        k = i % 4
        if k == 0:
            t = " ".join(f"The {rng.choice(['team', 'shop', 'agent'])} of {names()} {rng.choice(['keeps', 'shows'])} the list that we had in the {names()}." for _ in range(rng.randint(1, 6)))
            kind = "prose"
        elif k == 1:
            t, kind = "\n".join(f"- {names()} {names()}" for _ in range(rng.randint(4, 12))), "list"
        elif k == 2:
            t, kind = "\n".join(f"{names()} | {rng.randint(1, 900)} | 2025-01-{rng.randint(10, 30)}" for _ in range(rng.randint(3, 9))), "table"
        else:
            t, kind = rng.choice(["*** +++ ===" * 9, "".join(rng.choice("abcXYZ0189+/") for _ in range(90)), "null " * 30, '{"a_1": null, "b_2": [1, 2]}' * 4]), "junk"
        out.append((i, t, kind))
    return out


def test_quality_held_out(spark):
    train, test = docs(random.Random(1), 600), docs(random.Random(2), 400)
    test += [(9001, None, None), (9002, " \n", None), (9003, "word " * 40_000 + "the end of it.", None)]
    df = spark.createDataFrame([(10_000 + i, t, "x") for i, t, _ in train] + [(i, t, "x") for i, t, _ in test], "d long, text string, kind string")
    labels = spark.createDataFrame([(10_000 + i, k) for i, _, k in train] + [(10_001, "list"), (77_777, "junk"), (10_002, "odd")], "d long, kind string")
    got = {r.d: r.kind for r in quality.classify(df, labels, "d", "text").collect()}
    want = {i: k for i, _, k in test if k}
    assert sum(got[i] == k for i, k in want.items()) / len(want) > 0.97
    assert sum((got[i] != "prose") == (k != "prose") for i, k in want.items()) / len(want) > 0.98
    assert got[9001] is None and got[9002] is None and got[9003] is not None


def test_statistics_and_rules(spark):
    r = quality.statistics(spark.createDataFrame([(1, "The cat sat.\n- x"), (2, None)], "d long, t string"), "d", "t").orderBy("d").collect()
    assert (r[0].word_count, r[0].punct_line_share, r[0].bullet_line_share) == (4.0, 0.5, 0.5) and r[0].common_share == 0.25
    assert r[1].blank and r[1].word_count == 0 and r[1].symbol_share == 0
    assert quality.induce(np.empty((0, len(quality.FEATURES))), np.array([], str)) == []
    empty = spark.createDataFrame([], "d long, kind string")
    got = quality.classify(spark.createDataFrame([(1, "Some text here."), (2, "")], "d long, text string"), empty, "d", "text").collect()
    assert {x.d: x.kind for x in got} == {1: "prose", 2: None}


def test_recurring_notices_long_messages_and_long_placeholders(spark):
    unknown = "Questo negozio riapre tra poco, torna a trovarci"
    rows = [("live_runs", i, "final_text", f"site{i}", f"{unknown} {i}" if i < 41 else f"Own words of site number {'abcdefghij'[i % 10] * (i - 39)} about its goods and people.") for i in range(80)]
    long = "We could not load the page. " + "The people who look after this service have been told and work on it right now, so " * 5 + "please come back."
    rows += [
        ("live_runs", 100, "final_text", "a", long), ("live_runs", 101, "final_text", "a", "Dear {{ " + "customer.first_name | default('friend') | " * 4 + "title }}"),
        ("live_runs", 102, "final_text", "a", "Dear {{\n name\n}}"), ("live_runs", 103, "final_text", "b", "Error 1020 Ray ID 7d"), ("live_runs", 104, "final_text", "b", "Pagina non trovata"),
        ("live_runs", 105, "final_text", "b", "The harbour museum opens at ten. " + "It shows boats, nets and tools of the people who fished here, and more " * 6 + "for all."),
        ("live_runs", 106, "final_text", None, None), ("live_runs", 107, "final_text", None, " \n\t"),
    ]
    df = spark.createDataFrame(rows, "src string, rec_id long, field string, website string, text string").withColumn("kind", F.lit("clash"))
    got = {r.rec_id: r.kind for r in residue.residue(df).collect()}
    assert {i for i in got if i < 100} == set(range(41)) and {got[i] for i in range(41)} == {"notice"}
    assert {i: k for i, k in got.items() if i >= 100} == {100: "error", 101: "placeholder", 102: "placeholder", 103: "error", 104: "error"}
    assert residue.residue(df.limit(0)).count() == 0
