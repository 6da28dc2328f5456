import random

from pagetrail.llm import overlap as O

BASE = "Order a green lamp by Tordel for 7 people, in Zelmar, on November 3 and under 40 euros"


def test_request_key_same():
    same = [
        "ORDER A GREEN LAMP BY TORDEL FOR 7 PEOPLE, IN ZELMAR, ON NOVEMBER 3 AND UNDER 40 EUROS", "Please order a green lamp by Tordel in Zelmar for seven people under 40 EUR & on Nov 3.",
        "I want to order  a  green lamp by Torled under 40 euros, for 7 people, on Novmeber 3 and in Zelmár", "Task: order a green lamp by Tordel on November 3, for 7 people, in Zelma,r under 40 €",
    ]
    assert {O.request_key(t) for t in same} == {O.request_key(BASE)}


def test_request_key_other():
    other = [
        BASE.replace("Zelmar", "Zelmor"), BASE.replace("7", "8"), BASE.replace("40", "04"), BASE.replace("November", "December"), BASE.replace(" and under 40 euros", ""),
        BASE.replace("Tordel", "X").replace("Zelmar", "Tordel").replace("X", "Zelmar"), BASE.replace("green", "red"), BASE + " sorted by price",
    ]
    keys = {O.request_key(t) for t in [BASE, *other]}
    assert len(keys) == len(other) + 1
    assert [O.request_key(t) for t in (None, "", " .!")] == [None] * 3


def test_same_requests(spark):
    rows = [(1, True, BASE), (2, False, BASE.lower()), (3, False, BASE), (4, None, BASE), (5, True, None), (6, False, ""), (7, True, BASE), (8, False, "x" * 100_000)]
    got = {tuple(r) for r in O.same_requests(spark.createDataFrame(rows, "row_id long, train boolean, text string")).collect()}
    assert got == {(1, 2), (1, 3), (2, 7), (3, 7)}
    assert O.same_requests(spark.createDataFrame([], "row_id long, train boolean, text string")).count() == 0


def page(words, tag="p"):
    return f"<html><!-- v1 --><{tag} id='x'>" + f"</{tag}><{tag}>".join(words) + f"</{tag}><script>var a = 1;</script></html>"


def test_same_pages_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(4000)]
    texts = [[rng.choice(vocab) for _ in range(rng.randint(60, 200))] for _ in range(60)]
    for t in list(texts[:30]):
        u = list(t)
        for _ in range(rng.choice([0, 1, 2, 3, 30])):
            u[rng.randrange(len(u))] = rng.choice(vocab)
        texts.append(u)
    rows = [(i, i < 60 if i % 9 else None, [page(t, "div" if i % 3 else "li"), None, ""] + ([page(texts[0])] if i == 85 else [])) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(900, True, None), (901, False, []), (902, False, ["<p> </p>"]), (903, True, ["<p></p>"])]
    got = [tuple(r) for r in O.same_pages(spark.createDataFrame(rows, "row_id long, train boolean, pages array<string>")).collect()]
    from collections import Counter

    bags = [(i, tr, [Counter(O.visible_words(p)) for p in ps or [] if p]) for i, tr, ps in rows if tr is not None]
    alike = lambda a, b: a and b and sum((a & b).values()) >= 0.9 * max(sum(a.values()), sum(b.values()))
    want = {(min(i, j), max(i, j)) for i, a, p in bags for j, b, q in bags if a and not b and any(alike(x, y) for x in p for y in q)}
    assert set(got) == want and len(got) == len(want) and len(want) > 5


def test_visible_words():
    assert O.visible_words('<a href="x">Cafés &amp; <b>BARS</b></a><style>p{}</style><!-- no --><script>if (a < b) {}</script>') == ["cafes", "bars"]


def test_slips():
    assert [O.slip(*w) for w in (("review", "reveiw"), ("tent", "tents"), ("tent", "teent"), ("lamp", "lump"), ("salem", "males"), ("nice", "cine"), ("10", "11"))] == ["swapped", "lost", "lost", "wrong", None, None, None]


def same(a, b):
    wa, wb = O.request_words(a), O.request_words(b)
    return bool(set(O.request_blocks(wa)) & set(O.request_blocks(wb))) and O.same_request(wa, wb) is not None


def test_requests_of_other_things():
    assert not same("Book a room in Salem", "Book a room in Males") and not same("Find trains to Nice", "Find trains to Cine")
    assert not same("Find a red lamp and a green sofa", "Find a green lamp and a red sofa")
    assert same("Find a red lamp and a green sofa", "Find a green sofa and a red lamp") and same("Book for thirty people", "Book for 30 people")
    assert same("Rent 25 chairs", "Rent twenty five chairs") and not same("Rent 25 chairs", "Rent 26 chairs")


def test_slips_of_all_kinds_against_frequency(spark):
    """One slip in any word of the template is found; a name with another letter is another name."""
    rng = random.Random(9)
    names = ["".join(rng.choice(["tor", "vel", "mar", "zel", "bru", "kor", "gal"]) for _ in range(3)) for _ in range(40)]
    rows = [(i, True, f"Reserve a sturdy ladder in {n} with pickup at the central station and under {i} euros") for i, n in enumerate(names)]
    want, lost = set(), 0
    for i in range(40):
        words = rows[i][2].split()
        at = rng.choice([0, 2, 3, 7, 10, 11])
        w = words[at]
        k = rng.randrange(1, len(w) - 2)
        words[at] = [w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + "q" + w[k + 1 :]][i % 4]
        rows.append((100 + i, False, " ".join(words)))
        want.add((i, 100 + i))
    rows.append((500, False, rows[0][2].replace(names[0], names[0][:-1] + "x")))
    got = {tuple(r) for r in O.same_requests(spark.createDataFrame(rows, "row_id long, train boolean, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want), want - got


def test_hot_classes_are_joined_in_blocks_and_counted_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 7)
    rows = [(i, i % 3 > 0, BASE if i < 90 else f"{BASE} sorted by {i}") for i in range(100)]
    links, members = O.request_links(spark.createDataFrame(rows, "row_id long, train boolean, text string"))
    pairs = [tuple(r) for r in O.expand(links, members).collect()]
    assert len(pairs) == len(set(pairs)) == 30 * 60
    assert {r.row_id: r.n for r in O.counts(links, members).collect()} == {i: 60 for i in range(0, 90, 3)}
