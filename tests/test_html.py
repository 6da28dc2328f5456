from pagetrail.operators import html as H
from pagetrail.operators.cases import parsed_steps

PAGE = (
    '<html><nav><a backend_node_id="1" href="/">Home</a></nav><h2>Scores</h2><ul><li>Row one <a backend_node_id="10" href="/nfl">NFL Scores</a></li></ul>'
    '<input backend_node_id="20" placeholder="Find"/><button backend_node_id="30"><svg backend_node_id="31"></svg>Search</button>'
    '<div backend_node_id="40">Footer<label backend_node_id="41"><span><input backend_node_id="42" type="checkbox" name="agree"></span></label></div>'
    '<script>var x = "</p><a>no</a>";</script><p>Unclosed <b>bold</html>'
)


def elements(spark, page=PAGE):
    return H.described(H.elements(spark.createDataFrame([("p", page), ("null", None), ("empty", "")], "page_key string, html string")))


def test_elements(spark):
    rows = {r.node_id: r for r in elements(spark).where("node_id is not null").collect()}
    assert list(rows["20"].ops) == ["CLICK", "TYPE_TEXT"] and rows["20"].label == "Find" and rows["20"].role == "textbox"
    assert rows["10"].label == "NFL Scores" and rows["10"].section == "Scores" and rows["10"].row_text == "Row one NFL Scores"
    assert rows["1"].landmark == "nav" and rows["1"].section == "" and rows["10"].landmark == "main"
    assert rows["42"].role == "checkbox" and rows["42"].label == "agree"
    assert not rows["40"].interactive and rows["30"].label == "Search"


def test_nearest_interactive(spark):
    rows = elements(spark)
    wanted = rows.where("node_id in ('31', '40', '41')")
    found = {r.pos: r for r in H.nearest_interactive(rows, wanted).collect()}
    at = {r.node_id: r.pos for r in rows.where("node_id is not null").collect()}
    assert (found[at["31"]].to_pos, found[at["31"]].kind, found[at["31"]].distance) == (at["30"], "ancestor", 1)
    assert (found[at["40"]].to_pos, found[at["40"]].kind, found[at["40"]].distance) == (at["42"], "descendant", 3)
    assert found[at["41"]].to_pos == at["42"]


def test_deep_nesting(spark):
    page = "<div>" * 600 + '<a backend_node_id="600">deep</a>' + "</div>" * 600
    row = elements(spark, page).where("node_id = '600'").first()
    assert row.label == "deep" and row.depth == 600


def test_parsed_steps(spark):
    cand = "struct<tag:string,backend_node_id:string,attributes:string>"
    schema = f"task_row long, actions array<struct<operation:struct<op:string,value:string>,pos_candidates:array<{cand}>,neg_candidates:array<{cand}>>>"
    a, inp, btn, div = ("a", "10", "{}"), ("input", "20", "{}"), ("button", "30", None), ("div", "40", "not json")
    rows = [
        (1, [(("CLICK", None), [a], [inp, btn, div]), (("TYPE", "abc"), [inp], [a]), (("CLICK", None), [div], [a]), (("TYPE", "x"), [btn], [])]),
        (2, [(("CLICK", None), [div, btn], [None, btn]), None, (("CLICK", None), None, None), (("HOVER", None), [a], [])]),
        (3, None),
    ]
    got = {(r.task_row, r.step): (r.op, r.gold_id, r.pool_size, r.drop_reason) for r in parsed_steps(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, 0): ("CLICK", "10", 3, None), (1, 1): ("TYPE_TEXT", "20", 2, None), (1, 2): ("CLICK", "40", 1, "gold_not_interactive"), (1, 3): ("TYPE_TEXT", "30", 1, "op_not_allowed"),
        (2, 0): ("CLICK", "30", 1, None), (2, 2): ("CLICK", None, 0, "no_gold"), (2, 3): ("HOVER", "10", 1, "op_not_allowed"),
    }
