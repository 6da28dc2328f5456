from pyspark.sql import functions as F

from pagetrail.operators.shred import adjacency, entity_table, last_ordinal

SCHEMA = "id long, node string, items array<struct<name:string,size:struct<w:int,h:int>,tags:array<string>,parts:array<struct<k:string,v:double>>>>"
ROWS = [
    (1, "x", [("a", (1, None), ["t", None, "u"], [("p", 0.5), None, ("q", None)]), None, ("b", None, None, [])]),
    (2, None, []),
    (3, "z", None),
    (4, "long", [("n" * 100_000, (2, 3), [], None)]),
]


def test_adjacency_keeps_everything_once(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    nodes = adjacency(df, "id").collect()
    by = {(r.record, r.node): r for r in nodes}
    assert len(by) == len(nodes)
    assert by[(1, "node")].scalar == "x" and (2, "node") not in by
    assert by[(1, "items.0.tags.2")].scalar == "u" and by[(1, "items.0.tags.2")].ordinal == 2
    assert (1, "items.1") not in by and by[(1, "items.2.name")].scalar == "b"
    assert by[(1, "items.0.size")].kind == "object" and (1, "items.0.size.h") not in by
    assert by[(1, "items.0.parts.2")].parent == "items.0"
    assert len(by[(4, "items.0.name")].scalar) == 100_000
    assert all(r.parent == "" or (r.record, r.parent) in by for r in nodes)


def test_entities_and_links(spark):
    nodes = adjacency(spark.createDataFrame(ROWS, SCHEMA), "id")
    items = {(r.record, r.ordinal): r for r in entity_table(nodes, "items", ["name"]).collect()}
    assert set(items) == {(1, 0), (1, 2), (4, 0)} and items[(1, 2)].name == "b"
    parts = entity_table(nodes, "parts", ["k", "v"]).withColumn("item", last_ordinal(F.col("parent"))).collect()
    assert sorted((r.record, r.item, r.ordinal, r.k, r.v) for r in parts) == [(1, 0, 0, "p", "0.5"), (1, 0, 2, "q", None)]


def test_round_trip(spark):
    """The tables can be put together again to what they came from (nulls inside arrays aside)."""
    nodes = adjacency(spark.createDataFrame(ROWS, SCHEMA), "id")
    parts = entity_table(nodes, "parts", ["k", "v"]).groupBy("record", "parent").agg(F.sort_array(F.collect_list(F.struct("ordinal", "k", "v"))).alias("p"))
    back = {(r.record, r.parent): [(x.ordinal, x.k, x.v) for x in r.p] for r in parts.collect()}
    assert back == {(1, "items.0"): [(0, "p", "0.5"), (2, "q", None)]}


def test_empty_repeated_and_clashing(spark):
    assert adjacency(spark.createDataFrame([], SCHEMA), "id").count() == 0
    clash = spark.createDataFrame([(7, "r", ["m"])], "record long, parent string, label array<string>")
    got = sorted((r.record, r.node, r.scalar) for r in adjacency(clash, "record").collect())
    assert got == [(7, "label.0", "m"), (7, "parent", "r")]
