"""Shredding nested records into an adjacency table and flat entity tables.

Every record becomes a tree of nodes. A node has an id (its Dewey path below the record, e.g.
``actions.0.pos_candidates.3``), its parent's id, a label (the field's or array's name), an ordinal (its place
in an array, -1 otherwise) and, for scalars, the value as a string. Object nodes joined with their scalar
children and pivoted by label give one entity table per array of objects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "array<struct<node:string,parent:string,label:string,ordinal:int,kind:string,scalar:string>>"


def _node(node: Column, parent: Column, label: str, ordinal: Column, kind: str, scalar: Column) -> Column:
    return F.struct(
        node.alias("node"), parent.alias("parent"), F.lit(label).alias("label"), ordinal.cast("int").alias("ordinal"),
        F.lit(kind).alias("kind"), scalar.cast("string").alias("scalar"),
    )


def _nodes(value: Column, kind: T.DataType, path: Column, parent: Column, label: str, ordinal: Column) -> Column:
    """The nodes of one value, itself included, as an array; an absent (null) value has none."""
    none = F.array().cast(NODE)
    if isinstance(kind, T.StructType):
        own = F.array(_node(path, parent, label, ordinal, "object", F.lit(None)))
        scalars = [
            F.array(_node(F.concat(path, F.lit("." + f.name)), path, f.name, F.lit(-1), "scalar", value[f.name]))
            for f in kind.fields
            if not isinstance(f.dataType, (T.StructType, T.ArrayType))
        ]
        nested = [
            _nodes(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name)), path, f.name, F.lit(-1))
            for f in kind.fields
            if isinstance(f.dataType, (T.StructType, T.ArrayType))
        ]
        present = F.filter(F.concat(own, *scalars), lambda n: (n["kind"] == "object") | n["scalar"].isNotNull())
        return F.when(value.isNull(), none).otherwise(F.concat(present, *nested))
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda e, i: _nodes(e, kind.elementType, F.concat(path, F.lit("."), i.cast("string")), parent, label, i))
        return F.coalesce(F.flatten(each), none)
    return F.when(value.isNull(), none).otherwise(F.array(_node(path, parent, label, ordinal, "scalar", value)))


def adjacency(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Adjacency table ``(record, node, parent, label, ordinal, kind, scalar)`` of ``columns`` (all but ``key``).

    ``record`` is the value of ``key``, which must be unique and not null. The root of a record has the id ``""``
    and no row. Null array elements and null fields have no node; the ordinals of later elements stay as they
    are. An empty or null array has no nodes. Rows are spread by ``record`` first, so grouping by
    ``(record, ...)`` needs no further exchange. Map columns aren't supported.
    """
    columns = [c for c in (columns or df.columns) if c != key]
    types = {f.name: f.dataType for f in df.schema.fields}
    root = F.lit("")
    parts = [_nodes(F.col(f"_v{i}"), types[c], F.lit(c), root, c, F.lit(-1)) for i, c in enumerate(columns)]
    rows = df.select(F.col(f"`{key}`").alias("record"), *[F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(columns)]).repartition("record")
    return rows.select("record", F.inline(F.concat(*parts)))


def entity_table(nodes: DataFrame, label: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per object node labelled ``label``: ``(record, node, parent, label, ordinal, *fields)``.

    An object is joined with its scalar children by grouping both on the object's id, and the children are
    pivoted by label; absent children are null. As ids are unique below a record, nothing is lost or made up.
    """
    labels = [label] if isinstance(label, str) else list(label)
    is_object = (F.col("kind") == "object") & F.col("label").isin(labels)
    child_of = F.when(is_object, F.col("node")).otherwise(F.col("parent"))
    wanted = nodes.where(is_object | ((F.col("kind") == "scalar") & F.col("label").isin(list(fields))))
    joined = wanted.groupBy("record", child_of.alias("node")).agg(
        F.max(F.when(is_object, F.struct("label", "ordinal", "parent"))).alias("_o"),
        *[F.max(F.when(~is_object & (F.col("label") == f), F.col("scalar"))).alias(f) for f in fields],
    )
    return joined.where(F.col("_o").isNotNull()).select("record", "node", F.col("_o.parent").alias("parent"), F.col("_o.label").alias("label"), F.col("_o.ordinal").alias("ordinal"), *fields)


def last_ordinal(node: Column) -> Column:
    """The place in its array that a node id ends with, or -1: ids are Dewey paths, so no join is needed."""
    return F.coalesce(F.regexp_extract(node, r"\.(\d+)$", 1).try_cast("int"), F.lit(-1))
