"""Reading the project's Parquet tables with column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``; with ``columns``, only those are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def pruned(schema: T.DataType, keep: set[str]) -> T.DataType:
    """``schema`` with every struct reduced to the fields in ``keep`` (and to fields that still contain one)."""
    if isinstance(schema, T.StructType):
        fields = []
        for f in schema.fields:
            inner = pruned(f.dataType, keep)
            nested = isinstance(f.dataType, (T.StructType, T.ArrayType))
            if f.name in keep and not nested:
                fields.append(f)
            elif f.name in keep and inner is not None:
                fields.append(T.StructField(f.name, inner, f.nullable))
        return T.StructType(fields) if fields else None
    if isinstance(schema, T.ArrayType):
        inner = pruned(schema.elementType, keep) if isinstance(schema.elementType, (T.StructType, T.ArrayType)) else schema.elementType
        return None if inner is None else T.ArrayType(inner, schema.containsNull)
    return schema


def nested_table(spark: SparkSession, sf_dir: str, name: str, keep: set[str]) -> DataFrame:
    """Table ``name`` reduced at every level to the fields in ``keep``; Parquet reads only those leaves."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(pruned(spark.read.parquet(path).schema, keep)).parquet(path)


def utc(df: DataFrame, column: str) -> DataFrame:
    """A ``TIMESTAMP_NTZ`` column as ``TIMESTAMP`` (watermarks need one); the session time zone should be UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
