"""JSON and JSON-lines sources and sinks with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CANDIDATE = "array<struct<tag:string,backend_node_id:string,attributes:string>>"
TASK_SCHEMA = (
    "annotation_id string, website string, domain string, confirmed_task string, actions array<struct<action_uid:string,cleaned_html:string,"
    f"operation:struct<op:string,original_op:string,value:string>,pos_candidates:{_CANDIDATE},neg_candidates:{_CANDIDATE}>>"
)


def read_tasks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Task shards, each file one JSON array; a file is one input split, so a shard must fit an executor."""
    return spark.read.schema(TASK_SCHEMA).json(paths, multiLine=True)


def read_splits(spark: SparkSession, by_split: dict[str, str]) -> DataFrame:
    """Tasks with ``split`` from one glob per split; a split without any task is an error."""
    out = None
    for name, glob in by_split.items():
        part = read_tasks(spark, glob).withColumn("split", F.lit(name))
        if part.isEmpty():
            raise ValueError(f"no tasks for split {name!r} under {glob!r}")
        out = part if out is None else out.unionByName(part)
    return out


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, characters other than ASCII kept, nulls written."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_run_dir(spark: SparkSession, path: str, schema: str, glob: str = "*.json", excluding: str = "") -> DataFrame:
    """One JSON object per file, with ``file`` for an order by name; files whose name begins with ``excluding`` are left out."""
    df = spark.read.schema(schema).option("pathGlobFilter", glob).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    return df.where(~F.col("file").startswith(excluding)) if excluding else df


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as a single JSON object."""
    df.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
