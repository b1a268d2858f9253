"""Intermediate tables that outlive executors, and small local tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import AuditError

# A join side is broadcast up to this size, by its counted rows and the most
# bytes a row can have.
BROADCAST_BYTES = 64 << 20
TOKEN_ROW = 320  # column reference and token of at most 64 characters


def work_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where none is named, a local session gets a folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local"):
            raise AuditError("set spark.checkpoint.dir to a folder that all executors share", "no_work_folder")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="colsift-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, by a checkpoint in the work folder."""
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_columns(df: DataFrame) -> DataFrame:
    """Write a wide table once as Parquet in the work folder: later passes read the columns they need."""
    path = f"{work_folder(df.sparkSession).rstrip('/')}/colsift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast when its proven size is within the bound."""
    return df.hint("broadcast") if rows * row_bytes <= BROADCAST_BYTES else df


def local_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A DataFrame of a few facts; Spark knows its exact size."""
    table = pa.Table.from_pylist(
        [{f.name: row.get(f.name) for f in schema.fields} for row in rows],
        schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)
