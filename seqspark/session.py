"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def get_session(app: str = "seqspark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) is one chosen here:
    on a cluster a local folder would hold a part of each table on each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return os.path.join(tempfile.gettempdir(), "seqspark-scratch")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written below the shared folder and read again, so that later uses do not make them anew."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A DataFrame of rows the driver already holds, shipped as one Arrow batch."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    types = to_arrow_schema(struct)
    table = pa.table([pa.array(list(c), t.type) for c, t in zip(columns, types)], schema=types)
    return spark.createDataFrame(table, schema=struct)


def one_row(df: DataFrame) -> Column:
    """The columns of a one-row DataFrame as a struct value inside another query."""
    return df.select(F.struct(*df.columns)).scalar()


def fenced(df: DataFrame, *columns: str) -> DataFrame:
    """Compute columns below a one-row generator.

    The optimizer inlines column expressions into a Python function's arguments; behind
    the generator they are plain columns, made once per row.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint()
