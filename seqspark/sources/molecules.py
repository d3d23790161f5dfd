"""Labelled molecule lines: ``smiles,prop0,prop1,...``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqspark.functions import text as tx
from seqspark.sources.text import read_numbered


def read_properties(spark: SparkSession, path, num_props: int, header: bool = True, **options) -> DataFrame:
    """``parse_properties`` of a file, with ``line_no``; the first line is a header by default."""
    rows = read_numbered(spark, path)
    return parse_properties(rows.filter("line_no > 0") if header else rows, num_props, **options)


def read_unlabelled(spark: SparkSession, path, header: bool = True, **options) -> DataFrame:
    """``first_field`` of a file, with ``line_no``; the first line is a header by default."""
    rows = read_numbered(spark, path)
    return first_field(rows.filter("line_no > 0") if header else rows, **options)


def parse_properties(
    lines: DataFrame,
    num_props: int,
    separator: str = ",",
    missing: str | None = "NaN",
    line: str = "line",
) -> DataFrame:
    """Adds ``smiles, props, present, ok``; blank lines vanish, bad rows get ``ok = false``.

    The missing symbol is compared per field before any cast (a cast would read ``NaN``
    as a number); a missing property has value 0 and mask false.
    """
    rows = lines.withColumn("_s", tx.strip(F.col(line))).filter(F.col("_s") != "")
    fields = rows.withColumn("_f", F.split("_s", F.lit(separator), -1))
    raw = F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(0)))
    gone = (lambda v: F.trim(v) == missing) if missing is not None else (lambda v: F.lit(False))
    fields = fields.withColumn("_raw", raw)
    values = F.transform("_raw", lambda v: F.when(gone(v), F.lit(0.0)).otherwise(v.try_cast("double")))
    out = fields.withColumn("smiles", F.get("_f", F.lit(0))).withColumn("props", values)
    out = out.withColumn("present", F.transform("_raw", lambda v: ~gone(v)))
    good = (F.size("props") == num_props) & ~F.exists("props", lambda v: v.isNull())
    return out.withColumn("ok", good).drop("_s", "_f", "_raw")


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("ok").drop("ok")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Lines with a wrong number of fields or an unreadable number."""
    return parsed.filter("not ok").drop("ok", "props", "present")


def first_field(lines: DataFrame, separator: str = ",", line: str = "line") -> DataFrame:
    """Unlabelled source: the string before the first separator."""
    rows = lines.withColumn("_s", tx.strip(F.col(line))).filter(F.col("_s") != "")
    return rows.withColumn("smiles", F.get(F.split("_s", F.lit(separator)), F.lit(0))).drop("_s")
