"""Query registry and the derived tables the queries share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqspark.functions import text as tx
from seqspark.operators import vocab as vb
from seqspark.session import fenced, written

QUERIES: dict = {}
ORACLES: dict = {}

NWORDS, THRESHOLD = 4000, 2
# Pair ids hold the whole turn number; an id too large for this fails instead of colliding.
PAIR_ID = 2**32


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under a name."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a few files over all cores before CPU-heavy row-local work.

    A corpus of at least as many files as cores is left alone, so this shuffles nothing
    at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Only the number of files is asked for; a long listing stays in the JVM.
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"))


def doc_lines(spark, d, *keep: str) -> DataFrame:
    """``(doc_id, line_no, line)``: the documents table as a line corpus."""
    docs = documents(spark, d)
    rows = docs.select("doc_id", *keep, F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no").cast("bigint"))


def doc_words(spark, d, *keep: str) -> DataFrame:
    return doc_lines(spark, d, *keep).withColumn("words", tx.words(F.col("line")))


def doc_counts(spark, d) -> DataFrame:
    return vb.count_text(documents(spark, d), "doc_id", "text")


def doc_vocab(spark, d) -> DataFrame:
    """Written once (at most ``NWORDS`` rows and the filling words), so that no second use counts again."""
    return written(vb.finalize(doc_counts(spark, d), THRESHOLD, NWORDS), "doc_vocab")


def encoded_lines(spark, d, *keep: str) -> DataFrame:
    """Lines with ``words`` and ``ids`` (no end mark yet)."""
    return vb.encode_text(doc_words(spark, d, *keep), "line", doc_vocab(spark, d))


def pairs(spark, d) -> DataFrame:
    """User turn ``t`` with the assistant turn ``t + 1`` of the same conversation."""
    turns = table(spark, d, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    both = user.join(reply, ["conv_id", "turn"])
    return both.withColumn("id", F.col("conv_id") * PAIR_ID + F.col("turn"))


def pair_words(spark, d) -> DataFrame:
    p = pairs(spark, d)
    return p.select("id", "conv_id", "turn", tx.words(F.col("source")).alias("sw"), tx.words(F.col("target")).alias("tw"))


def joined(col: str):
    """Array as one text column: engines agree on text more easily than on arrays."""
    return F.array_join(F.col(col).cast("array<string>"), " ")


def ids_text(col: str):
    """``joined`` for an array of whole numbers, cut and joined in Arrow batches."""
    return vb.joined_ids(col).alias(col)


def doc_stream(spark, d) -> DataFrame:
    """One row per document: ``ids`` of all its lines with end marks, and per token the
    line number (``line``) and the position inside the line (``off``)."""
    return vb.encode_lines(documents(spark, d).select("doc_id", "text"), "text", doc_vocab(spark, d)).drop("text")


def pieces(spark, d) -> DataFrame:
    """Lines cut into marked pieces of at most two per word, with the end mark."""

    @F.arrow_udf("array<string>")
    def cut(lines: pa.Array) -> pa.Array:
        return vb.split_texts(lines, _marked)

    rows = fenced(doc_lines(spark, d), "line")
    return rows.select("doc_id", "line_no", cut(F.col("line")).alias("pieces"))


def _marked(line: str) -> list[str]:
    out = []
    for w in line.split():
        out += (w[:3] + "@@", w[3:]) if len(w) > 3 else (w,)
    return [*out, "</s>"]
