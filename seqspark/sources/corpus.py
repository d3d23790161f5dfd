"""Encoded corpora, vocabulary files, vectors, alignments and result records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqspark.consts import PLAIN_SPECIALS
from seqspark.functions import text as tx
from seqspark.operators.vocab import specials
from seqspark.session import local_table
from seqspark.sources.text import read_lines, read_numbered, write_lines


def write_encoded(df: DataFrame, path: str, ids: str = "ids", mode: str = "append") -> None:
    """Parquet with a ``size`` column, so that size filters never read the tokens.

    Workers append shards under the commit protocol; nothing has to be merged.
    """
    df.withColumn("size", F.size(ids)).write.mode(mode).parquet(path)


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_clustered(df: DataFrame, path: str, key: str, files: int, ids: str = "ids") -> None:
    """An encoded corpus in ``files`` ranges of ``key``, sorted inside, for ``lookup``. Rows of one key
    may lie in several files; null keys are kept and never found."""
    sized = df.withColumn("size", F.size(ids))
    sized.repartitionByRange(files, key, F.xxhash64(ids)).sortWithinPartitions(key).write.parquet(path)
    spans = read_encoded(df.sparkSession, path).groupBy(F.col("_metadata.file_path").alias("file"))
    spans.agg(F.min(key).alias("least"), F.max(key).alias("most")).write.parquet(f"{path}{SPANS}")


SPANS = "-spans"


def lookup(spark: SparkSession, path: str, wanted: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """The rows of a clustered corpus whose ``key`` is in ``wanted``, a table with that column.

    Up to ``most`` distinct keys, only the files whose range holds one are opened (the table of
    ranges has a row per file) and the scan skips row groups outside their range; more keys
    are joined with the whole corpus.
    """
    keys = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    listed = keys.limit(most + 1).collect()
    stored = read_encoded(spark, path)
    if len(listed) > most:
        return stored.join(keys, key, "left_semi")
    if not listed:
        return stored.limit(0)
    keys = F.broadcast(local_table(spark, [tuple(r) for r in listed], keys.schema))
    spans = spark.read.parquet(f"{path}{SPANS}")
    hit = spans.join(keys, (spans["least"] <= keys[key]) & (keys[key] <= spans["most"]), "left_semi")
    files = [r["file"] for r in hit.select("file").collect()]
    if not files:
        return stored.limit(0)
    ends = [min(r[0] for r in listed), max(r[0] for r in listed)]
    return spark.read.schema(stored.schema).parquet(*files).filter(F.col(key).between(*ends)).join(keys, key, "left_semi")


def save_vocab(vocab: DataFrame, path: str) -> None:
    """``symbol count`` lines in id order, reserved symbols left out."""
    words = vocab.filter("not is_special")
    write_lines(words, path, F.concat_ws(" ", "token", F.col("cnt").cast("string")), ["token_id"])


def load_vocab(spark: SparkSession, path: str, names: list[str] = PLAIN_SPECIALS) -> DataFrame:
    """Ids are line ordinals after the reserved symbols; split on the last space."""
    pattern = r"^(.*) (\d+)$"
    rows = read_numbered(spark, path).select(
        (F.col("line_no") + len(names)).alias("token_id"),
        F.regexp_extract("line", pattern, 1).alias("token"),
        F.regexp_extract("line", pattern, 2).cast("bigint").alias("cnt"),
        F.lit(False).alias("is_special"),
    )
    reserved = specials(spark, names).select(
        "token_id", "token", F.lit(0).cast("bigint").alias("cnt"), F.lit(True).alias("is_special")
    )
    return reserved.unionByName(rows)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word f1 ... fd`` lines after a header line; of a word's several vectors the last."""
    parts = read_numbered(spark, path).filter("line_no > 0").withColumn("_f", F.split(F.rtrim("line"), " "))
    vector = F.slice("_f", 2, F.size("_f") - 1).cast("array<float>")
    rows = parts.select(F.get("_f", F.lit(0)).alias("token"), vector.alias("vector"), "line_no")
    return rows.groupBy("token").agg(F.max_by("vector", "line_no").alias("vector"))


def parse_alignment(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """``0-0 1-2`` links: one row per link."""
    link = df.select(*keep, F.posexplode(tx.words(F.col(line))).alias("link", "_l"))
    pair = F.split("_l", "-")
    return link.select(*keep, "link", pair[0].cast("bigint").alias("src_pos"), pair[1].cast("bigint").alias("tgt_pos"))


def write_align_dict(align: DataFrame, path: str) -> None:
    write_lines(align, path, F.concat_ws(" ", "src", "tgt"))


def read_align_dict(spark: SparkSession, path: str) -> DataFrame:
    """First two columns of each line."""
    cols = tx.words(F.col("line"))
    return read_lines(spark, path).select(F.get(cols, F.lit(0)).alias("src"), F.get(cols, F.lit(1)).alias("tgt"))


def result_records(results: DataFrame, key: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """Tagged tab-separated records, e.g. ``H-3<TAB>score<TAB>text``, ordered inside a sample.

    ``fields`` maps a tag to the columns of its record; the record order is the map order.
    """
    name = F.concat_ws("-", *[F.col(k).cast("string") for k in key])
    record = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.concat_ws("\t", F.concat(F.lit(f"{tag}-"), name), *[F.col(c).cast("string") for c in cols]).alias("record"))
            for i, (tag, cols) in enumerate(fields.items())
        ]
    )
    return results.select(*key, F.inline(record))
