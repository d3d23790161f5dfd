"""Text corpora: numbered lines, parallel files, split discovery."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seqspark.functions import text as tx
from seqspark.operators.examples import concat_corpora
from seqspark.session import local_table, scratch_dir


def read_lines(spark: SparkSession, path) -> DataFrame:
    """One row per line; Hadoop input splits do the byte-range work."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def _file_order(path: str) -> tuple:
    """Name order, but Spark's part files by number: names get longer beyond 99 999 parts."""
    folder, _, name = path.rpartition("/")
    part = re.match(r"part-(\d+)", name)
    return folder, (0, int(part[1]), name) if part else (1, 0, name)


def read_numbered(spark: SparkSession, path, place=_file_order, file: str | None = None) -> DataFrame:
    """Lines with their 0-based ordinal over all files in name order.

    One scan, no shuffle of the text: lines are written with their file, the start of their
    input split and their place in the scan. Lines are then counted per split (one row per
    split), and a split's offset is added to the position inside it. However a scan packs the
    splits, now or with other settings, a line gets the same ordinal, and nothing has to be
    the same in a second scan. ``place`` sorts the files; ``file`` adds their path.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_m"),
    )
    scanned = scratch_dir(spark, "scanned")
    raw.write.parquet(scanned)
    raw = spark.read.schema(raw.schema).parquet(scanned)
    splits = raw.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("_m0")).collect()
    offset, rows = 0, []
    for s in sorted(splits, key=lambda r: (place(r["_file"]), r["_start"])):
        rows.append((s["_file"], s["_start"], s["_m0"], offset))
        offset += s["n"]
    table = local_table(spark, rows, "_file string, _start bigint, _m0 bigint, _offset bigint")
    ordinal = (F.col("_offset") + F.col("_m") - F.col("_m0")).alias("line_no")
    return raw.join(table, ["_file", "_start"]).select(ordinal, "line", *([F.col("_file").alias(file)] if file else []))


def parallel(source: DataFrame, target: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Line i of one side with line i of the other; ``full`` keeps the longer side's rest."""
    left = source.withColumnRenamed("line", "source")
    right = target.withColumnRenamed("line", "target")
    return left.join(right, on, how)


def aligner_input(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """``src ||| tgt`` lines; a missing side is empty."""
    both = parallel(source, target, on, "full")
    joined = F.concat_ws(" ||| ", F.coalesce("source", F.lit("")), F.coalesce("target", F.lit("")))
    return both.select(*on, joined.alias("line"))


def corpus_splits(files: DataFrame, path: str = "path") -> DataFrame:
    """Split, part number and language pair from names like ``train2.de-en.de``.

    A part is used only when all lower-numbered parts of its split and pair exist.
    """
    name = r"(train|valid|test)(\d*)\.(\w+)-(\w+)\.(\w+)$"
    group = [F.regexp_extract(path, name, i) for i in range(1, 6)]
    parts = files.select(
        F.col(path).alias("path"),
        group[0].alias("split"),
        F.when(group[1] == "", F.lit(0)).otherwise(group[1].cast("bigint")).cast("bigint").alias("part"),
        group[2].alias("src"),
        group[3].alias("tgt"),
        group[4].alias("lang"),
    ).filter(F.col("split") != "")
    by = Window.partitionBy("split", "src", "tgt", "lang").orderBy("part")
    return parts.withColumn("used", F.dense_rank().over(by) - 1 == F.col("part"))


#: Names of split files, in a folder or as a value of a partition folder.
_SPLIT_NAME = r"(train|valid|test)(\d*)\.(\w+)-(\w+)\.(\w+)"


def find_splits(spark: SparkSession, folder: str) -> DataFrame:
    """``corpus_splits`` of what a folder holds; a split file may itself be a folder of parts.

    The folder is listed by Spark, so it may be in any store that Spark reads; no content is
    read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return corpus_splits(files.select(F.regexp_extract("path", rf"[/=]({_SPLIT_NAME})(/|$)", 1).alias("path")).distinct())


def load_split(spark: SparkSession, folder: str, split: str, source: str, target: str, lang: str, upsample: int = 1, combine: bool = True) -> DataFrame:
    """``(position, part, line)``: the lines of one side of a split, in one corpus.

    The parts ``train``, ``train1``, ... are taken until one is missing (only the first without
    ``combine``), in the order of their numbers, the first one ``upsample`` times. All parts
    are one scan. A split without its first part is an error.
    """
    found = find_splits(spark, folder).filter((F.col("split") == split) & (F.col("src") == source) & (F.col("tgt") == target) & (F.col("lang") == lang) & F.col("used"))
    parts = sorted(r["part"] for r in found.select("part").collect())[: None if combine else 1]
    if not parts:
        raise FileNotFoundError(f"no {split} split of {source}-{target}.{lang} in {folder}")
    names = "|".join(f"{split}{p or ''}" for p in parts)
    wanted = re.compile(rf"[/=]({names})\.{re.escape(source)}-{re.escape(target)}\.{re.escape(lang)}(/|$)")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    paths = [r["path"] for r in files.filter(F.col("path").rlike(wanted.pattern)).collect()]

    def number(path: str) -> int:
        return int(wanted.search(path)[1][len(split) :] or 0)

    rows = read_numbered(spark, paths, lambda path: (number(path), _file_order(path)), "_file")
    part = F.regexp_extract("_file", rf"[/=]{split}(\d*)\.", 1)
    rows = rows.select("line_no", "line", F.when(part == "", F.lit(0)).otherwise(part.cast("bigint")).cast("bigint").alias("part"))
    laid = concat_corpora(rows, "part", ["line_no"], {0: upsample}, parts)
    return laid.select(F.col("new_id").alias("position"), "part", "line")


def write_lines(df: DataFrame, path: str, line: Column, order: list | None = None) -> None:
    """Text sink; with ``order`` the part files in name order hold the sorted lines."""
    rows = df.orderBy(*order) if order else df
    rows.select(line.alias("value")).write.mode("errorifexists").text(path)


def pick_field(frames: list[DataFrame], line: str = "line", separator: str = ",", field: int = -1) -> DataFrame:
    """Concatenate files, drop blank lines, keep one separated field (last by default)."""
    rows = frames[0].select(line)
    for other in frames[1:]:
        rows = rows.unionByName(other.select(line))
    rows = rows.withColumn("_s", tx.strip(F.col(line))).filter(F.col("_s") != "")
    position = field + 1 if field >= 0 else field
    return rows.select(F.try_element_at(F.split("_s", separator), F.lit(position)).alias("value"))
