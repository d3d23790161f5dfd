"""Corpus pipeline over ``documents``: language, near-duplicates, benchmark, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns, but for
the last, the same columns. Rows keep extra columns of any name. Null and empty texts, texts
without letters among them, are rejected by the first stage; an empty table passes through
all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqspark.llm import decontam, langid, packing, pii, simhash
from seqspark.llm.common import stored, table

#: A document whose largest language has a smaller share than this has no language.
LEAST_SHARE = 0.5


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """Columns under plain numbered names, so that results cannot clash with them."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: letters, and one with at least half of the text."""
    model = langid.fit(langid.learnable(docs), "text", "lang")
    rows, names, text = _carried(docs)
    found = langid.predict(rows, names, text, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return found.select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents linked by 80 % of their five-word
    shingles. Rows without an id stay; rows that share an id stay or go together."""
    groups = simhash.similar_groups(docs, "doc_id", "text", k=5, similarity=0.8)
    gone = stored(groups.filter(F.col("doc_id") != F.col("group")).select(F.col("doc_id").alias("_gone")), "duplicates")
    gone = decontam.bounded(gone)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item; rows without an id stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind in brackets."""
    model = pii.fit(docs, "doc_id", "text")
    rows, names, text = _carried(docs)
    found = pii.detect(rows, names, text, model, masked=True)
    values = {text: F.col("masked")}
    if "n_chars" in docs.columns:
        values[names[docs.columns.index("n_chars")]] = F.char_length("masked").cast(docs.schema["n_chars"].dataType)
    return found.select(*[values.get(n, F.col(n)).alias(n) for n in names]).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_personal_data", mask_personal_data),
    ("pack", pack),
]

#: SQL can express neither the language model nor the field; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
