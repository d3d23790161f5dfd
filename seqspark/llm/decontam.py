"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document if at least ``threshold`` of its distinct word shingles occur
there. Items are partitioned by size (number of distinct shingles, in powers of two). In the
partition with sizes up to u an item is sketched by its ``floor((1 - threshold) * u) + 1``
smallest shingle hashes. A document that contains the item lacks at most ``(1 - threshold)``
of its shingles, so it must hold the rest of the sketch, at least one hash: the search over
the sketches misses nothing, and asking for that many hits keeps chance matches out.
Candidates are verified by the shingles themselves. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqspark.llm.common import stored, table

WORDS, THRESHOLD = 5, 0.8
#: Tables of hashes and ids are broadcast up to this many rows (about 20 MB), else joined.
BROADCAST_ROWS = 500_000
#: Shingles of a document are made in runs of this many words.
RUN = 4096


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(df: DataFrame, key: list[str], text: str, k: int) -> DataFrame:
    """``key`` and the ``k`` words ``_0 .. _{k-1}`` of every shingle, repeats included."""
    rows = df.select(*key, words(F.col(text)).alias("_w")).filter(F.size("_w") >= k)
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_w") - (k - 1), F.lit(RUN))))
    count = F.least(F.lit(RUN), F.size("_w") - (k - 2) - F.col("_at"))
    parts = [F.slice("_w", F.col("_at") + i, count).alias(f"_{i}") for i in range(k)]
    return rows.select(*key, F.inline(F.arrays_zip(*parts)).alias(*[f"_{i}" for i in range(k)]))


def _hash(k: int) -> Column:
    return F.xxhash64(*[f"_{i}" for i in range(k)])


def _text(k: int) -> Column:
    return F.concat_ws(" ", *[f"_{i}" for i in range(k)])


def bounded(df: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint where its counted size allows one."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Distinct shingles of distinct items: ``item_id``, ``item_copies``, ``shingles`` (their
    number), ``shingle`` and ``hash``. Items equal in words go under their smallest id."""
    rows = items.select(F.col(key).alias("_id"), F.concat_ws(" ", words(F.col(text))).alias("_body"))
    same = rows.groupBy("_body").agg(F.min("_id").alias("item_id"), F.count("*").alias("item_copies"))
    found = shingles(same, ["item_id", "item_copies"], "_body", k).select("item_id", "item_copies", _text(k).alias("shingle"), _hash(k).alias("hash")).distinct()
    number = F.count("*").over(Window.partitionBy("item_id"))
    return found.withColumn("shingles", number)


def sketches(found: DataFrame, threshold: float) -> DataFrame:
    """``(hash, item_id, need)``: sketch hashes and how many of them a document must have."""
    top = F.expr("cast(shiftleft(1, cast(floor(log2(shingles)) as int) + 1) - 1 as double)")
    size = F.least(F.col("shingles"), F.floor(F.lit(1 - threshold) * top + 1e-9) + 1)
    lacking = F.col("shingles") - F.ceil(F.lit(threshold) * F.col("shingles") - 1e-9)
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("hash", "shingle"))
    rows = found.withColumn("_nth", nth).withColumn("_size", size).filter("_nth <= _size")
    return rows.select("hash", "item_id", (F.col("_size") - lacking).cast("bigint").alias("need"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``(key, item_id, item_copies, shingles, hits, containment)`` of every match.

    Items and documents of fewer than ``k`` words (null and empty texts too) have no shingle
    and match nothing; rows without a key are not reported. Rows that share a key count as
    one document. Items equal in words are one item with its smallest id; their number is
    ``item_copies``. Empty tables give no rows.
    """
    source = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_t")).filter(F.col("_doc").isNotNull())
    found = stored(item_shingles(items.filter(F.col(item_key).isNotNull()), item_key, item_text, k), "items")
    index = bounded(stored(sketches(found, threshold), "sketches"))
    hits = shingles(source, ["_doc"], "_t", k).select("_doc", _hash(k).alias("hash")).join(index, "hash")
    pairs = hits.groupBy("_doc", "item_id", "need", "hash").agg(F.lit(1)).groupBy("_doc", "item_id", "need").count()
    pairs = stored(pairs.filter("count >= need").select("_doc", "item_id"), "candidates")
    wanted = bounded(pairs.select("_doc").distinct())
    exact = shingles(source.join(wanted, "_doc", "left_semi"), ["_doc"], "_t", k).select("_doc", _text(k).alias("shingle"))
    exact = exact.join(bounded(found.drop("hash")), "shingle").join(pairs, ["_doc", "item_id"])
    group = ["_doc", "item_id", "item_copies", "shingles"]
    counted = exact.groupBy(*group, "shingle").agg(F.lit(1)).groupBy(*group).agg(F.count("*").alias("hits"))
    share = F.col("hits") / F.col("shingles")
    kept = counted.withColumn("containment", share).filter(F.col("hits") >= F.ceil(F.lit(threshold) * F.col("shingles") - 1e-9))
    return kept.select(F.col("_doc").alias(key), "item_id", "item_copies", "shingles", "hits", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, that contain no item."""
    matches = stored(contaminated(docs, items, key, text, **options).select(F.col(key).alias("_found")).distinct(), "contaminated")
    matches = bounded(matches)
    return docs.join(matches, docs[key] == matches["_found"], "left_anti")


def op8_containment_search(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT min(item_id) AS item_id, count(*) AS item_copies, w FROM w WHERE len(w) >= 5 GROUP BY w),
ip AS (SELECT item_id, item_copies, w, unnest(range(1, len(w) - 3)) AS p FROM i),
ish AS (SELECT DISTINCT item_id, item_copies, array_to_string(w[p:p + 4], ' ') AS s FROM ip),
n AS (SELECT item_id, count(*) AS shingles FROM ish GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM dp),
h AS (SELECT doc_id, item_id, item_copies, count(*) AS hits FROM dsh JOIN ish USING (s) GROUP BY ALL)
SELECT doc_id, item_id, item_copies, shingles, hits, hits / shingles AS containment
FROM h JOIN n USING (item_id) WHERE hits >= ceil(0.8 * shingles - 1e-9)
"""
