"""Ranked lexical search, reversed: the items are indexed and the documents stream past.

The items' terms make an inverted index (term -> items with that term and how often). One pass
counts, per document, the terms that any item has; totals and document frequencies are
aggregates of that table. A second pass streams the counts through the index: each document's
weights are added up per item, and each item keeps a bounded heap of its best documents. The
heaps of the tasks are merged in two steps, so that no task reads all of them.

The index is sent to the tasks, so its size is bounded: items are dealt into blocks of at most
``POSTINGS`` postings (one item at least), and each block streams the documents by itself.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seqspark.llm.common import slices, stored, table
from seqspark.operators.ordering import parallelism, running

TOP = 20
#: Postings of one block of items, and terms and cells that are scored at once.
POSTINGS, AT_ONCE, CELLS = 1 << 18, 1 << 21, 1 << 22
NO_KEY = np.iinfo(np.int64).max

# Letters A-Z become lower case; other ASCII characters than letters and digits part terms.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, A-Z lower-cased; null has none."""
    return text.translate(_TERM_BYTES).split() if text else []


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(item, term, times)``: rows that share a key are one item with the terms of all."""
    source = items.select(F.col(key).alias("item"), F.col(text).cast("binary").alias("text"))
    kind = source.schema["item"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                counts = [Counter(terms(t)) for t in part.column("text").to_pylist()]
                item = part.column("item").take(pa.array(np.repeat(np.arange(len(counts)), list(map(len, counts)))))
                found = [pa.array([x for c in counts for x in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays([item, *found], names=["item", "term", "times"])

    rows = source.mapInArrow(run, f"item {kind}, term binary, times bigint")
    return rows.groupBy("item", "term").agg(F.sum("times").alias("times"))


def blocks(found: DataFrame, postings: int) -> DataFrame:
    """``item_terms`` rows with the block of their item: about ``postings`` rows a block."""
    sizes = running(found.groupBy("item").agg(F.count("*").alias("n")), ["item"], {"upto": F.col("n")})
    sizes = sizes.select(F.col("item").alias("_item"), F.floor((F.col("upto") - F.col("n")) / postings).alias("block"))
    return stored(found.join(sizes, F.col("item").eqNullSafe(F.col("_item"))).drop("_item"), "item_terms")


def counted(docs: DataFrame, key: str, text: str, known: dict[bytes, int]) -> DataFrame:
    """``(doc, n, terms, times)``: per document its number of terms, and those of ``known``."""
    source = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, ids, times = [], [], []
                for t in part.column("text").to_pylist():
                    words = terms(t)
                    count = Counter(map(known.get, words))
                    count.pop(None, None)
                    sizes.append(len(words))
                    ids.append(list(count))
                    times.append(list(count.values()))
                cols = [part.column("doc"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "n", "terms", "times"])

    return source.mapInArrow(run, "doc bigint, n bigint, terms array<int>, times array<bigint>")


class Index:
    """Postings of a block of items, by term; ``weights`` by term."""

    def __init__(self, term: np.ndarray, item: np.ndarray, times: np.ndarray, weights: np.ndarray, items: int):
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], times[order]
        self.length = np.bincount(term, minlength=len(weights))
        self.start = np.cumsum(self.length) - self.length
        self.weights, self.items = weights, items

    def scores(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Sums of ``value`` times the item's repeats, per row and item, in whole numbers."""
        length = self.length[term]
        posting = np.arange(length.sum()) + np.repeat(self.start[term] - (np.cumsum(length) - length), length)
        out = np.zeros(rows * self.items, np.int64)
        np.add.at(out, np.repeat(row, length) * self.items + self.item[posting], np.repeat(value, length) * self.times[posting])
        return out.reshape(rows, self.items)


class Heaps:
    """The ``top`` best documents of each item so far: highest score first, then least key."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = np.zeros((items, top), np.int64)
        self.doc = np.full((items, top), NO_KEY)

    def update(self, scores: np.ndarray, docs: np.ndarray) -> None:
        row, item = np.nonzero((scores > 0) & (scores >= self.score[:, -1]))
        for i in np.unique(item):
            mine = row[item == i]
            score, doc = np.concatenate([self.score[i], scores[mine, i]]), np.concatenate([self.doc[i], docs[mine]])
            best = np.lexsort((doc, -score))[: self.top]
            self.score[i], self.doc[i] = score[best], doc[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, place = np.nonzero(self.score)
        return item, self.score[item, place], self.doc[item, place]


def searched(counts: DataFrame, index: Index, documents: int, words: int, top: int) -> DataFrame:
    """``(number, score, doc, part)``: the heaps of every task over its documents."""

    def run(batches):
        heaps = Heaps(index.items, top)
        for batch in batches:
            n, lists, times = batch.column("n").to_pylist(), batch.column("terms"), batch.column("times")
            docs = batch.column("doc").fill_null(NO_KEY).to_numpy()
            length = np.diff(lists.offsets.to_numpy())
            term, often = lists.flatten().to_numpy(), times.flatten().to_numpy()
            m = np.array([75 + 25 * x * documents // words if words else 75 for x in n], object)
            most = np.iinfo(np.int64).max // 24
            m = np.minimum(m, most).astype(np.int64) if len(m) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(n)), length)
            value = index.weights[term] * ((1_000_000_000 * often) // (1000 * often + 12 * m[row]))
            upto = np.concatenate([[0], np.cumsum(np.bincount(row, index.length[term], len(n)).astype(np.int64))])
            first, entry = 0, np.concatenate([[0], np.cumsum(length)])
            most = max(1, CELLS // max(1, index.items))
            while first < len(n):
                last = max(first + 1, min(first + most, int(np.searchsorted(upto, upto[first] + AT_ONCE, side="right")) - 1))
                part = slice(entry[first], entry[last])
                heaps.update(index.scores(row[part] - first, term[part], value[part], last - first), docs[first:last])
                first = last
        item, score, doc = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score), pa.array(doc, mask=doc == NO_KEY)], names=["number", "score", "doc"])

    rows = counts.mapInArrow(run, "number bigint, score bigint, doc bigint")
    return rows.withColumn("part", F.spark_partition_id())


def merged(rows: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows per item with their rank: first among some tasks, then among all."""
    parts = max(1, math.isqrt(parallelism(rows)))
    order = [F.desc("score"), F.col("doc").asc_nulls_last()]
    some = F.row_number().over(Window.partitionBy("number", "group").orderBy(*order))
    rows = rows.withColumn("group", F.col("part") % parts).withColumn("_nth", some).filter(F.col("_nth") <= top)
    every = F.row_number().over(Window.partitionBy("number").orderBy(*order))
    return rows.select("number", "score", "doc").withColumn("rank", every).filter(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """``(item_key, rank, key, score)``: the ``top`` best documents of every item.

    Null and empty texts have no term: as documents they score nothing, as items they find
    nothing. Rows that share an item key are one item. Documents are rows: those that share
    a key are ranked each, those without one come last among equal scores, with a null key.
    Keys are integers. Empty tables give no rows.
    """
    spark = docs.sparkSession
    found = blocks(item_terms(items, item_key, item_text), postings)
    out = None
    for (block,) in found.select("block").distinct().orderBy("block").toLocalIterator():
        own = found.filter(F.col("block") == block).select("item", "term", "times").toArrow()
        listed = own.column("term").to_pylist()
        known = {t: i for i, t in enumerate(dict.fromkeys(listed))}
        keys = own.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        counts = stored(counted(docs, key, text, known), "term_counts")
        documents, words = counts.agg(F.sum((F.col("n") > 0).cast("bigint")), F.sum("n")).first()
        documents, words = documents or 0, words or 0
        weights = np.full(len(known), math.floor(1000 * math.log(2 * documents + 2)), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            weights[r["t"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))
        term = np.fromiter((known[t] for t in listed), np.int64, len(listed))
        index = Index(term, keys.indices.to_numpy().astype(np.int64), own.column("times").to_numpy(), weights, len(keys.dictionary))
        best = merged(searched(counts, index, documents, words, top), top)
        names = pa.table({"_number": pa.array(np.arange(len(keys.dictionary))), item_key: keys.dictionary})
        named = best.join(F.broadcast(spark.createDataFrame(names)), F.col("number") == F.col("_number"))
        named = named.select(item_key, F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        kind = items.schema[item_key].dataType.simpleString()
        out = spark.createDataFrame([], f"`{item_key}` {kind}, rank int, `{key}` bigint, score bigint")
    return out


def op11_reversed_search(spark, sf_dir) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH i AS (SELECT item_id, unnest({_SQL_TERMS.format('text')}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
d AS (SELECT doc_id, {_SQL_TERMS.format('text')} AS w FROM documents),
t AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS words FROM d),
f AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
c AS (SELECT doc_id, n, term, count(*) AS tf FROM f GROUP BY doc_id, n, term),
e AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM t) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c GROUP BY term),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * (SELECT docs FROM t)) // (SELECT words FROM t)))))::BIGINT AS score
  FROM q JOIN c USING (term) JOIN e USING (term) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20
"""
