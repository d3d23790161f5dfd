"""Byte-pair encoding: learning merges and segmenting words."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seqspark.consts import BPE_MARK
from seqspark.operators.ordering import parallelism
from seqspark.operators.vocab import _in_chunks, _keyed
from seqspark.session import fenced, local_table, scratch_dir

END = "</w>"


def learn(
    words: DataFrame, merges: int, min_count: int = 2, top: int = 256, checkpoint_every: int = 32
) -> DataFrame:
    """Most frequent adjacent pair, merged again and again; ``words`` has ``(token, cnt)``.

    Works on distinct words only; null and empty ones have no pairs. Ties go to the greatest
    pair. One round accepts every merge that sequential learning would certainly make next,
    see ``_certain``; results equal one merge per round.

    Pairs are listed with the words they occur in, in ranges of pairs, so a round reads the
    lists of its own pairs, spells their words anew and appends what changed; pair counts
    follow from those changes. Every ``checkpoint_every`` rounds the changes are merged into the
    lists. No plan grows with the number of merges.
    """
    spark = words.sparkSession
    known = words.filter(F.char_length("token") > 0).groupBy("token").agg(F.sum("cnt").cast("bigint").alias("cnt"))
    known = _written(known, scratch_dir(spark, "words"))
    first = known.select("token", "cnt", F.explode(_adjacent(_letters("token"))).alias("p"))
    listed = [_listed(first.select("p.*", "token", "cnt", F.lit(1).cast("bigint").alias("change")), parallelism(words))]
    counted, learned = _written(_pair_counts(spark, listed), scratch_dir(spark, "counts")), []
    made: set[str] = set()
    while len(learned) < merges:
        pairs = counted if len(listed) == 1 else counted.unionByName(_pair_counts(spark, listed[1:]))
        pairs = pairs.groupBy("left", "right").agg(F.sum("cnt").alias("cnt"), F.sum("places").alias("places"))
        best = pairs.filter(F.col("cnt") >= min_count).orderBy(F.desc("cnt"), F.desc("left"), F.desc("right")).limit(top).collect()
        if not best:
            break
        batch = _certain([(r["left"], r["right"], r["cnt"]) for r in best], min_count - 1 if len(best) < top else best[-1]["cnt"], made)
        batch = batch[: merges - len(learned)]
        made |= {a + b for a, b, _ in batch}
        done = len(learned)
        learned += [(done + i, *pair) for i, pair in enumerate(batch)]
        places = sum(r["places"] for r in best[: len(batch)])
        touched = _touched(spark, listed, batch, min(parallelism(words), 1 + places // WORDS_PER_TASK))
        changed = touched.mapInArrow(_respelled(spark, learned, done), PAIR_LISTS)
        listed.append(scratch_dir(spark, "changes"))
        changed.write.parquet(listed[-1])
        if len(listed) > checkpoint_every:
            net = spark.read.schema(PAIR_LISTS).parquet(*listed).groupBy("left", "right", "token").agg(F.max("cnt").alias("cnt"), F.sum("change").alias("change"))
            listed = [_listed(net.filter("change > 0"), parallelism(words))]
            counted = _written(_pair_counts(spark, listed), scratch_dir(spark, "counts"))
    return local_table(spark, learned, "rank bigint, left string, right string, cnt bigint")


PAIR_LISTS = "left string, right string, token string, cnt bigint, change bigint"
WORDS_PER_TASK = 20_000


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _letters(word: str) -> Column:
    """The letters of a word, the last one with the end mark."""
    size = F.char_length(word)
    letters = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col(word), i, F.lit(1)))
    return F.transform(letters, lambda x, i: F.when(i == size - 1, F.concat(x, F.lit(END))).otherwise(x))


def _adjacent(parts: Column) -> Column:
    count = F.size(parts) - 1
    return F.arrays_zip(F.slice(parts, F.lit(1), count).alias("left"), F.slice(parts, F.lit(2), count).alias("right"))


def _listed(rows: DataFrame, ranges: int) -> str:
    """Written in ranges of pairs: a filter on pairs skips files and row groups, and the words of a
    frequent pair fill several ranges."""
    path = scratch_dir(rows.sparkSession, "pairs")
    rows = _written(rows, scratch_dir(rows.sparkSession, "unordered"))
    order = ["left", "right", "token"]
    rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.parquet(path)
    return path


def _pair_counts(spark, listed: list[str]) -> DataFrame:
    rows = spark.read.schema(PAIR_LISTS).parquet(*listed).groupBy("left", "right")
    return rows.agg(F.sum(F.col("cnt") * F.col("change")).alias("cnt"), F.sum("change").alias("places"))


def _touched(spark, listed: list[str], batch: list[tuple], tasks: int) -> DataFrame:
    """The words listed under a pair of the batch (of at most ``top`` pairs)."""
    rows = spark.read.schema(PAIR_LISTS).parquet(*listed)
    # The first two conditions reach the scan; a word too many would change nothing.
    rows = rows.filter(F.col("left").isin([a for a, _, _ in batch]) & F.col("right").isin([b for _, b, _ in batch]))
    rows = rows.filter(F.concat_ws("\0", "left", "right").isin([f"{a}\0{b}" for a, b, _ in batch]))
    return rows.select("token", "cnt").repartition(tasks, "token").distinct()


def _respelled(spark, learned: list[tuple], done: int):
    """Arrow function: per word, the pairs that the merges after the first ``done`` add and remove."""
    shipped = spark.sparkContext.broadcast([(a, b) for _, a, b, _ in learned])

    def changes(batches):
        ranks: dict[tuple[str, str], list[int]] = {}
        for rank, pair in enumerate(shipped.value):
            ranks.setdefault(pair, []).append(rank)
        for batch in batches:
            rows = []
            for token, cnt in zip(batch.column("token").to_pylist(), batch.column("cnt").to_pylist()):
                before = _in_sequence([*token[:-1], token[-1] + END], ranks, 0, done)
                after = _in_sequence(before, ranks, done, len(shipped.value))
                if len(after) < len(before):
                    change = Counter(zip(after, after[1:]))
                    change.subtract(Counter(zip(before, before[1:])))
                    rows += [(*pair, token, cnt, n) for pair, n in change.items() if n]
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["left", "right", "token", "cnt", "change"])

    return changes


def _in_sequence(pieces: list[str], ranks: dict[tuple[str, str], list[int]], start: int, stop: int) -> list[str]:
    """Merges ``start`` to ``stop`` one after the other, each once. Other than in ``segment``, a pair that
    a later merge spells again is not joined by an earlier one."""
    while len(pieces) > 1:
        least, best = stop, None
        for pair in zip(pieces, pieces[1:]):
            for rank in ranks.get(pair, ()):
                if start <= rank < least:
                    least, best = rank, pair
        if best is None:
            break
        pieces, start = _join(pieces, *best), least + 1
    return pieces


def _join(pieces: list[str], a: str, b: str) -> list[str]:
    out, i = [], 0
    while i < len(pieces):
        if pieces[i : i + 2] == [a, b]:
            out.append(a + b)
            i += 2
        else:
            out.append(pieces[i])
            i += 1
    return out


def _certain(best: list[tuple], floor: int, made: set[str]) -> list[tuple]:
    """Longest prefix of the ranked pairs that one-by-one merging would pick unchanged.

    ``floor`` bounds the count of a pair that is not listed, ``made`` has the merged symbols. Merging (a, b) leaves a pair over
    other symbols untouched and makes pairs that are at most as frequent as a former pair ending
    in ``a`` or starting with ``b``; where ``ab`` was a symbol before, they add to its pairs. A pair
    is therefore certain while its symbols are new and its count exceeds all those bounds.
    """
    accepted, used, bound = [], set(), 0
    for a, b, cnt in best:
        if accepted and (cnt <= bound or a in used or b in used):
            break
        accepted.append((a, b, cnt))
        if a == b:
            break
        used |= {a, b, a + b}
        near = max([c for x, y, c in best if (y == a or x == b) and (x, y) != (a, b)], default=floor)
        same = max([c for x, y, c in best if a + b in (x, y)], default=floor) if a + b in made else 0
        bound = max(bound, near + same)
    return accepted


def segment(word: str, ranks: dict[tuple[str, str], int], mark: str = BPE_MARK) -> list[str]:
    """Apply merges to one word, earliest learned first; all but the last piece are marked."""
    pieces = [*word[:-1], word[-1] + END]
    while len(pieces) > 1:
        rank, a, b = min((ranks.get(p, len(ranks)), *p) for p in zip(pieces, pieces[1:]))
        if rank == len(ranks):
            break
        pieces = _join(pieces, a, b)
    pieces[-1] = pieces[-1].removesuffix(END)
    if not pieces[-1]:
        pieces.pop()
    return [p + mark for p in pieces[:-1]] + pieces[-1:]


def _merged(parts: Column, left: Column, right: Column) -> Column:
    """Joins every ``left`` followed by ``right``, from the first on."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = F.coalesce((last == left) & (part == right), F.lit(False))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(left, right)))).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def segment_words(words: DataFrame, merges: DataFrame, mark: str = BPE_MARK) -> DataFrame:
    """``(word, pieces)`` for distinct words and merges of any number, by joins.

    Each round finds the earliest learned pair of every word that still has one and joins it
    where it occurs; words without one are finished. There are at most as many rounds as the
    longest word has letters, over fewer and fewer words.
    """
    spark = words.sparkSession
    ranks = merges.groupBy("left", "right").agg(F.min("rank").alias("rank"))
    rows = words.filter(F.char_length("word") > 0).select("word", _letters("word").alias("parts"))
    folder, rounds = scratch_dir(spark, "segments"), 0
    while True:
        path = scratch_dir(spark, "pieces")
        schema = rows.schema
        rows.write.parquet(path)
        rows = spark.read.schema(schema).parquet(path)
        count = F.size("parts") - 1
        pairs = rows.filter(count > 0).select("word", F.explode(_adjacent(F.col("parts"))).alias("p"))
        found = pairs.select("word", "p.*").join(ranks, ["left", "right"]).groupBy("word").agg(F.min(F.struct("rank", "left", "right")).alias("best"))
        joined = rows.join(found, "word", "left")
        path = scratch_dir(spark, "merged")
        joined.withColumn("parts", F.when(F.col("best").isNull(), F.col("parts")).otherwise(_merged(F.col("parts"), F.col("best.left"), F.col("best.right")))).select("word", "parts", F.col("best").isNull().alias("done")).write.parquet(path)
        state = spark.read.parquet(path)
        state.filter("done").select("word", "parts").write.parquet(f"{folder}/{rounds}")
        rounds += 1
        rows = state.filter("not done").select("word", "parts")
        if rows.isEmpty():
            break
    size = F.size("parts")
    ended = F.transform("parts", lambda x, i: F.when(i == size - 1, F.regexp_replace(x, END + "$", "")).otherwise(x))
    ended = F.filter(ended, lambda x: x != "")
    named = spark.read.schema("word string, parts array<string>").parquet(*[f"{folder}/{i}" for i in range(rounds)]).select("word", ended.alias("ended"))
    return named.select("word", F.transform("ended", lambda x, i: F.when(i < F.size("ended") - 1, F.concat(x, F.lit(mark))).otherwise(x)).alias("pieces"))


def _apply_joined(df: DataFrame, words: str, merges: DataFrame, out: str) -> DataFrame:
    """``apply`` with the distinct words segmented once and joined back."""
    df, key = _keyed(df, None)
    long = df.select(*key, F.posexplode(words).alias("_at", "word"))
    known = segment_words(long.select("word").distinct(), merges)
    packed = F.sort_array(F.collect_list(F.struct("_at", "pieces")))
    pieces = long.join(known, "word").groupBy(*key).agg(F.flatten(packed["pieces"]).alias("_pieces"))
    some = F.coalesce("_pieces", F.array().cast("array<string>"))
    return df.join(pieces, key, "left").withColumn(out, some).drop("_pieces", *key)


def apply(df: DataFrame, words: str, merges: DataFrame, out: str = "pieces", limit: int = 1_000_000) -> DataFrame:
    """Segment a column of word arrays; each part of a batch segments a word once, inside the row.

    A merge list longer than ``limit`` is not shipped: the distinct words are then segmented
    by joins, with the same result.
    """
    rows = merges.select("rank", "left", "right").limit(limit + 1).collect()
    if len(rows) > limit:
        return _apply_joined(df, words, merges, out)
    shipped = df.sparkSession.sparkContext.broadcast({(r["left"], r["right"]): r["rank"] for r in rows})

    @F.arrow_udf("array<string>")
    def split_words(batch: pa.Array) -> pa.Array:
        return _in_chunks(batch, segmented)

    def segmented(batch: pa.Array) -> pa.Array:
        ranks = shipped.value
        coded = pc.dictionary_encode(batch.flatten())
        known = [segment(w, ranks) for w in coded.dictionary.to_pylist()]
        table = pa.array(known, pa.list_(pa.string()))
        spread = pc.take(table, coded.indices)
        per_word = pc.list_value_length(spread).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], per_word.cumsum()])
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        rows_at = np.concatenate([[0], sizes.cumsum()])
        return pa.ListArray.from_arrays(pa.array(ends[rows_at].astype("int32")), spread.flatten())

    return fenced(df, words).withColumn(out, split_words(F.col(words)))
