"""Sorting, filtering, batching, sharding and collating encoded samples."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from seqspark.consts import PAD
from seqspark.functions import arrays as ar
from seqspark.functions.hashing import base as hash_base
from seqspark.operators.ordering import parallelism, placed, ranked
from seqspark.session import local_table


def filter_pairs(df: DataFrame, source: str, target: str, low: int, high: int, ratio: float) -> DataFrame:
    """Keep pairs with both lengths in range and a length ratio of at most ``ratio``."""
    s, t = F.col(source), F.col(target)
    return df.filter(
        s.between(low, high) & t.between(low, high) & (F.greatest(s, t) <= F.lit(ratio) * F.least(s, t))
    )


def every_kth(number: Column, k: int) -> Column:
    """Deterministic split of 1-based line numbers: every k-th line is validation."""
    return F.when(number % k == 0, F.lit("valid")).otherwise(F.lit("train"))


def length_key(seed: int, *ids: str) -> Column:
    """The random tie-break between samples of equal length."""
    return hash_base(seed, *[F.col(i) for i in ids])


def length_order(df: DataFrame, source: str, target: str | None, seed: int, ids: list[str], out: str = "rank") -> DataFrame:
    """Position in the order (source size, target size, random)."""
    sizes = [source] + ([target] if target else [])
    rows = df.withColumn("_h", length_key(seed, *ids))
    return ranked(rows, [*sizes, "_h", *ids], out).drop("_h")


def fits(size, limit) -> Column | bool:
    """One sample against scalar, tuple (None = no limit) or per-key limits.

    ``size`` mirrors ``limit``: a column, a tuple of columns, or a dict of either. Of two
    dicts only the common keys are compared.
    """
    if isinstance(limit, dict):
        tests = [fits(size[k], limit[k]) for k in limit if k in size]
    elif isinstance(limit, (tuple, list)):
        tests = [fits(s, m) for s, m in zip(size, limit)]
    elif limit is None or size is None:
        return F.lit(True)
    else:
        return size.isNull() | (size <= limit)
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def filter_by_size(df: DataFrame, size, limit, raise_exception: bool = False) -> tuple[DataFrame, DataFrame]:
    """Kept and ignored samples. With ``raise_exception`` an oversized row fails the job."""
    ok = fits(size, limit)
    if raise_exception:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error("sample is longer than the size limit").cast("boolean"))
    return df.filter(ok), df.filter(~fits(size, limit))


def ignored_report(ignored: DataFrame, id_col: str) -> DataFrame:
    """How many samples were ignored and the ten smallest of their ids."""
    first = ignored.select(id_col).orderBy(id_col).limit(10).agg(
        F.array_join(F.sort_array(F.collect_list(id_col)).cast("array<string>"), " ").alias("first_ids")
    )
    return ignored.agg(F.count(F.lit(1)).alias("n_ignored")).withColumn("first_ids", first.scalar())


def resolve_limits(*limits):
    """Null-safe component-wise minimum of scalars and tuples."""
    out = None
    for limit in limits:
        if limit is None:
            continue
        if out is None:
            out = limit
        elif isinstance(out, tuple) or isinstance(limit, tuple):
            width = len(out) if isinstance(out, tuple) else len(limit)
            a = out if isinstance(out, tuple) else (out,) * width
            b = limit if isinstance(limit, tuple) else (limit,) * width
            out = tuple(min((v for v in p if v is not None), default=None) for p in zip(a, b))
        else:
            out = min(out, limit)
    return out


def fold_batches(
    sizes: Iterable[tuple[int, int]], max_tokens: int | None, max_sentences: int | None, multiple: int = 1
) -> Iterator[tuple[int, int, int, int]]:
    """Greedy batches over run-length coded sizes ``(num_tokens, count)`` in sample order.

    Yields runs ``(first_rank, batch_len, n_batches, first_batch)``. A stretch of equal
    sizes repeats one batch length, so work and output follow the number of distinct
    sizes, not the number of samples.
    """
    tokens = float("inf") if max_tokens is None else max_tokens
    sentences = float("inf") if max_sentences is None else max_sentences
    batch: deque[list[int]] = deque()
    held = start = number = 0

    def cut(n: int) -> int:
        return max(multiple * (n // multiple), n % multiple)

    for size, count in sizes:
        while count:
            longest = max(size, max((s for s, _ in batch), default=0))
            room = min(sentences, tokens // longest if longest else tokens) - held
            if held == 0:
                room = max(room, 1)
            if room > 0:
                take = int(min(room, count))
                if batch and batch[-1][0] == size:
                    batch[-1][1] += take
                else:
                    batch.append([size, take])
                held += take
                count -= take
                continue
            length = cut(held)
            if len(batch) == 1 and batch[0][0] == size and room == 0 and count >= length:
                repeat = count // length
                yield start, length, repeat, number
                start += length * repeat
                number += repeat
                count -= length * repeat
                continue
            yield start, length, 1, number
            start += length
            number += 1
            held -= length
            rest = length
            while rest:
                used = min(rest, batch[0][1])
                batch[0][1] -= used
                rest -= used
                if not batch[0][1]:
                    batch.popleft()
            # The sample that did not fit joins the carried rest without another test.
            if batch and batch[-1][0] == size:
                batch[-1][1] += 1
            else:
                batch.append([size, 1])
            held += 1
            count -= 1
    if held:
        yield start, held, 1, number


def batch_by_size(
    df: DataFrame,
    size_cols: list[str],
    tie_cols: list,
    num_tokens: Column,
    max_tokens: int | None = None,
    max_sentences: int | None = None,
    multiple: int = 1,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """Add ``rank`` and ``batch_id`` for greedy token-budget batches in size order.

    ``num_tokens`` must be a function of ``size_cols``. The greedy depends only on the
    histogram of sizes, which is streamed to the driver in order (one row per distinct
    size, bounded by the length limit); samples get their rank by the bucketed global
    order, so neither step handles the samples in one place.
    """
    spark = df.sparkSession
    rows = ranked(df, [*size_cols, *tie_cols], "rank")
    histogram = df.groupBy(*size_cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_m", num_tokens).orderBy(*size_cols)
    classes = [(tuple(r[c] for c in size_cols), r["_m"], r["_n"]) for r in histogram.toLocalIterator()]
    runs = list(fold_batches(((m, n) for _, m, n in classes), max_tokens, max_sentences, multiple))
    table, i, low = [], 0, 0
    for key, _, n in classes:
        high = low + n
        while i + 1 < len(runs) and runs[i + 1][0] <= low:
            i += 1
        j, part = i, []
        while j < len(runs) and runs[j][0] < high:
            part.append({"first": runs[j][0], "len": runs[j][1], "batch": runs[j][3]})
            j += 1
        table.append((*key, part))
        low = high
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in size_cols)
    lookup = local_table(spark, table, f"{schema}, _runs array<struct<first:bigint,len:bigint,batch:bigint>>")
    if len(table) <= broadcast_rows:
        lookup = F.broadcast(lookup)
    rows = rows.join(lookup, size_cols)
    run = F.element_at(F.filter("_runs", lambda r: r["first"] <= F.col("rank")), -1)
    batch = run["batch"] + F.floor((F.col("rank") - run["first"]) / run["len"]).cast("bigint")
    return rows.withColumn("batch_id", batch).drop("_runs")


# Batches over a given order: sizes may rise and fall, so the histogram does not settle them. What
# the greedy knows before a sample is how many samples the open batch holds; which ones, and the
# longest of them, follow from the samples before. A bucket of the order is therefore summed up as
# a map from every number of open samples to the number at its end and the batches closed. The
# maps are made in parallel, chained on the driver, and the buckets replayed in parallel.


class OpenBatch:
    """The greedy from one known state: ``held`` open samples, the last ones of ``before``."""

    def __init__(self, limits: tuple[float, float, int], held: int, before: list[int]):
        self.tokens, self.sentences, self.multiple = limits
        self.held, self.start, self.starts, self.total = held, -held, [], 0
        self.longest = max(before[len(before) - held :], default=0)
        self.recent = deque(before, maxlen=self.multiple)

    def feed(self, sizes: Iterable[int]) -> None:
        """Adds samples; ``starts`` gets the place, from the first sample fed, of each new batch."""
        tokens, sentences, multiple = self.tokens, self.sentences, self.multiple
        held, longest, recent = self.held, self.longest, self.recent
        for size in sizes:
            after = size if size > longest else longest
            if held and (held == sentences or (held + 1) * after > tokens):
                cut = max(multiple * (held // multiple), held % multiple)
                self.start += cut
                self.starts.append(self.start)
                self.total += 1
                held -= cut
                after = max(size, *list(recent)[len(recent) - held :]) if held else size
            held += 1
            longest = after
            recent.append(size)
        self.held, self.longest = held, longest


class OpenBatches:
    """The greedy from every state at once; states that hold equally many samples are one."""

    def __init__(self, limits: tuple[float, float, int], most: int, before: list[int]):
        self.limits, self.one = limits, None
        self.held = np.arange(min(most, len(before)) + 1)
        self.longest = np.concatenate([[0], np.maximum.accumulate(np.array(before[::-1], np.int64))])[: len(self.held)]
        self.state, self.closed = np.arange(len(self.held)), np.zeros(len(self.held), np.int64)
        self.entered = self.closed.copy()
        self.recent = deque(before, maxlen=limits[2])

    def feed(self, sizes: list[int]) -> None:
        tokens, sentences, multiple = self.limits
        for i, size in enumerate(sizes):
            if len(self.held) == 1:
                if self.one is None:
                    self.one = OpenBatch(self.limits, 0, list(self.recent))
                    self.one.held, self.one.longest = int(self.held[0]), int(self.longest[0])
                self.one.feed(sizes[i:])
                return
            after = np.maximum(self.longest, size)
            full = (self.held > 0) & ((self.held == sentences) | ((self.held + 1) * after > tokens))
            rest = np.where(full, self.held - np.maximum(multiple * (self.held // multiple), self.held % multiple), self.held)
            carried = np.concatenate([[size], np.maximum(np.maximum.accumulate(np.array(list(self.recent)[::-1], np.int64)), size)])
            self.longest = np.where(full, carried[np.minimum(rest, len(carried) - 1)], after)
            self.closed = self.closed + full
            self.held = rest + 1
            self.recent.append(size)
            if full.any():
                held, first, index = np.unique(self.held, return_index=True, return_inverse=True)
                if len(held) < len(self.held):
                    self.entered += self.closed[self.state] - self.closed[first][index[self.state]]
                    self.state = index[self.state]
                    self.held, self.longest, self.closed = held, self.longest[first], self.closed[first]

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Per state at the beginning: samples held at the end, batches closed."""
        held = np.array([self.one.held]) if self.one else self.held
        return held[self.state], self.closed[self.state] + self.entered + (self.one.total if self.one else 0)


def batch_in_order(
    df: DataFrame,
    order: list,
    num_tokens: Column,
    max_tokens: int | None = None,
    max_sentences: int | None = None,
    multiple: int = 1,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``rank`` and ``batch_id`` for greedy token-budget batches over a given order.

    ``order`` identifies a sample; sizes below one count as one. Exact whatever the sizes: a batch
    holds at most ``max_sentences``, or as many as fit ``max_tokens`` at size one, and a bucket
    looks at so many sizes before and after it. Tasks stream the rows of their bucket.
    """
    spark = df.sparkSession
    most = min(max_sentences or float("inf"), max(max_tokens, multiple) if max_tokens is not None else float("inf"))
    if most == float("inf"):
        return ranked(df, order, "rank").withColumn("batch_id", F.lit(0).cast("bigint"))
    limits = (float("inf") if max_tokens is None else max_tokens, float("inf") if max_sentences is None else max_sentences, multiple)
    sized = df.withColumn("_m", F.greatest(num_tokens.cast("bigint"), F.lit(1)))
    table = placed(sized, order, {"_nth": F.lit(1).cast("bigint")}, [], buckets or parallelism(df))
    table = table.drop("_v0").withColumnRenamed("_l0", "_nth")
    counts = table.groupBy("_bucket").agg(F.max("_nth").alias("_count"))
    rows = {r["_bucket"]: r["_count"] for r in counts.collect()}
    # The sizes next to the borders of buckets: ``most`` on either side.
    near = table.join(F.broadcast(local_table(spark, sorted(rows.items()), "_bucket int, _count bigint")), "_bucket")
    near = near.filter((F.col("_nth") <= most) | (F.col("_nth") > F.col("_count") - most)).select("_bucket", "_nth", "_m")
    heads, tails = {b: [] for b in rows}, {b: [] for b in rows}
    for b, nth, size in sorted(map(tuple, near.collect())):
        if nth <= most:
            heads[b].append(size)
        if nth > rows[b] - most:
            tails[b].append(size)
    before, after, upto, listed = {}, {}, [], sorted(rows)
    for b in listed:
        before[b] = upto
        upto = (upto + tails[b])[-most:]
    upto = []
    for b in reversed(listed):
        after[b] = upto
        upto = (heads[b] + upto)[:most]
    in_order = table.repartition(max(1, len(rows)), "_bucket").sortWithinPartitions("_bucket", "_nth")

    def runs(batches):
        """``(bucket, batch)`` for the parts of batches that lie in one bucket."""
        for batch in batches:
            bucket = batch.column("_bucket").to_numpy()
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield int(bucket[a]), batch.slice(a, b - a)

    def summarise(batches):
        now, states = None, None
        for bucket, batch in runs(batches):
            if bucket != now:
                if states:
                    yield summary(now, states)
                now, states = bucket, OpenBatches(limits, most, before[bucket])
            states.feed(batch.column("_m").to_pylist())
        if states:
            yield summary(now, states)

    def summary(bucket, states):
        held, closed = states.ends()
        first = np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]) | (closed[1:] != closed[:-1])]))
        cols = [np.full(len(first), bucket), first, held[first], closed[first]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["bucket", "held", "end", "closed"])

    maps: dict[int, list] = {}
    for r in in_order.select("_bucket", "_m").mapInArrow(summarise, "bucket bigint, held bigint, end bigint, closed bigint").collect():
        maps.setdefault(r["bucket"], []).append((r["held"], r["end"], r["closed"]))
    begin, held, closed, rank = {}, 0, 0, 0
    for b in listed:
        begin[b] = (held, closed, rank)
        _, end, more = max(m for m in maps[b] if m[0] <= held)
        held, closed, rank = end, closed + more, rank + rows[b]
    out = StructType([*df.schema, StructField("rank", LongType()), StructField("batch_id", LongType())])
    names = to_arrow_schema(out).names

    def replay(batches):
        now, state, waiting, done = None, None, [], 0
        for bucket, batch in runs(batches):
            if bucket != now:
                if now is not None:
                    yield from finished(now, state, waiting, done)
                now, waiting, done = bucket, [], 0
                state = OpenBatch(limits, begin[bucket][0], before[bucket])
            state.feed(batch.column("_m").to_pylist())
            waiting.append(batch)
            # Rows before the open batch are settled; it holds few rows, which wait.
            if state.start > done:
                whole = pa.Table.from_batches(waiting)
                yield from numbered(now, state, whole.slice(0, state.start - done), done)
                waiting, done = whole.slice(state.start - done).to_batches(), state.start
                state.starts = state.starts[-1:]
        if now is not None:
            yield from finished(now, state, waiting, done)

    def finished(bucket, state, waiting, done):
        """The open rows: where their batch is cut is decided by what follows the bucket."""
        seen = len(state.starts)
        for size in after[bucket]:
            state.feed([size])
            if len(state.starts) > seen:
                break
        yield from numbered(bucket, state, pa.Table.from_batches(waiting), done)

    def numbered(bucket, state, table, done):
        _, closed, rank = begin[bucket]
        place = np.arange(done, done + table.num_rows)
        known = state.starts
        last = closed + state.total - len(known)
        ids = last + np.searchsorted(np.array(known, np.int64), place, side="right")
        table = table.append_column("rank", pa.array(place + rank)).append_column("batch_id", pa.array(ids))
        yield from table.select(names).to_batches()

    return in_order.mapInArrow(replay, out)


def epoch_order(batches: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Replayable shuffle of the batches of one epoch: adds ``position``."""
    rows = batches.withColumn("_h", hash_base(seed + epoch, F.col("batch_id")))
    return ranked(rows, ["_h", "batch_id"], "position").drop("_h")


def shard(ordered: DataFrame, num_shards: int) -> DataFrame:
    """Batch ``b`` goes to shard ``b % n``; short shards end with one empty batch."""
    placed = ordered.select(
        "batch_id",
        (F.col("position") % num_shards).alias("shard"),
        F.floor(F.col("position") / num_shards).cast("bigint").alias("step"),
    )
    total = ordered.agg(F.count(F.lit(1)).alias("n"))
    left = F.pmod(-F.col("n"), F.lit(num_shards))
    tail = total.select("n", F.explode(F.sequence(F.lit(0), F.lit(num_shards - 1))).alias("i")).filter(F.col("i") >= num_shards - left)
    empty = tail.select(
        F.lit(None).cast("bigint").alias("batch_id"),
        F.col("i").cast("bigint").alias("shard"),
        F.floor(F.col("n") / num_shards).cast("bigint").alias("step"),
    )
    return placed.unionByName(empty)


def grouped_steps(sharded: DataFrame, chunk: int) -> DataFrame:
    """Consecutive batches of a shard in groups of ``chunk`` (gradient accumulation)."""
    group = F.floor(F.col("step") / chunk).cast("bigint").alias("group")
    packed = F.sort_array(F.collect_list(F.struct("step", "batch_id")))
    return sharded.groupBy("shard", group).agg(packed.alias("_p")).select("shard", "group", F.col("_p.batch_id").alias("batches"))


def resume(sharded: DataFrame, iterations: int) -> DataFrame:
    """What is left of an epoch after ``iterations`` steps."""
    return sharded.filter(F.col("step") >= iterations)


def resume_point(epoch: int, iterations: int, steps: int) -> tuple[int, int]:
    """A complete epoch rolls over to the start of the next."""
    return (epoch + 1, 0) if iterations >= steps else (epoch, iterations)


def collate(
    df: DataFrame, source: str, target: str | None = None, left_pad_source: bool = True, left_pad_target: bool = False,
    pad: int = PAD,
) -> DataFrame:
    """One row per batch: ids, padded matrices, lengths, counts; longest source first.

    A batch is bounded by the batching limits, so collecting it into a row is safe.
    """
    cols = [source] + ([target] if target else [])
    packed = F.sort_array(F.collect_list(F.struct((-F.size(source)).alias("neg"), "id", *cols)))
    out = df.groupBy("batch_id").agg(packed.alias("_p"))

    def padded(rows: Column, left: bool) -> Column:
        width = F.array_max(F.transform(rows, lambda t: F.size(t)))
        return ar.let(width, lambda n: F.transform(rows, lambda t: ar.pad_to(t, n, left, pad)))

    lengths = F.transform("_p.neg", lambda n: -n)
    counted = F.col(f"_p.{target or source}")
    result = [
        F.col("batch_id"), F.col("_p.id").alias("ids"), padded(F.col(f"_p.{source}"), left_pad_source).alias("src_tokens"),
        lengths.alias("src_lengths"), F.size("_p").cast("bigint").alias("nsentences"),
        F.aggregate(F.transform(counted, lambda t: F.size(t).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ntokens"),
    ]
    if target:
        rows = F.col(f"_p.{target}")
        shifted = F.transform(rows, lambda t: ar.eos_to_front(t))
        result.append(padded(rows, left_pad_target).alias("target"))
        result.append(padded(shifted, left_pad_target).alias("prev_output_tokens"))
    return out.select(*result)


@dataclass(frozen=True)
class Field:
    """How one column of a batch is laid out: padded to its own longest row with ``pad``, on the
    ``left`` or right; ``shift`` moves the end mark to the front first. Without ``pad`` rows are
    stacked as they are (properties, labels, flags)."""

    column: str
    left: bool = False
    shift: bool = False
    pad: int | None = PAD


def collate_fields(df: DataFrame, fields: dict[str, Field], by: str, key: str = "id") -> DataFrame:
    """``batch_id``, ``ids``, ``lengths`` and one list of rows per field; longest ``by`` first.

    Several fields may show one column (targets of a language model: itself, shifted). All come
    from one aggregate, so rows of a batch are in one order; ties go by ``key``. A null value of
    a padded column counts as an empty row, a stacked one stays null.
    """
    columns = list(dict.fromkeys(f.column for f in fields.values()))
    places = {c: f"c{i}" for i, c in enumerate(columns)}
    row = F.struct((-F.coalesce(F.size(by), F.lit(0))).alias("neg"), F.col(key).alias("key"), *[F.col(c).alias(n) for c, n in places.items()])
    out = df.groupBy("batch_id").agg(F.sort_array(F.collect_list(row)).alias("_p"))

    def laid(field: Field) -> Column:
        rows = F.col(f"_p.{places[field.column]}")
        if field.shift:
            rows = F.transform(rows, lambda t: F.when(F.size(t) > 0, ar.eos_to_front(t)).otherwise(t))
        if field.pad is None:
            return rows
        rows = F.transform(rows, lambda t: F.coalesce(t, F.array().cast("array<int>")))
        width = F.array_max(F.transform(rows, lambda t: F.size(t)))
        return ar.let(width, lambda n: F.transform(rows, lambda t: ar.pad_to(t, n, field.left, field.pad)))

    lengths = F.transform("_p.neg", lambda n: (-n).cast("bigint"))
    return out.select("batch_id", F.col("_p.key").alias("ids"), lengths.alias("lengths"), *[laid(f).alias(n) for n, f in fields.items()])


def accounting(df: DataFrame, source_size: str, target_size: str, sentence_avg: bool = False) -> DataFrame:
    """Per batch: sentences, target tokens, sample size and share of padding cells."""
    out = df.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("nsentences"),
        F.sum(target_size).cast("bigint").alias("ntokens"),
        F.sum(source_size).cast("bigint").alias("_s"),
        F.max(source_size).alias("_w"),
    )
    sample = F.col("nsentences") if sentence_avg else F.col("ntokens")
    waste = F.round(1 - F.col("_s") / (F.col("_w") * F.col("nsentences")), 6)
    return out.select("batch_id", "nsentences", "ntokens", sample.alias("sample_size"), waste.alias("waste"))
