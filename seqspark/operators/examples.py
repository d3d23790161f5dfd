"""Training examples: language-model blocks, masked tokens, pairs, mixed corpora."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from seqspark.consts import EOS, GO, MASK, PAD
from seqspark.functions import arrays as ar
from seqspark.functions.hashing import folds, units
from seqspark.operators.ordering import parallelism, ranked, running
from seqspark.operators.vocab import CHUNK_TOKENS, chunks
from seqspark.session import fenced, local_table, one_row, scratch_dir

# ---------------------------------------------------------------- blocks


#: Rows of a stream that are looked at, per bucket, to find where its buckets begin.
SAMPLED = 32


def _bounds(stream: DataFrame, keys: list[str], buckets: int) -> list:
    """First keys of all buckets but the first, from a sample: buckets hold about as many tokens each."""
    rows = stream.count()
    share = SAMPLED * buckets / max(rows, 1)
    some = stream.select(*keys, "_n")
    if share < 1:
        some = some.filter(F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20)))))
    found = some.orderBy(*keys).collect()  # about SAMPLED rows a bucket
    upto = np.cumsum([0, *[r["_n"] + 1 for r in found]])
    at = np.searchsorted(upto, np.arange(1, buckets) * upto[-1] / buckets)
    return [found[i] for i in np.unique(at[(at > 0) & (at < len(found))])]


def _bucket(stream: DataFrame, keys: list[str], bounds: list) -> DataFrame:
    """Adds ``_bucket``: how many bounds are not after the row. Bounds are looked up in two steps
    of about the square root of their number."""
    if not bounds:
        return stream.withColumn("_bucket", F.lit(0))
    schema = stream.select(*keys).schema
    each = int(np.ceil(np.sqrt(len(bounds))))
    groups = [[tuple(b[k] for k in keys) for b in bounds[i : i + each]] for i in range(0, len(bounds), each)]
    kind = schema.simpleString()
    named = [[dict(zip(keys, b)) for b in g] for g in groups]
    table = local_table(stream.sparkSession, [(named,)], f"g array<array<{kind}>>")
    key = F.struct(*keys)
    rows = stream.withColumn("_g", one_row(table)["g"])
    rows = rows.withColumn("_i", F.greatest(F.size(F.filter("_g", lambda g: F.get(g, F.lit(0)) <= key)) - 1, F.lit(0)))
    inside = F.size(F.filter(F.get("_g", F.col("_i")), lambda b: b <= key))
    return rows.withColumn("_bucket", F.col("_i") * each + inside).drop("_g", "_i")


def stream_fragments(rows: DataFrame, order: list[str], size: Column, block_size: int, build, fields: str) -> DataFrame:
    """Cut the stream of all rows' tokens, in order, at the block borders.

    Gives ``block_id``, ``at`` (position inside the block), ``n`` and ``fields``, made by
    ``build(batch, low, high, row)`` from token positions of a batch: fragment i reaches from
    ``low[i]`` to ``high[i]``, and ``row(positions)`` tells the rows they are in. Blocks are whole
    but where a batch begins or ends in one.

    Rows are written once with a number each, which settles the order of equal keys and may not
    change when a task runs again. Buckets of the order get their offset from an aggregate of
    the sizes; then one exchange brings the tokens of a bucket together, and they are cut there.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, "stream")
    numbered = rows.withColumn("_n", F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0))).withColumn("_row", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    stream = spark.read.schema(numbered.schema).parquet(path).filter("_n > 0")
    keys = [*order, "_row"]
    bounds = _bounds(stream, keys, parallelism(rows))
    dealt = _bucket(stream, keys, bounds)
    starts = np.zeros(len(bounds) + 1, np.int64)
    for r in _bucket(stream.select(*keys, "_n"), keys, bounds).groupBy("_bucket").agg(F.sum("_n").alias("n")).collect():
        starts[r["_bucket"]] = r["n"]
    starts = np.cumsum(starts) - starts
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("_bucket")).sortWithinPartitions(*keys)
    schema = StructType.fromDDL(f"block_id bigint, at int, n int, {fields}")
    target = to_arrow_schema(schema)

    def run(batches):
        begin = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if begin is None:
                begin = int(starts[batch.column("_bucket")[0].as_py()])
            ends = np.cumsum(batch.column("_n").to_numpy())
            total = int(ends[-1])
            edges = np.unique(np.concatenate([[0], np.arange(-begin % block_size, total, block_size), [total]]))
            low, high = edges[:-1], edges[1:]
            made = build(batch, low, high, lambda at: np.searchsorted(ends, at, side="right"))
            block = (begin + low) // block_size
            cols = [pa.array(block), pa.array((begin + low - block * block_size).astype(np.int32)), pa.array((high - low).astype(np.int32)), *made]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else c for c, f in zip(cols, target)], names=target.names)
            begin += total

    path = scratch_dir(spark, "fragments")
    dealt.mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _whole(fragments: DataFrame, block_size: int, merged: dict[str, Column]) -> DataFrame:
    """One row per block: whole fragments as they are, the others merged by ``merged``."""
    whole = (F.col("at") == 0) & (F.col("n") == block_size)
    parts = fragments.filter(~whole).groupBy("block_id").agg(*[c.alias(n) for n, c in merged.items()])
    return fragments.filter(whole).select("block_id", *merged).unionByName(parts)


def _merged_items(items: str) -> Column:
    return F.flatten(F.sort_array(F.collect_list(F.struct("at", F.col(items).alias("t"))))["t"])


def _cut(tokens: pa.Array, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """Consecutive parts of the tokens of a batch as one list per fragment."""
    return pa.ListArray.from_arrays(pa.array(np.append(low, high[-1:]), pa.int32()), tokens.flatten())


def token_blocks(rows: DataFrame, order: list[str], ids: str, block_size: int, size: str | None = None) -> DataFrame:
    """Mode *none*: the concatenated stream cut every ``block_size`` tokens.

    Rows may share an order key or have none: null keys come first, equal keys in the order in
    which the rows are written. A stored ``size`` column spares an aggregate over the tokens.
    """
    length = F.col(size) if size else F.size(ids)
    kind = rows.schema[ids].dataType.simpleString()
    fragments = stream_fragments(rows.select(*order, ids, *([size] if size else [])), order, length, block_size, lambda b, low, high, row: [_cut(b.column(ids), low, high)], f"item {kind}")
    return _whole(fragments, block_size, {"item": _merged_items("item")})


def block_index(rows: DataFrame, order: list[str], line: str, offset: str, block_size: int) -> DataFrame:
    """First sentence with the offset inside it, and last sentence, of every block.

    ``line`` and ``offset`` are arrays parallel to the tokens of a row.
    """
    names = [f.name for f in rows.select(*order).schema]
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.select(*order).schema)

    def build(batch, low, high, row):
        out = []
        for at in (low, high - 1):
            of, place = pa.array(row(at)), pa.array(at)
            values = [batch.column(c).take(of) for c in names] + [batch.column(c).flatten().take(place).cast(pa.int64()) for c in (line, offset)]
            out.append(pa.StructArray.from_arrays(values, names=[*names, "line", "offset"]))
        return out

    kind = f"struct<{kinds}, line: bigint, offset: bigint>"
    fragments = stream_fragments(rows.select(*order, line, offset), order, F.size(line), block_size, build, f"start {kind}, end {kind}")
    return _whole(fragments, block_size, {"start": F.min_by("start", "at"), "end": F.max_by("end", "at")})


def block_targets(rows: DataFrame, order: list[str], ids: str, offset: str, block_size: int, size: str | None = None) -> DataFrame:
    """Blocks with ``source`` (stream shifted by one) and ``past`` (shifted by two).

    Shifts cross block borders, except where a block starts at the first or second token
    of a sentence: those look-backs are EOS and pad. ``rows`` end with EOS, so only the
    two tokens before the block inside the same row are ever needed.
    """
    length = F.col(size) if size else F.size(ids)

    def build(batch, low, high, row):
        tokens, within = batch.column(ids).flatten(), batch.column(offset).flatten().take(pa.array(low)).to_numpy(zero_copy_only=False)
        flat = tokens.to_numpy(zero_copy_only=False)
        before = np.where(within == 0, EOS, flat[low - 1])
        second = np.where(within == 0, PAD, np.where(within == 1, EOS, flat[low - 2]))
        return [_cut(batch.column(ids), low, high), pa.array(before.astype(np.int32)), pa.array(second.astype(np.int32))]

    fragments = stream_fragments(rows.select(*order, ids, offset, *([size] if size else [])), order, length, block_size, build, f"item {rows.schema[ids].dataType.simpleString()}, b1 int, b2 int")
    out = _whole(fragments, block_size, {"item": _merged_items("item"), "b1": F.min_by("b1", "at"), "b2": F.min_by("b2", "at")})
    length = F.size("item")
    source = F.slice(F.concat(F.array("b1"), "item"), 1, length)
    past = F.slice(F.concat(F.array("b2", "b1"), "item"), 1, length)
    return out.select("block_id", "item", source.alias("source"), past.alias("past"))


def sentence_blocks(rows: DataFrame, order: list[str], size: Column) -> DataFrame:
    """Mode *eos*: one sentence per block; sentences of at most one token are skipped."""
    return ranked(rows.filter(size > 1), order, "block_id")


# The greedy of mode *complete* is sequential, but its state is one number, the fill of the
# open block (0..block_size). A bucket of the order is therefore summarised by where each
# possible start state leads; buckets are summarised in parallel, chained on the driver (a
# few intervals per bucket), and replayed in parallel from their known start states.


def _advance(sizes: np.ndarray, fill: int, block: int, limit: int):
    """Greedy over a chunk of sizes: block number of each, final fill and block."""
    ends = np.cumsum(sizes)
    blocks = np.empty(len(sizes), np.int64)
    i, taken = 0, 0
    while i < len(sizes):
        stop = int(np.searchsorted(ends, taken + limit - fill, side="right"))
        if stop <= i and fill == 0:
            stop = i + 1
        stop = max(stop, i)
        blocks[i:stop] = block
        if stop > i:
            fill += int(ends[stop - 1] - taken)
            taken = int(ends[stop - 1])
        i = stop
        if i < len(sizes):
            if fill == 0:
                continue
            fill, block = 0, block + 1
    return blocks, fill, block


class _Transfer:
    """Where every start state 0..limit leads; equal states are merged as they meet."""

    def __init__(self, limit: int):
        self.limit = limit
        self.group = np.arange(limit + 1)
        self.extra = np.zeros(limit + 1, np.int64)
        self.fill = np.arange(limit + 1, dtype=np.int64)
        self.closed = np.zeros(limit + 1, np.int64)

    def feed(self, sizes: np.ndarray) -> None:
        for i, s in enumerate(sizes):
            if len(self.fill) == 1:
                _, fill, block = _advance(sizes[i:], int(self.fill[0]), 0, self.limit)
                self.fill[0] = fill
                self.closed[0] += block
                return
            over = (self.fill > 0) & (self.fill + s > self.limit)
            self.closed[over] += 1
            self.fill = np.where(over, s, self.fill + s)
            if over.any():
                merged, first, index = np.unique(self.fill, return_index=True, return_inverse=True)
                if len(merged) < len(self.fill):
                    self.extra += self.closed[self.group] - self.closed[first][index[self.group]]
                    self.group = index[self.group]
                    self.fill, self.closed = merged, self.closed[first]

    def intervals(self) -> list[tuple[int, int, int, int, bool]]:
        """``(low, high, fill at low, closed, rising)``: start states that behave alike."""
        fill, closed = self.fill[self.group], self.closed[self.group] + self.extra
        step = np.diff(fill)
        same = (np.diff(closed) == 0) & ((step == 0) | (step == 1))
        kind = np.where(step == 1, 1, 0)
        out, low = [], 0
        for s in range(1, self.limit + 2):
            if s == self.limit + 1 or not same[s - 1] or (s - low > 1 and kind[s - 1] != kind[low]):
                rising = bool(s - low > 1 and kind[low])
                out.append((low, s - 1, int(fill[low]), int(closed[low]), rising))
                low = s
        return out


def pack_sentences(rows: DataFrame, order: list[str], size: str, block_size: int, buckets: int | None = None) -> DataFrame:
    """Mode *complete*: whole sentences, greedily; a longer one gets its own block.

    Exact over the global order. Returns ``order`` columns and ``block_id``; tasks stream
    sizes only, batch by batch. One pass lays the sizes out by range, summarises each bucket
    and writes both; the other replays the buckets from their start states.
    """
    spark = rows.sparkSession
    keyed = rows.select(*order, F.col(size).cast("bigint").alias("_size"))
    keyed = keyed.repartitionByRange(buckets or parallelism(rows), *order).sortWithinPartitions(*order)
    keyed = keyed.withColumn("_bucket", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    schema = StructType([StructField(f.name, f.dataType) for f in keyed.schema])
    for name, kind in (("low", "long"), ("high", "long"), ("fill", "long"), ("closed", "long"), ("rising", "boolean")):
        schema = schema.add(name, kind)
    target = to_arrow_schema(schema)

    def summarise(batches):
        bucket, transfer = None, _Transfer(block_size)
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column("_bucket")[0].as_py()
                transfer.feed(batch.column("_size").to_numpy())
            kept = [*batch.columns, *[pa.nulls(batch.num_rows, f.type) for f in list(target)[batch.num_columns :]]]
            yield pa.RecordBatch.from_arrays(kept, names=target.names)
        if bucket is not None:
            found = [dict(zip(("low", "high", "fill", "closed", "rising"), r)) | {"_bucket": bucket} for r in transfer.intervals()]
            last = pa.Table.from_pylist(found, schema=pa.schema([f.with_nullable(True) for f in target])).combine_chunks()
            yield pa.RecordBatch.from_arrays([c.chunk(0) for c in last.columns], names=target.names)

    path = scratch_dir(spark, "packed")
    keyed.mapInArrow(summarise, schema).write.parquet(path)
    placed = spark.read.schema(schema).parquet(path)
    # A few intervals per bucket, one start state per bucket.
    found: dict[int, list] = {}
    for r in placed.filter("low is not null").select("_bucket", "low", "high", "fill", "closed", "rising").collect():
        found.setdefault(r["_bucket"], []).append(r)
    starts, fill, block = {}, 0, 0
    for b in sorted(found):
        starts[b] = (fill, block)
        state = min(fill, block_size)
        r = next(r for r in found[b] if r["low"] <= state <= r["high"])
        # A fill above the block size (one long sentence) acts like a full block.
        fill, block = r["fill"] + ((state - r["low"]) if r["rising"] else 0), block + r["closed"]
    columns = [*order, "block_id"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def replay(batches):
        bucket, fill, block = None, 0, 0
        for pdf in batches:
            done = []
            for b, part in pdf.groupby("_bucket", sort=True):
                if b != bucket:
                    bucket, (fill, block) = b, starts[b]
                ids, fill, block = _advance(part["_size"].to_numpy(), min(fill, block_size), block, block_size)
                done.append(part.assign(block_id=ids)[columns])
            if done:
                yield pd.concat(done)

    again = placed.filter("low is null").select(*order, "_size", "_bucket", "_pos").repartition("_bucket").sortWithinPartitions("_bucket", "_pos")
    return again.mapInPandas(replay, ", ".join(f"{c} {types[c]}" for c in order) + ", block_id bigint")


def select_targets(df: DataFrame, targets: list[str] | None, add_eos: bool = False) -> DataFrame:
    """Choose ``self`` / ``future`` / ``past`` targets of ``(source, future, past)`` rows.

    With ``add_eos`` (modes other than *none*) a source without final EOS gets one when
    ``self`` or ``past`` is asked for, and the other targets are filled up to its length.
    """
    source, future, past = F.col("source"), F.col("future"), F.col("past")
    if targets and add_eos and ({"self", "past"} & set(targets)):
        grow = ~ar.ends_with(source)
        df = df.withColumn("_grow", grow)
        future = F.when(F.col("_grow"), F.concat(future, ar.ints(PAD))).otherwise(future) if "future" in targets else future
        if "past" in targets:
            shifted = F.concat(ar.ints(PAD), F.slice(past, 2, F.size(past)), F.array(ar.last(source)))
            past = F.when(F.col("_grow"), shifted).otherwise(past)
        source = F.when(F.col("_grow"), ar.append_eos(source)).otherwise(source)
    named = {"self": source, "future": future, "past": past}
    keep = [c for c in df.columns if c not in ("source", "future", "past", "_grow")]
    wanted = targets or ["future"]
    return df.select(*keep, source.alias("source"), *[named[t].alias(f"target_{t}") for t in wanted])


# ---------------------------------------------------------------- masked tokens


def masked_example(
    df: DataFrame, ids: str, acc: Column, vocab_size: int, p: float = 0.15,
    mask: int = MASK, go: int | None = GO, eos: int = EOS, pad: int = PAD,
) -> DataFrame:
    """Adds ``source`` and ``target`` of a masked-token example, entirely inside the row.

    The ``max(1, round(p * length))`` candidates with the smallest draws are chosen; of
    these 80 % become the mask, 10 % stay, 10 % become any id. ``acc`` is the row's hash; without
    one nothing is chosen.
    """
    closed = [eos] if go is None else [eos, go]

    def masked(t: np.ndarray, sizes: np.ndarray, acc: np.ndarray, able: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat tokens of rows with these sizes; ``able`` tells which tokens may be chosen."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(able & ~np.isin(t, closed))
        # Smallest draws of a row first, equal ones by their place.
        at = at[np.argsort((row[at] << 31) + folds(acc[row[at]], place[at]), kind="stable")]
        opened = np.bincount(row[at], minlength=len(sizes))
        nth = np.arange(len(at)) - (np.cumsum(opened) - opened)[row[at]]
        at = at[nth < np.maximum(1, np.rint(sizes * p))[row[at]]]
        u = units(acc[row[at]], place[at] + 1_000_000_007)
        other = np.floor(units(acc[row[at]], place[at] + 1_500_000_001) * vocab_size).astype(t.dtype)
        source, target = t.copy(), np.full(len(t), pad, t.dtype)
        target[at] = t[at]
        source[at] = np.where(u < 0.8, mask, np.where(u < 0.9, t[at], other))
        return source, target

    @F.arrow_udf("struct<source:array<int>,target:array<int>>")
    def build(batch: pa.Array, acc: pa.Array) -> pa.Array:
        empty = pa.array([], pa.list_(pa.int32()))
        parts = [pa.StructArray.from_arrays([empty, empty], names=["source", "target"])]
        length = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in chunks(length, CHUNK_TOKENS):
            rows, hashes, sizes = batch.slice(a, b - a), acc.slice(a, b - a), length[a:b]
            tokens = rows.flatten()
            known = tokens.is_valid().to_numpy(zero_copy_only=False)
            t = pc.fill_null(tokens, 0).to_numpy(zero_copy_only=False).astype(np.int32)
            if go is not None:
                given = rows.is_valid().to_numpy(zero_copy_only=False)
                heads = (np.cumsum(sizes) - sizes)[given]
                t, known, sizes = np.insert(t, heads, go), np.insert(known, heads, True), sizes + given
            hashed = hashes.is_valid().to_numpy(zero_copy_only=False)
            source, target = masked(t, sizes, pc.fill_null(hashes, 0).to_numpy(zero_copy_only=False), known & np.repeat(hashed, sizes))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(rows.is_null().to_numpy(zero_copy_only=False), False))
            lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(source, mask=~known), pa.array(target))]
            parts.append(pa.StructArray.from_arrays(lists, names=["source", "target"]))
        return pa.concat_arrays(parts)

    rows = fenced(df.withColumn("_acc", acc.cast("bigint")), ids, "_acc")
    rows = fenced(rows.withColumn("_m", build(F.col(ids), F.col("_acc"))), "_m")
    return rows.withColumns({"source": F.col("_m.source"), "target": F.col("_m.target")}).drop("_m", "_acc")


# ---------------------------------------------------------------- pairs


def property_example(df: DataFrame, ids: str, reverse: bool = True, go: int | None = GO, props: list[str] | None = None) -> DataFrame:
    """``source`` is the target without EOS, optionally reversed; GO opens both.

    With ``props`` the row also gets ``prop``, all property values (0 where missing), and
    ``miss``, true where the value is present.
    """
    if props:
        df = df.withColumns({
            "prop": F.array(*[F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in props]),
            "miss": F.array(*[F.col(p).isNotNull() for p in props]),
        })
    body = ar.drop_last(F.col(ids))
    source = F.reverse(body) if reverse else body
    target = F.col(ids)
    if go is not None:
        source, target = F.concat(ar.ints(go), source), F.concat(ar.ints(go), target)
    return df.withColumn("source", source).withColumn("target", target)


def pair_example(df: DataFrame, append_eos_to_target: bool = False, remove_eos_from_source: bool = False) -> DataFrame:
    source, target = F.col("source"), F.col("target")
    if append_eos_to_target:
        target = ar.ensure_eos(target)
    if remove_eos_from_source:
        source = ar.strip_eos(source)
    return df.withColumns({"source": source, "target": target})


def transform_eos(df: DataFrame, append_src=False, remove_src=False, append_tgt=False, remove_tgt=False) -> DataFrame:
    """Append or remove EOS; a row where that contradicts its tokens fails the job."""
    if (append_src and remove_src) or (append_tgt and remove_tgt):
        raise ValueError("cannot both append and remove EOS on one side")
    out = {}
    for name, append, remove in (("source", append_src, remove_src), ("target", append_tgt, remove_tgt)):
        t = F.col(name)
        if append or remove:
            changed = ar.append_eos(t) if append else ar.drop_last(t)
            wrong = F.raise_error(F.lit(f"unexpected EOS state in {name}")).cast("array<int>")
            out[name] = F.when(ar.ends_with(t) == F.lit(bool(remove)), changed).otherwise(wrong)
    return df.withColumns(out) if out else df


def eos_violations(df: DataFrame, column: str, expected: bool) -> DataFrame:
    """Number of rows whose EOS state is not the expected one."""
    return df.filter(ar.ends_with(F.col(column)) != F.lit(expected)).agg(F.count(F.lit(1)).alias("violations"))


def back_translate(samples: DataFrame, best: DataFrame, key: str = "id") -> DataFrame:
    """Best hypothesis becomes the source, the original source the target."""
    hyp = best.select(key, F.col("tokens").alias("_hyp"))
    return samples.join(hyp, key).withColumn("target", F.col("source")).withColumn("source", F.col("_hyp")).drop("_hyp")


def closest(queries: DataFrame, values: DataFrame, group: list[str], size: str, name: str) -> DataFrame:
    """The rows of ``queries`` with the (at most two) ``name`` of ``values`` of their group that may
    be closest in size: the last that is not larger and the next one, with ``distance``.

    Of values of one group and size the smallest name counts. Values and queries are laid out in
    one order, where a running count of values tells a query its neighbours' places; groups of
    any size are split like any other range. Rows without a size have no neighbour.
    """
    kind = values.schema[name].dataType.simpleString()
    listed = values.filter(F.col(size).isNotNull()).groupBy(*group, F.col(size).cast("bigint").alias("_size")).agg(F.min(name).alias("_name"))
    asked = queries.filter(F.col(size).isNotNull()).select(*group, F.col(size).cast("bigint").alias("_size"), F.lit(None).cast(kind).alias("_name"), F.struct(*queries.columns).alias("_row"))
    events = listed.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).withColumn("_asks", F.lit(0)).unionByName(asked.withColumn("_asks", F.lit(1)))
    laid = running(events, ["_size", "_asks"], {"_nth": (1 - F.col("_asks")).cast("bigint")}, group=group)
    found = laid.filter("_asks = 0").select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_nth").alias("_place"), F.col("_size").alias("_found"), F.col("_name").alias("_near"))
    near = laid.filter("_asks = 1").withColumn("_nth", F.explode(F.array(F.col("_nth"), F.col("_nth") + 1)))
    match = F.col("_nth") == F.col("_place")
    for i, g in enumerate(group):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    both = near.join(found, match)
    return both.select("_row.*", F.col("_near").alias(name), F.abs(F.col("_size") - F.col("_found")).alias("distance"))


def canonical_pair(pair: Column) -> Column:
    """``de-en`` for both directions of a language pair."""
    return F.array_join(F.sort_array(F.split(pair, "-")), "-")


def swap_direction(df: DataFrame, reverse: Column) -> DataFrame:
    """Serve the reverse direction from the same corpus."""
    return df.withColumns({
        "source": F.when(reverse, F.col("target")).otherwise(F.col("source")),
        "target": F.when(reverse, F.col("source")).otherwise(F.col("target")),
    })


# ---------------------------------------------------------------- corpus mixing

REPEATS_PER_ROW = 1 << 16


def corpus_table(df: DataFrame, key: str, ratios: dict | int = 1, corpora: list | None = None) -> DataFrame:
    """``(_key, n, ratio, place)`` per corpus: rows, repetitions, position (listed ones first,
    the others by name). Written once; as many rows as corpora, whose number is not bounded."""
    spark = df.sparkSession
    rows = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    kind = df.schema[key].dataType.simpleString()
    named = ratios if isinstance(ratios, dict) else {}
    default = 1 if isinstance(ratios, dict) else ratios
    listed = [(k, int(named.get(k, default)), i) for i, k in enumerate(corpora or [])]
    listed += [(k, int(r), None) for k, r in named.items() if k not in (corpora or [])]
    known = local_table(spark, listed, f"_key {kind}, ratio bigint, place bigint")
    rows = rows.join(known, "_key", "left")
    rows = rows.select("_key", "n", F.coalesce("ratio", F.lit(default)).cast("bigint").alias("ratio"), F.coalesce("place", F.lit(len(corpora or []))).alias("place"))
    path = scratch_dir(spark, "corpora")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _repeat(df: DataFrame, times: Column, most: int, out: str) -> DataFrame:
    """Rows repeated ``times`` with their repetition number; huge factors are dealt out."""
    rows = df.withColumn("_times", times.cast("bigint")).filter("_times > 0")
    if most > REPEATS_PER_ROW:
        first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1, F.lit(REPEATS_PER_ROW).cast("bigint")))
        rows = rows.withColumn("_from", first).repartition(F.col("_from"), F.xxhash64(*df.columns))
        last = F.least(F.col("_from") + REPEATS_PER_ROW, F.col("_times")) - 1
        rows = rows.withColumn(out, F.explode(F.sequence("_from", last))).drop("_from")
    else:
        rows = rows.withColumn(out, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)))
    return rows.drop("_times")


def concat_corpora(df: DataFrame, key: str, order: list[str], ratios: dict | int = 1, corpora: list | None = None) -> DataFrame:
    """Corpora one after the other, each repeated ``ratio`` times; adds ``new_id``.

    ``corpora`` names those that come first, in order; the others follow by name.
    """
    sizes = corpus_table(df, key, ratios, corpora)
    laid = running(sizes, ["place", "_key"], {"_end": F.col("n") * F.col("ratio")})
    most = sizes.agg(F.max("ratio")).first()[0] or 1
    rows = ranked(df, order, "_rank", group=[key]).join(laid, F.col(key) == F.col("_key"))
    rows = rows.withColumn("_first", F.col("_end") - F.col("n") * F.col("ratio")).withColumnRenamed("n", "_n")
    rows = _repeat(rows.select(*df.columns, "_rank", "_first", "_n", F.col("ratio").alias("_ratio")), F.col("_ratio"), most, "_rep")
    new_id = F.col("_first") + F.col("_rep") * F.col("_n") + F.col("_rank")
    return rows.withColumn("new_id", new_id).drop("_rep", "_rank", "_first", "_n", "_ratio")


def round_robin(df: DataFrame, key: str, order: list[str], eval_key=None) -> DataFrame:
    """One row per ``(step, corpus)``; shorter corpora start over until the longest ends."""
    if eval_key is not None:
        return ranked(df.filter(F.col(key) == eval_key), order, "step")
    sizes = corpus_table(df, key).select("_key", F.col("n").alias("_n"))
    longest, least = sizes.agg(F.max("_n"), F.min("_n")).first()
    rows = ranked(df, order, "_rank", group=[key]).join(sizes, F.col(key) == F.col("_key")).drop("_key")
    times = F.floor((F.lit(longest) - F.col("_rank") - 1) / F.col("_n")) + 1
    rows = _repeat(rows, times, (longest or 0) // (least or 1) + 1, "_rep")
    return rows.withColumn("step", F.col("_rank") + F.col("_rep") * F.col("_n")).drop("_rank", "_rep", "_n")


def classification_pairs(texts: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Text ids with exactly one label id each."""
    return texts.join(labels, key).withColumn("target", F.array(F.col("label_id").cast("int")))
