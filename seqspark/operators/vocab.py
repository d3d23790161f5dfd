"""Vocabularies: counting, ranking, encoding, decoding, alignment dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seqspark.consts import EOS, PLAIN_SPECIALS, UNK
from seqspark.functions import text as tx
from seqspark.operators.ordering import ranked
from seqspark.session import fenced, local_table, pin, scratch_dir, written

# Lookup tables that may be shipped to every task: rows, and bytes of the longest token. So
# they are at most 250 MB, and about 20 MB for ordinary words.
BROADCAST_ROWS, TOKEN_BYTES = 1_000_000, 250
# Of a larger table of values, as many rows are shipped: their index is made for each part of a batch.
SHIPPED_ROWS = 200_000
# Tokens of an Arrow batch, and bytes of its texts, that are worked on at once.
CHUNK_TOKENS, CHUNK_BYTES = 1 << 19, 8 << 20


def first_key(*parts: tuple[Column, int]) -> Column:
    """Pack an order key ``(column, bits)`` into one decimal.

    A decimal fits the fixed-width buffer of a hash aggregate, so ``min`` of it is
    combined on the map side; ``min`` of a struct would sort all tokens instead.
    """
    key = F.lit(0).cast("decimal(38,0)")
    for column, bits in parts:
        key = (key * F.lit(2**bits).cast("decimal(20,0)") + column.cast("decimal(20,0)")).cast("decimal(38,0)")
    return key


def count_tokens(tokens: DataFrame, token: str = "token", first: str = "first") -> DataFrame:
    """Token counts and first occurrences; ``tokens`` has one row per occurrence."""
    return tokens.groupBy(token).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(first).alias("first")
    )


def count_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Token counts of whole texts plus one end mark per line.

    A task counts the words of some texts at a time, so one row per distinct word of these is
    aggregated and not one per occurrence.
    """
    end = PLAIN_SPECIALS[EOS]
    # The key of a text has at most 30 digits, so that a place added to it still fits a decimal.
    base = first_key((F.col(id_col), 0), (F.lit(0), 31)).cast("decimal(30,0)")
    rows = docs.select(base.alias("base"), F.col(text_col).alias("text"))

    def record(tokens, n, base, pos):
        first = pc.add(base, pa.array(pos, pa.int64()).cast(pa.decimal128(19, 0))).cast(pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([tokens, pa.array(n, pa.int64()), first], names=["token", "n", "first"])

    def tallied(batches):
        for batch in batches:
            for start, stop in chunks(_byte_sizes(batch.column("text")), CHUNK_BYTES):
                part = batch.slice(start, stop - start).filter(pc.is_valid(batch.column("text").slice(start, stop - start)))
                if not part.num_rows:
                    continue
                part = part.take(pc.sort_indices(part.column("base"), null_placement="at_end"))
                base, texts = part.column("base"), part.column("text")
                tokens, sizes = _words(texts)
                # The end marks of a text come after its words.
                yield record(pa.array([end] * len(texts), pa.string()), pc.add(pc.count_substring(texts, "\n").cast(pa.int64()), 1), base, sizes)
                row = np.repeat(np.arange(len(texts)), sizes)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                same = pc.fill_null(pc.equal(base.slice(1), base.slice(0, len(texts) - 1)), False).to_numpy(zero_copy_only=False)
                if same.any():  # rows of one id: their first positions are compared
                    number = np.cumsum(np.concatenate([[0], ~same]))
                    order = np.lexsort((pos, number[row]))
                    tokens, row, pos = tokens.take(pa.array(order)), row[order], pos[order]
                # Tokens are coded in the order in which they appear.
                coded = tokens.dictionary_encode()
                codes = coded.indices.to_numpy()
                first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
                yield record(coded.dictionary, np.bincount(codes, minlength=len(first)), base.take(pa.array(row[first])), pos[first])

    found = rows.mapInArrow(tallied, "token string, n bigint, first decimal(38,0)")
    return found.groupBy("token").agg(F.sum("n").alias("cnt"), F.min("first").alias("first"))


def specials(spark: SparkSession, names: list[str] = PLAIN_SPECIALS) -> DataFrame:
    return local_table(spark, list(enumerate(names)), "token_id bigint, token string")


def fixed_vocab(spark: SparkSession, names: list[str], tokens: list[str]) -> DataFrame:
    """A vocabulary given as a list (the molecule vocabularies)."""
    rows = [(i, t, i < len(names)) for i, t in enumerate(names + tokens)]
    return local_table(spark, rows, "token_id bigint, token string, is_special boolean")


def finalize(
    counts: DataFrame,
    threshold: int = -1,
    nwords: int = -1,
    padding_factor: int = 8,
    names: list[str] = PLAIN_SPECIALS,
) -> DataFrame:
    """Dense ids by ``(cnt desc, first occurrence)``, after the reserved symbols.

    ``counts`` has ``(token, cnt, first)``. With ``nwords`` the candidates are a top-k
    and ids are given inside that bounded result; without it every token is ranked by
    the bucketed global order.
    """
    spark = counts.sparkSession
    nspecial = len(names)
    special = F.col("token").isin(names)
    found = counts.filter(special | (F.col("cnt") >= threshold)).select("token", "cnt", "first", special.alias("is_special"))
    order = [-F.col("cnt"), F.col("first")]
    reserved = specials(spark, names).select("token", F.col("token_id").alias("sid"), F.lit(0).cast("bigint").alias("cnt"))
    if nwords > 0:
        # Reserved symbols and the best words, in one pass over the counts.
        top = found.orderBy(F.desc("is_special"), *order).limit(nwords + nspecial)
        listed = top.select("token", F.lit(None).cast("bigint").alias("sid"), "cnt", "first").unionByName(
            reserved, allowMissingColumns=True
        )
        listed = listed.groupBy("token").agg(F.max("sid").alias("sid"), F.sum("cnt").alias("cnt"), F.min("first").alias("first"))
        one = Window.partitionBy(F.lit(0)).orderBy(F.col("sid").asc_nulls_last(), *order)
        rows = listed.withColumn("token_id", (F.row_number().over(one) - 1).cast("bigint")).filter(F.col("token_id") < nwords)
        rows = rows.withColumn("is_special", F.col("sid").isNotNull())
    else:
        # Every word is ranked; the counts are written once instead of being made three times.
        found = pin(found)
        words = ranked(found.filter("not is_special"), order, "token_id")
        rows = words.withColumn("token_id", F.col("token_id") + nspecial)
        seen = found.filter("is_special").select("token", F.col("cnt").alias("c"))
        rows = rows.unionByName(
            reserved.join(F.broadcast(seen), "token", "left").select(
                F.col("sid").alias("token_id"), "token", F.coalesce("c", "cnt").alias("cnt"), F.lit(True).alias("is_special")
            ),
            allowMissingColumns=True,
        )
    out = rows.select("token_id", "token", "cnt", "is_special")
    if padding_factor <= 1:
        return out
    # The last id is followed by the filling words.
    last = rows.agg(F.max("token_id").alias("m")) if nwords <= 0 else None
    if last is not None:
        out = out.withColumn("m", last.scalar())
    else:
        out = out.withColumn("m", F.max("token_id").over(Window.partitionBy(F.lit(0))))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(padding_factor - 1)), lambda i: i < F.pmod(-F.col("m") - 1, F.lit(padding_factor)))
    fill = F.transform(
        numbers,
        lambda i: F.struct(
            (F.col("m") + 1 + i).alias("token_id"), F.format_string("madeupword%04d", i).alias("token"),
            F.lit(0).cast("bigint").alias("cnt"), F.lit(False).alias("is_special"),
        ),
    )
    own = F.array(F.struct("token_id", "token", "cnt", "is_special"))
    return out.select(F.inline(F.when(F.col("token_id") == F.col("m"), F.concat(own, fill)).otherwise(own)))


def first_seen_vocab(tokens: DataFrame, names: list[str] = PLAIN_SPECIALS) -> DataFrame:
    """Growing vocabulary: ids by first occurrence. ``tokens`` has ``(token, first)``."""
    spark = tokens.sparkSession
    seen = tokens.filter(~F.col("token").isin(names)).groupBy("token").agg(F.min("first").alias("first"))
    grown = ranked(seen, ["first"], "rank").select((F.col("rank") + len(names)).alias("token_id"), "token")
    return specials(spark, names).unionByName(grown)


def merge_vocabs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Add the counts of ``right``; unseen symbols get ids after ``left`` in right order."""
    both = left.select("token", "token_id", F.col("cnt").alias("lc")).join(
        right.select("token", F.col("token_id").alias("right_id"), F.col("cnt").alias("rc")), "token", "full"
    )
    total = F.coalesce("lc", F.lit(0)) + F.coalesce("rc", F.lit(0))
    known = both.filter("token_id is not null").select("token_id", "token", total.alias("cnt"))
    new = ranked(both.filter("token_id is null"), ["right_id"], "rank")
    size = left.agg((F.max("token_id") + 1).alias("n"))
    new = new.select((size.scalar() + F.col("rank")).alias("token_id"), "token", total.alias("cnt"))
    return known.unionByName(new)


def _small(table: DataFrame, limit: int, value: str = "token_id"):
    """``(token, value)`` rows when the table provably fits, else None."""
    long = F.octet_length("token") > TOKEN_BYTES
    cut = table.select(F.when(~long, F.col("token")).alias("token"), value, F.coalesce(long, F.lit(False)).alias("long"))
    rows = cut.limit(limit + 1).toArrow()
    return rows.select(["token", value]) if rows.num_rows <= limit and not pc.any(rows["long"]).as_py() else None


def _keyed(df: DataFrame, key: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Rows with a key; without one they are numbered and written, so numbers stay."""
    if key:
        return df, key
    path = scratch_dir(df.sparkSession, "numbered")
    df.withColumn("_rid", F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path), ["_rid"]


def _offsets(batch: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], sizes.cumsum()]).astype("int32"))


def chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges with sizes of at most ``most`` together (at least one row)."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def _byte_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _in_chunks(batch: pa.Array, run: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``run`` on row ranges of a batch of arrays with a bounded number of tokens."""
    sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [run(batch.slice(a, b - a)) for a, b in chunks(sizes, CHUNK_TOKENS)]
    return pa.concat_arrays(parts) if parts else run(batch)


def _flat(found: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
    """Lists of words end to end, and their sizes."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return pa.array(list(chain.from_iterable(found)), pa.string()), sizes


def _listed(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32")), values)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of an Arrow array of texts end to end, and their number per text. Arrow parts at the same
    characters as ``str.split``, but leaves an empty part where a text begins or ends with one."""
    found = pc.utf8_split_whitespace(texts)
    parts, ends = found.flatten(), _offsets(found).to_numpy()
    some = pc.greater(pc.binary_length(parts), 0)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return parts.filter(some).cast(pa.string()), np.diff(upto[ends])


def split_texts(texts: pa.Array, split: Callable[[str], list[str]]) -> pa.Array:
    """Arrays of tokens of an Arrow batch of texts, a bounded part of it at a time."""
    parts = [pa.array([], pa.list_(pa.string()))]
    for a, b in chunks(_byte_sizes(texts), CHUNK_BYTES):
        tokens, sizes = _flat([[] if t is None else split(t) for t in texts.slice(a, b - a).to_pylist()])
        parts.append(_listed(sizes, tokens))
    return pa.concat_arrays(parts)


def joined_ids(ids: str) -> Column:
    """An array of whole numbers as text, parted by spaces; nulls in it are left out."""

    @F.arrow_udf("string")
    def shown(batch: pa.Array) -> pa.Array:
        return _in_chunks(batch, _spaced)

    return shown(F.col(ids))


def _spaced(part: pa.Array) -> pa.Array:
    flat, ends = part.flatten(), _offsets(part).to_numpy()
    if flat.null_count:
        some = pc.is_valid(flat)
        ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[ends].astype(np.int32)
        flat = flat.filter(some)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat.cast(pa.string())), " ")
    return pc.if_else(pc.is_valid(part), text, pa.scalar(None, pa.string())) if part.null_count else text


def _numbered(tokens: pa.Array, table, unk: int) -> pa.Array:
    names, ids = table.value
    return pc.fill_null(pc.take(ids, pc.index_in(tokens, value_set=names)), unk)


def shipped(vocab: DataFrame, limit: int = BROADCAST_ROWS):
    """A broadcast ``(tokens, ids)`` of a vocabulary that fits, else None."""
    table = _small(vocab, limit)
    if table is None:
        return None
    columns = table["token"].combine_chunks(), table["token_id"].combine_chunks().cast(pa.int32())
    return vocab.sparkSession.sparkContext.broadcast(columns)


def encode(
    df: DataFrame,
    tokens: str,
    vocab: DataFrame,
    out: str = "ids",
    key: list[str] | None = None,
    limit: int = BROADCAST_ROWS,
    unk: int = UNK,
    lookup=None,
) -> DataFrame:
    """Replace a column of token arrays by a column of id arrays, unknown -> ``unk``.

    Up to ``limit`` vocabulary rows (counted first) the lookup is row-local: no shuffle of
    the corpus, one vectorised dictionary probe per part of an Arrow batch. Beyond that the lookup
    is a join, by ``key`` if it identifies a row, else by a number given to each. A stream passes
    the ``lookup`` it made once with ``shipped``.
    """
    table = lookup or shipped(vocab, limit)
    if table is None:
        return _encode_by_join(df, tokens, vocab, out, key, unk)

    @F.arrow_udf("array<int>")
    def probe(batch: pa.Array) -> pa.Array:
        return _in_chunks(batch, lambda part: pa.ListArray.from_arrays(_offsets(part), _numbered(part.flatten(), table, unk)))

    return fenced(df, tokens).withColumn(out, probe(F.col(tokens)))


def encode_text(
    df: DataFrame, text: str, vocab: DataFrame, out: str = "ids", key: list[str] | None = None,
    limit: int = BROADCAST_ROWS, unk: int = UNK, lookup=None,
) -> DataFrame:
    """``encode`` for the words of a text column; no text has no words.

    Where the lookup is row-local, texts are split where they are looked up: ``str.split``
    parts words at the characters of ``tx.words``.
    """
    table = lookup or shipped(vocab, limit)
    if table is None:
        return _encode_by_join(df.withColumn("_words", tx.words(F.col(text))), "_words", vocab, out, key, unk).drop("_words")

    @F.arrow_udf("array<int>")
    def probe(batch: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.int32()))]
        for a, b in chunks(_byte_sizes(batch), CHUNK_BYTES):
            tokens, sizes = _words(batch.slice(a, b - a))
            parts.append(_listed(sizes, _numbered(tokens, table, unk)))
        return pa.concat_arrays(parts)

    return fenced(df, text).withColumn(out, probe(F.col(text)))


def encode_lines(df: DataFrame, text: str, vocab: DataFrame, limit: int = BROADCAST_ROWS, unk: int = UNK) -> DataFrame:
    """Per text the ``ids`` of all its lines with end marks and, per token, the number of its line
    (``line``) and its place there (``off``), with their number (``size``); all but ``ids`` are null
    where there is no text."""
    end = PLAIN_SPECIALS[EOS]
    table = shipped(vocab, limit)
    if table is None:
        lines = F.transform(tx.lines(F.col(text)), lambda t: F.concat(tx.words(t), F.array(F.lit(end))))
        rows = df.withColumn("_l", lines).withColumns({
            "_tokens": F.flatten("_l"),
            "line": F.flatten(F.transform("_l", lambda w, i: F.array_repeat(i, F.size(w)))),
            "off": F.flatten(F.transform("_l", lambda w: F.sequence(F.lit(0), F.size(w) - 1))),
            "size": F.aggregate("_l", F.lit(0), lambda a, w: a + F.size(w)),
        })
        return _encode_by_join(rows.drop("_l"), "_tokens", vocab, "ids", None, unk).drop("_tokens")

    @F.arrow_udf("struct<ids:array<int>,line:array<int>,off:array<int>>")
    def probe(batch: pa.Array) -> pa.Array:
        empty = pa.array([], pa.list_(pa.int32()))
        parts = [pa.StructArray.from_arrays([empty] * 3, names=["ids", "line", "off"])]
        for a, b in chunks(_byte_sizes(batch), CHUNK_BYTES):
            lines = pc.split_pattern(batch.slice(a, b - a), "\n")
            ends = _offsets(lines).to_numpy()
            number = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
            tokens, width = _words(lines.flatten())
            stops = np.cumsum(width + 1)  # a line ends with its mark
            ids = np.insert(_numbered(tokens, table, unk).to_numpy(), np.cumsum(width), _numbered(pa.array([end]), table, unk)[0].as_py())
            off = np.arange(len(ids)) - np.repeat(stops - width - 1, width + 1)
            sizes = np.diff(np.concatenate([[0], stops])[ends])
            cols = [pa.array(x.astype(np.int32)) for x in (ids, np.repeat(number, width + 1), off)]
            parts.append(pa.StructArray.from_arrays([_listed(sizes, c) for c in cols], names=["ids", "line", "off"]))
        return pa.concat_arrays(parts)

    found = fenced(fenced(df, text).withColumn("_s", probe(F.col(text))), "_s")
    some = F.col(text).isNotNull()
    named = {"line": F.when(some, F.col("_s.line")), "off": F.when(some, F.col("_s.off")), "size": F.when(some, F.size("_s.ids")), "ids": F.col("_s.ids")}
    return found.withColumns(named).drop("_s")


def attach_values(
    df: DataFrame, tokens: str, table: DataFrame, value: str, out: str,
    limit: int = BROADCAST_ROWS, key: list[str] | None = None, often: str | None = None, default: float | None = None,
    kind: str = "double",
) -> DataFrame:
    """Array of values (of a ``kind``) looked up for an array of tokens (``table``: ``(token, value)``, a
    row a token); tokens that the table lacks have the ``default``. Null tokens are in no table.

    Up to ``limit`` rows of the table are shipped. Of a larger one ``SHIPPED_ROWS`` are, those with
    the greatest ``often`` (any choice gives the same values); the rows are then written once, and
    only those with a token that was not shipped are joined, by these tokens.
    """
    named = table.select("token", F.col(value).cast(kind).alias("v"), (F.col(often) if often else F.lit(0)).alias("n"))
    rows = _small(named, limit, "v")
    whole = rows is not None
    if not whole:
        short = named.filter(F.octet_length("token") <= TOKEN_BYTES)
        rows = (short.orderBy(F.desc("n"), "token") if often else short).select("token", "v").limit(min(limit, SHIPPED_ROWS)).toArrow()
    shipped = df.sparkSession.sparkContext.broadcast((rows["token"].combine_chunks(), rows["v"].combine_chunks()))

    def found(part: pa.Array) -> pa.Array:
        names, values = shipped.value
        coded = part.flatten().dictionary_encode()
        at = pc.take(pc.index_in(coded.dictionary, value_set=names), coded.indices)
        taken = pc.take(values, at)
        if whole:
            if default is not None:
                taken = pc.if_else(pc.is_null(at), default, taken)
            return pa.ListArray.from_arrays(_offsets(part), taken)
        named = pc.is_valid(coded.indices)
        if default is not None:
            taken = pc.if_else(named, taken, default)
        given = pa.ListArray.from_arrays(_offsets(part), taken)
        place = np.flatnonzero(pc.and_(pc.is_null(at), named).to_numpy(zero_copy_only=False))
        ends = _offsets(part).to_numpy()
        row = np.searchsorted(ends, place, side="right") - 1
        missing = _listed(np.bincount(row, minlength=len(part)), pa.array((place - ends[row]).astype(np.int32)))
        return pa.StructArray.from_arrays([given, missing], names=["v", "missing"])

    @F.arrow_udf(f"array<{kind}>" if whole else f"struct<v:array<{kind}>,missing:array<int>>")
    def lookup(batch: pa.Array) -> pa.Array:
        return _in_chunks(batch, found)

    looked = fenced(df, tokens).withColumn(out, lookup(F.col(tokens)))
    if whole:
        return looked
    looked = written(looked.withColumn("_rid", F.monotonically_increasing_id()), "looked_up")
    done, more = F.col(f"{out}.v"), F.size(f"{out}.missing") > 0
    open_ = looked.filter(more)
    asked = open_.select("_rid", F.col(tokens).alias("_t"), F.explode(f"{out}.missing").alias("pos")).select("_rid", "pos", F.get("_t", F.col("pos")).alias("token"))
    if default is None:
        values = asked.join(named.select("token", "v"), "token")
    else:
        values = asked.join(named.select("token", "v", F.lit(True).alias("_in")), "token", "left")
        values = values.withColumn("v", F.when(F.col("_in"), F.col("v")).otherwise(F.lit(float(default))))
    late = values.groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("_late"))
    patched = F.when(F.col("_late").isNull(), done).otherwise(F.transform(done, lambda x, i: F.coalesce(x, F.try_element_at("_late", i))))
    joined = open_.join(late, "_rid", "left").withColumn(out, patched).drop("_late")
    return looked.filter(~more).withColumn(out, done).unionByName(joined).drop("_rid")


def lookup_ids(tokens: DataFrame, vocab: DataFrame, unk: int = UNK) -> DataFrame:
    """Long form of the same: one row per token, joined to its id.

    Adaptive execution picks broadcast or sort-merge from the measured vocabulary size
    and splits the partitions of hot tokens.
    """
    names = vocab.select("token", "token_id")
    return tokens.join(names, "token", "left").withColumn("token_id", F.coalesce("token_id", F.lit(unk)).cast("bigint"))


def _encode_by_join(df, tokens, vocab, out, key, unk):
    df, key = _keyed(df, key)
    long = df.select(*key, F.posexplode(tokens).alias("pos", "token"))
    packed = F.sort_array(F.collect_list(F.struct("pos", F.col("token_id").cast("int").alias("i"))))
    ids = lookup_ids(long, vocab, unk).groupBy(*key).agg(packed.alias("_p")).select(*key, F.col("_p.i").alias(out))
    empty = F.array().cast("array<int>")
    return df.join(ids, key, "left").withColumn(out, F.coalesce(out, empty)).drop("_rid")


def decode(
    long: DataFrame, vocab: DataFrame, key: list[str], escape_unk: bool = False, bpe: bool = False, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """``(key, pos, token_id)`` to text: EOS dropped, unknown ids shown as the unk symbol.

    Ids are gathered by key and named there; beyond ``limit`` vocabulary rows they are named
    by a join before.
    """
    kept = long.filter(F.col("token_id") != EOS)
    if _small(vocab, limit) is not None:
        packed = F.sort_array(F.collect_list(F.struct("pos", "token_id")))
        rows = kept.groupBy(*key).agg(packed["token_id"].alias("_ids"))
        return decode_rows(rows, "_ids", vocab, escape_unk=escape_unk, bpe=bpe, limit=limit).select(*key, "text")
    unk = f"<{PLAIN_SPECIALS[UNK]}>" if escape_unk else PLAIN_SPECIALS[UNK]
    named = kept.join(vocab.select("token_id", "token"), "token_id", "left")
    token = F.when(F.col("token_id") == UNK, F.lit(unk)).otherwise(F.coalesce("token", F.lit(unk)))
    packed = F.sort_array(F.collect_list(F.struct("pos", token.alias("t"))))
    sent = F.array_join(packed["t"], " ")
    return named.groupBy(*key).agg((tx.remove_bpe(sent) if bpe else sent).alias("text"))


def decode_rows(
    df: DataFrame, ids: str, vocab: DataFrame, key: list[str] | None = None,
    escape_unk: bool = False, bpe: bool = False, limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add ``text`` for a column of id arrays; row-local while the vocabulary is small."""
    unk = f"<{PLAIN_SPECIALS[UNK]}>" if escape_unk else PLAIN_SPECIALS[UNK]
    table = _small(vocab, limit)
    if table is None:
        df, key = _keyed(df, key)
        long = df.select(*key, F.posexplode(ids).alias("pos", "token_id"))
        return df.join(decode(long, vocab, key, escape_unk, bpe, limit), key, "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("_rid")
    shipped = df.sparkSession.sparkContext.broadcast((table["token_id"].combine_chunks().cast(pa.int32()), table["token"].combine_chunks()))

    def shown_as(part: pa.Array) -> pa.Array:
        keys, names = shipped.value
        flat = part.flatten()
        found = pc.fill_null(pc.take(names, pc.index_in(flat, value_set=keys)), unk)
        found = pc.if_else(pc.equal(flat, UNK), unk, found)
        return pa.ListArray.from_arrays(_offsets(part), found)

    @F.arrow_udf("array<string>")
    def lookup(batch: pa.Array) -> pa.Array:
        return _in_chunks(batch, shown_as)

    shown = df.withColumn("_shown", F.filter(F.col(ids), lambda i: i != EOS))
    named = fenced(shown, "_shown").withColumn("_names", lookup(F.col("_shown")))
    sentence = F.array_join("_names", " ")
    return named.withColumn("text", tx.remove_bpe(sentence) if bpe else sentence).drop("_shown", "_names")


def encode_report(encoded: DataFrame, by: list[str]) -> DataFrame:
    """Per split: sequences, tokens incl. EOS, replaced tokens and their percentage.

    ``encoded`` has ``(words, ids)`` per line; a literal unk symbol is not a replacement.
    """
    unk = PLAIN_SPECIALS[UNK]
    replaced = F.size(
        F.filter(F.arrays_zip(F.col("words").alias("w"), F.col("ids").alias("i")), lambda z: (z["i"] == UNK) & (z["w"] != unk))
    )
    total = encoded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nseq"),
        F.sum(F.size("ids") + 1).cast("bigint").alias("ntok"),
        F.sum(replaced).cast("bigint").alias("nunk"),
    )
    return total.withColumn("pct", F.round(100.0 * F.col("nunk") / F.col("ntok"), 6))


def replaced_tokens(encoded: DataFrame) -> DataFrame:
    """How often each token was replaced."""
    z = encoded.select(F.explode(F.arrays_zip(F.col("words").alias("w"), F.col("ids").alias("i"))).alias("z"))
    hit = z.filter((F.col("z.i") == UNK) & (F.col("z.w") != PLAIN_SPECIALS[UNK]))
    return hit.groupBy(F.col("z.w").alias("token")).agg(F.count(F.lit(1)).alias("cnt"))


def coverage(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """How many vocabulary words have a vector."""
    hit = vocab.join(vectors.select("token").distinct(), "token", "left_semi").agg(F.count(F.lit(1)).alias("covered"))
    return hit.withColumn("total", vocab.agg(F.count(F.lit(1))).scalar())


def attach_vectors(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    return vocab.join(vectors, "token", "left")


def alignment_counts(links: DataFrame, source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """``(src, tgt, first)`` per aligned pair, counted; with vocabularies, only known words."""
    for vocab, side in ((source, "src"), (target, "tgt")):
        if vocab is not None:
            known = vocab.filter(F.col("token") != PLAIN_SPECIALS[UNK]).select(F.col("token").alias(side))
            links = links.join(known, side, "left_semi")
    return links.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("cnt"), F.min("first").alias("first"))


def alignment_dict(links: DataFrame, source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """Most frequent target per source, ties to the pair seen first; see ``alignment_counts``."""
    best = F.max_by("tgt", F.struct("cnt", (-F.col("first")).alias("f")))
    return alignment_counts(links, source, target).groupBy("src").agg(best.alias("tgt"))


def replace_unk(hyp: DataFrame, source: DataFrame, align: DataFrame, unk: str = PLAIN_SPECIALS[UNK], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Unknown hypothesis words become the dictionary entry of the aligned source word.

    ``hyp``: ``(id, pos, token, src_pos)``; ``source``: ``(id, words)``; ``align``:
    ``(src, tgt)``, a row a word. The source is followed by one ``<eos>``. Words are looked up
    where the hypotheses are (see ``attach_values``), so a frequent one gathers no rows.
    """
    src = source.select("id", F.concat("words", F.array(F.lit("<eos>"))).alias("_src"))
    gathered = hyp.groupBy("id").agg(F.collect_list(F.struct("pos", "token", "src_pos")).alias("_h"))
    # Words of one hypothesis stay in one row; the others than unknown ones have no source word.
    word = F.transform("_h", lambda h: F.when(h["token"] == unk, F.get("_src", h["src_pos"].cast("int"))))
    rows = written(gathered.join(src, "id").select("id", "_h", word.alias("_word")), "hypotheses")
    asked = rows.select(F.explode("_word").alias("src")).filter("src is not null").groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    found = align.join(asked, "src").select(F.col("src").alias("token"), "tgt", "n")
    looked = attach_values(rows, "_word", found, "tgt", "_tgt", limit=limit, often="n", kind="string")
    named = F.transform(
        F.arrays_zip(F.col("_h").alias("h"), F.col("_word").alias("w"), F.col("_tgt").alias("t")),
        lambda z: F.struct(z["h"]["pos"].alias("pos"), F.when(z["h"]["token"] == unk, F.coalesce(z["t"], z["w"])).otherwise(z["h"]["token"]).alias("t")),
    )
    # Sources with one id each have their own copy of the hypothesis.
    packed = F.sort_array(F.flatten(F.collect_list(named)))
    return looked.groupBy("id").agg(F.array_join(packed["t"], " ").alias("text"))


def bands(token_id: Column, cutoffs: list[int]) -> tuple[Column, Column]:
    """Frequency band of an id and its position inside the band."""
    band, start = F.lit(len(cutoffs) - 1), F.lit(cutoffs[-2] if len(cutoffs) > 1 else 0)
    for i in range(len(cutoffs) - 1, -1, -1):
        low = cutoffs[i - 1] if i else 0
        band = F.when(token_id < cutoffs[i], F.lit(i)).otherwise(band)
        start = F.when(token_id < cutoffs[i], F.lit(low)).otherwise(start)
    return band.cast("bigint"), (token_id - start).cast("bigint")


def incompatible(left: DataFrame, right: DataFrame) -> DataFrame:
    """Reserved symbols whose ids differ between two vocabularies (empty = compatible)."""
    names = PLAIN_SPECIALS[1:]
    a = left.filter(F.col("token").isin(names)).select("token", F.col("token_id").alias("left_id"))
    b = right.filter(F.col("token").isin(names)).select("token", F.col("token_id").alias("right_id"))
    return a.join(b, "token", "full").filter(~F.col("left_id").eqNullSafe(F.col("right_id")))
