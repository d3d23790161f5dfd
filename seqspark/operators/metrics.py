"""Corpus metrics and meters as mergeable aggregates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seqspark.consts import BPE_MARK, EOS, PAD, UNK
from seqspark.functions import arrays as ar
from seqspark.functions.arrays import let
from seqspark.session import fenced, one_row
from seqspark.operators.ordering import running
from seqspark.operators.vocab import CHUNK_TOKENS, chunks

LN2 = math.log(2)

# ---------------------------------------------------------------- BLEU


def clipped_matches(ref: np.ndarray, hyp: np.ndarray, ref_row: np.ndarray, hyp_row: np.ndarray, rows: int, order: int, unk: int) -> np.ndarray:
    """Clipped n-gram matches ``(rows, order)`` of flat id arrays with their row numbers.

    N-grams get exact dense numbers by numbering (number of the (n-1)-gram, next token).
    """
    out = np.zeros((rows, order), np.int64)
    row = np.concatenate([ref_row, hyp_row + rows])
    _, token = np.unique(np.concatenate([ref, hyp]), return_inverse=True)
    known = np.concatenate([ref != unk, np.ones(len(hyp), bool)])
    gram, at, ok = token, np.arange(len(token)), known
    for n in range(1, order + 1):
        if n > 1:
            inside = at + n - 1 < len(row)
            inside[inside] &= row[at[inside] + n - 1] == row[at[inside]]
            at, gram, ok = at[inside], gram[inside], ok[inside]
            ok = ok & known[at + n - 1]
            _, gram = np.unique(gram * (token.max(initial=0) + 1) + token[at + n - 1], return_inverse=True)
        pair = row[at] % rows * (gram.max(initial=0) + 1) + gram
        side = row[at] >= rows
        hyp_grams, hyp_n = np.unique(pair[side], return_counts=True)
        ref_grams, ref_n = np.unique(pair[~side & ok], return_counts=True)
        both, i, j = np.intersect1d(hyp_grams, ref_grams, assume_unique=True, return_indices=True)
        hits = np.minimum(hyp_n[i], ref_n[j])
        out[:, n - 1] = np.bincount(both // (gram.max(initial=0) + 1), hits, rows)[:rows]
    return out


def trimmed(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows laid end to end without leading pads, then without trailing pads and EOS; a row that
    is not empty keeps one element. Returns the kept values and the new sizes."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    place = np.arange(len(values))
    row = np.repeat(np.arange(len(sizes)), sizes)
    start, stop = ends - 1, begins.copy()
    lead = np.flatnonzero(values != PAD)
    np.minimum.at(start, row[lead], lead)
    start = np.maximum(start, begins)
    tail = np.flatnonzero((values != PAD) & (values != EOS))
    np.maximum.at(stop, row[tail], tail + 1)
    stop = np.minimum(np.maximum(stop, start + 1), ends)
    kept = (place >= start[row]) & (place < stop[row])
    return values[kept], np.maximum(stop - start, 0)


TOKENS_PER_CHUNK = 1 << 20


def _match_udf(order: int, unk: int):
    @F.arrow_udf("array<bigint>")
    def matches(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        parts, start = [np.zeros((0, order + 2), np.int64)], 0
        sizes = [pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False) for a in (ref, hyp)]
        ends = np.cumsum(sizes[0] + sizes[1])
        while start < len(ref):
            # A chunk of rows with a bounded number of tokens (at least one row).
            limit = (ends[start - 1] if start else 0) + TOKENS_PER_CHUNK
            stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            flat, row, length = [], [], []
            for side, size in zip((ref, hyp), sizes):
                values = side.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False)
                cut, sizes_now = trimmed(values, size[start:stop].astype(np.int64))
                length.append(sizes_now)
                flat.append(cut)
                row.append(np.repeat(np.arange(stop - start), length[-1]))
            found = clipped_matches(*flat, *row, stop - start, order, unk)
            parts.append(np.column_stack([*length, found]))
            start = stop
        table = np.concatenate(parts)
        offsets = pa.array(np.arange(0, table.size + 1, order + 2, dtype="int32"))
        return pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))

    return matches


def bleu_stats(df: DataFrame, key: list[str], ref: str, hyp: str, order: int = 4, by: list[str] | None = None, unk: int = UNK) -> DataFrame:
    """``ref_len, hyp_len, count1.., match1..`` per pair of id arrays, or summed over ``by``.

    Matching is local to a row, so pairs are not shuffled and n-grams never leave their
    task; an n-gram of the reference with an unknown token is never matched.
    """
    keep = list(dict.fromkeys([*key, *(by or [])]))
    rows = fenced(df.select(*keep, F.col(ref).alias("_r"), F.col(hyp).alias("_h")), "_r", "_h")
    rows = rows.select(*keep, _match_udf(order, unk)("_r", "_h").alias("_m"))
    parts = {"ref_len": F.get("_m", F.lit(0)), "hyp_len": F.get("_m", F.lit(1))}
    for k in range(1, order + 1):
        parts[f"count{k}"] = F.greatest(F.get("_m", F.lit(1)) - (k - 1), F.lit(0).cast("bigint"))
        parts[f"match{k}"] = F.get("_m", F.lit(k + 1))
    if by is None:
        return rows.select(*key, *[c.alias(n) for n, c in parts.items()])
    return rows.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in parts.items()])


def bleu(stats: DataFrame, order: int = 4, smooth: bool = False) -> DataFrame:
    """Corpus score with its parts. ``smooth`` starts the counts of n >= 2 at one."""
    one = lambda k: 1 if smooth and k > 1 else 0
    precision = [
        F.when(F.col(f"count{k}") + one(k) == 0, F.lit(0.0)).otherwise((F.col(f"match{k}") + one(k)) / (F.col(f"count{k}") + one(k)))
        for k in range(1, order + 1)
    ]
    ratio = F.when(F.col("ref_len") == 0, F.lit(0.0)).otherwise(F.col("hyp_len") / F.col("ref_len"))
    penalty = F.when(F.col("hyp_len") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))))
    lowest = F.least(*precision) if order > 1 else precision[0]
    mean = sum((F.log(F.greatest(p, F.lit(1e-300))) for p in precision[1:]), F.log(F.greatest(precision[0], F.lit(1e-300)))) / order
    score = F.when(lowest <= 0, F.lit(0.0)).otherwise(100 * penalty * F.exp(mean))
    out = stats.withColumns({f"p{k}": 100 * p for k, p in enumerate(precision, 1)})
    return out.withColumns({"brevity": penalty, "ratio": ratio, "bleu": score})


def bleu_text(order: int = 4) -> Column:
    shown = "/".join(["%.1f"] * order)
    parts = [F.col("bleu"), *[F.col(f"p{k}") for k in range(1, order + 1)], F.col("brevity"), F.col("ratio"), F.col("hyp_len"), F.col("ref_len")]
    return F.format_string(f"BLEU{order} = %.2f, {shown} (BP=%.3f, ratio=%.3f, syslen=%d, reflen=%d)", *parts)


# ---------------------------------------------------------------- losses


def cross_entropy(
    scores: DataFrame, by: list[str], logp: str = "logp", sample: list[str] | None = None,
    keep: Column | None = None, sentence_avg: bool = False,
) -> DataFrame:
    """Base-2 loss per sample unit and per token, and perplexity.

    ``scores`` has one row per target token; rows where ``keep`` is false (padding) count
    nowhere. ``nll_loss`` exists only when the two denominators differ.
    """
    rows = scores.filter(keep) if keep is not None else scores
    parts = [(-F.sum(logp)).alias("nll"), F.count(F.lit(1)).alias("ntokens")]
    if sentence_avg:
        rows = rows.groupBy(*by, *[s for s in sample if s not in by]).agg(F.sum(logp).alias(logp), F.count(F.lit(1)).alias("_n"))
        parts = [(-F.sum(logp)).alias("nll"), F.sum("_n").alias("ntokens"), F.count(F.lit(1)).alias("nsentences")]
    out = rows.groupBy(*by).agg(*parts)
    size = F.col("nsentences") if sentence_avg else F.col("ntokens")
    out = out.withColumn("sample_size", size).withColumn("loss", F.col("nll") / size / LN2)
    nll = F.when(F.col("sample_size") != F.col("ntokens"), F.col("nll") / F.col("ntokens") / LN2)
    return out.withColumn("nll_loss", nll).withColumn("ppl", perplexity(F.coalesce("nll_loss", "loss")))


def perplexity(loss: Column) -> Column:
    return F.when(loss > 1023, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), loss))


def composite(losses: DataFrame, by: list[str], loss: str = "loss", size: str = "sample_size") -> DataFrame:
    """Mean over several targets of the same samples."""
    return losses.groupBy(*by).agg(F.avg(loss).alias(loss), F.avg(size).alias(size))


def label_smoothed(rows: DataFrame, lprobs: str, target: str, epsilon: float, pad: int = PAD) -> DataFrame:
    """Per row: ``nll`` and smoothed ``loss``; padding rows are left out."""
    at = F.element_at(lprobs, F.col(target).cast("int") + 1)
    spread = -F.aggregate(lprobs, F.lit(0.0), lambda a, x: a + x)
    share = F.lit(epsilon) / F.size(lprobs)
    kept = rows.filter(F.col(target) != pad)
    return kept.withColumn("nll", -at).withColumn("loss", (1 - epsilon) * F.col("nll") + share * spread)


def exact_match(rows: DataFrame, sample: list[str], pred: str, target: str, by: list[str] | None = None, pad: int = PAD) -> DataFrame:
    """Share of samples whose every non-pad position is predicted."""
    hit = (F.col(pred) == F.col(target)) | (F.col(target) == pad)
    per = rows.groupBy(*sample).agg(F.bool_and(hit).alias("hit"))
    out = per.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("bigint")).alias("n_match"))
    return out.withColumn("accuracy", F.when(F.col("n") > 0, F.col("n_match") / F.col("n")).otherwise(F.lit(0.0)))


def property_metrics(rows: DataFrame, by: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Masked metrics over long rows ``(prop, present, kind, value, pred | scores)``.

    ``kind`` is ``reg`` (squared error of ``pred``) or ``cls`` (cross-entropy and accuracy of
    ``scores`` against the label ``value``). Absent labels contribute nothing; an empty
    property scores 0. ``weighted`` is the loss times the property's weight.
    """
    label = F.col("value").cast("int")
    peak = F.array_max("scores")
    norm = ar.let(peak, lambda m: m + F.log(F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - m))))
    cross = norm - F.element_at("scores", label + 1)
    loss = F.when(F.col("kind") == "cls", cross).otherwise(F.pow(F.col("pred") - F.col("value"), 2))
    best = F.array_position("scores", peak) - 1
    right = F.when(F.col("kind") == "cls", (best == label).cast("double"))
    present = rows.withColumn("_l", F.when(F.col("present"), loss)).withColumn("_a", F.when(F.col("present"), right))
    out = present.groupBy(*by, "prop", "kind").agg(
        F.count("_l").alias("num"),
        F.coalesce(F.avg("_l"), F.lit(0.0)).alias("loss"),
        F.when(F.col("kind") == "cls", F.coalesce(F.avg("_a"), F.lit(0.0))).alias("acc"),
    )
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("prop") == name, F.lit(float(w))).otherwise(weight)
    return out.withColumn("weighted", F.col("loss") * weight)


def merge_weighted(parts: DataFrame, by: list[str], values: list[str], count: str = "num") -> DataFrame:
    """Merge shard metrics weighted by their counts; 0 where there is no label."""
    total = F.sum(count)
    merged = [F.when(total == 0, F.lit(0.0)).otherwise(F.sum(F.col(v) * F.col(count)) / total).alias(v) for v in values]
    return parts.groupBy(*by).agg(total.alias(count), *merged)


def flatten_corpora(per: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``corpus:name`` rows plus one row per name summed over the corpora."""
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
    long = per.select(key, F.inline(pairs))
    sums = long.groupingSets([["name", key], ["name"]], "name", key).agg(F.sum("value").alias("value"), F.grouping(key).alias("_all"))
    label = F.when(F.col("_all") == 1, F.col("name")).otherwise(F.concat_ws(":", key, "name"))
    return sums.select(label.alias("name"), "value")


# ---------------------------------------------------------------- meters


def running_average(df: DataFrame, key: list[str], order: list[str], value: str, n: Column | None = None) -> DataFrame:
    """Average meter after every update, per key; keys may be of any size."""
    n = F.lit(1).cast("bigint") if n is None else n
    out = running(df, order, {"sum": F.col(value) * n, "count": n}, group=key)
    return out.withColumn("avg", F.col("sum") / F.col("count"))


def rate(df: DataFrame, key: list[str], ts: str, n: Column | None = None) -> DataFrame:
    """Units per elapsed second between the first and the last update."""
    n = F.lit(1).cast("bigint") if n is None else n
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    out = df.groupBy(*key).agg(F.sum(n).alias("n"), ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("elapsed"))
    return out.withColumn("rate", F.when(F.col("elapsed") > 0, F.col("n") / F.col("elapsed")))


def stopwatch(df: DataFrame, key: list[str], duration: str, n: Column | None = None) -> DataFrame:
    """Summed duration and mean duration per unit."""
    n = F.lit(1).cast("bigint") if n is None else n
    out = df.groupBy(*key).agg(F.sum(duration).alias("sum"), F.sum(n).alias("n"))
    return out.withColumn("avg", F.col("sum") / F.col("n"))


def histogram(df: DataFrame, value: str, bins: int = 1000) -> DataFrame:
    """Equal-width counts (last bin closed) with the summary of all values on each row."""
    v = F.col(value).cast("double")
    stats = df.agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("num"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_squares")
    )
    low, high = F.col("min"), F.col("max")
    width = F.when(high > low, (high - low) / bins).otherwise(F.lit(1.0 / bins))
    start = F.when(high > low, low).otherwise(low - 0.5)
    placed = df.select(v.alias("v"), one_row(stats.select("min", "max")).alias("s")).filter("v is not null").select("v", "s.*")
    guess = F.least(F.floor((F.col("v") - start) / width), F.lit(bins - 1)).cast("bigint")
    placed = placed.withColumn("_at", guess)
    # Division may round over an edge: the edges decide.
    below = F.col("v") < start + F.col("_at") * width
    above = (F.col("v") >= start + (F.col("_at") + 1) * width) & (F.col("_at") < bins - 1)
    bin_ = F.col("_at") - below.cast("bigint") + above.cast("bigint")
    counts = placed.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    out = grid.join(counts, "bin", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("bigint"))
    return out.withColumn("edge", start + (F.col("bin") + 1) * width)


# ---------------------------------------------------------------- sequence scores


def sequence_score(rows: DataFrame, sample: list[str], pos: str = "pos", logp: str = "logp", target: str = "target", pad: int = PAD) -> DataFrame:
    """Mean log-probability of the non-pad targets, with the scores by position."""
    kept = rows.filter(F.col(target) != pad)
    return kept.groupBy(*sample).agg(
        F.avg(logp).alias("score"), F.sort_array(F.collect_list(F.struct(pos, logp)))[logp].alias("positional")
    )


def sequence_texts(rows: DataFrame, sample: list[str], ids: str, model: DataFrame, pad: int = PAD) -> DataFrame:
    """``sequence_score`` of rows with arrays of target ids, scored by ``model``: ``(token_id, logp, shown)``,
    a row an id of the vocabulary. Gives ``score`` and ``positional``, the ``shown`` forms by position.

    Only ids are shuffled, in whole rows. Rows of one sample are merged by position and score.
    """
    found = model.select("token_id", "logp", "shown").toArrow()
    shipped = rows.sparkSession.sparkContext.broadcast([found[c].combine_chunks() for c in found.column_names])

    def scored(part: pa.Array) -> pa.Array:
        keys, values, names = shipped.value
        given = part.flatten()
        sizes = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False)
        flat = given.flatten()
        at = pc.index_in(flat, value_set=keys.cast(flat.type))
        kept = pc.and_(pc.is_valid(at), pc.fill_null(pc.not_equal(flat, pad), False)).to_numpy(zero_copy_only=False)
        parts = pc.list_value_length(part).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(part)), parts)
        row, pos = np.repeat(of, sizes)[kept], (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[kept]
        at = at.filter(pa.array(kept))
        logp = values.take(at).to_numpy(zero_copy_only=False)
        if parts.max(initial=0) > 1:
            order = np.lexsort((logp, pos, row))
            logp, at = logp[order], at.take(pa.array(order))
        n = np.bincount(row, minlength=len(part))
        total = np.bincount(row, logp, len(part))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        text = pc.binary_join(pa.ListArray.from_arrays(ends, names.take(at)), " ")
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        return pa.StructArray.from_arrays([mean, text], names=["score", "positional"])

    @F.arrow_udf("struct<score:double,positional:string>")
    def score(batch: pa.Array) -> pa.Array:
        tokens = pc.fill_null(pc.list_value_length(batch.flatten()), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch).to_numpy(zero_copy_only=False))])
        size = np.diff(np.concatenate([[0], np.cumsum(tokens)])[ends])
        parts = [scored(batch.slice(a, b - a)) for a, b in chunks(size, CHUNK_TOKENS)]
        return pa.concat_arrays(parts) if parts else scored(batch)

    gathered = rows.groupBy(*sample).agg(F.collect_list(ids).alias("_ids"))
    out = fenced(gathered.withColumn("_s", score(F.col("_ids"))), "_s")
    return out.filter("_s.score is not null").select(*sample, "_s.score", "_s.positional")


def ensemble(rows: DataFrame, key: list[str], lprob: str = "lprob") -> DataFrame:
    """Log of the mean probability over models (one row per model and key)."""
    packed = rows.groupBy(*key).agg(F.sort_array(F.collect_list(lprob)).alias("_l"))
    mean = ar.let(
        F.array_max("_l"),
        lambda m: m + F.log(F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.exp(x - m)) / F.size("_l")),
    )
    return packed.select(*key, mean.alias("lprob"))


def word_scores(df: DataFrame, pieces: str, scores: str, keep: list[str], mark: str = BPE_MARK) -> DataFrame:
    """Whole words ``(keep, word_idx, word, logp, is_bpe, next)`` of rows with pieces and scores.

    Continuation pieces hand their score on, infinite words are skipped, ``next`` is the
    first later score that is not zero. One pass over the flat pieces of an Arrow batch.
    """

    @F.arrow_udf("array<struct<word_idx:int,word:string,logp:double,is_bpe:boolean,next:double>>")
    def words(batch: pa.Array, values: pa.Array) -> pa.Array:
        return _word_scores(batch, values, mark)

    rows = fenced(df.filter(F.size(pieces) > 0).select(*keep, pieces, scores), pieces, scores)
    return rows.select(*keep, F.inline(words(F.col(pieces), F.col(scores))))


def _word_scores(batch: pa.Array, values: pa.Array, mark: str) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
    flat, rows = batch.flatten(), len(batch)
    score = values.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(rows), sizes)
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | ~pc.ends_with(flat, mark).to_numpy(zero_copy_only=False)[:-1]
    start = np.flatnonzero(opens)
    size = np.diff(np.append(start, len(row)))
    plain = pc.replace_substring(flat, mark, "")
    ends = pa.array(np.append(start, len(row)).astype(np.int32))
    word = pc.binary_join(pa.ListArray.from_arrays(ends, plain), "")
    with np.errstate(invalid="ignore"):
        total = np.add.reduceat(score, start) if len(start) else np.zeros(0)
    of = row[start]
    first = np.searchsorted(of, np.arange(rows))
    number = np.arange(len(start)) - first[of]
    good = np.flatnonzero(~np.isinf(total))
    total, of = total[good], of[good]
    real = np.flatnonzero(total != 0)
    later = np.append(real, -1)[np.searchsorted(real, np.arange(len(good)), side="right")]
    known = (later >= 0) & (of[later] == of)
    follow = pa.array(np.where(known, total[later], 0.0), mask=~known)
    out = pa.StructArray.from_arrays(
        [pa.array(number[good].astype(np.int32)), pc.take(word, pa.array(good)), pa.array(total), pa.array(size[good] > 1), follow],
        names=["word_idx", "word", "logp", "is_bpe", "next"],
    )
    offsets = np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), out)


def lm_loss(words: DataFrame, by: list[str]) -> DataFrame:
    """Natural-log loss per word and ``exp(loss)``."""
    out = words.groupBy(*by).agg(F.sum("logp").alias("score_sum"), F.count(F.lit(1)).alias("count"))
    out = out.withColumn("loss", -F.col("score_sum") / F.col("count"))
    return out.withColumn("ppl", F.exp("loss"))


def word_stats(words: DataFrame) -> DataFrame:
    """Per word: count, summed score, is_bpe, summed next-word score, count with a next word."""
    return words.groupBy("word").agg(
        F.count(F.lit(1)).alias("count"), F.sum("logp").alias("logp"), F.bool_or("is_bpe").alias("is_bpe"),
        F.coalesce(F.sum("next"), F.lit(0.0)).alias("next_logp"), F.count("next").alias("n_next"),
    )


# ---------------------------------------------------------------- vectors and snapshots


def pool_vectors(df: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """First, mean, max and L2 of the vectors of a key, by dimension."""
    long = df.select(key, order, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy(key, "dim").agg(
        F.min_by("x", order).alias("first"), F.avg("x").alias("mean"), F.max("x").alias("max"),
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l2"),
    )


def snapshot_number(path: Column, update_based: bool = False) -> Column:
    """Epoch (``checkpoint7.pt``) or update number (``checkpoint_2_500.pt``) of a file name."""
    pattern = r"checkpoint_\d+_(\d+)\.pt$" if update_based else r"checkpoint(\d+)\.pt$"
    return F.regexp_extract(path, pattern, 1).try_cast("bigint")


def last_snapshots(df: DataFrame, n: int, update_based: bool = False, snapshot: str = "snapshot") -> DataFrame:
    """Rows of the ``n`` snapshots with the highest numbers."""
    number = snapshot_number(F.col(snapshot), update_based)
    names = df.select(snapshot).distinct().withColumn("_n", number).filter("_n is not null")
    return df.join(F.broadcast(names.orderBy(F.desc("_n")).limit(n).select(snapshot)), snapshot)


def average_snapshots(df: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Element-wise mean of ``(snapshot, key, pos, value, is_int)``; integers truncate.

    ``complete`` is false for elements that some snapshot lacks.
    """
    total = df.agg(F.countDistinct(snapshot).alias("_s"))
    mean = df.groupBy("key", "pos").agg(
        F.avg("value").alias("value"), F.bool_and("is_int").alias("is_int"), F.count(F.lit(1)).alias("_n")
    )
    mean = mean.withColumn("_s", total.scalar())
    value = F.when(F.col("is_int"), F.col("value").cast("bigint").cast("double")).otherwise(F.col("value"))
    return mean.select("key", "pos", value.alias("value"), (F.col("_n") == F.col("_s")).alias("complete"))
