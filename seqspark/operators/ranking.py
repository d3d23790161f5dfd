"""Selection rules over tables of scored candidates and hypotheses.

``cand`` has ``(sample, beam, token, lprob, cum)``; a window or group is one sample, so
its size is the beam times the vocabulary. Limits by ``row_number`` are applied before
the shuffle as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqspark.consts import EOS, PAD, UNK
from seqspark.functions.hashing import P, base as hash_base

MINUS_INF = float("-inf")


def _top(df: DataFrame, key: list[str], order: list, n, out: str = "rank") -> DataFrame:
    # The bare comparison is what lets Spark cut each partition to its best rows first.
    by = Window.partitionBy(*key).orderBy(*order)
    best = df.withColumn(out, F.row_number().over(by)).filter(F.col(out) <= n)
    return best.withColumn(out, F.col(out).cast("bigint") - 1)


def n_best(hyps: DataFrame, key: list[str], n: int, score: str = "score", tie: str = "hyp") -> DataFrame:
    """Top ``n`` hypotheses per sample, best first; ties in generation order."""
    return _top(hyps, key, [F.desc(score), F.col(tie)], n, "hyp_rank")


def beam_candidates(cand: DataFrame, beam: int, step: int, vocab_size: int) -> DataFrame:
    """The best ``2 * beam`` continuations per sample (one less than all there are).

    At step 0 all beams are alike and only the first counts; later the cumulative score
    of the beam is added.
    """
    rows = cand.filter("beam = 0") if step == 0 else cand
    score = F.col("lprob") if step == 0 else F.col("lprob") + F.col("cum")
    width = vocab_size * (1 if step == 0 else beam)
    rows = rows.withColumn("score", score)
    return _top(rows, ["sample"], [F.desc("score"), "beam", "token"], min(2 * beam, width - 1))


def constrain_length(cand: DataFrame, step: int, src_len: Column, min_a: float, min_b: float, max_a: float, max_b: float) -> DataFrame:
    """EOS is impossible before the minimum, certain at the maximum, impossible after it."""
    low, high = min_a * src_len + min_b, max_a * src_len + max_b
    lprob = (
        F.when((F.lit(step) < low) | (F.lit(step) > high), F.lit(MINUS_INF)).when(F.lit(step) == high, F.lit(0.0)).otherwise(F.col("lprob"))
    )
    return cand.withColumn("lprob", F.when(F.col("token") == EOS, lprob).otherwise(F.col("lprob")))


def match_source_length(finished: DataFrame, step: Column, src_len: Column, score: str = "score") -> DataFrame:
    """Hypotheses that end after the source's length can never win."""
    return finished.withColumn(score, F.when(step > src_len, F.lit(MINUS_INF)).otherwise(F.col(score)))


def diverse_candidates(cand: DataFrame, beam: int, groups: int, strength: float, step: int, vocab_size: int) -> DataFrame:
    """Groups choose in turn; a token costs ``strength`` per pick of an earlier group."""
    if beam % groups:
        raise ValueError("the beam must be divisible by the number of groups")
    chosen, picks = None, None
    for g in range(groups):
        rows = cand.filter(F.col("beam") % groups == g)
        if picks is not None:
            rows = rows.join(picks, ["sample", "token"], "left")
            rows = rows.withColumn("lprob", F.col("lprob") - strength * F.coalesce("_n", F.lit(0))).drop("_n")
        local = rows.withColumn("beam", F.floor(F.col("beam") / groups))
        top = beam_candidates(local, beam // groups, step, vocab_size)
        top = top.withColumn("beam", (F.col("beam") * groups + g).cast("bigint")).withColumn("grp", F.lit(g).cast("bigint"))
        chosen = top if chosen is None else chosen.unionByName(top)
        picks = chosen.groupBy("sample", "token").agg(F.count(F.lit(1)).alias("_n"))
    return chosen


def sample_candidates(cand: DataFrame, beam: int, step: int, seed: int, topk: int = -1, temperature: float = 1.0) -> DataFrame:
    """Draw tokens in proportion to their probability (Gumbel maximum of hashed draws).

    The first two ids are never drawn. At step 0 ``beam`` draws with replacement are made
    from the first beam, later one draw per beam.
    """
    rows = cand.filter(F.col("token") >= 2)
    if step == 0:
        rows = rows.filter("beam = 0")
    if topk > 0:
        rows = _top(rows, ["sample", "beam"], [F.desc("lprob"), "token"], topk, "_k").drop("_k")
    rows = rows.withColumn("scaled", F.col("lprob") / temperature)
    draws = F.sequence(F.lit(0), F.lit(beam - 1 if step == 0 else 0))
    rows = rows.withColumn("draw", F.explode(draws.cast("array<bigint>")))
    u = (hash_base(seed, F.col("sample"), F.col("beam"), F.col("token"), F.col("draw")) + 0.5) / F.lit(float(P))
    rows = rows.withColumn("_g", F.col("scaled") - F.log(-F.log(u)))
    best = _top(rows, ["sample", "beam", "draw"], [F.desc("_g"), "token"], 1, "_r").drop("_r", "_g")
    score = F.col("scaled") if step == 0 else F.col("scaled") + F.col("cum")
    return best.withColumn("score", score)


def ban_repeats(cand: DataFrame, prefix: DataFrame, n: int) -> DataFrame:
    """Drop tokens that would complete an n-gram already in ``prefix(sample, beam, tokens)``."""
    t = F.col("tokens")
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    last = F.slice(t, F.greatest(F.size(t) - n + 2, F.lit(1)), n - 1)
    rows = prefix.filter(F.size(t) >= n - 1).select("sample", "beam", last.alias("last"), F.explode(F.transform(starts, lambda i: F.slice(t, i, n))).alias("g"))
    banned = rows.filter(F.slice("g", 1, n - 1) == F.col("last")).select("sample", "beam", F.element_at("g", n).alias("token"))
    return cand.join(banned.distinct(), ["sample", "beam", "token"], "left_anti")


def hypothesis_scores(hyps: DataFrame, lenpen: float = 1.0, normalize: bool = True) -> DataFrame:
    """Per-position scores from cumulative ones, and the sentence score.

    ``hyps`` has ``(sample, hyp, pos, token, cum)``, EOS included.
    """
    by = Window.partitionBy("sample", "hyp").orderBy("pos")
    step = hyps.withColumn("pos_score", F.col("cum") - F.coalesce(F.lag("cum").over(by), F.lit(0.0)))
    whole = Window.partitionBy("sample", "hyp").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, size = F.last("cum").over(whole), F.count(F.lit(1)).over(whole)
    return step.withColumn("score", total / F.pow(size.cast("double"), F.lit(lenpen)) if normalize else total)


def follow_prefix(cand: DataFrame, prefix: DataFrame, step: int) -> DataFrame:
    """Samples whose gold prefix reaches this step keep only its token, on the first beam.

    ``prefix`` has ``(sample, tokens)``.
    """
    gold = prefix.select("sample", F.get("tokens", F.lit(step)).cast("bigint").alias("_gold"))
    rows = cand.join(gold, "sample", "left")
    return rows.filter(F.col("_gold").isNull() | ((F.col("beam") == 0) & (F.col("token") == F.col("_gold")))).drop("_gold")


def adjust_scores(cand: DataFrame, unk_penalty: float) -> DataFrame:
    """Padding can never be chosen, the unknown token costs extra."""
    penalty = F.when(F.col("token") == UNK, F.lit(unk_penalty)).otherwise(F.lit(0.0))
    return cand.filter(F.col("token") != PAD).withColumn("lprob", F.col("lprob") - penalty)


def finalizing(top: DataFrame, beam: int, step: int, min_len: int) -> DataFrame:
    """Flag candidates that end a hypothesis: EOS among the first ``beam``, late enough."""
    ends = (F.col("token") == EOS) & (F.col("rank") < beam) & F.lit(step >= min_len)
    return top.withColumn("finalizes", ends)


def alignment(attention: DataFrame, key: list[str]) -> DataFrame:
    """Source position with the greatest weight, the first of equals."""
    best = F.max_by("src_pos", F.struct("weight", (-F.col("src_pos")).alias("f")))
    return attention.groupBy(*key).agg(best.alias("src_pos"))


def top_labels(cand: DataFrame, key: list[str], n: int = 3) -> DataFrame:
    return _top(cand, key, [F.desc("lprob"), "token"], n)


def finished(hyps: DataFrame, beam: int, max_len: int, lenpen: float = 1.0, stop_early: bool = False) -> DataFrame:
    """Per sample: is the search over? ``hyps`` has ``(sample, is_final, score)``.

    Open scores are cumulative and are normalised by the longest possible length.
    """
    out = hyps.groupBy("sample").agg(
        F.count(F.when(F.col("is_final"), 1)).alias("n_final"),
        F.min(F.when(F.col("is_final"), F.col("score"))).alias("worst"),
        F.max(F.when(~F.col("is_final"), F.col("score"))).alias("best_open"),
    )
    reach = F.col("best_open") / (max_len**lenpen)
    done = F.lit(stop_early) | F.col("best_open").isNull() | (F.col("worst") >= reach)
    return out.withColumn("finished", F.coalesce((F.col("n_final") >= beam) & done, F.lit(False)))
