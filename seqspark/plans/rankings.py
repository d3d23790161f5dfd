"""Ranking queries (D1-D12) over candidates read off the embeddings table.

Four consecutive vectors are the beams of one sample, the 64 dimensions the tokens, and
the log-softmax of a vector the token scores of its beam.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions.hashing import P
from seqspark.operators import ranking as rk
from seqspark.plans import base, sql
from seqspark.plans.base import query
from seqspark.plans.metrics import _LPROBS, _UNIGRAM, lprobs, r6, unigram_scores

BEAM, TOKENS, STEP, SEED = 4, 64, 3, 41

_CAND = f"""{_LPROBS},
cand AS (SELECT vec_id // 4 AS sample, vec_id % 4 AS beam, unnest(range(64)) AS token, unnest(l) AS lprob,
  -1 - abs(embedding[1]::DOUBLE) AS cum, label FROM lp),
prefix AS (SELECT vec_id // 4 AS sample, vec_id % 4 AS beam, label, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 100)::BIGINT) % 16) AS tokens FROM embeddings)"""


def _vectors(spark, d):
    v = base.table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return v.withColumn("sample", F.floor(F.col("vec_id") / 4)).withColumn("beam", F.col("vec_id") % 4)


def candidates(spark, d):
    cum = -1 - F.abs(F.get("embedding", F.lit(0)).cast("double"))
    rows = _vectors(spark, d).select("sample", "beam", cum.alias("cum"), "label", F.posexplode(lprobs()).alias("token", "lprob"))
    return rows.withColumn("token", F.col("token").cast("bigint"))


def prefixes(spark, d):
    tokens = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100) % 16)
    return _vectors(spark, d).select("sample", "beam", "label", tokens.alias("tokens"))


def _top_sql(rows: str, score: str, n: int, key: str = "sample", extra: str = "") -> str:
    return f"""SELECT * FROM (SELECT sample, beam, token, {score} AS score{extra},
  row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, beam, token) - 1 AS rank FROM {rows}) WHERE rank < {n}"""


def _show(df, *more):
    return df.select("sample", "beam", "token", r6("score").alias("score"), "rank", *more)


@query("d01_beam_candidates", f"""WITH {_CAND}, t AS ({_top_sql('cand', '(lprob + cum)', 8)})
SELECT sample, beam, token, round(score, 6) AS score, rank FROM t""")
def beam_candidates(spark, d):
    return _show(rk.beam_candidates(candidates(spark, d), BEAM, STEP, TOKENS))


@query("d01_first_step", f"""WITH {_CAND}, z AS (SELECT * FROM cand WHERE beam = 0), t AS ({_top_sql('z', 'lprob', 8)})
SELECT sample, beam, token, round(score, 6) AS score, rank FROM t""")
def first_step(spark, d):
    return _show(rk.beam_candidates(candidates(spark, d), BEAM, 0, TOKENS))


# The label plays the source length.
@query("d02_length_constraint", f"""WITH {_CAND},
c AS (SELECT sample, beam, token, cum, CASE WHEN token <> 2 THEN lprob WHEN 3 < 0.25 * label + 1 OR 3 > 0.5 * label + 1 THEN '-inf'::DOUBLE
  WHEN 3 = 0.5 * label + 1 THEN 0 ELSE lprob END AS lprob FROM cand), t AS ({_top_sql('c', '(lprob + cum)', 8)})
SELECT sample, beam, token, round(score, 6) AS score, rank FROM t""")
def length_constraint(spark, d):
    c = rk.constrain_length(candidates(spark, d), STEP, F.col("label"), 0.25, 1, 0.5, 1)
    return _show(rk.beam_candidates(c, BEAM, STEP, TOKENS))


# Every candidate as a hypothesis that ends at the step of its beam; the label is the length.
@query("d02_match_source_length", f"""WITH {_CAND}
SELECT sample, beam, token, CASE WHEN beam + 3 > label THEN '-inf'::DOUBLE ELSE round(lprob + cum, 6) END AS score FROM cand""")
def match_source_length(spark, d):
    c = candidates(spark, d).withColumn("score", F.round(F.col("lprob") + F.col("cum"), 6))
    return rk.match_source_length(c, F.col("beam") + 3, F.col("label")).select("sample", "beam", "token", "score")


@query("d03_diverse_beams", f"""WITH {_CAND},
g0 AS ({_top_sql('(SELECT * FROM cand WHERE beam % 2 = 0)', '(lprob + cum)', 4)}),
n AS (SELECT sample, token, count(*) AS n FROM g0 GROUP BY ALL),
c1 AS (SELECT c.sample, beam, token, lprob - 0.5 * coalesce(n, 0) + cum AS s FROM cand c LEFT JOIN n USING (sample, token) WHERE beam % 2 = 1),
g1 AS ({_top_sql('c1', 's', 4)})
SELECT sample, beam, token, round(score, 6) AS score, rank, 0::BIGINT AS grp FROM g0
UNION ALL SELECT sample, beam, token, round(score, 6), rank, 1::BIGINT FROM g1""")
def diverse_beams(spark, d):
    return _show(rk.diverse_candidates(candidates(spark, d), BEAM, 2, 0.5, STEP, TOKENS), "grp")


_GUMBEL = f"-ln(-ln(({sql.base(SEED, 'sample', 'beam', 'token', 'draw')} + 0.5::DOUBLE) / {float(P)}::DOUBLE))"


def _sampling_sql(where: str, draws: int, score: str) -> str:
    return f"""WITH {_CAND},
k AS (SELECT *, lprob / 0.8::DOUBLE AS scaled FROM cand WHERE token >= 2 {where}
  QUALIFY row_number() OVER (PARTITION BY sample, beam ORDER BY lprob DESC, token) <= 10),
x AS (SELECT * FROM k, range({draws}) r(draw)),
y AS (SELECT *, scaled + {_GUMBEL} AS g FROM x)
SELECT sample, beam, token, draw, round({score}, 6) AS score FROM y
QUALIFY row_number() OVER (PARTITION BY sample, beam, draw ORDER BY g DESC, token) = 1"""


@query("d04_sampling", _sampling_sql("", 1, "scaled + cum"))
def sampling(spark, d):
    s = rk.sample_candidates(candidates(spark, d), BEAM, STEP, SEED, 10, 0.8)
    return s.select("sample", "beam", "token", "draw", r6("score").alias("score"))


@query("d04_sampling_first_step", _sampling_sql("AND beam = 0", 4, "scaled"))
def sampling_first_step(spark, d):
    s = rk.sample_candidates(candidates(spark, d), BEAM, 0, SEED, 10, 0.8)
    return s.select("sample", "beam", "token", "draw", r6("score").alias("score"))


@query("d05_no_repeat_ngrams", f"""WITH {_CAND},
banned AS (SELECT DISTINCT sample, beam, tokens[i + 2] AS token FROM prefix, range(1, 63) r(i)
  WHERE tokens[i] = tokens[63] AND tokens[i + 1] = tokens[64])
SELECT sample, beam, token, round(lprob, 6) AS lprob FROM cand ANTI JOIN banned USING (sample, beam, token)""")
def no_repeat_ngrams(spark, d):
    out = rk.ban_repeats(candidates(spark, d), prefixes(spark, d), 3)
    return out.select("sample", "beam", "token", r6("lprob").alias("lprob"))


# Every line of a document is one hypothesis for it, scored by the unigram model.
_HYPS = f"""{_UNIGRAM},
hyp AS (SELECT doc_id AS sample, line_no AS hyp, pos, token_id AS token, sum(logp) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS cum
  FROM enc JOIN uni USING (token_id)),
hs AS (SELECT *, cum - coalesce(lag(cum) OVER w, 0) AS pos_score,
  last_value(cum) OVER f / pow(count(*) OVER f, 0.6) AS score FROM hyp
  WINDOW w AS (PARTITION BY sample, hyp ORDER BY pos),
    f AS (PARTITION BY sample, hyp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def hypotheses(spark, d):
    from pyspark.sql import Window

    s = unigram_scores(spark, d).withColumnsRenamed({"doc_id": "sample", "line_no": "hyp", "token_id": "token"})
    # The running sum ends with the line.
    upto = Window.partitionBy("sample", "hyp").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("cum", F.sum("logp").over(upto)).withColumn("pos", F.col("pos").cast("bigint"))


@query("d06_hypothesis_scores", f"""WITH {_HYPS}
SELECT sample, hyp, pos, round(pos_score, 6) AS pos_score, round(score, 6) AS score FROM hs""")
def hypothesis_scores(spark, d):
    out = rk.hypothesis_scores(hypotheses(spark, d), 0.6)
    return out.select("sample", "hyp", "pos", r6("pos_score").alias("pos_score"), r6("score").alias("score"))


def scored_lines(spark, d):
    s = unigram_scores(spark, d)
    total = s.groupBy("doc_id", "line_no").agg(F.sum("logp").alias("cum"), F.count(F.lit(1)).alias("n"))
    return total.select(F.col("doc_id").alias("sample"), F.col("line_no").alias("hyp"), (F.col("cum") / F.col("n")).alias("score"))


_LINES = f"""{_UNIGRAM}, sc AS (SELECT doc_id AS sample, line_no AS hyp, sum(logp) / count(*) AS score FROM enc JOIN uni USING (token_id) GROUP BY ALL)"""


@query("d07_n_best", f"""WITH {_LINES}
SELECT sample, hyp, round(score, 9) AS score, row_number() OVER (PARTITION BY sample ORDER BY round(score, 9) DESC, hyp) - 1 AS hyp_rank FROM sc
QUALIFY hyp_rank < 3""")
def n_best(spark, d):
    # Rounded, so that equal lines tie in every order of addition.
    out = rk.n_best(scored_lines(spark, d).withColumn("score", F.round("score", 9)), ["sample"], 3)
    return out.select("sample", "hyp", "score", "hyp_rank")


@query("d08_prefix_constraint", f"""WITH {_CAND},
gold AS (SELECT sample, CASE WHEN label >= 5 THEN tokens[4] END AS gold FROM prefix WHERE beam = 0)
SELECT sample, beam, token, round(lprob, 6) AS lprob FROM cand JOIN gold USING (sample)
WHERE gold IS NULL OR (beam = 0 AND token = gold)""")
def prefix_constraint(spark, d):
    first = prefixes(spark, d).filter("beam = 0")
    # Samples with a small label have a prefix that ends before this step.
    gold = first.select("sample", F.when(F.col("label") >= 5, F.col("tokens")).otherwise(F.slice("tokens", 1, STEP)).alias("tokens"))
    out = rk.follow_prefix(candidates(spark, d), gold, STEP)
    return out.select("sample", "beam", "token", r6("lprob").alias("lprob"))


@query("d09_score_adjustment", f"""WITH {_CAND},
c AS (SELECT sample, beam, token, CASE WHEN token = 3 THEN lprob - 0.5 ELSE lprob END + cum AS s FROM cand WHERE token <> 1),
t AS ({_top_sql('c', 's', 8)})
SELECT sample, beam, token, round(score, 6) AS score, rank, token = 2 AND rank < 4 AS finalizes FROM t""")
def score_adjustment(spark, d):
    c = rk.adjust_scores(candidates(spark, d), 0.5)
    return _show(rk.finalizing(rk.beam_candidates(c, BEAM, STEP, TOKENS), BEAM, STEP, 1), "finalizes")


@query("d10_attention_alignment", f"""WITH {_CAND}
SELECT sample, beam AS tgt_pos, token AS src_pos FROM cand QUALIFY row_number() OVER (PARTITION BY sample, beam ORDER BY lprob DESC, token) = 1""")
def attention_alignment(spark, d):
    c = candidates(spark, d).select("sample", F.col("beam").alias("tgt_pos"), F.col("token").alias("src_pos"), F.exp("lprob").alias("weight"))
    return rk.alignment(c, ["sample", "tgt_pos"])


@query("d11_top_labels", f"""WITH {_LPROBS}, t AS (SELECT vec_id, unnest(range(64)) AS token, unnest(l) AS lprob FROM lp)
SELECT vec_id, 'label' || token AS label, round(lprob, 6) AS lprob, row_number() OVER (PARTITION BY vec_id ORDER BY lprob DESC, token) - 1 AS rank FROM t QUALIFY rank < 3""")
def top_labels(spark, d):
    rows = base.table(spark, d, "embeddings").select("vec_id", F.posexplode(lprobs()).alias("token", "lprob"))
    out = rk.top_labels(rows, ["vec_id"], 3)
    return out.select("vec_id", F.concat(F.lit("label"), F.col("token").cast("string")).alias("label"), r6("lprob").alias("lprob"), "rank")


# Even lines are final hypotheses (mean score), odd lines are open (summed score).
@query("d12_early_stop", f"""WITH {_UNIGRAM},
sc AS (SELECT doc_id AS sample, line_no % 2 = 0 AS is_final, CASE WHEN line_no % 2 = 0 THEN sum(logp) / count(*) ELSE sum(logp) END AS score
  FROM enc JOIN uni USING (token_id) GROUP BY doc_id, line_no),
a AS (SELECT sample, count(*) FILTER (is_final) AS n_final, min(score) FILTER (is_final) AS worst, max(score) FILTER (NOT is_final) AS best_open FROM sc GROUP BY sample)
SELECT sample, n_final, n_final >= 3 AND (best_open IS NULL OR worst >= best_open / 20) AS finished FROM a""")
def early_stop(spark, d):
    s = unigram_scores(spark, d).groupBy("doc_id", "line_no").agg(F.sum("logp").alias("cum"), F.count(F.lit(1)).alias("n"))
    final = F.col("line_no") % 2 == 0
    score = F.when(final, F.col("cum") / F.col("n")).otherwise(F.col("cum"))
    rows = s.select(F.col("doc_id").alias("sample"), final.alias("is_final"), score.alias("score"))
    return rk.finished(rows, 3, 20).select("sample", "n_final", "finished")
