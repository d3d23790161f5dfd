"""Metric queries (A1-A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import arrays as ar
from seqspark.functions.hashing import base as hash_base, fold_unit, unit
from seqspark.operators import metrics as mt, vocab as vb
from seqspark.plans import base, sql
from seqspark.plans.base import query
from seqspark.session import fenced, written

SEED = 31


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Reference: the encoded line. Hypothesis: the same ids with a fifth of the tokens dropped.
_HYP = f"""{sql.ENCODED},
hy AS (SELECT *, {sql.unit(SEED, 'doc_id', 'line_no', 'pos')} >= 0.2 AS kept FROM enc),
seqs AS (SELECT w.doc_id, w.line_no, w.lang, coalesce(r, []) AS r, coalesce(h, []) AS h FROM words w LEFT JOIN (
  SELECT doc_id, line_no, list(token_id ORDER BY pos) AS r, list(token_id ORDER BY pos) FILTER (kept) AS h FROM hy GROUP BY ALL) USING (doc_id, line_no))"""

_BLEU = f"""{_HYP},
g AS (
  SELECT doc_id, line_no, lang, n, array_to_string(list_slice(h, i, i + n - 1), ' ') AS gram, 1 AS hc, 0 AS rc
  FROM seqs, range(1, 5) a(n), unnest(range(1, len(h) - n + 2)) u(i)
  UNION ALL SELECT doc_id, line_no, lang, n, array_to_string(list_slice(r, i, i + n - 1), ' '), 0, 1
  FROM seqs, range(1, 5) a(n), unnest(range(1, len(r) - n + 2)) u(i) WHERE NOT list_contains(list_slice(r, i, i + n - 1), 3)),
c AS (SELECT doc_id, line_no, lang, n, gram, sum(hc) AS hc, sum(rc) AS rc FROM g GROUP BY ALL),
m AS (SELECT doc_id, line_no, lang, n, sum(hc)::BIGINT AS cnt, sum(least(hc, rc))::BIGINT AS hit FROM c GROUP BY ALL),
st AS (SELECT s.doc_id, s.line_no, s.lang, len(r) AS ref_len, len(h) AS hyp_len,
  {', '.join(f"coalesce(max(cnt) FILTER (n = {k}), 0) AS count{k}, coalesce(max(hit) FILTER (n = {k}), 0) AS match{k}" for k in range(1, 5))}
  FROM seqs s LEFT JOIN m USING (doc_id, line_no, lang) GROUP BY ALL),
tot AS (SELECT lang, sum(ref_len)::BIGINT AS ref_len, sum(hyp_len)::BIGINT AS hyp_len,
  {', '.join(f"sum(count{k})::BIGINT AS count{k}, sum(match{k})::BIGINT AS match{k}" for k in range(1, 5))} FROM st GROUP BY lang)"""
_STATS = ["ref_len", "hyp_len"] + [f"{w}{k}" for k in range(1, 5) for w in ("count", "match")]


def hypothesis_pairs(spark, d):
    e = base.encoded_lines(spark, d, "lang")
    acc = hash_base(SEED, F.col("doc_id"), F.col("line_no"))
    hyp = ar.let(acc, lambda a: F.filter("ids", lambda x, i: fold_unit(a, i) >= 0.2))
    return e.select("doc_id", "line_no", "lang", F.col("ids").alias("ref"), hyp.alias("hyp"))


@query("a01_bleu_stats", f"WITH {_BLEU} SELECT doc_id, line_no, {', '.join(_STATS)} FROM st")
def bleu_stats(spark, d):
    return mt.bleu_stats(hypothesis_pairs(spark, d), ["doc_id", "line_no"], "ref", "hyp").select("doc_id", "line_no", *_STATS)


def _score_sql(one: int) -> str:
    p = {k: f"((match{k} + {one if k > 1 else 0}) / (count{k} + {one if k > 1 else 0})::DOUBLE)" for k in range(1, 5)}
    bp = "least(1.0::DOUBLE, exp(1 - ref_len / hyp_len::DOUBLE))"
    mean = " + ".join(f"ln({p[k]})" for k in range(1, 5))
    return f"""SELECT lang, round(100 * {bp} * exp(({mean}) / 4), 6) AS bleu, round({bp}, 6) AS brevity,
  round(hyp_len / ref_len::DOUBLE, 6) AS ratio, {', '.join(f"round(100 * {p[k]}, 6) AS p{k}" for k in range(1, 5))}, hyp_len, ref_len FROM tot"""


def _corpus_bleu(spark, d, smooth):
    pairs = hypothesis_pairs(spark, d)
    stats = mt.bleu_stats(pairs, ["doc_id", "line_no", "lang"], "ref", "hyp", by=["lang"])
    b = mt.bleu(stats, smooth=smooth)
    return b, [r6(c).alias(c) for c in ("bleu", "brevity", "ratio", "p1", "p2", "p3", "p4")]


@query("a02_corpus_bleu", f"""WITH {_BLEU}, s AS ({_score_sql(0)})
SELECT *, printf('BLEU4 = %.2f, %.1f/%.1f/%.1f/%.1f (BP=%.3f, ratio=%.3f, syslen=%d, reflen=%d)', bleu, p1, p2, p3, p4, brevity, ratio, hyp_len, ref_len) AS line FROM s""")
def corpus_bleu(spark, d):
    b, rounded = _corpus_bleu(spark, d, False)
    return b.select("lang", *rounded, "hyp_len", "ref_len").withColumn("line", mt.bleu_text())


@query("a03_smoothed_bleu", f"WITH {_BLEU} {_score_sql(1)}")
def smoothed_bleu(spark, d):
    b, rounded = _corpus_bleu(spark, d, True)
    return b.select("lang", *rounded, "hyp_len", "ref_len")


# Unigram model of the encoded documents: every token scored by its share of all tokens.
_UNIGRAM = f"""{sql.ENCODED},
uni AS (SELECT token_id, ln(count(*) / (SELECT count(*) FROM enc)::DOUBLE) AS logp FROM enc GROUP BY token_id)"""


def unigram_lines(spark, d, *keep):
    """Encoded lines and their unigram model ``(token_id, logp)``."""
    # The model and the scores need the ids, some metrics several times: they are encoded once.
    lines = written(base.encoded_lines(spark, d, *keep).select("doc_id", "line_no", *keep, "ids"), "encoded")
    counts = lines.select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    return lines, counts.select("token_id", F.log(F.col("c") / total.scalar()).alias("logp"))


def unigram_scores(spark, d, *keep):
    lines, model = unigram_lines(spark, d, *keep)
    ids = lines.select("doc_id", "line_no", *keep, F.posexplode("ids").alias("pos", "token_id"))
    # The model has one row per vocabulary id, at most the configured vocabulary size.
    return ids.join(F.broadcast(model), "token_id")


@query("a04_cross_entropy", f"""WITH {_UNIGRAM},
s AS (SELECT lang, -sum(logp) AS nll, count(*) AS ntokens, count(DISTINCT doc_id) AS sample_size FROM enc JOIN uni USING (token_id) GROUP BY lang)
SELECT lang, ntokens, sample_size, round(nll / sample_size / ln(2), 6) AS loss, round(nll / ntokens / ln(2), 6) AS nll_loss,
  round(pow(2, nll / ntokens / ln(2)), 6) AS ppl FROM s""")
def cross_entropy(spark, d):
    out = mt.cross_entropy(unigram_scores(spark, d, "lang"), ["lang"], sample=["doc_id"], sentence_avg=True)
    return out.select("lang", "ntokens", "sample_size", r6("loss").alias("loss"), r6("nll_loss").alias("nll_loss"), r6("ppl").alias("ppl"))


@query("a04_token_perplexity", f"""WITH {_UNIGRAM},
s AS (SELECT source, -sum(logp) / count(*) / ln(2) AS loss, count(*) AS ntokens FROM enc JOIN uni USING (token_id) GROUP BY source),
t AS (SELECT source, -sum(logp) / count(*) / ln(2) AS loss, count(*) AS ntokens FROM enc JOIN uni USING (token_id) WHERE pos > 0 GROUP BY source)
SELECT s.source, round(s.loss, 6) AS loss, round(pow(2, s.loss), 6) AS ppl, round((s.loss + t.loss) / 2, 6) AS composite,
  (s.ntokens + t.ntokens) / 2::DOUBLE AS sample_size FROM s JOIN t USING (source)""")
def token_perplexity(spark, d):
    scores = unigram_scores(spark, d, "source")
    first = mt.cross_entropy(scores, ["source"])
    # Second target: the same tokens without the line starts.
    second = mt.cross_entropy(scores, ["source"], keep=F.col("pos") > 0)
    both = mt.composite(first.unionByName(second), ["source"]).select("source", r6("loss").alias("composite"), "sample_size")
    return first.select("source", r6("loss").alias("loss"), r6("ppl").alias("ppl")).join(both, "source")


# Embedding values as logits over 64 classes; the log-softmax is the model output.
_LPROBS = """lp AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE - norm) AS l, embedding FROM (
  SELECT *, ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) AS norm FROM embeddings))"""


def lprobs(vector: str = "embedding"):
    """Log-softmax of a vector, inside the row."""
    return ar.let(
        F.col(vector).cast("array<double>"),
        lambda e: ar.let(
            F.log(F.aggregate(e, F.lit(0.0), lambda a, x: a + F.exp(x))), lambda n: F.transform(e, lambda x: x - n)
        ),
    )


def log_softmax(spark, d):
    return base.table(spark, d, "embeddings").withColumn("lprobs", lprobs())


@query("a05_label_smoothing", f"""WITH {_LPROBS}
SELECT vec_id, round(-l[label + 1], 6) AS nll, round(0.9 * -l[label + 1] + 0.1 / 64 * -list_sum(l), 6) AS loss FROM lp WHERE label <> 1""")
def label_smoothing(spark, d):
    out = mt.label_smoothed(log_softmax(spark, d), "lprobs", "label", 0.1)
    return out.select("vec_id", r6("nll").alias("nll"), r6("loss").alias("loss"))


@query("a06_exact_match", f"""WITH {sql.ENCODED},
p AS (SELECT *, CASE WHEN {sql.unit(SEED, 'doc_id', 'line_no', 'pos')} < 0.02 THEN 0 ELSE token_id END AS pred FROM enc),
s AS (SELECT doc_id, line_no, any_value(lang) AS lang, bool_and(pred = token_id) AS hit FROM p GROUP BY doc_id, line_no)
SELECT lang, count(*) AS n, count(*) FILTER (hit) AS n_match, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS accuracy FROM s GROUP BY lang""")
def exact_match(spark, d):
    ids = base.encoded_lines(spark, d, "lang").select("doc_id", "line_no", "lang", F.posexplode("ids").alias("pos", "target"))
    miss = unit(SEED, F.col("doc_id"), F.col("line_no"), F.col("pos")) < 0.02
    rows = ids.withColumn("pred", F.when(miss, F.lit(0)).otherwise(F.col("target")))
    out = mt.exact_match(rows, ["doc_id", "line_no", "lang"], "pred", "target", by=["lang"])
    return out.withColumn("accuracy", r6("accuracy"))


# quality: regression on n_chars / 1000; toxic: two scores. Labels are missing for most documents.
_PROPS = """props AS (SELECT d.doc_id, d.lang, d.source, p.prop, CASE WHEN p.prop = 'quality' THEN quality ELSE toxic END AS value,
    n_chars / 1000.0::DOUBLE AS x FROM documents d LEFT JOIN labels l USING (doc_id), (VALUES ('quality'), ('toxic')) p(prop)),
pm AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN prop = 'quality' THEN pow(x - value, 2)
    ELSE ln(exp(x) + exp(1.0::DOUBLE)) - CASE WHEN value = 0 THEN x ELSE 1 END END AS loss,
  CASE WHEN prop = 'toxic' AND value IS NOT NULL THEN (CASE WHEN x >= 1 THEN 0 ELSE 1 END = value)::INT::DOUBLE END AS acc FROM props)"""


def property_rows(spark, d):
    docs = base.table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("n_chars") / 1000.0).alias("x"))
    rows = docs.join(base.table(spark, d, "labels"), "doc_id", "left")
    props = F.array(
        F.struct(F.lit("quality").alias("prop"), F.lit("reg").alias("kind"), F.col("quality").cast("double").alias("value")),
        F.struct(F.lit("toxic").alias("prop"), F.lit("cls").alias("kind"), F.col("toxic").cast("double").alias("value")),
    )
    long = rows.select("doc_id", "lang", "source", "x", F.inline(props))
    return long.select("*", F.col("value").isNotNull().alias("present"), F.col("x").alias("pred"), F.array("x", F.lit(1.0)).alias("scores"))


@query("a07_property_metrics", f"""WITH {_PROPS}
SELECT lang, prop, count(loss) AS num, round(coalesce(avg(loss), 0), 6) AS loss,
  CASE WHEN prop = 'toxic' THEN round(coalesce(avg(acc), 0), 6) END AS acc,
  round(coalesce(avg(loss), 0) * CASE WHEN prop = 'toxic' THEN 2 ELSE 1 END, 6) AS weighted FROM pm GROUP BY lang, prop""")
def property_metrics(spark, d):
    out = mt.property_metrics(property_rows(spark, d), ["lang"], {"toxic": 2.0})
    return out.select("lang", "prop", "num", *[r6(c).alias(c) for c in ("loss", "acc", "weighted")])


@query("a08_merge_shards", f"""WITH {_PROPS},
part AS (SELECT source, prop, count(loss) AS num, coalesce(avg(loss), 0) AS loss FROM pm GROUP BY source, prop)
SELECT prop, sum(num)::BIGINT AS num, round(CASE WHEN sum(num) = 0 THEN 0 ELSE sum(loss * num) / sum(num) END, 6) AS loss FROM part GROUP BY prop""")
def merge_shards(spark, d):
    parts = mt.property_metrics(property_rows(spark, d), ["source"])
    out = mt.merge_weighted(parts, ["prop"], ["loss"])
    return out.select("prop", "num", r6("loss").alias("loss"))


@query("a09_per_corpus_metrics", f"""WITH {_UNIGRAM},
s AS (SELECT lang, -sum(logp) AS nll, count(*) AS ntokens, count(DISTINCT doc_id) AS sample_size FROM enc JOIN uni USING (token_id) GROUP BY lang),
v AS (SELECT lang, u.name, u.value FROM s, LATERAL (VALUES ('loss', nll / sample_size / ln(2)), ('nll_loss', nll / ntokens / ln(2)),
  ('ntokens', ntokens::DOUBLE), ('sample_size', sample_size::DOUBLE)) u(name, value))
SELECT lang || ':' || name AS name, round(value, 6) AS value FROM v UNION ALL SELECT name, round(sum(value), 6) FROM v GROUP BY name""")
def per_corpus_metrics(spark, d):
    per = mt.cross_entropy(unigram_scores(spark, d, "lang"), ["lang"], sample=["doc_id"], sentence_avg=True)
    out = mt.flatten_corpora(per, "lang", ["loss", "nll_loss", "ntokens", "sample_size"])
    return out.withColumn("value", r6("value"))


# Values in cents, so that sums are exact in every order of addition.
@query("a10_running_average", """WITH e AS (SELECT event_id, event_type, ts, round(value * 100)::BIGINT AS val FROM events)
SELECT event_id, event_type, val, (sum(val) OVER w)::BIGINT AS sum, count(*) OVER w AS count,
  (sum(val) OVER w)::DOUBLE / count(*) OVER w AS avg FROM e
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_average(spark, d):
    cents = F.round(F.col("value") * 100).cast("bigint")
    e = base.table(spark, d, "events").select("event_id", "event_type", "ts", cents.alias("val"))
    return mt.running_average(e, ["event_type"], ["ts", "event_id"], "val").drop("ts")


@query("a11_rate_meters", """SELECT event_type, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS elapsed,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS rate FROM events GROUP BY event_type""")
def rate_meters(spark, d):
    out = mt.rate(base.table(spark, d, "events"), ["event_type"], "ts")
    return out.select("event_type", "n", r6("elapsed").alias("elapsed"), F.round("rate", 9).alias("rate"))


@query("a11_stopwatch_meters", """SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS sum, count(*) AS n,
  sum(round(value * 100)::BIGINT)::DOUBLE / count(*) AS avg FROM events GROUP BY user_id""")
def stopwatch_meters(spark, d):
    e = base.table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return mt.stopwatch(e, ["user_id"], "cents")


@query("a12_histogram", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS num, sum(value) AS total, sum(value * value) AS sq, (max(value) - min(value)) / 1000 AS w FROM events),
g AS (SELECT value, lo, w, least(floor((value - lo) / w), 999)::BIGINT AS b FROM events, s WHERE value IS NOT NULL),
c AS (SELECT b - (value < lo + b * w)::BIGINT + (value >= lo + (b + 1) * w AND b < 999)::BIGINT AS bin, count(*) AS cnt FROM g GROUP BY 1)
SELECT i AS bin, round(lo + (i + 1) * w, 6) AS edge, coalesce(cnt, 0) AS cnt, lo AS "min", hi AS "max", num, round(total, 4) AS "sum", round(sq, 3) AS sum_squares
FROM s, range(1000) r(i) LEFT JOIN c ON c.bin = i""")
def histogram(spark, d):
    h = mt.histogram(base.table(spark, d, "events"), "value", 1000)
    return h.select("bin", r6("edge").alias("edge"), "cnt", "min", "max", "num", F.round("sum", 4).alias("sum"), F.round("sum_squares", 3).alias("sum_squares"))


@query("a13_sequence_score", f"""WITH {_UNIGRAM}
SELECT doc_id, line_no, round(avg(logp), 6) AS score, string_agg(printf('%.4f', logp), ' ' ORDER BY pos) AS positional
FROM enc JOIN uni USING (token_id) GROUP BY doc_id, line_no""")
def sequence_score(spark, d):
    lines, model = unigram_lines(spark, d)
    model = model.withColumn("shown", F.format_string("%.4f", "logp"))
    out = mt.sequence_texts(lines, ["doc_id", "line_no"], "ids", model)
    return out.select("doc_id", "line_no", r6("score").alias("score"), "positional")


@query("a14_ensemble", f"""WITH {_LPROBS},
t AS (SELECT vec_id // 4 AS sample, unnest(range(64)) AS token, unnest(l) AS lprob FROM lp)
SELECT sample, token, round(ln(avg(exp(lprob))), 6) AS lprob FROM t GROUP BY sample, token""")
def ensemble(spark, d):
    v = base.table(spark, d, "embeddings")
    rows = v.select(F.floor(F.col("vec_id") / 4).alias("sample"), F.posexplode(lprobs()).alias("token", "lprob"))
    out = mt.ensemble(rows, ["sample", "token"])
    return out.select("sample", F.col("token").cast("bigint").alias("token"), r6("lprob").alias("lprob"))


# Pieces scored by their share of all pieces; a piece seen once gets an infinite score.
_WORD_SCORES = f"""{sql.PIECES},
pu AS (SELECT piece, CASE WHEN count(*) = 1 THEN '-inf'::DOUBLE ELSE ln(count(*) / (SELECT count(*) FROM pieces)::DOUBLE) END AS logp FROM pieces GROUP BY piece),
ws AS (SELECT doc_id, line_no, wi, sum(logp) AS logp, string_agg(replace(piece, '@@', ''), '' ORDER BY pos) AS word, count(*) > 1 AS is_bpe
  FROM pieces JOIN pu USING (piece) GROUP BY doc_id, line_no, wi HAVING NOT isinf(sum(logp))),
wn AS (SELECT *, lead(logp) OVER (PARTITION BY doc_id, line_no ORDER BY wi) AS nxt FROM ws)"""


def piece_words(spark, d):
    p = base.pieces(spark, d)
    counts = written(fenced(p, "pieces").select(F.explode("pieces").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")), "piece_counts")
    total = counts.agg(F.sum("c").alias("n"))
    # Pieces seen once, which grow most with the corpus, need no row: theirs is the score of the others.
    model = counts.filter("c > 1").select("token", "c", F.log(F.col("c") / total.scalar()).alias("logp"))
    scored = vb.attach_values(p, "pieces", model, "logp", "scores", often="c", default=float("-inf"))
    return mt.word_scores(scored, "pieces", "scores", ["doc_id", "line_no"])


@query("a15_lm_loss", f"""WITH {_WORD_SCORES}
SELECT count(*) AS count, round(-sum(logp) / count(*), 6) AS loss, round(exp(-sum(logp) / count(*)), 4) AS ppl FROM wn""")
def lm_loss(spark, d):
    out = mt.lm_loss(piece_words(spark, d), [])
    return out.select("count", r6("loss").alias("loss"), F.round("ppl", 4).alias("ppl"))


@query("a16_word_stats", f"""WITH {_WORD_SCORES}
SELECT word, count(*) AS count, round(sum(logp), 6) AS logp, bool_or(is_bpe) AS is_bpe, round(coalesce(sum(nxt), 0), 6) AS next_logp, count(nxt) AS n_next
FROM wn GROUP BY word""")
def word_stats(spark, d):
    out = mt.word_stats(piece_words(spark, d)).orderBy(F.desc("count"), "word")
    return out.select("word", "count", r6("logp").alias("logp"), "is_bpe", r6("next_logp").alias("next_logp"), "n_next")


@query("a17_vector_pooling", """WITH t AS (SELECT label, vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label::BIGINT AS label, dim, arg_min(x, vec_id) AS first, round(avg(x), 6) AS mean, max(x) AS max, round(sqrt(sum(x * x)), 6) AS l2 FROM t GROUP BY label, dim""")
def vector_pooling(spark, d):
    out = mt.pool_vectors(base.table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return out.select(F.col("label").cast("bigint").alias("label"), F.col("dim").cast("bigint").alias("dim"), "first", r6("mean").alias("mean"), "max", r6("l2").alias("l2"))


# Five snapshots of a matrix (float rows) and of an integer counter, dealt from the vectors.
_SNAP = """snap AS (SELECT 'checkpoint' || (vec_id % 5 + 1) || '.pt' AS snapshot, 'row' || (vec_id // 5) AS key, dim AS pos, x AS value, false AS is_int
  FROM (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
  UNION ALL SELECT 'checkpoint' || (vec_id % 5 + 1) || '.pt', 'label', vec_id // 5, label, true FROM embeddings)"""


@query("a18_average_snapshots", f"""WITH {_SNAP},
l AS (SELECT * FROM snap WHERE snapshot IN ('checkpoint3.pt', 'checkpoint4.pt', 'checkpoint5.pt'))
SELECT key, pos, round(CASE WHEN bool_and(is_int) THEN trunc(avg(value)) ELSE avg(value) END, 6) AS value, count(*) = 3 AS complete FROM l GROUP BY key, pos""")
def average_snapshots(spark, d):
    v = base.table(spark, d, "embeddings")
    name = F.concat(F.lit("checkpoint"), (F.col("vec_id") % 5 + 1).cast("string"), F.lit(".pt"))
    row = F.floor(F.col("vec_id") / 5)
    rows = v.select(name.alias("snapshot"), F.concat(F.lit("row"), row.cast("string")).alias("key"), F.posexplode("embedding").alias("pos", "value"))
    rows = rows.select("snapshot", "key", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"), F.lit(False).alias("is_int"))
    ints = v.select(name.alias("snapshot"), F.lit("label").alias("key"), row.alias("pos"), F.col("label").cast("double").alias("value"), F.lit(True).alias("is_int"))
    out = mt.average_snapshots(mt.last_snapshots(rows.unionByName(ints), 3))
    return out.withColumn("value", r6("value"))
