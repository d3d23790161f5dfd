"""Example-builder queries (E1-E20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.consts import MOLECULE_SPECIALS
from seqspark.functions import arrays as ar, text as tx
from seqspark.functions.hashing import base as hash_base
from seqspark.operators import examples as ex, noise as nz, vocab as vb
from seqspark.plans import base, sql
from seqspark.plans.base import NWORDS, THRESHOLD, ids_text, joined, query
from seqspark.plans.vocabs import JOINT_VOCAB, joint_vocab
from seqspark.session import written

BLOCK = 256
SEED = 17


@query("e01_token_blocks", f"""WITH {sql.STREAM}
SELECT g // {BLOCK} AS block_id, count(*) AS n, string_agg(token_id::VARCHAR, ' ' ORDER BY g) AS item FROM stream GROUP BY 1""")
def token_blocks(spark, d):
    b = ex.token_blocks(base.doc_stream(spark, d), ["doc_id"], "ids", BLOCK, "size")
    return b.select("block_id", F.size("item").cast("bigint").alias("n"), joined("item").alias("item"))


@query("e02_complete_blocks", f"""WITH RECURSIVE {sql.WORDS},
s AS (SELECT doc_id, line_no, len(words) + 1 AS size, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i FROM words),
c AS MATERIALIZED (SELECT *, sum(size) OVER (ORDER BY i)::BIGINT AS upto FROM s),
n AS MATERIALIZED (SELECT a.i, a.upto, greatest(a.i + 1, (SELECT count(*) FROM c b WHERE b.upto <= a.upto - a.size + {BLOCK})) AS nxt FROM c a),
w AS (SELECT 0::BIGINT AS start_i, 0::BIGINT AS block_id
  UNION ALL SELECT n.nxt, w.block_id + 1 FROM w JOIN n ON n.i = w.start_i WHERE n.nxt < (SELECT count(*) FROM c))
SELECT c.doc_id, c.line_no, w.block_id FROM c ASOF JOIN w ON c.i >= w.start_i""")
def complete_blocks(spark, d):
    rows = base.doc_words(spark, d).select("doc_id", "line_no", (F.size("words") + 1).alias("size"))
    return ex.pack_sentences(rows, ["doc_id", "line_no"], "size", BLOCK)


@query("e03_sentence_blocks", f"""WITH {sql.WORDS}
SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS block_id, doc_id, line_no, len(words)::BIGINT + 1 AS size
FROM words WHERE len(words) + 1 > 1""")
def sentence_blocks(spark, d):
    rows = base.doc_words(spark, d).select("doc_id", "line_no", (F.size("words") + 1).cast("bigint").alias("size"))
    return ex.sentence_blocks(rows, ["doc_id", "line_no"], F.col("size"))


@query("e04_block_index", f"""WITH {sql.STREAM}
SELECT g // {BLOCK} AS block_id, arg_min(doc_id, g) AS start_doc, arg_min(line_no, g) AS start_line, arg_min(pos, g) AS start_off,
  arg_max(doc_id, g) AS end_doc, arg_max(line_no, g) AS end_line FROM stream GROUP BY 1""")
def block_index(spark, d):
    b = ex.block_index(base.doc_stream(spark, d), ["doc_id"], "line", "off", BLOCK)
    return b.select(
        "block_id", F.col("start.doc_id").alias("start_doc"), F.col("start.line").alias("start_line"),
        F.col("start.offset").alias("start_off"), F.col("end.doc_id").alias("end_doc"), F.col("end.line").alias("end_line"),
    )


_TARGETS = f"""{sql.STREAM},
sh AS (SELECT g, g // {BLOCK} AS block_id, g % {BLOCK} AS i, token_id, pos,
  lag(token_id, 1, 2) OVER (ORDER BY g) AS s1, lag(token_id, 2, 2) OVER (ORDER BY g) AS s2 FROM stream),
st AS (SELECT block_id, pos AS off FROM sh WHERE i = 0),
tg AS (SELECT sh.block_id, i, token_id, CASE WHEN off = 0 AND i = 0 THEN 2 ELSE s1 END AS source,
  CASE WHEN off = 0 AND i = 0 THEN 1 WHEN off = 0 AND i = 1 THEN 2 WHEN off = 1 AND i = 0 THEN 2 ELSE s2 END AS past
  FROM sh JOIN st USING (block_id)),
blocks AS (SELECT block_id, string_agg(token_id::VARCHAR, ' ' ORDER BY i) AS item,
  string_agg(source::VARCHAR, ' ' ORDER BY i) AS source, string_agg(past::VARCHAR, ' ' ORDER BY i) AS past FROM tg GROUP BY block_id)"""


@query("e05_block_targets", f"WITH {_TARGETS} SELECT block_id, item, source, past FROM blocks")
def block_targets(spark, d):
    b = ex.block_targets(base.doc_stream(spark, d), ["doc_id"], "ids", "off", BLOCK, "size")
    return b.select("block_id", *[ids_text(c) for c in ("item", "source", "past")])


@query("e06_select_targets", f"""WITH {_TARGETS},
b AS (SELECT block_id, item AS future, source, past, string_split(source, ' ')[-1] = '2' AS done FROM blocks)
SELECT block_id, source || CASE WHEN done THEN '' ELSE ' 2' END AS source,
  source || CASE WHEN done THEN '' ELSE ' 2' END AS target_self,
  future || CASE WHEN done THEN '' ELSE ' 1' END AS target_future,
  CASE WHEN done THEN past ELSE '1 ' || array_to_string(list_slice(string_split(past, ' '), 2, len(string_split(past, ' '))) || [string_split(source, ' ')[-1]], ' ') END AS target_past
FROM b""")
def select_targets(spark, d):
    b = ex.block_targets(base.doc_stream(spark, d), ["doc_id"], "ids", "off", BLOCK, "size")
    t = ex.select_targets(b.withColumnRenamed("item", "future"), ["self", "future", "past"], add_eos=True)
    return t.select("block_id", *[ids_text(c) for c in ("source", "target_self", "target_future", "target_past")])


# Token vocabulary laid out after the five molecule symbols (mask 0, go 4).
_MASK_VOCAB = f"{sql.COUNTS},\n{sql.finalize('counts', THRESHOLD, NWORDS, 8, MOLECULE_SPECIALS)}"
_CHOSEN = sql.fifth(f"(acc * {sql.MUL} + i + {sql.ADD}) % {sql.P}")
_U = sql.fifth(f"(acc * {sql.MUL} + (i + 1000000007) % {sql.P} + {sql.ADD}) % {sql.P}")
_V = sql.fifth(f"(acc * {sql.MUL} + (i + 1500000001) % {sql.P} + {sql.ADD}) % {sql.P}")


@query("e07_masked_example", f"""WITH {_MASK_VOCAB},
x AS (SELECT doc_id, line_no, pos + 1 AS i, coalesce(token_id, 3) AS t FROM tok LEFT JOIN vocab USING (token)
  UNION ALL SELECT doc_id, line_no, 0, 4 FROM words UNION ALL SELECT doc_id, line_no, len(words) + 1, 2 FROM words),
a AS (SELECT doc_id, line_no, {sql.base(SEED, 'doc_id', 'line_no')} AS acc, len(words) + 2 AS size FROM words),
h AS (SELECT x.*, acc, size, {_CHOSEN} AS h FROM x JOIN a USING (doc_id, line_no)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY t IN (2, 4), h, i) AS rk FROM h),
c AS (SELECT *, t NOT IN (2, 4) AND rk <= greatest(1, round_even(size * 0.15::DOUBLE, 0)) AS chosen FROM r),
u AS (SELECT *, CASE WHEN chosen THEN {_U} / {float(sql.P)}::DOUBLE END AS u, CASE WHEN chosen THEN {_V} / {float(sql.P)}::DOUBLE END AS v FROM c)
SELECT doc_id, line_no, string_agg((CASE WHEN NOT chosen THEN t WHEN u < 0.8 THEN 0 WHEN u < 0.9 THEN t
    ELSE floor(v * (SELECT count(*) FROM vocab))::BIGINT END)::VARCHAR, ' ' ORDER BY i) AS source,
  string_agg((CASE WHEN chosen THEN t ELSE 1 END)::VARCHAR, ' ' ORDER BY i) AS target
FROM u GROUP BY doc_id, line_no""")
def masked_example(spark, d):
    vocab = written(vb.finalize(base.doc_counts(spark, d), THRESHOLD, NWORDS, names=MOLECULE_SPECIALS), "mask_vocab")
    rows = vb.encode_text(base.doc_lines(spark, d), "line", vocab).withColumn("ids", ar.append_eos(F.col("ids")))
    acc = hash_base(SEED, F.col("doc_id"), F.col("line_no"))
    out = ex.masked_example(rows, "ids", acc, vocab_size=vocab.count())
    return out.select("doc_id", "line_no", ids_text("source"), ids_text("target"))


@query("e08_property_example", f"""WITH {_MASK_VOCAB},
x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS i, coalesce(token_id, 3) AS t FROM tok LEFT JOIN vocab USING (token)),
g AS (SELECT doc_id, string_agg(t::VARCHAR, ' ' ORDER BY i DESC) AS s, string_agg(t::VARCHAR, ' ' ORDER BY i) AS t FROM x GROUP BY doc_id)
SELECT g.doc_id, '4 ' || s AS source, '4 ' || t || ' 2' AS target, coalesce(quality, 0)::DOUBLE AS prop0, coalesce(toxic, 0)::DOUBLE AS prop1,
  quality IS NOT NULL AS miss0, toxic IS NOT NULL AS miss1
FROM g LEFT JOIN labels USING (doc_id)""")
def property_example(spark, d):
    vocab = written(vb.finalize(base.doc_counts(spark, d), THRESHOLD, NWORDS, names=MOLECULE_SPECIALS), "mask_vocab")
    rows = vb.encode_text(base.documents(spark, d).select("doc_id", "text"), "text", vocab).withColumn("ids", ar.append_eos(F.col("ids")))
    rows = rows.join(base.table(spark, d, "labels"), "doc_id", "left")
    out = ex.property_example(rows, "ids", props=["quality", "toxic"])
    return out.select(
        "doc_id", joined("source").alias("source"), joined("target").alias("target"),
        *[F.get("prop", F.lit(i)).alias(f"prop{i}") for i in (0, 1)], *[F.get("miss", F.lit(i)).alias(f"miss{i}") for i in (0, 1)],
    )


# Both sides of the pairs as ids; every third source already ends with EOS, targets do not.
PAIR_IDS = f"""{JOINT_VOCAB},
se AS (SELECT id, string_agg(coalesce(token_id, 3)::VARCHAR, ' ' ORDER BY pos) AS x FROM side LEFT JOIN vocab USING (token) WHERE s = 0 GROUP BY id),
te AS (SELECT id, string_agg(coalesce(token_id, 3)::VARCHAR, ' ' ORDER BY pos) AS x FROM side LEFT JOIN vocab USING (token) WHERE s = 1 GROUP BY id),
pe AS (SELECT pw.id, conv_id, turn, len(sw) AS ns, len(tw) AS nt, se.x AS source, te.x AS target FROM pw JOIN se USING (id) JOIN te USING (id))"""


def pair_ids(spark, d):
    vocab = joint_vocab(spark, d)
    p = base.pair_words(spark, d)
    p = vb.encode(vb.encode(p, "sw", vocab, "source"), "tw", vocab, "target")
    return p.select("id", "conv_id", "turn", "source", "target", F.size("sw").alias("ns"), F.size("tw").alias("nt"))


@query("e09_pair_example", f"""WITH {PAIR_IDS}
SELECT id, source, target || ' 2' AS target FROM pe""")
def pair_example(spark, d):
    p = pair_ids(spark, d)
    p = p.withColumn("source", F.when(F.col("id") % 3 == 0, ar.append_eos(F.col("source"))).otherwise(F.col("source")))
    out = ex.pair_example(p, append_eos_to_target=True, remove_eos_from_source=True)
    return out.select("id", joined("source").alias("source"), joined("target").alias("target"))


@query("e10_transform_eos", f"""WITH {PAIR_IDS}
SELECT id, source || ' 2' AS source, target AS target, ns::BIGINT + 1 AS src_size, nt::BIGINT AS tgt_size FROM pe""")
def transform_eos(spark, d):
    p = pair_ids(spark, d).withColumn("target", ar.append_eos(F.col("target")))
    out = ex.transform_eos(p, append_src=True, remove_tgt=True)
    return out.select(
        "id", joined("source").alias("source"), joined("target").alias("target"),
        F.size("source").cast("bigint").alias("src_size"), F.size("target").cast("bigint").alias("tgt_size"),
    )


@query("e10_eos_violations", f"WITH {PAIR_IDS} SELECT count(*) AS violations FROM pe WHERE id % 3 <> 0")
def eos_violations(spark, d):
    p = pair_ids(spark, d)
    p = p.withColumn("source", F.when(F.col("id") % 3 == 0, ar.append_eos(F.col("source"))).otherwise(F.col("source")))
    return ex.eos_violations(p, "source", expected=True)


# Sources in name order; src0 is the primary corpus, taken three times.
@query("e11_concat_corpora", """WITH n AS (SELECT source, count(*) AS n, CASE WHEN source = 'src0' THEN 3 ELSE 1 END AS r FROM documents GROUP BY source),
o AS (SELECT *, coalesce(sum(n * r) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM n)
SELECT d.doc_id, d.source, off + rep * n + row_number() OVER (PARTITION BY d.source, rep ORDER BY doc_id) - 1 AS new_id
FROM documents d JOIN o USING (source), range(3) u(rep) WHERE rep < r""")
def concat_corpora(spark, d):
    docs = base.table(spark, d, "documents").select("doc_id", "source")
    return ex.concat_corpora(docs, "source", ["doc_id"], {"src0": 3})


@query("e12_round_robin", """WITH k AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rk,
  count(*) OVER (PARTITION BY lang) AS n FROM documents),
g AS (SELECT i AS step FROM range((SELECT max(n) FROM k)) r(i)),
z AS (SELECT step, lang, doc_id, n_chars FROM g JOIN k ON step % n = rk)
SELECT step, lang, doc_id, max(n_chars) OVER (PARTITION BY step) AS num_tokens FROM z""")
def round_robin(spark, d):
    from pyspark.sql import Window

    docs = base.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    rows = ex.round_robin(docs, "lang", ["doc_id"])
    # A step holds one row per corpus, so the window group is as small as the corpus list.
    most = F.max("n_chars").over(Window.partitionBy("step"))
    return rows.select("step", "lang", "doc_id", most.alias("num_tokens"))


@query("e12_round_robin_eval", """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS step, doc_id FROM documents WHERE lang = 'en'""")
def round_robin_eval(spark, d):
    docs = base.table(spark, d, "documents").select("doc_id", "lang")
    return ex.round_robin(docs, "lang", ["doc_id"], eval_key="en").select("step", "doc_id")


# Neighbouring documents as a parallel corpus: the language of a document to that of the next.
@query("e13_language_pairs", """WITH p AS (SELECT a.lang || '-' || b.lang AS pair, a.doc_id AS source, b.doc_id AS target
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
c AS (SELECT *, array_to_string(list_sort(string_split(pair, '-')), '-') AS canonical FROM p)
SELECT pair, canonical, CASE WHEN pair <> canonical THEN target ELSE source END AS source,
  CASE WHEN pair <> canonical THEN source ELSE target END AS target FROM c""")
def language_pairs(spark, d):
    a = base.table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.col("lang").alias("sl"))
    b = base.table(spark, d, "documents").select(F.col("doc_id").alias("target"), F.col("lang").alias("tl"))
    p = a.join(b, F.col("target") == F.col("source") + 1).withColumn("pair", F.concat_ws("-", "sl", "tl"))
    p = p.withColumn("canonical", ex.canonical_pair(F.col("pair")))
    return ex.swap_direction(p, F.col("pair") != F.col("canonical")).select("pair", "canonical", "source", "target")


# Candidates for a pair: all replies of its conversation, scored by closeness in length.
@query("e14_back_translation", f"""WITH {PAIR_IDS},
h AS (SELECT p.id, q.turn AS hyp, q.target AS tokens, -abs(p.ns - q.nt)::DOUBLE AS score FROM pe p JOIN pe q ON p.conv_id = q.conv_id),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, hyp) = 1)
SELECT p.id, b.tokens AS source, p.source AS target FROM pe p JOIN b USING (id)""")
def back_translation(spark, d):
    from seqspark.operators.ranking import n_best

    p = pair_ids(spark, d)
    asked, replies = p.select("id", "conv_id", F.col("ns").alias("size")), p.select("conv_id", F.col("turn").alias("hyp"), F.col("nt").alias("size"))
    near = ex.closest(asked, replies, ["conv_id"], "size", "hyp")
    best = n_best(near.withColumn("score", -F.col("distance").cast("double")), ["id"], 1)
    tokens = p.select("conv_id", F.col("turn").alias("hyp"), F.col("target").alias("tokens"))
    out = ex.back_translate(p.select("id", "source"), best.join(tokens, ["conv_id", "hyp"]))
    return out.select("id", joined("source").alias("source"), joined("target").alias("target"))


@query("e15_word_index", f"""WITH {sql.PIECES}
SELECT doc_id, line_no, string_agg(piece, ' ' ORDER BY pos) AS pieces, string_agg(wi::VARCHAR, ' ' ORDER BY pos) AS word_index
FROM pieces GROUP BY doc_id, line_no""")
def word_index(spark, d):
    p = base.pieces(spark, d)
    return p.select("doc_id", "line_no", joined("pieces").alias("pieces"), F.array_join(nz.word_index(F.col("pieces")).cast("array<string>"), " ").alias("word_index"))


def _drop_sql(source: str, salt: int, p: float, out: str, blank: bool = False, keep: str = "") -> str:
    """Dropout over ``source(doc_id, line_no, pos, piece, wi, last_pos, acc)`` rows."""
    acc = sql.fifth(f"(acc * {sql.MUL} + {salt} + {sql.ADD}) % {sql.P}") if salt else "acc"
    u = sql.fifth(f"(a * {sql.MUL} + wi + {sql.ADD}) % {sql.P}") + f" / {float(sql.P)}::DOUBLE"
    v = sql.fifth(f"(a * {sql.MUL} + 1000000007 + {sql.ADD}) % {sql.P}") + f" / {float(sql.P)}::DOUBLE"
    piece = "CASE WHEN kept THEN piece ELSE '<unk>' END" if blank else "piece"
    where = "" if blank else "WHERE kept"
    return f"""{out}_a AS (SELECT *, {acc} AS a FROM {source}),
{out}_k AS (SELECT *, {u} >= {p} OR wi = max(wi) OVER (PARTITION BY doc_id, line_no) AS kept,
  floor({v} * (last_pos + 1))::BIGINT AS spare FROM {out}_a),
{out}_n AS (SELECT *, count(*) {'' if blank else 'FILTER (kept)'} OVER (PARTITION BY doc_id, line_no) AS left_over FROM {out}_k),
{out} AS (SELECT doc_id, line_no, pos, {piece} AS piece FROM {out}_n {where}
  UNION ALL SELECT doc_id, line_no, -1, piece FROM {out}_n WHERE left_over <= 1 AND pos = spare)"""


_ACC = f"pa AS (SELECT *, {sql.base(SEED, 'doc_id', 'line_no')} AS acc FROM pieces)"
_LINE = "SELECT doc_id, line_no, string_agg(piece, ' ' ORDER BY pos) AS pieces FROM {} GROUP BY doc_id, line_no"


def _noised(spark, d, fn):
    acc = hash_base(SEED, F.col("doc_id"), F.col("line_no"))
    p = base.pieces(spark, d).withColumn("acc", acc)
    return p.select("doc_id", "line_no", F.array_join(fn(F.col("pieces"), F.col("acc")), " ").alias("pieces"))


@query("e16_word_dropout", f"WITH {sql.PIECES}, {_ACC}, {_drop_sql('pa', 0, 0.3, 'dropped')} {_LINE.format('dropped')}")
def word_dropout(spark, d):
    return _noised(spark, d, lambda p, acc: nz.word_dropout(p, 0.3, acc))


@query("e17_word_blanking", f"WITH {sql.PIECES}, {_ACC}, {_drop_sql('pa', 0, 0.3, 'blanked', True)} {_LINE.format('blanked')}")
def word_blanking(spark, d):
    return _noised(spark, d, lambda p, acc: nz.word_dropout(p, 0.3, acc, blank="<unk>"))


def _shuffle_sql(source: str, salt: int, k: int, out: str) -> str:
    acc = sql.fifth(f"(acc * {sql.MUL} + {salt} + {sql.ADD}) % {sql.P}") if salt else "acc"
    u = sql.fifth(f"(a * {sql.MUL} + wi + {sql.ADD}) % {sql.P}") + f" / {float(sql.P)}::DOUBLE"
    return f"""{out}_a AS (SELECT *, {acc} AS a FROM {source}),
{out}_k AS (SELECT *, wi + CASE WHEN pos = last_pos THEN 1e9 WHEN wi = 0 THEN -1 ELSE {k} * ({u}) END AS key FROM {out}_a),
{out} AS (SELECT doc_id, line_no, piece, acc, last_pos, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY key, wi, pos) - 1 AS pos FROM {out}_k)"""


@query("e18_word_shuffle", f"WITH {sql.PIECES}, {_ACC}, {_shuffle_sql('pa', 0, 3, 'moved')} {_LINE.format('moved')}")
def word_shuffle(spark, d):
    return _noised(spark, d, lambda p, acc: nz.word_shuffle(p, 3, acc))


_REWORD = """{1} AS (SELECT *, coalesce(sum(CASE WHEN piece LIKE '%@@' THEN 0 ELSE 1 END) OVER (
  PARTITION BY doc_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wi FROM {0})"""
_RENUM = """{1} AS (SELECT doc_id, line_no, piece, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) - 1 AS pos,
  count(*) OVER (PARTITION BY doc_id, line_no) - 1 AS last_pos FROM {0})"""


@query("e19_noise_pipeline", f"""WITH {sql.PIECES}, {_ACC}, {_shuffle_sql('pa', 101, 3, 'moved')}, {_REWORD.format('moved', 'moved_w')},
{_drop_sql('moved_w', 102, 0.1, 'dropped')}, {_RENUM.format('dropped', 'dropped_r')}, {_REWORD.format('dropped_r', 'dropped_w')},
pb AS (SELECT *, {sql.base(SEED, 'doc_id', 'line_no')} AS acc FROM dropped_w),
{_drop_sql('pb', 103, 0.2, 'blanked', True)} {_LINE.format('blanked')}""")
def noise_pipeline(spark, d):
    acc = hash_base(SEED, F.col("doc_id"), F.col("line_no"))
    p = base.pieces(spark, d).withColumn("acc", acc)
    out = p.transform(nz.noise("pieces", "acc", 3, 0.1, 0.2))
    return out.select("doc_id", "line_no", joined("pieces").alias("pieces"))


@query("e20_classification_pairs", f"""WITH {sql.VOCAB},
e AS (SELECT doc_id, string_agg(coalesce(token_id, 3)::VARCHAR, ' ' ORDER BY line_no, pos) AS ids FROM tok LEFT JOIN vocab USING (token) GROUP BY doc_id),
l AS (SELECT lang, 3 + row_number() OVER (ORDER BY min(doc_id)) AS label_id FROM documents GROUP BY lang)
SELECT d.doc_id, e.ids AS source, l.label_id AS target FROM documents d JOIN e USING (doc_id) JOIN l ON l.lang = d.lang""")
def classification_pairs(spark, d):
    docs = base.documents(spark, d)
    texts = vb.encode(docs.select("doc_id", F.col("lang").alias("token"), tx.words(F.col("text")).alias("words")), "words", base.doc_vocab(spark, d))
    seen = docs.select(F.col("lang").alias("token"), F.col("doc_id").alias("first"))
    # The label stands in the row; only its id is looked up, in the table of labels.
    labels = vb.first_seen_vocab(seen).select("token", F.col("token_id").alias("label_id"))
    out = ex.classification_pairs(texts, labels, ["token"])
    return out.select("doc_id", joined("ids").alias("source"), F.get("target", F.lit(0)).cast("bigint").alias("target"))
