"""Vocabulary queries (V1-V15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.consts import MOLECULE_SPECIALS, SHORT_MOLECULE_TOKENS, GENERAL_MOLECULE_PATTERN, GENERAL_MOLECULE_TOKENS
from seqspark.functions import arrays as ar, text as tx
from seqspark.operators import vocab as vb
from seqspark.plans import base, sql
from seqspark.plans.base import joined, query
from seqspark.plans.sources import ALIGN_SQL, alignment_links


def _vocab(v):
    return v.select("token_id", "token", "cnt")


@query("v01_token_counts", f"WITH {sql.COUNTS} SELECT token, cnt, first::VARCHAR AS first FROM counts")
def token_counts(spark, d):
    # Bits of the order key: document, line, position; here read off the stored text.
    lines = base.doc_lines(spark, d)
    key = vb.first_key((F.col("doc_id"), 0), (F.col("line_no"), 31), (F.lit(0), 31))
    tok = lines.select(key.alias("k"), F.posexplode(tx.words(F.col("line"))).alias("pos", "token"))
    counts = vb.count_tokens(tok.select("token", (F.col("k") + F.col("pos")).cast("decimal(38,0)").alias("first")))
    ends = lines.agg(F.lit("</s>").alias("token"), F.count(F.lit(1)).alias("cnt"), F.lit(None).cast("decimal(38,0)").alias("first"))
    return counts.unionByName(ends).withColumn("first", F.col("first").cast("string"))


@query("v02_finalize_vocab", f"WITH {sql.VOCAB} SELECT token_id, token, cnt FROM vocab")
def finalize_vocab(spark, d):
    return _vocab(base.doc_vocab(spark, d))


@query("v02_rank_all_tokens", f"WITH {sql.COUNTS},\n{sql.finalize('counts', -1, -1)} SELECT token_id, token, cnt FROM vocab")
def rank_all_tokens(spark, d):
    return _vocab(vb.finalize(base.doc_counts(spark, d)))


# Source before target: the target text continues after the sources of all pairs.
_JOINT = f"""{sql.PAIR_WORDS},
side AS (SELECT 0 AS s, id, unnest(sw) AS token, unnest(range(len(sw))) AS pos FROM pw
  UNION ALL SELECT 1, id, unnest(tw), unnest(range(len(tw))) FROM pw),
jcounts AS (SELECT token, count(*) AS cnt,
  min(s * 4611686018427387904::HUGEINT * 1073741824 + id::HUGEINT * 2147483648 + pos) AS first FROM side GROUP BY token
  UNION ALL SELECT '</s>', 2 * count(*), NULL FROM pw)"""
JOINT_VOCAB = f"{_JOINT},\n{sql.finalize('jcounts', 2, 2000)}"


def joint_counts(spark, d):
    p = base.pair_words(spark, d)
    sides = None
    for i, c in enumerate(["sw", "tw"]):
        key = vb.first_key((F.lit(i), 0), (F.col("id"), 61), (F.lit(0), 31))
        one = p.select(key.alias("k"), F.posexplode(c).alias("pos", "token"))
        sides = one if sides is None else sides.unionByName(one)
    counts = vb.count_tokens(sides.select("token", (F.col("k") + F.col("pos")).cast("decimal(38,0)").alias("first")))
    ends = p.agg(F.lit("</s>").alias("token"), (2 * F.count(F.lit(1))).alias("cnt"), F.lit(None).cast("decimal(38,0)").alias("first"))
    return counts.unionByName(ends)


def joint_vocab(spark, d):
    return vb.finalize(joint_counts(spark, d), 2, 2000)


@query("v03_joined_vocab", f"WITH {JOINT_VOCAB} SELECT token_id, token, cnt FROM vocab")
def joined_vocab(spark, d):
    return _vocab(joint_vocab(spark, d))


def _side_vocab(spark, d, col):
    p = base.pair_words(spark, d)
    key = vb.first_key((F.col("id"), 0), (F.lit(0), 31))
    tok = p.select(key.alias("k"), F.posexplode(col).alias("pos", "token"))
    counts = vb.count_tokens(tok.select("token", (F.col("k") + F.col("pos")).cast("decimal(38,0)").alias("first")))
    return vb.finalize(counts, padding_factor=1)


def _side_sql(name: str, col: str) -> str:
    body = sql.finalize(f"{name}_counts", -1, -1, 1)
    for cte in ("ranked", "kept", "vocab"):
        body = body.replace(f"{cte} AS (", f"{name}_{cte} AS (").replace(f"FROM {cte} ", f"FROM {name}_{cte} ").replace(f"FROM {cte})", f"FROM {name}_{cte})").replace(f"FROM {cte}\n", f"FROM {name}_{cte}\n")
    return f"""{name}_tok AS (SELECT id, unnest({col}) AS token, unnest(range(len({col}))) AS pos FROM pw),
{name}_counts AS (SELECT token, count(*) AS cnt, min(id::HUGEINT * 2147483648 + pos) AS first FROM {name}_tok GROUP BY token),
{body}"""


@query("v04_merge_vocabs", f"""WITH {sql.PAIR_WORDS}, {_side_sql('l', 'sw')}, {_side_sql('r', 'tw')},
new AS (SELECT r.token, r.cnt, row_number() OVER (ORDER BY r.token_id) - 1 AS k FROM r_vocab r ANTI JOIN l_vocab l USING (token))
SELECT l.token_id, l.token, l.cnt + coalesce(r.cnt, 0) AS cnt FROM l_vocab l LEFT JOIN r_vocab r USING (token)
UNION ALL SELECT (SELECT max(token_id) + 1 FROM l_vocab) + k, token, cnt FROM new""")
def merge_vocabs(spark, d):
    return _vocab(vb.merge_vocabs(_side_vocab(spark, d, "sw"), _side_vocab(spark, d, "tw")))


@query("v05_encode_lines", f"""WITH {sql.ENCODED}
SELECT w.doc_id, w.line_no, coalesce(string_agg(token_id::VARCHAR, ' ' ORDER BY pos), '') AS ids {sql.BY_LINE}""")
def encode_lines(spark, d):
    e = base.encoded_lines(spark, d)
    return e.select("doc_id", "line_no", joined("ids").alias("ids"))


@query("v05_encode_by_join", f"WITH {sql.ENCODED} SELECT doc_id, line_no, pos, token, token_id FROM enc")
def encode_by_join(spark, d):
    tok = base.doc_lines(spark, d).select("doc_id", "line_no", F.posexplode(tx.words(F.col("line"))).alias("pos", "token"))
    out = vb.lookup_ids(tok, base.doc_vocab(spark, d))
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("v06_growing_vocab", f"""WITH t AS (SELECT item_id, unnest({sql.words('text')}) AS token, unnest(range(len({sql.words('text')}))) AS pos FROM benchmark),
s AS (SELECT token, 3 + row_number() OVER (ORDER BY min(item_id * 2147483648 + pos)) AS token_id FROM t GROUP BY token)
SELECT item_id, string_agg(token_id::VARCHAR, ' ' ORDER BY pos) || ' 2' AS ids FROM t JOIN s USING (token) GROUP BY item_id""")
def growing_vocab(spark, d):
    items = base.table(spark, d, "benchmark").withColumn("words", tx.words(F.col("text")))
    key = vb.first_key((F.col("item_id"), 0), (F.lit(0), 31))
    tok = items.select(key.alias("k"), F.posexplode("words").alias("pos", "token"))
    vocab = vb.first_seen_vocab(tok.select("token", (F.col("k") + F.col("pos")).cast("decimal(38,0)").alias("first")))
    e = vb.encode(items, "words", vocab)
    return e.select("item_id", F.array_join(ar.append_eos(F.col("ids")).cast("array<string>"), " ").alias("ids"))


@query("v07_decode_lines", f"""WITH {sql.ENCODED}
SELECT w.doc_id, w.line_no, coalesce(string_agg(CASE WHEN token_id = 3 THEN '<<unk>>' ELSE token END, ' ' ORDER BY pos), '') AS text
{sql.BY_LINE}""")
def decode_lines(spark, d):
    vocab = base.doc_vocab(spark, d)
    rows = vb.encode_text(base.doc_lines(spark, d), "line", vocab).withColumn("ids", ar.append_eos(F.col("ids")))
    out = vb.decode_rows(rows, "ids", vocab, escape_unk=True)
    return out.select("doc_id", "line_no", "text")


@query("v07_decode_by_join", f"""WITH {sql.ENCODED},
t AS (SELECT doc_id, string_agg(CASE WHEN token_id = 3 THEN '<unk>' ELSE token END, ' ' ORDER BY line_no, pos) AS text FROM enc GROUP BY doc_id)
SELECT doc_id, coalesce(t.text, '') AS text FROM documents LEFT JOIN t USING (doc_id)""")
def decode_by_join(spark, d):
    vocab = base.doc_vocab(spark, d)
    docs = base.documents(spark, d).select("doc_id", "text")
    long = vb.encode_text(docs, "text", vocab).select("doc_id", F.posexplode("ids").alias("pos", "token_id"))
    # Documents without tokens have no row to decode, but a text: the empty one.
    return docs.select("doc_id").join(vb.decode(long, vocab, ["doc_id"]), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


@query("v08_encode_report", f"""WITH {sql.ENCODED},
l AS (SELECT lang, count(*) AS nseq FROM lines GROUP BY lang),
t AS (SELECT lang, count(*) AS n, count(*) FILTER (token_id = 3 AND token <> '<unk>') AS nunk FROM enc GROUP BY lang)
SELECT lang, nseq, n + nseq AS ntok, nunk, round(100.0::DOUBLE * nunk / (n + nseq), 6) AS pct FROM l JOIN t USING (lang)""")
def encode_report(spark, d):
    return vb.encode_report(base.encoded_lines(spark, d, "lang"), ["lang"])


@query("v08_replaced_tokens", f"""WITH {sql.ENCODED}
SELECT token, count(*) AS cnt FROM enc WHERE token_id = 3 AND token <> '<unk>' GROUP BY token""")
def replaced_tokens(spark, d):
    return vb.replaced_tokens(base.encoded_lines(spark, d))


@query("v09_truncated_vocab", f"""WITH {sql.ENCODED}
SELECT w.doc_id, w.line_no, coalesce(string_agg((CASE WHEN token_id >= 500 THEN 3 ELSE token_id END)::VARCHAR, ' ' ORDER BY pos), '') AS ids
{sql.BY_LINE}""")
def truncated_vocab(spark, d):
    e = base.encoded_lines(spark, d)
    return e.select("doc_id", "line_no", F.array_join(ar.truncate_vocab(F.col("ids"), 500).cast("array<string>"), " ").alias("ids"))


def _values(tokens: list[str]) -> str:
    return ", ".join(f"({i}, '{t}')" for i, t in enumerate(MOLECULE_SPECIALS + tokens))


@query("v10_short_molecule_vocab", f"""WITH v(token_id, token) AS (VALUES {_values(SHORT_MOLECULE_TOKENS)}),
t AS (SELECT unnest(regexp_extract_all(text, '(?s)Cl|Br|10|Ru|.')) AS token FROM (
  SELECT regexp_replace(text, '^{sql.WHITE}+|{sql.WHITE}+$', '', 'g') AS text FROM documents)),
c AS (SELECT coalesce(v.token_id, 3) AS token_id, count(*) AS cnt FROM t LEFT JOIN v USING (token) GROUP BY 1)
SELECT v.token_id::BIGINT AS token_id, v.token, coalesce(cnt, 0) AS cnt FROM v LEFT JOIN c USING (token_id)""")
def short_molecule_vocab(spark, d):
    return _usage(spark, d, SHORT_MOLECULE_TOKENS, tx.short_molecule)


@query("v10_general_molecule_vocab", f"""WITH v(token_id, token) AS (VALUES {_values(GENERAL_MOLECULE_TOKENS)}),
t AS (SELECT unnest(regexp_extract_all(text, '{GENERAL_MOLECULE_PATTERN}')) AS token FROM documents),
c AS (SELECT coalesce(v.token_id, 3) AS token_id, count(*) AS cnt FROM t LEFT JOIN v USING (token) GROUP BY 1)
SELECT v.token_id::BIGINT AS token_id, v.token, coalesce(cnt, 0) AS cnt FROM v LEFT JOIN c USING (token_id)""")
def general_molecule_vocab(spark, d):
    return _usage(spark, d, GENERAL_MOLECULE_TOKENS, tx.general_molecule)


def _usage(spark, d, tokens, tokenize):
    """How often each entry of a fixed vocabulary occurs in the documents."""
    vocab = vb.fixed_vocab(spark, MOLECULE_SPECIALS, tokens)
    found = base.documents(spark, d).select(F.explode(tokenize(F.col("text"))).alias("token"))
    found = found.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    used = vb.lookup_ids(found, vocab).groupBy("token_id").agg(F.sum("cnt").alias("cnt"))
    return vocab.join(used, "token_id", "left").select("token_id", "token", F.coalesce("cnt", F.lit(0)).alias("cnt"))


_VECTORS = "vec AS (SELECT coalesce(token, 'vec' || vec_id) AS token, embedding FROM embeddings e LEFT JOIN vocab v ON v.token_id = e.vec_id + 4)"
DIMENSIONS = 64


def _vectors(spark, d):
    """Every vector under a name: the word that many places after the symbols, else its number."""
    v = base.table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") + 4).alias("token_id"), "embedding")
    named = v.join(base.doc_vocab(spark, d).select("token_id", "token"), "token_id", "left")
    return named.select(F.coalesce("token", F.concat(F.lit("vec"), F.col("vec_id").cast("string"))).alias("token"), "embedding")


@query("v11_vector_coverage", f"""WITH {sql.VOCAB},
{_VECTORS}
SELECT (SELECT count(*) FROM vocab WHERE token IN (SELECT token FROM vec)) AS covered, (SELECT count(*) FROM vocab) AS total""")
def vector_coverage(spark, d):
    return vb.coverage(base.doc_vocab(spark, d), _vectors(spark, d))


@query("v11_attach_vectors", f"""WITH {sql.VOCAB},
{_VECTORS}
SELECT token_id, token, {", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(DIMENSIONS))} FROM vocab LEFT JOIN vec USING (token)""")
def attach_vectors(spark, d):
    out = vb.attach_vectors(base.doc_vocab(spark, d), _vectors(spark, d))
    return out.select("token_id", "token", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(DIMENSIONS)])


@query("v12_alignment_dict", f"""WITH {ALIGN_SQL},
cnt AS (SELECT src, tgt, count(*) AS c, min(id * 1048576 + src_pos) AS f FROM links GROUP BY src, tgt)
SELECT src, tgt FROM cnt QUALIFY row_number() OVER (PARTITION BY src ORDER BY c DESC, f) = 1""")
def alignment_dict(spark, d):
    return vb.alignment_dict(alignment_links(spark, d))


# Only words that the vocabulary of the documents knows, on both sides.
@query("v12_alignment_known", f"""WITH {sql.VOCAB}, {ALIGN_SQL},
known AS (SELECT token FROM vocab WHERE token <> '<unk>'),
cnt AS (SELECT src, tgt, count(*) AS c, min(id * 1048576 + src_pos) AS f FROM links
  WHERE src IN (SELECT token FROM known) AND tgt IN (SELECT token FROM known) GROUP BY src, tgt)
SELECT src, tgt FROM cnt QUALIFY row_number() OVER (PARTITION BY src ORDER BY c DESC, f) = 1""")
def alignment_known(spark, d):
    vocab = base.doc_vocab(spark, d)
    return vb.alignment_dict(alignment_links(spark, d), vocab, vocab)


# Hypothesis: the target with every third word unknown, aligned i -> i (past the end: <eos>).
@query("v13_replace_unknown", f"""WITH {ALIGN_SQL},
cnt AS (SELECT src, tgt, count(*) AS c, min(id * 1048576 + src_pos) AS f FROM links GROUP BY src, tgt),
dict AS (SELECT src, tgt FROM cnt QUALIFY row_number() OVER (PARTITION BY src ORDER BY c DESC, f) = 1),
hyp AS (SELECT id, pos, CASE WHEN pos % 3 = 0 THEN '<unk>' ELSE tw[pos + 1] END AS token,
  coalesce(sw[pos + 1], '<eos>') AS src FROM pw, unnest(range(len(tw))) u(pos))
SELECT id, string_agg(CASE WHEN token = '<unk>' THEN coalesce(tgt, hyp.src) ELSE token END, ' ' ORDER BY pos) AS text
FROM hyp LEFT JOIN dict ON dict.src = hyp.src GROUP BY id""")
def replace_unknown(spark, d):
    p = base.pair_words(spark, d)
    hyp = p.select("id", F.size("sw").alias("n"), F.posexplode("tw").alias("pos", "token"))
    hyp = hyp.select("id", "pos", F.when(F.col("pos") % 3 == 0, F.lit("<unk>")).otherwise(F.col("token")).alias("token"), F.least("pos", "n").alias("src_pos"))
    source = p.select("id", F.col("sw").alias("words"))
    return vb.replace_unk(hyp, source, vb.alignment_dict(alignment_links(spark, d)))


@query("v14_frequency_bands", f"""WITH {sql.ENCODED},
b AS (SELECT CASE WHEN token_id < 100 THEN 0 WHEN token_id < 1000 THEN 1 ELSE 2 END AS band,
  token_id - CASE WHEN token_id < 100 THEN 0 WHEN token_id < 1000 THEN 100 ELSE 1000 END AS inner_id FROM enc)
SELECT band::BIGINT AS band, inner_id, count(*) AS cnt FROM b GROUP BY ALL""")
def frequency_bands(spark, d):
    ids = base.encoded_lines(spark, d).select(F.explode("ids").alias("token_id"))
    band, inner = vb.bands(F.col("token_id"), [100, 1000, 4000])
    return ids.select(band.alias("band"), inner.alias("inner_id")).groupBy("band", "inner_id").agg(F.count(F.lit(1)).alias("cnt"))


# The document vocabulary against one whose reserved symbols were counted as words.
@query("v15_vocab_compatibility", f"""WITH {sql.VOCAB},
t AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS token_id FROM vocab WHERE token IN ('<pad>', '</s>', '<unk>'))
SELECT v.token, v.token_id AS left_id, t.token_id AS right_id FROM vocab v JOIN t USING (token) WHERE v.token_id <> t.token_id""")
def vocab_compatibility(spark, d):
    from pyspark.sql import Window

    vocab = base.doc_vocab(spark, d)
    names = vocab.filter(F.col("token").isin("<pad>", "</s>", "<unk>"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("cnt"), "token")
    other = names.select("token", (F.row_number().over(order) - 1).cast("bigint").alias("token_id"))
    return vb.incompatible(vocab, other)
