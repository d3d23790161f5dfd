"""Tokenizing, cleaning and BPE (T1-T16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.consts import GENERAL_MOLECULE_PATTERN
from seqspark.functions import text as tx
from seqspark.plans import base, sql
from seqspark.plans.base import joined, query

_STRIP = f"regexp_replace(line, '^{sql.WHITE}+|{sql.WHITE}+$', '', 'g')"


@query("t01_whitespace_tokens", f"""WITH {sql.WORDS}
SELECT doc_id, line_no, len(words)::BIGINT AS n, array_to_string(words, ' ') AS tokens FROM words""")
def whitespace_tokens(spark, d):
    w = base.doc_words(spark, d)
    return w.select("doc_id", "line_no", F.size("words").cast("bigint").alias("n"), joined("words").alias("tokens"))


@query("t02_short_molecule_tokens", f"""WITH {sql.LINES}
SELECT doc_id, line_no, array_to_string(regexp_extract_all({_STRIP}, '(?s)Cl|Br|10|Ru|.'), '|') AS tokens FROM lines""")
def short_molecule_tokens(spark, d):
    w = base.doc_lines(spark, d)
    return w.select("doc_id", "line_no", F.array_join(tx.short_molecule(F.col("line")), "|").alias("tokens"))


@query("t03_general_molecule_tokens", f"""WITH {sql.TOKENS},
w AS (SELECT token AS line, count(*) AS cnt FROM tok GROUP BY token),
m AS (SELECT line, cnt, regexp_extract_all(line, '{GENERAL_MOLECULE_PATTERN}') AS t FROM w)
SELECT line AS molecule, cnt, array_to_string(t, ' ') AS tokens, array_to_string(t, '') = line AS valid FROM m""")
def general_molecule_tokens(spark, d):
    words = base.documents(spark, d).select(F.explode(tx.words(F.col("text"))).alias("molecule"))
    found = words.groupBy("molecule").agg(F.count(F.lit(1)).alias("cnt"))
    found = found.withColumn("t", tx.general_molecule(F.col("molecule")))
    return found.select("molecule", "cnt", joined("t").alias("tokens"), tx.is_lossless(F.col("molecule"), F.col("t")).alias("valid"))


@query("t04_character_tokens", """SELECT item_id, array_to_string(regexp_extract_all(text, '(?s).'), ' ') AS tokens FROM benchmark""")
def character_tokens(spark, d):
    return base.table(spark, d, "benchmark").select("item_id", F.array_join(tx.characters(F.col("text")), " ").alias("tokens"))


@query("t05_reverse_tokens", f"""WITH {sql.WORDS}
SELECT doc_id, line_no, array_to_string(list_reverse(words), ' ') AS tokens FROM words""")
def reverse_tokens(spark, d):
    return base.doc_words(spark, d).select("doc_id", "line_no", F.array_join(F.reverse("words"), " ").alias("tokens"))


@query("t06_append_eos", f"""WITH {sql.ENCODED},
e AS (SELECT doc_id, line_no, string_agg(token_id::VARCHAR, ' ' ORDER BY pos) AS ids FROM enc GROUP BY ALL)
SELECT w.doc_id, w.line_no, coalesce(ids || ' ', '') || '2' AS ids FROM words w LEFT JOIN e USING (doc_id, line_no)""")
def append_eos(spark, d):
    from seqspark.functions.arrays import append_eos as add

    e = base.encoded_lines(spark, d).withColumn("ids", add(F.col("ids")))
    return e.select("doc_id", "line_no", base.ids_text("ids"))


_META, _WRAP = ["title", "script", "style"], ["article", "p", "b", "div"]


@query("t07_clean_markup_lines", """WITH l AS (
  SELECT page_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no
  FROM (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS ls FROM pages)),
k AS (SELECT * FROM l WHERE NOT regexp_matches(line, '<title>|<script>|<style>'))
SELECT page_id, line_no, replace(regexp_replace(line, '</?article( [^>]*)?>|</?p( [^>]*)?>|</?b( [^>]*)?>|</?div( [^>]*)?>', '', 'g'), '’', '''') AS line,
  regexp_matches(line, '<li[ >]') AS is_seg, trim(regexp_extract(line, '<li[^>]*>(.*?)</li>', 1)) AS seg
FROM k""")
def clean_markup_lines(spark, d):
    html = F.replace("html", F.lit("><"), F.lit(">\n<"))
    rows = base.table(spark, d, "pages").select("page_id", F.posexplode(tx.lines(html)).alias("line_no", "raw"))
    raw = F.col("raw")
    kept = rows.filter(tx.drop_metadata(raw, _META))
    return kept.select(
        "page_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        tx.straighten_apostrophe(tx.unwrap_tags(raw, _WRAP)).alias("line"),
        tx.has_tag(raw, "li").alias("is_seg"),
        tx.inner_text(raw, "li").alias("seg"),
    )


@query("t08_lower_case", f"WITH {sql.LINES} SELECT doc_id, line_no, lower(line) AS line FROM lines")
def lower_case(spark, d):
    return base.doc_lines(spark, d).withColumn("line", tx.lower(F.col("line")))


@query("t09_pair_filter", f"""WITH {sql.PAIR_WORDS}
SELECT id, len(sw)::BIGINT AS ns, len(tw)::BIGINT AS nt FROM pw
WHERE len(sw) BETWEEN 1 AND 175 AND len(tw) BETWEEN 1 AND 175
  AND greatest(len(sw), len(tw)) <= 1.5 * least(len(sw), len(tw))""")
def pair_filter(spark, d):
    from seqspark.operators.batching import filter_pairs

    p = base.pair_words(spark, d).select("id", F.size("sw").cast("bigint").alias("ns"), F.size("tw").cast("bigint").alias("nt"))
    return filter_pairs(p, "ns", "nt", 1, 175, 1.5)


@query("t10_first_words", f"""SELECT doc_id, array_to_string(list_slice({sql.words('text')}, 1, 1000), ' ') AS text FROM documents""")
def first_words(spark, d):
    return base.documents(spark, d).select("doc_id", tx.first_words(F.col("text"), 1000).alias("text"))


@query("t11_train_valid_split", f"""WITH {sql.LINES},
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS nr FROM lines)
SELECT nr, line, CASE WHEN nr % 23 = 0 THEN 'valid' ELSE 'train' END AS split FROM n""")
def train_valid_split(spark, d):
    from seqspark.operators.batching import every_kth
    from seqspark.operators.ordering import ranked

    rows = ranked(base.doc_lines(spark, d), ["doc_id", "line_no"], "nr").withColumn("nr", F.col("nr") + 1)
    return rows.select("nr", "line", every_kth(F.col("nr"), 23).alias("split"))


@query("t12_plain_characters", f"""WITH {sql.LINES}
SELECT doc_id, line_no, translate(regexp_replace(line, '\\p{{C}}', ' ', 'g'), '{tx.QUOTES_FROM}', '{tx.QUOTES_TO.replace("'", "''")}') AS line FROM lines""")
def plain_characters(spark, d):
    line = tx.plain_punctuation(tx.printable(F.col("line")))
    return base.doc_lines(spark, d).withColumn("line", line)


MERGES = 60


def _bpe_sql(merges: int) -> str:
    """``w{merges}(token, cnt, s)`` and ``m1 .. m{merges}(a, b, cnt)``: one merge after the other.

    Every symbol of ``s`` has a blank on both sides, so a literal replacement of two
    neighbours goes from left to right and takes no symbol twice.
    """
    steps = [f"""{sql.PAIR_WORDS},
bt AS (SELECT id, 0 AS side, unnest(sw) AS token, unnest(range(len(sw))) AS pos FROM pw
  UNION ALL SELECT id, 1, unnest(tw), unnest(range(len(tw))) FROM pw),
w0 AS MATERIALIZED (SELECT token, count(*) AS cnt, ' ' || array_to_string(regexp_extract_all(token, '(?s).'), '  ') || '</w> ' AS s
  FROM bt GROUP BY token)"""]
    for k in range(1, merges + 1):
        steps.append(f"""m{k} AS MATERIALIZED (SELECT a, b, sum(cnt)::BIGINT AS cnt FROM (
  SELECT cnt, unnest(l[:-2]) AS a, unnest(l[2:]) AS b FROM (SELECT cnt, string_split(trim(s), '  ') AS l FROM w{k - 1}))
  GROUP BY a, b HAVING sum(cnt) >= 2 ORDER BY 3 DESC, a DESC, b DESC LIMIT 1),
w{k} AS MATERIALIZED (SELECT token, w{k - 1}.cnt, coalesce(replace(s, ' ' || a || '  ' || b || ' ', ' ' || a || b || ' '), s) AS s
  FROM w{k - 1} LEFT JOIN m{k} ON true)""")
    return ",\n".join(steps)


@query("t13_learn_bpe", f"WITH {_bpe_sql(MERGES)}\n" + "\nUNION ALL ".join(
    f"SELECT {k - 1}::BIGINT AS rank, a AS left, b AS right, cnt FROM m{k}" for k in range(1, MERGES + 1)))
def learn_bpe(spark, d):
    from seqspark.operators import bpe

    return bpe.learn(bpe_words(spark, d), merges=MERGES)


def bpe_words(spark, d):
    """Word counts over both sides of the pairs."""
    p = base.pair_words(spark, d)
    both = p.select(F.explode("sw").alias("token")).unionByName(p.select(F.explode("tw").alias("token")))
    return both.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


# Merging in learnt order is what segmenting a word does.
@query("t14_apply_bpe", f"""WITH {_bpe_sql(MERGES)},
cut AS (SELECT token, regexp_replace(replace(trim(s), '  ', '@@ '), '</w>$', '') AS pieces FROM w{MERGES}),
side AS (SELECT id, side, string_agg(pieces, ' ' ORDER BY pos) AS pieces FROM bt JOIN cut USING (token) GROUP BY id, side)
SELECT pw.id, coalesce(a.pieces, '') AS source, coalesce(b.pieces, '') AS target FROM pw
LEFT JOIN side a ON a.id = pw.id AND a.side = 0 LEFT JOIN side b ON b.id = pw.id AND b.side = 1""")
def apply_bpe(spark, d):
    from seqspark.operators import bpe

    merges = bpe.learn(bpe_words(spark, d), merges=MERGES)
    p = bpe.apply(base.pair_words(spark, d).select("id", "sw", "tw"), "sw", merges, "source")
    p = bpe.apply(p, "tw", merges, "target")
    return p.select("id", joined("source").alias("source"), joined("target").alias("target"))


@query("t15_remove_bpe", f"""WITH {sql.WORDS},
marked AS (SELECT doc_id, line_no, array_to_string(list_transform(words, lambda w:
  CASE WHEN length(w) > 3 THEN substr(w, 1, 3) || '@@ ' || substr(w, 4) ELSE w END), ' ') AS pieces FROM words)
SELECT doc_id, line_no, rtrim(replace(pieces || ' ', '@@ ', '')) AS text FROM marked""")
def remove_bpe(spark, d):
    cut = F.transform("words", lambda w: F.when(F.char_length(w) > 3, F.concat(F.substring(w, 1, 3), F.lit("@@ "), F.substring(w, F.lit(4), F.char_length(w)))).otherwise(w))
    rows = base.doc_words(spark, d).withColumn("pieces", F.array_join(cut, " "))
    return rows.select("doc_id", "line_no", tx.remove_bpe(F.col("pieces")).alias("text"))


@query("t16_byte_ids", f"""WITH {sql.VOCAB}
SELECT token_id, token, CASE WHEN is_special THEN array_to_string(list_transform(range(50), lambda i: 0), ' ')
  ELSE array_to_string(list_transform(range(50), lambda i:
    CASE WHEN i < octet_length(encode(token)) THEN ('0x' || substr(hex(encode(token)), (2 * i + 1)::INT, 2))::INT + 1 ELSE 0 END), ' ') END AS bytes,
  (NOT is_special AND octet_length(encode(token)) > 50) AS truncated
FROM vocab""")
def byte_ids(spark, d):
    v = base.doc_vocab(spark, d)
    zero = F.array_repeat(F.lit(0), 50)
    v = v.withColumn("b", F.when(F.col("is_special"), zero).otherwise(tx.byte_ids(F.col("token"))))
    cut = ~F.col("is_special") & (tx.byte_length(F.col("token")) > 50)
    return v.select("token_id", "token", joined("b").alias("bytes"), cut.alias("truncated"))
