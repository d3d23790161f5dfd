"""Sources and sinks (S1-S15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import text as tx
from seqspark.operators import vocab as vb
from seqspark.plans import base, sql
from seqspark.plans.base import query
from seqspark.session import local_table, scratch_dir
from seqspark.sources import corpus, molecules, text as src


def _written_lines(spark, d) -> str:
    path = scratch_dir(spark, "lines")
    src.write_lines(base.doc_lines(spark, d), path, F.col("line"), ["doc_id", "line_no"])
    return path


@query("s01_line_source", f"""WITH {sql.LINES}
SELECT line, count(*) AS cnt, sum(length(line))::BIGINT AS chars FROM lines GROUP BY line""")
def line_source(spark, d):
    rows = src.read_lines(spark, _written_lines(spark, d))
    return rows.groupBy("line").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(F.char_length("line")).alias("chars")
    )


@query("s02_line_ordinals", f"""WITH {sql.WORDS}
SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, line,
       array_to_string(words, ' ') AS tokens FROM words""")
def line_ordinals(spark, d):
    rows = src.read_numbered(spark, _written_lines(spark, d))
    return rows.select("line_no", "line", F.array_join(tx.words(F.col("line")), " ").alias("tokens"))


@query("s03_parallel_pairs", f"WITH {sql.PAIRS} SELECT conv_id, turn, source, target FROM pairs")
def parallel_pairs(spark, d):
    turns = base.table(spark, d, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("line"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("line"))
    return src.parallel(user, reply, ["conv_id", "turn"])


# A labelled line per document: name, quality, toxic; NaN where the label is missing and a
# third property for every tenth document, which makes that line malformed.
_PROPERTY_SQL = """plines AS (
  SELECT d.doc_id, 'doc' || d.doc_id || ',' || coalesce(l.quality::VARCHAR, 'NaN') || ',' ||
    coalesce(l.toxic::VARCHAR, 'NaN') || CASE WHEN d.doc_id % 10 = 9 THEN ',1' ELSE '' END AS line
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _property_lines(spark, d):
    docs = base.table(spark, d, "documents").select("doc_id")
    rows = docs.join(base.table(spark, d, "labels"), "doc_id", "left")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in ("quality", "toxic")]
    extra = F.when(F.col("doc_id") % 10 == 9, F.lit(",1")).otherwise(F.lit(""))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", F.concat(F.concat_ws(",", name, *text), extra).alias("line"))


@query("s04_property_source", f"""WITH {_PROPERTY_SQL}
SELECT row_number() OVER (ORDER BY doc_id) AS line_no, 'doc' || doc_id AS smiles, len(string_split(line, ',')) = 3 AS ok,
  CASE WHEN string_split(line, ',')[2] = 'NaN' THEN 0 ELSE string_split(line, ',')[2]::DOUBLE END AS prop0,
  CASE WHEN string_split(line, ',')[3] = 'NaN' THEN 0 ELSE string_split(line, ',')[3]::DOUBLE END AS prop1,
  string_split(line, ',')[2] <> 'NaN' AS present0, string_split(line, ',')[3] <> 'NaN' AS present1
FROM plines""")
def property_source(spark, d):
    path = scratch_dir(spark, "properties")
    header = local_table(spark, [(-1, "smiles,quality,toxic")], "doc_id bigint, line string")
    src.write_lines(header.unionByName(_property_lines(spark, d)), path, F.col("line"), ["doc_id"])
    parsed = molecules.read_properties(spark, path, num_props=2)
    return parsed.select(
        "line_no", "smiles", "ok",
        *[F.get("props", F.lit(i)).alias(f"prop{i}") for i in (0, 1)],
        *[F.get("present", F.lit(i)).alias(f"present{i}") for i in (0, 1)],
    )


@query("s05_unlabelled_source", f"""WITH {sql.LINES}
SELECT line_no, string_split(regexp_replace(line, '^{sql.WHITE}+|{sql.WHITE}+$', '', 'g'), ',')[1] AS smiles
FROM (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, line FROM lines)
WHERE line_no > 0 AND regexp_replace(line, '{sql.WHITE}+', '', 'g') <> ''""")
def unlabelled_source(spark, d):
    return molecules.read_unlabelled(spark, _written_lines(spark, d)).select("line_no", "smiles")


@query("s06_encoded_round_trip", f"""WITH {sql.ENCODED}
SELECT w.doc_id, w.line_no, count(token_id) AS size, coalesce(string_agg(token_id::VARCHAR, ' ' ORDER BY pos), '') AS ids
{sql.BY_LINE}""")
def encoded_round_trip(spark, d):
    path = scratch_dir(spark, "encoded")
    corpus.write_encoded(base.encoded_lines(spark, d).select("doc_id", "line_no", "ids"), path)
    kept = corpus.read_encoded(spark, path)
    return kept.select("doc_id", "line_no", F.col("size").cast("bigint").alias("size"), base.joined("ids").alias("ids"))


@query("s06_point_lookup", f"""WITH {sql.ENCODED},
benchmarked AS (SELECT DISTINCT item_id * 7 AS doc_id FROM benchmark)
SELECT w.doc_id, w.line_no, count(token_id) AS size, coalesce(string_agg(token_id::VARCHAR, ' ' ORDER BY pos), '') AS ids
{sql.BY_LINE} HAVING w.doc_id IN (SELECT doc_id FROM benchmarked)""")
def point_lookup(spark, d):
    """Documents asked for by number: here seven times the number of each benchmark item."""
    path = scratch_dir(spark, "clustered")
    corpus.write_clustered(base.encoded_lines(spark, d).select("doc_id", "line_no", "ids"), path, "doc_id", 64)
    wanted = base.table(spark, d, "benchmark").select((F.col("item_id") * 7).alias("doc_id"))
    found = corpus.lookup(spark, path, wanted, "doc_id")
    return found.select("doc_id", "line_no", F.col("size").cast("bigint").alias("size"), base.joined("ids").alias("ids"))


@query("s07_vocab_round_trip", f"""WITH {sql.VOCAB}
SELECT token_id, token, CASE WHEN is_special THEN 0 ELSE cnt END AS cnt FROM vocab""")
def vocab_round_trip(spark, d):
    path = scratch_dir(spark, "vocab")
    corpus.save_vocab(base.doc_vocab(spark, d), path)
    return corpus.load_vocab(spark, path).select("token_id", "token", "cnt")


@query("s08_split_discovery", """WITH files AS (
  SELECT DISTINCT n, lang, 'corpus/train' || CASE WHEN n = 0 THEN '' ELSE n::VARCHAR END || '.' || lang || '-en.' || lang AS path
  FROM (SELECT lang, CASE WHEN s > 9 THEN s + 1 ELSE s END AS n FROM (
    SELECT lang, substr(source, 4)::BIGINT AS s FROM documents)))
SELECT path, 'train' AS split, n AS part, lang AS src, 'en' AS tgt, lang,
       dense_rank() OVER (PARTITION BY lang ORDER BY n) - 1 = n AS used FROM files""")
def split_discovery(spark, d):
    number = F.substring("source", 4, 9).cast("bigint")
    number = F.when(number > 9, number + 1).otherwise(number)
    part = F.when(number == 0, F.lit("")).otherwise(number.cast("string"))
    path = F.concat(F.lit("corpus/train"), part, F.lit("."), F.col("lang"), F.lit("-en."), F.col("lang"))
    files = base.table(spark, d, "documents").select(path.alias("path")).distinct()
    return src.corpus_splits(files)


# Sources as numbered training files of the language pairs xx-en, the first one taken twice; what
# follows the gap after the tenth number is not read.
@query("s08_load_split", """WITH f AS (SELECT doc_id, lang, CASE WHEN s > 9 THEN s + 1 ELSE s END AS part, string_split(text, chr(10)) AS ls
  FROM (SELECT *, substr(source, 4)::BIGINT AS s FROM documents)),
u AS (SELECT lang, part, dense_rank() OVER (PARTITION BY lang ORDER BY part) - 1 = part AS used FROM (SELECT DISTINCT lang, part FROM f)),
l AS (SELECT f.lang, f.part, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM f JOIN u USING (lang, part) WHERE used),
r AS (SELECT l.*, rep FROM l, range(2) t(rep) WHERE rep = 0 OR part = 0)
SELECT lang, part, row_number() OVER (PARTITION BY lang ORDER BY part, rep, doc_id, line_no) - 1 AS position, line FROM r""")
def load_split(spark, d):
    folder = scratch_dir(spark, "corpus")
    number = F.substring("source", 4, 9).cast("bigint")
    number = F.when(number > 9, number + 1).otherwise(number)
    part = F.when(number == 0, F.lit("")).otherwise(number.cast("string"))
    name = F.concat(F.lit("train"), part, F.lit("."), F.col("lang"), F.lit("-en."), F.col("lang"))
    lines = base.doc_lines(spark, d, "source", "lang").select(name.alias("file"), "doc_id", "line_no", F.col("line").alias("value"))
    lines = lines.repartitionByRange("file", "doc_id", "line_no").sortWithinPartitions("file", "doc_id", "line_no")
    lines.select("file", "value").write.partitionBy("file").text(folder)
    out = None
    for r in src.find_splits(spark, folder).filter("used and part = 0").orderBy("lang").collect():
        rows = src.load_split(spark, folder, "train", r["src"], r["tgt"], r["lang"], upsample=2).withColumn("lang", F.lit(r["lang"]))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s09_raw_copy", f"""WITH {sql.LINES}
SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, line FROM lines""")
def raw_copy(spark, d):
    path = scratch_dir(spark, "raw")
    numbered = src.read_numbered(spark, _written_lines(spark, d))
    src.write_lines(numbered, path, F.col("line"), ["line_no"])
    return src.read_numbered(spark, path)


@query("s10_concatenate_files", f"""WITH {_PROPERTY_SQL},
alltext AS (SELECT line FROM plines UNION ALL SELECT line FROM (
  SELECT unnest(string_split(text, chr(10))) AS line FROM documents) UNION ALL SELECT text FROM benchmark),
s AS (SELECT regexp_replace(line, '^{sql.WHITE}+|{sql.WHITE}+$', '', 'g') AS line FROM alltext)
SELECT string_split(line, ',')[-1] AS value, count(*) AS cnt FROM s WHERE line <> '' GROUP BY 1""")
def concatenate_files(spark, d):
    frames = [
        _property_lines(spark, d),
        base.doc_lines(spark, d),
        base.table(spark, d, "benchmark").withColumnRenamed("text", "line"),
    ]
    return src.pick_field(frames).groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))


@query("s11_vector_text_source", """SELECT 'v' || vec_id AS token, i AS dim, embedding[i + 1]::DOUBLE AS value
FROM embeddings, range(64) r(i)""")
def vector_text_source(spark, d):
    path = scratch_dir(spark, "vectors")
    vectors = base.table(spark, d, "embeddings")
    size = vectors.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.size("embedding")).cast("string")).alias("line"))
    text = F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(" "), base.joined("embedding"))
    size.unionByName(vectors.select(text.alias("line"))).write.text(path)
    read = corpus.read_vectors(spark, path)
    return read.select("token", F.posexplode("vector").alias("dim", "value")).select(
        "token", F.col("dim").cast("bigint").alias("dim"), F.col("value").cast("double").alias("value")
    )


# Links i-i over the shorter side of each pair.
ALIGN_SQL = f"""{sql.PAIR_WORDS},
links AS (SELECT id, i AS src_pos, i AS tgt_pos, sw[i + 1] AS src, tw[i + 1] AS tgt
  FROM pw, unnest(range(least(len(sw), len(tw)))) u(i))"""


def alignment_lines(spark, d):
    p = base.pair_words(spark, d)
    shorter = F.least(F.size("sw"), F.size("tw"))
    links = F.when(shorter > 0, F.transform(F.sequence(F.lit(0), shorter - 1), lambda i: F.concat_ws("-", i.cast("string"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return p.withColumn("align", F.array_join(links, " "))


@query("s12_alignment_source", f"WITH {ALIGN_SQL} SELECT id, src_pos AS link, src_pos, tgt_pos FROM links")
def alignment_source(spark, d):
    parsed = corpus.parse_alignment(alignment_lines(spark, d), "align", ["id"])
    return parsed.withColumn("link", F.col("link").cast("bigint"))


@query("s12_alignment_dict_round_trip", f"""WITH {ALIGN_SQL},
cnt AS (SELECT src, tgt, count(*) AS c, min(id * 1048576 + src_pos) AS f FROM links GROUP BY src, tgt)
SELECT src, tgt FROM cnt QUALIFY row_number() OVER (PARTITION BY src ORDER BY c DESC, f) = 1""")
def alignment_dict_round_trip(spark, d):
    path = scratch_dir(spark, "align")
    corpus.write_align_dict(vb.alignment_dict(alignment_links(spark, d)), path)
    return corpus.read_align_dict(spark, path)


def alignment_links(spark, d):
    parsed = corpus.parse_alignment(alignment_lines(spark, d), "align", ["id", "sw", "tw"])
    return parsed.select(
        "id",
        F.get("sw", F.col("src_pos").cast("int")).alias("src"),
        F.get("tw", F.col("tgt_pos").cast("int")).alias("tgt"),
        vb.first_key((F.col("id"), 0), (F.col("link"), 31)).alias("first"),
    )


@query("s13_result_records", f"""WITH {sql.PAIRS}
SELECT id, 0::BIGINT AS ord, 'S-' || id || chr(9) || source AS record FROM pairs
UNION ALL SELECT id, 1::BIGINT, 'T-' || id || chr(9) || target FROM pairs
UNION ALL SELECT id, 2::BIGINT, 'H-' || id || chr(9) || length(target) || chr(9) || lower(target) FROM pairs""")
def result_records(spark, d):
    p = base.pairs(spark, d).withColumn("score", F.char_length("target")).withColumn("hyp", F.lower("target"))
    out = corpus.result_records(p, ["id"], {"S": ["source"], "T": ["target"], "H": ["score", "hyp"]})
    return out.withColumn("ord", F.col("ord").cast("bigint"))


@query("s14_aligner_input", """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, coalesce(u.text, '') || ' ||| ' || coalesce(a.text, '') AS line
FROM u FULL JOIN a USING (conv_id, turn)""")
def aligner_input(spark, d):
    turns = base.table(spark, d, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("line"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("line"))
    return src.aligner_input(user, reply, ["conv_id", "turn"])


@query("s15_decode_corpus", f"""WITH {sql.ENCODED}
SELECT w.doc_id, w.line_no, coalesce(string_agg(CASE WHEN token_id = 3 THEN '<unk>' ELSE token END, ' ' ORDER BY pos), '') AS text
{sql.BY_LINE}""")
def decode_corpus(spark, d):
    path = scratch_dir(spark, "encoded")
    vocab = base.doc_vocab(spark, d)
    lines = vb.encode_text(base.doc_lines(spark, d), "line", vocab)
    corpus.write_encoded(lines.select("doc_id", "line_no", "ids"), path)
    stored = corpus.read_encoded(spark, path)
    return vb.decode_rows(stored, "ids", vocab).select("doc_id", "line_no", "text")
