"""Sorting, filtering and batching queries (B1-B15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import arrays as ar, text as tx
from seqspark.functions.hashing import base as hash_base
from seqspark.operators import batching as bt, examples as ex
from seqspark.plans import base, sql
from seqspark.plans.base import joined, query
from seqspark.plans.examples import PAIR_IDS, pair_ids
from seqspark.session import one_row

SEED = 23
MAX_TOKENS, MAX_SENTENCES, MULTIPLE = 3000, 16, 8

_SIZES = f"""{sql.PAIR_WORDS},
sz AS (SELECT id, conv_id, len(sw) + 1 AS src_size, len(tw) + 1 AS tgt_size, {sql.base(SEED, 'id')} AS h FROM pw)"""


def pair_sizes(spark, d):
    p = base.pair_words(spark, d)
    return p.select("id", "conv_id", (F.size("sw") + 1).cast("bigint").alias("src_size"), (F.size("tw") + 1).cast("bigint").alias("tgt_size"))


@query("b01_sample_sizes", f"""WITH {_SIZES}
SELECT id, src_size, tgt_size, greatest(src_size, tgt_size) AS num_tokens FROM sz""")
def sample_sizes(spark, d):
    p = pair_sizes(spark, d)
    return p.select("id", "src_size", "tgt_size", F.greatest("src_size", "tgt_size").alias("num_tokens"))


@query("b02_length_order", f"""WITH {_SIZES}
SELECT id, src_size, tgt_size, row_number() OVER (ORDER BY src_size, tgt_size, h, id) - 1 AS rank FROM sz""")
def length_order(spark, d):
    return bt.length_order(pair_sizes(spark, d).drop("conv_id"), "src_size", "tgt_size", SEED, ["id"])


@query("b03_size_filter", f"""WITH {_SIZES}
SELECT id, src_size <= 40 AS scalar_ok, src_size <= 60 AS pair_ok, src_size <= 80 AND tgt_size <= 200 AS keyed_ok FROM sz""")
def size_filter(spark, d):
    s, t = F.col("src_size"), F.col("tgt_size")
    return pair_sizes(spark, d).select(
        "id",
        bt.fits(s, 40).alias("scalar_ok"),
        bt.fits((s, t), (60, None)).alias("pair_ok"),
        bt.fits({"a": s, "b": (s, t)}, {"a": 80, "b": (None, 200), "c": 1}).alias("keyed_ok"),
    )


@query("b03_ignored_report", f"""WITH {_SIZES},
i AS (SELECT id FROM sz WHERE src_size > 40 OR tgt_size > 200)
SELECT count(*) AS n_ignored, (SELECT string_agg(id::VARCHAR, ' ' ORDER BY id) FROM (SELECT id FROM i ORDER BY id LIMIT 10)) AS first_ids FROM i""")
def ignored_report(spark, d):
    s, t = F.col("src_size"), F.col("tgt_size")
    _, ignored = bt.filter_by_size(pair_sizes(spark, d), (s, t), (40, 200))
    return bt.ignored_report(ignored, "id")


# Limits of a conversation: its longest source and target; every third names no source limit.
@query("b04_resolve_limits", f"""WITH {_SIZES},
l AS (SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN max(src_size) END AS max_src, max(tgt_size) AS max_tgt FROM sz GROUP BY conv_id)
SELECT conv_id, least(max_src, 120) AS max_src, least(max_tgt, 300) AS max_tgt,
  min(max_src) OVER () AS all_src, min(max_tgt) OVER () AS all_tgt FROM l""")
def resolve_limits(spark, d):
    per = pair_sizes(spark, d).groupBy("conv_id").agg(
        F.max(F.when(F.col("conv_id") % 3 != 0, F.col("src_size"))).alias("max_src"), F.max("tgt_size").alias("max_tgt")
    )
    least = one_row(per.agg(F.min("max_src").alias("all_src"), F.min("max_tgt").alias("all_tgt")))
    own = bt.resolve_limits((120, None), (None, 300), 500)
    return per.select(
        "conv_id", F.least("max_src", F.lit(own[0])).alias("max_src"), F.least("max_tgt", F.lit(own[1])).alias("max_tgt"),
        least["all_src"].alias("all_src"), least["all_tgt"].alias("all_tgt"),
    )


def _greedy_sql(multiple: int) -> str:
    """The greedy, one sample per step, with the lengths of the open batch as a list."""
    return f"""WITH RECURSIVE {_SIZES},
o AS MATERIALIZED (SELECT id, greatest(src_size, tgt_size) AS m, row_number() OVER (ORDER BY src_size, tgt_size, h, id) - 1 AS rank FROM sz),
w AS (SELECT 0::BIGINT AS nxt, []::BIGINT[] AS lens, 0::BIGINT AS first_rank, 0::BIGINT AS batch_id
  UNION ALL SELECT nxt + 1,
    CASE WHEN full_ THEN list_slice(lens, cut + 1, len(lens)) || [m] ELSE lens || [m] END,
    CASE WHEN full_ THEN first_rank + cut ELSE first_rank END,
    CASE WHEN full_ THEN batch_id + 1 ELSE batch_id END
  FROM (SELECT w.*, o.m, len(lens) > 0 AND (len(lens) = {MAX_SENTENCES} OR
      (len(lens) + 1) * greatest(o.m, coalesce(list_max(lens), 0)) > {MAX_TOKENS}) AS full_,
      greatest({multiple} * (len(lens) // {multiple}), len(lens) % {multiple}) AS cut
    FROM w JOIN o ON o.rank = w.nxt)),
starts AS (SELECT batch_id, min(first_rank) AS first_rank FROM w GROUP BY batch_id)
SELECT o.id, o.rank, s.batch_id FROM o ASOF JOIN starts s ON o.rank >= s.first_rank"""


def _batched(spark, d, multiple):
    p = pair_sizes(spark, d).withColumn("h", bt.length_key(SEED, "id"))
    out = bt.batch_by_size(
        p, ["src_size", "tgt_size"], ["h", "id"], F.greatest("src_size", "tgt_size"), MAX_TOKENS, MAX_SENTENCES, multiple
    )
    return out.select("id", "rank", "batch_id")


@query("b05_token_budget_batches", _greedy_sql(1))
def token_budget_batches(spark, d):
    return _batched(spark, d, 1)


@query("b05_batch_multiple", _greedy_sql(MULTIPLE))
def batch_multiple(spark, d):
    return _batched(spark, d, MULTIPLE)


def _in_order_sql(samples: str, max_tokens: int, max_sentences: int, multiple: int) -> str:
    """The greedy over ``o(id, m, rank)``, one sample per step."""
    return f"""WITH RECURSIVE {samples},
w AS (SELECT 0::BIGINT AS nxt, []::BIGINT[] AS lens, 0::BIGINT AS first_rank, 0::BIGINT AS batch_id
  UNION ALL SELECT nxt + 1,
    CASE WHEN full_ THEN list_slice(lens, cut + 1, len(lens)) || [m] ELSE lens || [m] END,
    CASE WHEN full_ THEN first_rank + cut ELSE first_rank END,
    CASE WHEN full_ THEN batch_id + 1 ELSE batch_id END
  FROM (SELECT w.*, o.m, len(lens) > 0 AND (len(lens) = {max_sentences} OR
      (len(lens) + 1) * greatest(o.m, coalesce(list_max(lens), 0)) > {max_tokens}) AS full_,
      greatest({multiple} * (len(lens) // {multiple}), len(lens) % {multiple}) AS cut
    FROM w JOIN o ON o.rank = w.nxt)),
starts AS (SELECT batch_id, min(first_rank) AS first_rank FROM w GROUP BY batch_id)
SELECT o.id, o.m AS num_tokens, o.rank, s.batch_id FROM o ASOF JOIN starts s ON o.rank >= s.first_rank"""


# Documents in file order, not sorted by length.
@query("b05_file_order_batches", _in_order_sql(f"""ds AS (SELECT doc_id AS id, len({sql.words('text')})::BIGINT + 1 AS m FROM documents),
o AS MATERIALIZED (SELECT id, m, row_number() OVER (ORDER BY id) - 1 AS rank FROM ds)""", 8000, 24, MULTIPLE))
def file_order_batches(spark, d):
    docs = base.documents(spark, d).select(F.col("doc_id").alias("id"), (F.size(tx.words(F.col("text"))) + 1).cast("bigint").alias("num_tokens"))
    return bt.batch_in_order(docs, ["id"], F.col("num_tokens"), 8000, 24, MULTIPLE)


# Steps of the round robin over languages in their order; a step is as long as its longest text.
@query("b05_round_robin_batches", _in_order_sql("""k AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rk,
  count(*) OVER (PARTITION BY lang) AS n FROM documents),
g AS (SELECT i AS step FROM range((SELECT max(n) FROM k)) r(i)),
z AS (SELECT step, max(n_chars) AS m FROM g JOIN k ON step % n = rk GROUP BY step),
o AS MATERIALIZED (SELECT step AS id, m, row_number() OVER (ORDER BY step) - 1 AS rank FROM z)""", 40000, 1000, 1))
def round_robin_batches(spark, d):
    docs = base.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    steps = ex.round_robin(docs, "lang", ["doc_id"]).groupBy(F.col("step").alias("id")).agg(F.max("n_chars").alias("num_tokens"))
    return bt.batch_in_order(steps, ["id"], F.col("num_tokens"), 40000, 1000)


# Documents in batches of eight, in length order.
_DOC_BATCHES = f"""ds AS (SELECT doc_id, len({sql.words('text')}) + 1 AS size, {sql.base(SEED, 'doc_id')} AS h FROM documents),
db AS (SELECT doc_id, size, (row_number() OVER (ORDER BY size, h, doc_id) - 1) // 8 AS batch_id FROM ds)"""


def doc_batches(spark, d):
    docs = base.documents(spark, d).select("doc_id", (F.size(tx.words(F.col("text"))) + 1).cast("bigint").alias("size"))
    docs = docs.withColumn("h", bt.length_key(SEED, "doc_id"))
    return bt.batch_by_size(docs, ["size"], ["h", "doc_id"], F.col("size"), max_sentences=8)


@query("b05_sentence_batches", f"WITH {_DOC_BATCHES} SELECT doc_id, size, batch_id FROM db")
def sentence_batches(spark, d):
    return doc_batches(spark, d).select("doc_id", "size", "batch_id")


_EPOCH = f"""{_DOC_BATCHES},
b AS (SELECT DISTINCT batch_id FROM db),
e AS (SELECT batch_id, row_number() OVER (ORDER BY h, batch_id) - 1 AS position FROM (
  SELECT batch_id, {sql.base(SEED + 2, 'batch_id')} AS h FROM b)),
n AS (SELECT count(*) AS n FROM b),
sh AS (SELECT batch_id, position % 7 AS shard, position // 7 AS step FROM e
  UNION ALL SELECT NULL, i, n // 7 FROM n, range(7) r(i) WHERE n % 7 > 0 AND i >= n % 7)"""


def epoch_batches(spark, d):
    return bt.epoch_order(doc_batches(spark, d).select("batch_id").distinct(), SEED, 2)


@query("b06_epoch_shuffle", f"WITH {_EPOCH} SELECT batch_id, position FROM e")
def epoch_shuffle(spark, d):
    return epoch_batches(spark, d)


@query("b07_shards", f"WITH {_EPOCH} SELECT coalesce(batch_id, -1) AS batch_id, shard, step FROM sh")
def shards(spark, d):
    s = bt.shard(epoch_batches(spark, d), 7)
    return s.withColumn("batch_id", F.coalesce("batch_id", F.lit(-1)).cast("bigint"))


@query("b08_step_groups", f"""WITH {_EPOCH}
SELECT shard, step // 3 AS "group", string_agg(coalesce(batch_id, -1)::VARCHAR, ' ' ORDER BY step) AS batches FROM sh GROUP BY 1, 2""")
def step_groups(spark, d):
    g = bt.grouped_steps(bt.shard(epoch_batches(spark, d), 7), 3)
    ids = F.transform("batches", lambda b: F.coalesce(b, F.lit(-1)).cast("string"))
    return g.select("shard", "group", F.array_join(ids, " ").alias("batches"))


@query("b09_resume_epoch", f"WITH {_EPOCH} SELECT coalesce(batch_id, -1) AS batch_id, shard, step FROM sh WHERE step >= 2")
def resume_epoch(spark, d):
    rest = bt.resume(bt.shard(epoch_batches(spark, d), 7), 2)
    return rest.withColumn("batch_id", F.coalesce("batch_id", F.lit(-1)).cast("bigint"))


# Pairs with end marks in batches of four; padded matrices, one row per sample.
_MATRIX = f"""{PAIR_IDS},
pb AS (SELECT id, ns + 1 AS ns, nt + 1 AS nt, source || ' 2' AS source, target || ' 2' AS target, '2 ' || target AS prev,
  (row_number() OVER (ORDER BY ns, nt, {sql.base(SEED, 'id')}, id) - 1) // 4 AS batch_id FROM pe),
mx AS (SELECT *, max(ns) OVER w AS ws, max(nt) OVER w AS wt FROM pb WINDOW w AS (PARTITION BY batch_id)),
pm AS (SELECT id, batch_id, ns, nt, repeat('1 ', (ws - ns)::INT) || source AS source, target || repeat(' 1', (wt - nt)::INT) AS target,
  prev || repeat(' 1', (wt - nt)::INT) AS prev,
  row_number() OVER (PARTITION BY batch_id ORDER BY ns DESC, id) - 1 AS row FROM mx)"""


def batched_pairs(spark, d):
    p = pair_ids(spark, d)
    p = p.withColumns({c: ar.append_eos(F.col(c)) for c in ("source", "target")})
    p = p.withColumns({"ns": F.col("ns") + 1, "nt": F.col("nt") + 1, "h": bt.length_key(SEED, "id")})
    return bt.batch_by_size(p, ["ns", "nt"], ["h", "id"], F.greatest("ns", "nt"), max_sentences=4)


def matrices(spark, d):
    return bt.collate(batched_pairs(spark, d), "source", "target")


def matrix_rows(spark, d):
    m = matrices(spark, d)
    z = F.arrays_zip("ids", "src_tokens", "src_lengths", "target", "prev_output_tokens")
    rows = m.select("batch_id", "nsentences", "ntokens", F.posexplode(z).alias("row", "z"))
    return rows.select("batch_id", "nsentences", "ntokens", F.col("row").cast("bigint").alias("row"), "z.*").withColumnRenamed("ids", "id")


@query("b10_collate", f"""WITH {_MATRIX}
SELECT batch_id, row, id, ns AS src_length, source, target, count(*) OVER w AS nsentences, sum(nt) OVER w::BIGINT AS ntokens
FROM pm WINDOW w AS (PARTITION BY batch_id)""".replace("sum(nt) OVER w::BIGINT", "(sum(nt) OVER w)::BIGINT"))
def collate(spark, d):
    r = matrix_rows(spark, d)
    return r.select(
        "batch_id", "row", "id", F.col("src_lengths").cast("bigint").alias("src_length"),
        joined("src_tokens").alias("source"), joined("target").alias("target"), "nsentences", "ntokens",
    )


# Two targets from one column, a masked form and properties with their missing flags.
@query("b10_collate_fields", f"""WITH {_MATRIX}
SELECT batch_id, row, id, ns AS length, source, target AS future, prev AS past,
  repeat('1 ', (len(string_split(source, ' ')) - ns)::INT)
    || array_to_string(list_transform(string_split(own, ' '), lambda x, i: CASE WHEN i % 3 = 1 THEN x ELSE '1' END), ' ') AS masked,
  ns || ' ' || CASE WHEN nt > 8 THEN 0 ELSE nt END AS props, '0 ' || (nt > 8)::INT AS missing
FROM pm JOIN (SELECT id, source AS own FROM pb) o USING (id)""")
def collate_fields(spark, d):
    absent = F.col("nt") > 8
    b = batched_pairs(spark, d).withColumns({
        "masked": F.transform("source", lambda x, i: F.when(i % 3 == 0, x).otherwise(1).cast("int")),
        "props": F.array("ns", F.when(absent, 0).otherwise(F.col("nt"))),
        "missing": F.array(F.lit(0), absent.cast("int")),
    })
    fields = {
        "source": bt.Field("source", left=True), "future": bt.Field("target"), "past": bt.Field("target", shift=True),
        "masked": bt.Field("masked", left=True), "props": bt.Field("props", pad=None), "missing": bt.Field("missing", pad=None),
    }
    rows = bt.collate_fields(b, fields, by="source").select("batch_id", F.posexplode(F.arrays_zip("ids", "lengths", *fields)).alias("row", "z"))
    rows = rows.select("batch_id", F.col("row").cast("bigint").alias("row"), "z.*")
    return rows.select("batch_id", "row", F.col("ids").alias("id"), F.col("lengths").alias("length"), *[joined(f).alias(f) for f in fields])


@query("b11_teacher_forcing", f"WITH {_MATRIX} SELECT batch_id, row, prev FROM pm")
def teacher_forcing(spark, d):
    return matrix_rows(spark, d).select("batch_id", "row", joined("prev_output_tokens").alias("prev"))


@query("b12_flip_padding", f"""WITH {_MATRIX}
SELECT id, ltrim(regexp_replace(source, '^(1 )+', '') || repeat(' 1', (len(string_split(source, ' ')) - ns)::INT)) AS source,
  repeat('1 ', (len(string_split(target, ' ')) - nt)::INT) || regexp_replace(target, '( 1)+$', '') AS target FROM pm""")
def flip_padding(spark, d):
    r = matrix_rows(spark, d)
    flipped = {"source": ar.flip_padding(F.col("src_tokens"), to_left=False), "target": ar.flip_padding(F.col("target"), to_left=True)}
    return r.select("id", *[F.array_join(c.cast("array<string>"), " ").alias(n) for n, c in flipped.items()])


@query("b13_position_ids", f"""WITH {_MATRIX}
SELECT id, array_to_string(list_transform(range(len(string_split(source, ' '))), lambda i: greatest(1, i - len(string_split(source, ' ')) + ns + 2)), ' ') AS source,
  array_to_string(list_transform(range(len(string_split(target, ' '))), lambda i: CASE WHEN i < nt THEN i + 2 ELSE 1 END), ' ') AS target FROM pm""")
def position_ids(spark, d):
    r = matrix_rows(spark, d)
    found = {"source": ar.position_ids(F.col("src_tokens")), "target": ar.position_ids(F.col("target"))}
    return r.select("id", *[F.array_join(c.cast("array<string>"), " ").alias(n) for n, c in found.items()])


@query("b14_strip_padding", f"WITH {_MATRIX} SELECT id, source, target FROM pb")
def strip_padding(spark, d):
    r = matrix_rows(spark, d)
    found = {"source": ar.strip_pad(F.col("src_tokens")), "target": ar.strip_pad(F.col("target"))}
    return r.select("id", *[F.array_join(c.cast("array<string>"), " ").alias(n) for n, c in found.items()])


@query("b15_batch_accounting", f"""WITH {_SIZES},
b AS (SELECT *, (row_number() OVER (ORDER BY src_size, tgt_size, h, id) - 1) // 16 AS batch_id FROM sz)
SELECT batch_id, count(*) AS nsentences, sum(tgt_size)::BIGINT AS ntokens, sum(tgt_size)::BIGINT AS sample_size,
  round(1 - sum(src_size) / (max(src_size) * count(*))::DOUBLE, 6) AS waste FROM b GROUP BY batch_id""")
def batch_accounting(spark, d):
    p = pair_sizes(spark, d).withColumn("h", bt.length_key(SEED, "id"))
    b = bt.batch_by_size(p, ["src_size", "tgt_size"], ["h", "id"], F.greatest("src_size", "tgt_size"), max_sentences=16)
    return bt.accounting(b, "src_size", "tgt_size")
