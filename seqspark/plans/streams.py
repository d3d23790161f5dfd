"""Streaming queries (R1-R2): drained with the batch result as the expectation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import arrays as ar
from seqspark.operators import batching as bt, vocab as vb
from seqspark.plans import base, sql
from seqspark.plans.base import joined, query
from seqspark.session import scratch_dir
from seqspark.streaming import stream as st


@query("r01_buffered_lines", f"""WITH {sql.ENCODED}
SELECT w.doc_id, w.line_no, count(token_id) + 1 AS size, concat_ws(' ', string_agg(token_id::VARCHAR, ' ' ORDER BY pos), '2') AS ids
{sql.BY_LINE} HAVING count(token_id) + 1 <= 100""")
def buffered_lines(spark, d):
    vocab = base.doc_vocab(spark, d).select("token_id", "token")
    path = scratch_dir(spark, "vocab")
    vocab.write.parquet(path)
    inbox, out = scratch_dir(spark, "inbox"), scratch_dir(spark, "replies")
    base.doc_lines(spark, d).write.parquet(inbox)
    table = spark.read.parquet(path)

    lookup = vb.shipped(table)  # one broadcast for all micro-batches

    def process(batch):
        ids = vb.encode_text(batch, "line", table, lookup=lookup).withColumn("ids", ar.append_eos(F.col("ids")))
        kept, _ = bt.filter_by_size(ids.withColumn("size", F.size("ids").cast("bigint")), F.col("size"), 100)
        return kept.select("doc_id", "line_no", "size", joined("ids").alias("ids"))

    # A few files for every core: each micro-batch is worked on by all of them.
    files = 4 * spark.sparkContext.defaultParallelism
    lines = st.line_stream(spark, inbox, "doc_id bigint, line_no bigint, line string", files)
    st.process_in_order(lines, process, ["doc_id", "line_no"], out, scratch_dir(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("r02_running_meters", """SELECT event_type, sum(round(value * 100)::BIGINT)::BIGINT AS sum, count(*) AS count FROM events GROUP BY event_type""")
def running_meters(spark, d):
    schema = base.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    cents = events.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    out = scratch_dir(spark, "meters")
    st.latest(st.running_meters(cents, ["event_type"], "cents"), out, scratch_dir(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)
