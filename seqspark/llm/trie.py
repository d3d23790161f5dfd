"""Conversation prefix trie by truncation peeling.

Every distinct sequence of first turns is a node. The levels are made from the deepest to the
root: the conversations that end at a depth join the nodes that survive from below, rows with
one path are merged, the merged rows are the nodes of the depth, and their paths lose the
last turn for the next round. Counts, leaves and savings are sums over that one regrouping, so
nodes are aggregated while they are found, with partial sums before each shuffle.

A path holds, per turn, a 128-bit digest chained over the turns so far and the bytes of text so
far (about 40 bytes a turn); texts are never shuffled. Equal conversations are one row before
the first round. What a conversation shares with no different one is a chain of nodes known
from its own row and is written at once, so the number of rounds follows the depth to which
different conversations are alike, not the longest conversation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import stored, table
from seqspark.operators.ordering import parallelism
from seqspark.session import scratch_dir

ROOT = b"\0" * 16
PATH = "array<struct<digest: binary, upto: bigint>>"
#: Conversations whose ids agree but for this many low bits are listed together.
LIST_BITS = 16


def ordered_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, turns)``: per conversation the digest and text bytes of its turns, in order.

    Null orders come first, ties go by role and digest; null roles and texts are empty. Rows
    without a key belong to no conversation and are left out.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)))
    item = F.struct(F.col(order).alias("at"), r.alias("role"), digest.alias("digest"), F.octet_length(t).cast("bigint").alias("bytes"))
    rows = turns.filter(F.col(key).isNotNull()).select(F.col(key).alias("conv_id"), item.alias("item"))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return packed.select("conv_id", F.transform("items", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("turns"))


def chained(conversations: DataFrame) -> DataFrame:
    """``(conv_id, path)``: digests of all turns so far and the bytes of text so far."""

    def run(batches):
        for batch in batches:
            turns = batch.column("turns")
            offsets = turns.offsets.to_numpy() - turns.offsets[0].as_py() if len(turns) else np.zeros(1, np.int32)
            flat = turns.flatten()
            digests, sizes = flat.field("digest").to_pylist(), flat.field("bytes").to_numpy()
            out, upto = [], np.zeros(len(digests), np.int64)
            for start, end in zip(offsets[:-1], offsets[1:]):
                last = ROOT
                for d in digests[start:end]:
                    last = hashlib.md5(last + d).digest()
                    out.append(last)
                upto[start:end] = np.cumsum(sizes[start:end])
            steps = pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(upto)], names=["digest", "upto"])
            path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), path], names=["conv_id", "path"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.select("conv_id", "turns").mapInArrow(run, f"conv_id {kind}, path {PATH}")


def _key(path, depth):
    """The digest of the node at a depth (0: the root) of a path."""
    return F.when(depth > 0, F.get(path, depth - 1)["digest"]).otherwise(F.lit(ROOT))


def _upto(path, depth):
    return F.when(depth > 0, F.get(path, depth - 1)["upto"]).otherwise(F.lit(0).cast("bigint"))


def ends(paths: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: per node the hash of the ids that end there, ascending.

    Ids are listed in ranges of at most 2**16 and a node's lists pass one by one through
    the hash, so that a node where very many conversations end needs no large list.
    """
    rows = paths.select(_key("path", F.size("path")).alias("key"), "conv_id")
    rows = rows.groupBy("key", F.shiftright("conv_id", LIST_BITS).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    rows = rows.select("key", "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    rows = rows.repartition(parallelism(rows), "key").sortWithinPartitions("key", "range")

    def run(batches):
        last, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == last:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        done.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
            yield found(done)
        if state:
            yield found([(last, state.hexdigest())])

    def found(done):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in ((0, pa.binary()), (1, pa.string()))], names=["key", "ends_sha256"])

    return rows.mapInArrow(run, "key binary, ends_sha256 string")


def _starts(paths: DataFrame) -> DataFrame:
    """Distinct conversations with the depth ``cut`` from which peeling starts: the least power
    of two to which no different conversation agrees with it, or else its end."""
    same = paths.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).withColumn("len", F.size("path"))
    same = stored(same.withColumn("key", _key("path", F.col("len"))), "conversations")
    powers = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda k: k <= F.col("len"))
    probes = same.select("key", F.explode(F.transform(powers, lambda k: F.struct(k.alias("k"), F.get("path", k - 1)["digest"].alias("at")))).alias("p"))
    alone = probes.groupBy("p.at").agg(F.count("*").alias("c"), F.min("p.k").alias("k"), F.min("key").alias("key")).filter("c = 1")
    cuts = alone.groupBy("key").agg(F.min("k").alias("cut"))
    return same.join(cuts, "key", "left").withColumn("cut", F.coalesce("cut", "len"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations(conv_id, turns)`` with unique integer ids.

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (text bytes of turns that
    need not be repeated in the subtree), ``ends_sha256``. Conversations without turns are
    members of the root; no conversations give no nodes. Turns are equal if their digests are.
    """
    spark = conversations.sparkSession
    paths = stored(chained(conversations), "paths")
    starts = stored(_starts(paths), "starts")
    total, cut = _upto("path", F.col("len")), F.col("cut")
    spare = F.col("n") - 1
    deeper = (F.col("len") > cut).cast("bigint")
    entering = starts.select(
        F.slice("path", F.lit(1), cut).alias("path"), cut.alias("p"), "conv_id", F.col("n").alias("n_convs"), deeper.alias("children"),
        deeper.alias("leaves"), (spare * (total - _upto("path", cut))).alias("saved"),
    )
    folder = scratch_dir(spark, "entering")
    entering.write.partitionBy("p").parquet(folder)
    entering = spark.read.schema(entering.schema).parquet(folder)
    deepest = starts.agg(F.max("cut")).first()[0]
    tails = starts.filter(F.col("len") > cut).select("conv_id", "n", F.col("len"), F.explode(F.transform(
        F.sequence(cut + 1, F.col("len")),
        lambda i: F.struct(i.alias("depth"), _key("path", i).alias("key"), _key("path", i - 1).alias("parent"), (spare * (total - _upto("path", i - 1))).alias("saved")),
    )).alias("t"))
    one = F.lit(1).cast("bigint")
    tails = tails.select(
        "t.key", "t.parent", "conv_id", F.col("n").alias("n_convs"), (F.col("t.depth") < F.col("len")).cast("bigint").alias("n_children"),
        one.alias("n_leaves"), F.col("t.saved").alias("saved_tokens"), F.col("t.depth").cast("bigint").alias("depth"),
    )
    levels, above = scratch_dir(spark, "levels"), None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        rows = entering.filter(F.col("p") == depth).drop("p")
        rows = rows if above is None else rows.unionByName(above)
        nodes = rows.groupBy("path").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("children").alias("n_children"),
            F.greatest(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("_below"),
        )
        at = F.size("path")  # the depth, without a constant that would compile each round anew
        own = (F.col("n_convs") - 1) * (_upto("path", at) - _upto("path", at - 1))
        nodes = nodes.select(
            _key("path", at).alias("key"), F.when(at > 0, _key("path", at - 1)).alias("parent"), "conv_id", "n_convs",
            "n_children", "n_leaves", (F.col("_below") + own).alias("saved_tokens"), at.cast("bigint").alias("depth"), "path",
        )
        place = f"{levels}/{depth}"
        nodes.write.parquet(place)
        nodes = spark.read.schema(nodes.schema).parquet(place)
        above = nodes.select(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("path"), "conv_id", "n_convs", one.alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    if deepest is not None:
        tails = spark.read.schema(nodes.schema).parquet(*[f"{levels}/{d}" for d in range(deepest + 1)]).drop("path").unionByName(tails)
    trie = stored(tails, "nodes")
    over = trie.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = trie.join(over, "parent", "left").join(ends(paths), "key", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation c opens with the first h turns of c - c % 5 in place of its own first
    h, h being crc32 of the decimal id mod 9; at most eight turns come from elsewhere."""
    heads = conversations.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 8).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    rows = conversations.withColumn("_h", h).join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("_base"), "left")
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def op13_truncation_peeling(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie(rebuilt(stored(ordered_turns(turns), "turns")))


SQL = r"""
WITH o AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''),
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, w, xor(list_reduce([4294967295::BIGINT] || flatten([[ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295::BIGINT) % 9 AS h FROM o),
r AS (SELECT a.conv_id, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS depth FROM r),
q AS (SELECT conv_id, depth, w[1:depth] AS k, depth = len(w) AS done FROM p),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (done), '')) AS ends_sha256 FROM q GROUP BY depth, k),
c AS (SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.k[n.depth].t) END AS own
    FROM n LEFT JOIN c ON c.depth = n.depth AND c.k = n.k),
u AS (SELECT k, own, n_children, unnest(range(0, depth + 1)) AS depth FROM m),
s AS (SELECT depth, k[1:depth] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM u GROUP BY 1, 2)
SELECT m.conv_id, m.depth, e.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s ON s.depth = m.depth AND s.k = m.k LEFT JOIN n e ON e.depth = m.depth - 1 AND e.k = m.k[1:m.depth - 1]
"""
