"""SimHash near-duplicates by anchor-point covering.

The 64 bits are split into ``blocks``; two fingerprints within ``distance`` differ in at most
``distance // blocks`` bits of some block. Per block the anchors are the words of a covering
code of radius 1: a Hamming code on the first 2**r - 1 bits of the block times all values of
its remaining bits. A fingerprint is copied to every anchor within that radius plus the
block's threshold. The anchor nearest to one fingerprint is then within reach of every
partner, so each linked pair meets at an anchor and is compared there by all 64 bits.

Only distinct fingerprints take part. Anchors with more than ``TILE`` of them are cut into
chunks whose pairs are compared in separate groups. A comparing task keeps of its links a
forest, which has the same components.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from seqspark.llm.common import lean, slices, stored, table
from seqspark.llm.components import components
from seqspark.operators.ordering import parallelism

WORDS, DISTANCE, SEED = 4, 4, 42
CHUNK = 1 << 20
TILE = 1024
#: Keys of crowded anchors are broadcast up to this many rows (16 bytes each), else joined.
BROADCAST_ROWS = 500_000
PENDING = 1 << 20


def _bit_sums(words: list[bytes], k: int) -> tuple[np.ndarray, int]:
    """Per bit, how many shingle hashes have it set, and the number of shingles."""
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())), "<u8", len(starts))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64), len(starts)


def fingerprint(text: str, k: int = WORDS) -> int:
    """64 majority bits of the ``k``-word shingles; A-Z lower-cased, ASCII blanks split."""
    data = text.encode().lower()
    sums, shingles, carry, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in b"\t\n\x0b\x0c\r ":
            end += 1
        words = carry + data[at:end].split()
        at = end
        if len(words) >= k:
            more, n = _bit_sums(words, k)
            sums, shingles, words = sums + more, shingles + n, words[len(words) - k + 1 :]
        carry = words
    if not shingles:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int.from_bytes(np.packbits(2 * sums > shingles, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str, text: str, k: int = WORDS) -> DataFrame:
    """``(key, fp bigint)``, the fingerprint as a signed number; null text: 0."""
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                found = np.array([fingerprint(t or "", k) for t in part.column("_text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(found.view(np.int64))], names=[key, "fp"])

    return source.mapInArrow(run, f"`{key}` {kind}, fp bigint")


@dataclass(frozen=True)
class CoveringCode:
    """Anchors of one block of ``bits`` bits: Hamming code of order ``r``, rest free."""

    bits: int
    r: int

    def syndromes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for i in range(min(self.bits, 2**self.r - 1)):
            out ^= ((values >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
        return out

    def patterns(self, reach: int) -> list[np.ndarray]:
        """Per syndrome the differences, of at most ``reach`` bits, that lead to an anchor."""
        masks = np.array([sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(self.bits), n)], np.uint64)
        syndrome = self.syndromes(masks)
        return [masks[syndrome == s] for s in range(2**self.r)]


def block_codes(blocks: int, r: int) -> list[tuple[int, CoveringCode]]:
    """``(first bit, code)`` of each block of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    for lo, hi in zip(edges, edges[1:]):
        if hi - lo < 2**r - 1:
            raise ValueError(f"a block of {hi - lo} bits has no room for a code of {2**r - 1}")
    return [(lo, CoveringCode(hi - lo, r)) for lo, hi in zip(edges, edges[1:])]


def anchors(prints: DataFrame, distance: int, blocks: int, r: int) -> DataFrame:
    """``(anchor, fp)``: every fingerprint at every anchor within reach."""
    reach = 1 + distance // blocks
    codes = [(lo, c, c.patterns(reach)) for lo, c in block_codes(blocks, r)]

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for number, (lo, code, patterns) in enumerate(codes):
                value = (fp >> np.uint64(lo)) & np.uint64((1 << code.bits) - 1)
                syndrome = code.syndromes(value)
                for s in np.unique(syndrome):
                    pick = syndrome == s
                    at = (value[pick][:, None] ^ patterns[s][None, :]) | np.uint64(number << 56)
                    copies = np.repeat(fp[pick], len(patterns[s]))
                    yield pa.RecordBatch.from_arrays([pa.array(at.ravel().view(np.int64)), pa.array(copies.view(np.int64))], names=["anchor", "fp"])

    return prints.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest of its component, for links ``a - b``."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _close_pairs(group: np.ndarray, fp: np.ndarray, distance: int):
    """Links among rows of equal group (groups are contiguous), as a forest."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, step = np.arange(len(fp)), 0
    found, waiting = [], 0
    while len(first):
        step += 1
        first = first[first + step < len(fp)]
        first = first[group[first] == group[first + step]]
        near = first[np.bitwise_count(fp[first] ^ fp[first + step]) <= distance]
        found.append((near, near + step))
        waiting += len(near)
        if waiting > PENDING or not len(first):
            a, b = forest(np.concatenate([a, *[fp[i].view(np.int64) for i, _ in found]]), np.concatenate([b, *[fp[j].view(np.int64) for _, j in found]]))
            found, waiting = [], 0
    return a, b


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """Rows dealt and sorted by ``anchor`` and ``cell``; the others follow.

    An anchor with at most ``tile`` rows is one cell; a crowded one is cut into chunks by
    hash, and each pair of chunks is a cell of at most about twice ``tile`` rows.
    """
    crowded = stored(rows.groupBy("anchor").count().filter(F.col("count") > tile), "crowded")
    small = crowded.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(crowded) if small else crowded, "anchor", "left")
    rest = [c for c in rows.columns if c not in ("anchor", "count")]
    chunks = F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(*rest), F.col("_n")).cast("int")
    rows = rows.withColumn("_n", chunks).withColumn("_c", own)
    rows = rows.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cell = (F.least("_c", "_d") * F.col("_n") + F.greatest("_c", "_d")).cast("bigint")
    rows = rows.select("anchor", cell.alias("cell"), *rest)
    return rows.repartition(parallelism(rows), "anchor", "cell").sortWithinPartitions("anchor", "cell")


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = 3, r: int = 4, tile: int = TILE) -> DataFrame:
    """``(a, b)``: a forest over the distinct fingerprints within ``distance``.

    Its components are those of all links. ``blocks`` and ``r`` set the code: 3 blocks of
    21 or 22 bits with 2**17 anchors or more each and about 45 copies a fingerprint; more
    anchors (2 blocks, r = 5) cost more copies and fewer comparisons.
    """
    rows = anchors(prints, distance, blocks, r)
    rows = tiled(rows, tile)

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            cols = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            cut = change[-1] if len(change) else 0
            rest = [c[cut:] for c in cols]
            yield from compared([c[:cut] for c in cols])
        yield from compared(rest)

    def compared(cols):
        if len(cols[0]) > 1:
            group = np.concatenate([[0], np.cumsum((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))])
            a, b = _close_pairs(group, cols[2].view(np.uint64), distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, key: str, text: str, k: int = WORDS, distance: int = DISTANCE, blocks: int = 3, r: int = 4) -> DataFrame:
    """``key``, ``fingerprint`` (hex) and ``component_id``, the smallest key reachable.

    Null and empty texts and texts without words have fingerprint zero and are linked like
    any other. Equal fingerprints are one node, so copies cost nothing beyond their row. A
    null key keeps its row; it is nobody's smallest key unless the whole component is null.
    """
    docs = stored(fingerprints(df, key, text, k), "fingerprints")
    prints = stored(docs.groupBy("fp").agg(F.min(key).alias("_first")), "prints")
    linked = components(links(prints, distance, blocks, r)).select(F.col("node").alias("fp"), "root")
    rooted = prints.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return docs.join(named, "fp").select(key, hexed.alias("fingerprint"), "component_id")


def op4_simhash_anchors(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


# Near-duplicates by exact shingle similarity. Two texts that share 80 % of their five-word
# shingles share one of the first 20 % (and one more) of each, in any order common to all
# texts: the prefix join below misses no pair. Its order takes rare shingles first, so few rows
# meet. SimHash fingerprints over distinct words are searched before by anchors; they join
# most members of a large group of near copies, whose pairs the prefix join then leaves out.

TABLES = 8
#: Of the pairs that meet at an anchor, the links each row reports besides the forest. What
#: fails among them is found by the prefix join.
NEIGHBOURS = 1
#: Shingles with a place of their own in the order, and the count from which a shingle has one.
FREQUENT, OFTEN = 1 << 18, 4
#: Up to so many rows with a common shingle are paired at once (at most 3.5 pairs a row), more in
#: tiles, where the groups found so far are known and their pairs are not made again.
LIGHT = 8
#: Shingles of texts that a task holds before it reports those found more than once.
HELD = 1 << 22
#: Texts that a task remembers as sent; beyond that it may send an equal text again.
REMEMBERED = 1 << 17
MARK = 1024


def word_prints(text: str, tables: int = TABLES) -> np.ndarray:
    """``tables`` SimHash fingerprints of the distinct lower-cased words (no words: zeros)."""
    words = set(text.lower().split())
    if not words:
        return np.zeros(tables, np.int64)
    base = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    out = np.zeros((tables, 8), np.uint8)
    for t in range(tables):
        x = (base ^ np.uint64(0x9E3779B97F4A7C15 * (t + 1) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        bits = np.unpackbits((x ^ (x >> np.uint64(33))).view(np.uint8).reshape(-1, 8), axis=1)
        out[t] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(words))
    return out.view(np.int64).ravel()


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles; a shorter text is one shingle."""
    words = text.lower().split()
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p) for p in parts), np.uint64, len(parts))).view(np.int64)


def _same(text: str) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(text.lower().split()))


def _node(same: bytes) -> int:
    return int.from_bytes(same[:8], "little", signed=True)


def similar_groups(df: DataFrame, key: str, text: str, k: int = 5, similarity: float = 0.8, tables: int = TABLES, distance: int = 3, blocks: int = 4, r: int = 4, tile: int = TILE, light: int = LIGHT) -> DataFrame:
    """``(key, group)``: documents linked by ``similarity`` of their ``k``-word shingle sets.

    ``group`` is the smallest key of the component. Equal texts are one node. Rows without a
    key are left out; rows that share a key share a group. A null text counts as empty; texts
    without words are equal to each other only. Words are lower-cased and split at white space.
    """
    source = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).filter(F.col("_key").isNotNull())
    kind = source.schema["_key"].dataType.simpleString()

    def prints(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column("_text").to_pylist()
                same = [_same(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_key"),
                        pa.array(same, pa.binary()),
                        pa.array([_node(x) for x in same], pa.int64()),
                        pa.array([word_prints(t, tables) for t in texts], pa.list_(pa.int64())),
                    ],
                    names=["key", "same", "node", "prints"],
                )

    docs = stored(source.mapInArrow(lean(prints), f"key {kind}, same binary, node bigint, prints array<bigint>"), "word_prints")
    nodes = stored(docs.groupBy("same").agg(F.min("key").alias("id"), F.first("node").alias("node"), F.first("prints").alias("prints")), "nodes")
    edges = stored(candidates(nodes.select(F.col("node").alias("id"), "prints"), "bigint", distance, blocks, r, tile), "candidate_links")
    first = stored(similar(source, nodes, edges, k, similarity), "similar")
    roots = stored(components(first), "similar_roots")
    rows = prefixes(source, k, similarity, light)
    edges = stored(across(prefix_pairs(rows, roots, similarity, tile, light), roots), "prefix_links")
    edges = stored(likely(source, nodes, edges, k, similarity), "likely_links")
    linked = components(first.union(similar(source, nodes, edges, k, similarity)))
    rooted = nodes.select("same", "node", "id").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("group"))
    named = rooted.join(smallest, "root").select("same", "group")
    return docs.join(named, "same").groupBy("key").agg(F.min("group").alias("group")).withColumnRenamed("key", key)


def chosen(source: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``source`` with the texts that ``edges`` link."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    ends = stored(nodes.join(ends, "node", "left_semi").select("id").distinct(), "candidate_ends")
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    return source.join(ends, source["_key"] == ends["id"], "left_semi")


def parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes falls on each bit. Two sets differ in at least as many
    members as their bits do. There are ``MARK`` bits, or for a larger set the next power of two,
    because fewer would hardly differ more for unlike sets than for like ones."""
    size = max(MARK, 1 << (len(own) - 1).bit_length())
    bits = np.bincount(own.view(np.uint64) % np.uint64(size), minlength=size).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def folded(mark: str, words: Column) -> Column:
    """The parities of a smaller power of two of bits, as 64-bit ``words``."""
    parts = F.sequence(F.lit(0), F.floor(F.size(mark) / words).cast("int") - 1)
    return F.transform(
        F.sequence(F.lit(0), words - 1),
        lambda i: F.aggregate(parts, F.lit(0).cast("bigint"), lambda x, part: x.bitwiseXOR(F.get(F.col(mark), i + part * words))),
    )


def likely(source: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, similarity: float) -> DataFrame:
    """``edges`` without those that differ too much in their parities: an exact bound, so that
    the sets of few texts are needed."""

    def marks(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column("_text").to_pylist()
                found = [shingle_set(t, k) for t in texts]
                cols = [pa.array([_node(_same(t)) for t in texts], pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array([parities(x) for x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "size", "mark"])

    marked = stored(chosen(source, nodes, edges).mapInArrow(lean(marks), "node bigint, size bigint, mark array<bigint>").dropDuplicates(["node"]), "parities")
    left, right = (marked.select(F.col("node").alias(e), F.col("size").alias(f"_n{e}"), F.col("mark").alias(f"_{e}")) for e in "ab")
    words = F.least(F.size("_a"), F.size("_b"))
    apart = F.aggregate(F.zip_with(folded("_a", words), folded("_b", words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = (F.col("_na") + F.col("_nb")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    return edges.join(left, "a").join(right, "b").filter(apart <= most).select("a", "b")


def similar(source: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of ``edges`` whose shingle sets have the similarity."""

    def sets(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column("_text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(_same(t)) for t in texts], pa.int64()), pa.array([shingle_set(t, k) for t in texts], pa.list_(pa.int64()))], names=["node", "set"]
                )

    shingled = stored(chosen(source, nodes, edges).mapInArrow(lean(sets), "node bigint, set array<bigint>").groupBy("node").agg(F.first("set").alias("set")), "shingle_sets")
    left, right = (shingled.select(F.col("node").alias(e), F.col("set").alias(f"_{e}")) for e in "ab")
    both = edges.join(left, "a").join(right, "b").withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    return both.filter(F.col("_n") >= F.lit(similarity) * (F.size("_a") + F.size("_b") - F.col("_n")) - 1e-9).select("a", "b")


def frequent(source: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found often in all texts, sorted, and their counts. A task reports those that it
    found more than once among the texts it holds. They make the order of ``prefixes`` a good one
    (any order is right) and say which shingles are dealt at once (any choice is right)."""

    def run(batches):
        found, seen, waiting = [], set(), 0
        for batch in batches:
            for part in slices(batch, "_text"):
                for t in part.column("_text").to_pylist():
                    if (same := _same(t)) not in seen:
                        seen.add(same)
                        found.append(shingle_set(t, k))
                        waiting += len(found[-1])
                    if waiting >= HELD:
                        yield repeated(found)
                        found, seen, waiting = [], set(), 0
        if found:
            yield repeated(found)

    def repeated(found):
        shingle, count = np.unique(np.concatenate(found), return_counts=True)
        often = count > 1
        return pa.RecordBatch.from_arrays([pa.array(shingle[often]), pa.array(count[often].astype(np.int64))], names=["shingle", "n"])

    rows = source.select("_text").mapInArrow(lean(run), "shingle bigint, n bigint")
    counts = rows.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingle, n = (top.column(i).to_numpy() for i in range(2))
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefix_length(n: int, similarity: float) -> int:
    """How many first shingles of ``n`` hold one of any set with the similarity."""
    return n - max(1, int(np.ceil(similarity * n - 1e-6))) + 1


def prefixes(source: DataFrame, k: int, similarity: float, light: int) -> DataFrame:
    """``(anchor, node, size, at, often)``: the first shingles of each text, rare ones first, with
    the size of its set, their place in it and whether more than ``light`` texts are expected to
    have the shingle. A task sends equal texts once, while it remembers them."""
    known, counts = frequent(source, k)

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "_text"):
                if len(seen) > REMEMBERED:
                    seen.clear()
                node, size, anchor, often = [], [], [], []
                for t in part.column("_text").to_pylist():
                    if (same := _same(t)) in seen:
                        continue
                    seen.add(same)
                    own = shingle_set(t, k)
                    found = np.zeros(len(own), np.int64)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        found = np.where(known[place] == own, counts[place], 0)
                        order = np.argsort(found, kind="stable")
                        own, found = own[order], found[order]
                    node.append(_node(same))
                    size.append(len(own))
                    first = prefix_length(len(own), similarity)
                    anchor.append(own[:first])
                    often.append(found[:first] > light)
                if node:
                    length = np.fromiter(map(len, anchor), np.int64, len(anchor))
                    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                    cols = [np.concatenate(anchor), np.repeat(np.array(node, np.int64), length), np.repeat(np.array(size, np.int32), length), at.astype(np.int32), np.concatenate(often)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "node", "size", "at", "often"])

    return source.select("_text").mapInArrow(lean(run), "anchor bigint, node bigint, size int, at int, often boolean")


def _pairs(group: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray, root: np.ndarray, similarity: float):
    """Batches of the pairs of equal group whose sizes and places allow the similarity; pairs
    of one root are left out. At the first shingle a pair has in common, at most what follows
    it in either set can be common too; the pair meets there."""
    first, step, a, b, waiting = np.arange(len(node)), 0, [], [], 0
    while len(first):
        step += 1
        first = first[first + step < len(node)]
        first = first[group[first] == group[first + step]]
        x, y = first, first + step
        common = np.minimum(size[x] - at[x], size[y] - at[y])
        fit = (common * (1 + similarity) >= similarity * (size[x].astype(np.int64) + size[y]) - 1e-6) & (root[x] != root[y])
        a.append(node[x[fit]])
        b.append(node[y[fit]])
        waiting += len(a[-1])
        if waiting > PENDING or waiting and not len(first):
            yield np.concatenate(a), np.concatenate(b)
            a, b, waiting = [], [], 0


def prefix_pairs(rows: DataFrame, roots: DataFrame, similarity: float, tile: int, light: int) -> DataFrame:
    """``(a, b)`` with a < b: texts with a common prefix shingle that may be similar.

    Up to ``light`` rows of a shingle are paired where they meet. The few shingles with more
    are dealt again in tiles, with the root each text has so far. Rows expected to be of such a
    shingle (``often``) are spread by their text; a task holds at most ``light`` rows of any
    other one and passes on the rest, so no shingle is gathered before it is cut.
    """

    def crowded(cols):
        if len(cols[0]):
            anchor, node, size, at = map(pa.array, cols)
            yield pa.RecordBatch.from_arrays([anchor, node, pa.nulls(len(node), pa.int64()), size, at], names=names)

    def paired(cols):
        if not len(cols[0]):
            return
        group = np.cumsum(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])) - 1
        heavy = (np.bincount(group) > light)[group]
        some = ~heavy
        for a, b in _pairs(group[some], *(c[some] for c in cols[1:]), cols[1][some], similarity):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.int32())] * 2], names=names)
        yield from crowded([c[heavy] for c in cols])

    def meet(batches):
        # Rows of the last anchor so far, and the anchor whose first rows were passed on.
        rest, hot = None, None
        for batch in batches:
            cols, often = [batch.column(i).to_numpy() for i in range(4)], batch.column(4).to_numpy(zero_copy_only=False)
            passed = often if hot is None else often | (cols[0] == hot)
            yield from crowded([c[passed] for c in cols])
            cols = [c[~passed] for c in cols]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
            change = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            cut = int(change[-1]) if len(change) else 0
            yield from paired([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
            if len(rest[0]) > light:
                hot = rest[0][0]
                yield from crowded(rest)
                rest = None
        if rest is not None:
            yield from paired(rest)

    def tiles(batches):
        for cols, _ in _groups(batches, 6):
            group = np.concatenate([[0], np.cumsum((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))])
            for a, b in _pairs(group, *cols[2:], similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    names = ["anchor", "a", "b", "size", "at"]
    salt = F.when(F.col("often"), F.col("node"))
    rows = rows.repartition(parallelism(rows), "anchor", salt).sortWithinPartitions("anchor", "node")
    met = stored(rows.mapInArrow(lean(meet), "anchor bigint, a bigint, b bigint, size int, at int"), "prefix_rows")
    crowd = met.filter("anchor is not null").select("anchor", F.col("a").alias("node"), "size", "at").dropDuplicates(["anchor", "node"])
    crowd = crowd.join(roots, "node", "left").select("anchor", "node", "size", "at", F.coalesce("root", "node").alias("root"))
    found = met.filter("anchor is null").select("a", "b").union(tiled(stored(crowd, "crowd"), tile).mapInArrow(lean(tiles), "a bigint, b bigint"))
    return found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends have different roots."""
    for e in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(e), F.col("root").alias(f"_{e}")), e, "left")
    return pairs.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def candidates(nodes: DataFrame, kind: str, distance: int, blocks: int, r: int, tile: int = TILE) -> DataFrame:
    """``(a, b)`` with a < b: nodes with a fingerprint within ``distance`` in some table.

    Each row of an anchor's group is linked to the smallest member of its component there
    and to up to ``NEIGHBOURS`` other close members: links stay linear in rows.
    """
    reach = 1 + distance // blocks
    codes = [(lo, c, c.patterns(reach)) for lo, c in block_codes(blocks, r)]

    def spread(batches):
        for batch in batches:
            fps = np.stack(batch.column("prints").to_numpy(zero_copy_only=False)).view(np.uint64) if batch.num_rows else np.zeros((0, 0), np.uint64)
            for t in range(fps.shape[1]):
                fp = fps[:, t]
                for number, (lo, code, patterns) in enumerate(codes):
                    value = (fp >> np.uint64(lo)) & np.uint64((1 << code.bits) - 1)
                    syndrome = code.syndromes(value)
                    for s in np.unique(syndrome):
                        pick = np.flatnonzero(syndrome == s)
                        at = (value[pick][:, None] ^ patterns[s][None, :]) | np.uint64((t * len(codes) + number) << 40)
                        rows = np.repeat(pick, len(patterns[s]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(at.ravel().view(np.int64)), pa.array(fp[rows].view(np.int64)), batch.column("id").take(pa.array(rows))], names=["anchor", "fp", "id"]
                        )

    rows = nodes.select("id", "prints").mapInArrow(lean(spread), f"anchor bigint, fp bigint, id {kind}")
    rows = tiled(rows, tile)

    def close(batches):
        for cols, ids in _groups(batches):
            group = np.concatenate([[0], np.cumsum((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))])
            a, b = _neighbours(group, cols[2].view(np.uint64), distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

    found = rows.mapInArrow(lean(close), f"a {kind}, b {kind}").filter("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _groups(batches, width: int = 3):
    """Whole groups of rows sorted by (anchor, cell), as ``width`` arrays, with the ids that may
    follow."""
    rest, held = None, None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(width)]
        ids = batch.column(min(width, batch.num_columns - 1))
        if rest is not None:
            cols, ids = [np.concatenate([x, y]) for x, y in zip(rest, cols)], pa.concat_arrays([held, ids])
        change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut > 1:
            yield [c[:cut] for c in cols], ids.slice(0, cut)
        rest, held = [c[cut:] for c in cols], ids.slice(cut)
    if rest is not None and len(rest[0]) > 1:
        yield rest, held


def _neighbours(group: np.ndarray, fp: np.ndarray, distance: int):
    """Positions of close pairs of equal group: some of each row's, and a forest of all."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept, found, first, step, waiting = [], [], np.arange(len(fp)), 0, 0
    taken = np.zeros(len(fp), np.int64)
    while len(first):
        step += 1
        first = first[first + step < len(fp)]
        first = first[group[first] == group[first + step]]
        near = first[np.bitwise_count(fp[first] ^ fp[first + step]) <= distance]
        found.append((near, near + step))
        some = near[taken[near] < NEIGHBOURS]
        taken[some] += 1
        kept.append((some, some + step))
        waiting += len(near)
        if waiting > PENDING or not len(first):
            a, b = forest(np.concatenate([a, *[i for i, _ in found]]), np.concatenate([b, *[j for _, j in found]]))
            found, waiting = [], 0
    return np.concatenate([a, *[i for i, _ in kept]]), np.concatenate([b, *[j for _, j in kept]])
