"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A sketch has cells of (count, xor of digests, xor of check sums); a digest goes into three
of them. Subtracting the sketches of two versions leaves the paragraphs they do not share;
peeling cells that hold a single digest recovers these. Where peeling stops early the
sketches are made again at twice the size with other cells, until it ends. Work is done on
whole slices of documents at once: the tables of all pairs are one array.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import slices, stored, table
from seqspark.operators.ordering import parallelism
from seqspark.session import local_table

CELLS = 9
#: Sentences end a paragraph too; longer ones are cut after words with a fixed check sum.
PARAGRAPH = re.compile(r"\n+|(?<=[.!?])[ \t]+")
LONG = 100
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)


def paragraphs(text: str) -> list[str]:
    """Lines cut at sentence ends; what is still long is cut after words whose check sum
    is a multiple of 8, so an edit moves no cut but its own."""
    out = []
    for part in PARAGRAPH.split(text):
        part = part.strip()
        if len(part) <= LONG:
            if part:
                out.append(part)
            continue
        words, at = part.split(), 0
        for i, w in enumerate(words):
            if xxhash.xxh32_intdigest(w) % 8 == 0:
                out.append(" ".join(words[at : i + 1]))
                at = i + 1
        if at < len(words):
            out.append(" ".join(words[at:]))
    return out


def digests(text: str) -> np.ndarray:
    """Sorted digests of the paragraphs; the n-th repeat of one has a digest of its own."""
    parts = paragraphs(text)
    found = np.sort(np.fromiter((xxhash.xxh64_intdigest(p) for p in parts), np.uint64, len(parts)))
    if len(found) > 1:
        same = np.concatenate([[False], found[1:] == found[:-1]])
        if same.any():
            at = np.arange(len(found))
            nth = at - np.maximum.accumulate(np.where(same, 0, at))
            found = found ^ _mixed(nth.astype(np.uint64), 3) * (nth > 0)
    return found


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(MIX[seed % 4] * (seed + 1) & (2**64 - 1))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[3])
    return x ^ (x >> np.uint64(32))


class Sketches:
    """Tables of ``cells`` cells for ``n`` documents (or pairs of them)."""

    def __init__(self, n: int, cells: int, seed: int):
        self.n, self.cells, self.seed = n, cells, seed
        self.count = np.zeros(n * cells, np.int32)
        self.keys, self.checks = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint32)

    def _check(self, key: np.ndarray) -> np.ndarray:
        return (_mixed(key, 4 * self.seed + 3) >> np.uint64(32)).astype(np.uint32)

    def add(self, row: np.ndarray, key: np.ndarray, sign) -> None:
        third, check = self.cells // 3, self._check(key)
        for j in range(3):
            at = row * self.cells + j * third + (_mixed(key, 4 * self.seed + j) % np.uint64(third)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, key)
            np.bitwise_xor.at(self.checks, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered ``(row, digest, side)`` and which rows came out empty."""
        found = []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[self._check(self.keys[pure]) == self.checks[pure]]
            if not len(pure):
                break
            row, key, side = pure // self.cells, self.keys[pure], self.count[pure]
            order = np.lexsort((key, row))
            row, key, side = row[order], key[order], side[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
            row, key, side = row[new], key[new], side[new]
            self.add(row, key, -side)
            found.append((row, key, side))
        full = self.count.astype(bool) | self.keys.astype(bool) | self.checks.astype(bool)
        done = ~full.reshape(self.n, self.cells).any(axis=1)
        parts = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)]
        return *parts, done

    def texts(self) -> list[str]:
        """One printable string per document."""
        raw = np.zeros((self.n, self.cells), [("c", "<i4"), ("k", "<u8"), ("s", "<u4")])
        raw["c"], raw["k"], raw["s"] = (a.reshape(self.n, self.cells) for a in (self.count, self.keys, self.checks))
        return [base64.b64encode(r.tobytes()).decode() for r in raw]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return rows, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The first sketch of each set, as text."""
    sketch = Sketches(len(sets), cells, 0)
    sketch.add(*_flat(sets), 1)
    return sketch.texts()


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pair the digests only ``a`` has and those only ``b`` has, by subtract and peel."""
    out: list = [None] * len(a)
    left, seed = np.arange(len(a)), 0
    while len(left):
        sketch = Sketches(len(left), cells, seed)
        sketch.add(*_flat([a[i] for i in left]), 1)
        sketch.add(*_flat([b[i] for i in left]), -1)
        row, key, side, done = sketch.peel()
        order = np.argsort(row, kind="stable")
        row, key, side = row[order], key[order], side[order]
        edge = np.searchsorted(row, np.arange(len(left) + 1))
        for n in np.flatnonzero(done):
            k, s = key[edge[n] : edge[n + 1]], side[edge[n] : edge[n + 1]]
            out[left[n]] = (k[s > 0], k[s < 0])
        left, cells, seed = left[~done], cells * 2, seed + 1
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    """Shared paragraphs over all paragraphs of each pair; two empty sets are alike (1)."""
    out = []
    for x, y, (p, m) in zip(a, b, differences(a, b)):
        both = len(x) + len(y) - len(p) - len(m)
        every = both // 2 + len(p) + len(m)
        out.append(both / 2 / every if every else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the beginning, as long, of the text that follows."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compared(keys: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Result rows for texts, each with the text that follows it."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    # Neighbours repeat: a text that follows one row is the next row's own.
    made: dict[int, np.ndarray] = {}
    own, new, nxt = [[made[id(t)] if id(t) in made else made.setdefault(id(t), digests(t)) for t in ts] for ts in (texts, changed, following)]
    return pa.RecordBatch.from_arrays([
        keys, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
        pa.array(fingerprints(own)), pa.array(fingerprints(new)), pa.array(likeness(own, new)), pa.array(likeness(own, nxt)),
    ], names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def revisions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each text against its edited version and against the text that follows it by key.

    The texts are range-partitioned by key once; rows are compared with their successors in
    the stream of a partition, and the first and last row of each partition (two rows per
    partition) are matched afterwards; the last row of all is followed by the first. A null
    text is empty; null keys come first; rows of equal key follow each other by a hash of the text. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Bounds are sampled from keys and hashes, not from texts.
    hashed = source.withColumn("hash", F.xxhash64("text"))
    rows = hashed.repartitionByRange(parallelism(df), "key", "hash").sortWithinPartitions("key", "hash", "text").select("key", "text")
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"]

    def run(batches):
        part, held = TaskContext.get().partitionId(), None

        def edge(which, row):
            cols = [row.column("key"), *[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]]
            return pa.RecordBatch.from_arrays([*cols, pa.array([part], pa.int32()), pa.array([which]), row.column("text")], names=names)

        for batch in batches:
            for piece in slices(batch, "text"):
                if held is None:
                    yield edge("first", piece.slice(0, 1))
                    own = piece
                else:
                    own = pa.concat_batches([held, piece])
                held = own.slice(own.num_rows - 1, 1)
                texts = own.column("text").to_pylist()
                if len(texts) > 1:
                    done = _compared(own.column("key").slice(0, len(texts) - 1), texts[:-1], texts[1:])
                    n = done.num_rows
                    yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
        if held is not None:
            yield edge("last", held)

    found = stored(rows.mapInArrow(run, f"key {kind}, {RESULT}, part int, edge string, text string"), "revisions")
    edges = found.filter("edge is not null").select("key", "part", "edge", "text")
    parts = sorted(r["part"] for r in edges.filter("edge = 'first'").select("part").collect())  # one number per partition
    follow = local_table(spark, list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next"))
    # One text per partition on each side: joined by shuffle, never broadcast.
    pairs = edges.filter("edge = 'last'").join(F.broadcast(follow), "part").join(firsts.hint("merge"), "following").select("key", "text", "next")

    def match(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                yield _compared(piece.column("key"), piece.column("text").to_pylist(), piece.column("next").to_pylist())

    inner = found.filter("edge is null").drop("part", "edge", "text")
    return inner.union(pairs.mapInArrow(match, f"key {kind}, {RESULT}")).withColumnRenamed("key", key)


def changed_paragraphs(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, removed, added)``: digests of the paragraphs that differ between versions.

    Keys of one side only are compared with an empty text; null keys match each other.
    """
    a = old.select(F.col(key).alias("_k"), F.col(text).alias("_a"))
    b = new.select(F.col(key).alias("_l"), F.col(text).alias("_b"))
    both = a.join(b, a["_k"].eqNullSafe(b["_l"]), "full").select(F.coalesce("_k", "_l").alias("key"), "_a", "_b")
    kind = both.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "_a"):
                sides = [[digests(t or "") for t in piece.column(c).to_pylist()] for c in ("_a", "_b")]
                found = differences(*sides)
                cols = [pa.array([np.sort(d[i].view(np.int64)) for d in found], pa.list_(pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([piece.column("key"), *cols], names=["key", "removed", "added"])

    out = both.mapInArrow(run, f"key {kind}, removed array<bigint>, added array<bigint>")
    return out.withColumnRenamed("key", key)


def op7_paragraph_sketches(spark, sf_dir) -> DataFrame:
    return revisions(table(spark, sf_dir, "documents"), "doc_id", "text")
