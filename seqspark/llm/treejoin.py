"""Word-n-gram Jaccard join over prefix trees.

Every text becomes the set of its shingles in one global order, that of their counts in all
texts; shingles are counted where they meet, and no list of them is gathered. Two sets of the
wanted similarity share one of the first few of their shingles (rare ones first), so sets that
share none can never meet: what hangs together by such shingles is a block, and each block's sets
are sent to one place once. There they are stored in a prefix tree, those of many sets first, so
that common beginnings are stored and compared once. Each set walks the tree with its overlap so
far; a subtree is left when its sizes are out of range or when the overlap and what remains of
either side cannot reach the similarity any more. Links are exact up to equal 64-bit hashes.

Blocks of more than ``CELL`` shingles are cut into chunks. Each chunk has a tree of its own;
then one set per linked group of a chunk is compared across chunks; what is then not in the
largest group of its block is walked through the trees of all chunks whose sizes allow a link.
In the first two steps a set has one place, so the task that links a group also names it; only
blocks and the links of the third step need rounds over a table of links. The third step sends
a part of its pairs of chunks at a time, so its disk does not grow with the square of a block.
"""

from __future__ import annotations

import gc
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import lean, slices, stored, table
from seqspark.llm.components import components
from seqspark.llm.simhash import forest
from seqspark.operators.ordering import parallelism, running

WORDS, PERCENT = 5, 80
#: Shingles of one prefix tree (and one set), and rows that a task works on at once.
CELL, BUFFER = 1 << 18, 1 << 20
#: The count from which a shingle has a level in the global order, and sets numbered in one batch.
#: Any order common to all sets gives the same links; this one keeps blocks small.
OFTEN, TEXTS = 2, 1 << 16
#: Ids of sets that are fetched again are broadcast up to this many (16 bytes each), else joined.
BROADCAST_ROWS = 500_000
#: Pairs of chunks are compared in rounds, which send a half of the shingles of all rows at most.
SHARE = 2
#: Forks of a prefix tree that are walked together.
LEVELS = 6

_MIX = np.random.default_rng(42).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.arange(64, dtype=np.uint64) * _MIX[:1]


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles (fewer words: of the whole sequence).

    A-Z are lower-cased, ASCII white space parts words; no words give an empty set.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    at = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    mixed = np.full(len(at) - width + 1, _SHORT[width], np.uint64)
    for i in range(width):
        mixed += at[i : len(at) - width + 1 + i] * _MIX[1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[0]
    mixed = np.sort(mixed ^ (mixed >> np.uint64(29)))
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def _name(own: np.ndarray) -> int:
    """The number that stands for a set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def named(source: DataFrame, k: int) -> DataFrame:
    """``(key, node, size)``; the node of an empty set is null."""
    kind = source.schema["_key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [shingle_set(t, k) for t in part.column("_text").to_pylist()]
                cols = [part.column("_key"), pa.array([_name(x) if len(x) else None for x in found], pa.int64()), pa.array(list(map(len, found)), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "node", "size"])

    return source.mapInArrow(lean(run), f"key {kind}, node bigint, size bigint")


# ---------------------------------------------------------------- global order


def _places(own: np.ndarray, parts: int) -> np.ndarray:
    """Under which number a shingle is counted: its part, then its low bits."""
    part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return part << np.uint64(32) | own & np.uint64(0xFFFFFFFF)


def _steps(numbers: np.ndarray) -> bytes:
    """Numbers under ``TEXTS`` that never fall, two bytes each: the low ones of all steps, then the high ones."""
    return np.diff(numbers, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _numbers(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint8).reshape(2, -1).T.copy().view("<u2")[:, 0], dtype=np.int64)


def levels(source: DataFrame, k: int) -> DataFrame:
    """The shingles that occur more than once, with their levels, for every set of every batch.

    A level is a fourth of a power of two of the count in all texts. A task numbers the sets of
    a batch and sends each shingle with its set's number to the shingle's part, four bytes and
    two; the part knows all counts and answers with the shingles that are not alone. Rows are
    ``(batch, kind, part, low, text, level)``: of kind 1 the low bits, set numbers and levels of
    one part, of kind 0 the names and sizes of the sets of the batch.
    """
    parts = parallelism(source)
    kinds = {"batch": pa.int64(), "kind": pa.int32(), "part": pa.int32(), "low": pa.binary(), "text": pa.binary(), "level": pa.binary()}

    def table_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    def split(batches):
        number, held, waiting = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for part in slices(batch, "_text"):
                for t in part.column("_text").to_pylist():
                    own = shingle_set(t, k)
                    if len(own) and (name := _name(own)) not in held:
                        held[name] = own
                        waiting += len(own)
                        if waiting >= 2 * BUFFER or len(held) == TEXTS:
                            yield packed(number, held)
                            number, held, waiting = number + 1, {}, 0
        if held:
            yield packed(number, held)

    def packed(number, held):
        size = np.array(list(map(len, held.values())), np.int64)
        place = _places(np.concatenate(list(held.values())), parts)
        part = (place >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        low, text = place[order].astype(np.uint32), np.repeat(np.arange(len(size)), size)[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
        rows = [(number, 1, p, low[a:b].tobytes(), _steps(text[a:b]), None) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return table_of([(number, 0, number % parts, np.array(list(held), np.int64).tobytes(), size.tobytes(), None), *rows])

    def answers(batches):
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == 0:
                    yield table_of([row])
                    continue
                if row[2] != now and held:
                    yield from counted(held)
                    held = []
                now = row[2]
                held.append(row)
        if held:
            yield from counted(held)

    def counted(held):
        low = np.concatenate([np.frombuffer(x[3], np.uint32) for x in held])
        at = np.sort(low.astype(np.uint64) << np.uint64(32) | np.arange(len(low), dtype=np.uint64))
        first = np.flatnonzero(np.concatenate([[True], at[1:] >> np.uint64(32) != at[:-1] >> np.uint64(32)]))
        count = np.diff(np.append(first, len(at)))
        often = np.repeat(count >= OFTEN, count)
        at = (at[often] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        level = np.repeat(np.minimum(4 * np.log2(count), 255).astype(np.uint8), count)[often]
        order = np.argsort(at)
        at, level = at[order], level[order]
        edges = np.concatenate([[0], np.cumsum([len(x[3]) // 4 for x in held])])
        cuts = np.searchsorted(at, edges)
        rows = []
        for x, edge, a, b in zip(held, edges, cuts, cuts[1:]):
            if b > a:
                rows.append((*x[:3], low[at[a:b]].tobytes(), _steps(_numbers(x[4])[at[a:b] - edge]), level[a:b].tobytes()))
        if rows:
            yield table_of(rows)

    schema = "batch bigint, kind int, part int, low binary, text binary, level binary"
    asked = source.select("_text").mapInArrow(lean(split), schema).repartition(parts, "part").sortWithinPartitions("part")
    return asked.mapInArrow(lean(answers), schema)


def first_shingles(size: np.ndarray, text: np.ndarray, place: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """Of the shingles that sets ``text`` of ``size`` shingles share with others, those among the
    first ones by which similar sets meet. Rare shingles come first, equal levels by place; what
    a set has alone comes before all these and meets nothing.
    """
    want = np.bincount(text, minlength=len(size)) + 1 + -percent * size // 100
    kept = np.flatnonzero(want[text] > 0)
    kept = kept[np.lexsort((place[kept], level[kept], text[kept]))]
    owner = text[kept]
    return kept[np.arange(len(owner)) - np.searchsorted(owner, owner) < want[owner]]


# ---------------------------------------------------------------- blocks


def _runs(anchor, size, node, percent):
    """Rows of equal anchor and sizes that follow closely, as one row each, and the links in them."""
    order = np.lexsort((size, anchor))
    anchor, size, node = anchor[order], size[order], node[order]
    joined = (anchor[1:] == anchor[:-1]) & (100 * size[:-1] >= percent * size[1:])
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    at = np.flatnonzero(joined)
    return anchor[first], size[first], size[last], node[first], forest(node[at], node[at + 1])


def block_links(source: DataFrame, k: int, percent: int) -> DataFrame:
    """``(a, b)``: sets that share a first shingle and may be similar are connected by these.

    A batch merges its rows of one shingle before they are shuffled, so a shingle of any number
    of sets arrives as a few rows per batch. Its own links go the same way, as pairs of rows
    under a number of their own. A link may come from several batches.
    """

    def run(batches):
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now and len(held) > 1:
                    yield from rows(held)
                if row[0] != now:
                    now, held = row[0], []
                held.append(row)
        if len(held) > 1:
            yield from rows(held)

    def rows(held):
        name, size = (np.frombuffer(x, np.int64) for x in held[0][3:5])
        text = np.concatenate([_numbers(x[4]) for x in held[1:]])
        place = np.concatenate([np.int64(x[2]) << 32 | np.frombuffer(x[3], np.uint32).astype(np.int64) for x in held[1:]])
        level = np.concatenate([np.frombuffer(x[5], np.uint8) for x in held[1:]])
        first = first_shingles(size, text, place, level, percent)
        if len(first):
            anchor, low, high, node, (a, b) = _runs(place[first], size[text[first]], name[text[first]], percent)
            link = (a ^ (b * 3)) * np.int64(-7046029254386353131)
            span = np.concatenate([low << 32 | high, np.zeros(2 * len(a), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([anchor, link, link])), pa.array(span), pa.array(np.concatenate([node, a, b]))], names=["anchor", "span", "node"])

    def meet(batches):
        last, found, waiting = [np.zeros(0, np.int64)] * 3, [], 0
        for batch in batches:
            anchor, span, node = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(last))
            if not len(anchor):
                continue
            group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
            most = np.maximum.accumulate(group << 32 | span & 0xFFFFFFFF) & 0xFFFFFFFF
            at = np.flatnonzero((anchor[1:] == anchor[:-1]) & (percent * (span[1:] >> 32) <= 100 * most[:-1]))
            found.append((node[at], node[at + 1]))
            waiting += len(at)
            last = [anchor[-1:], (span[-1:] >> 32 << 32) | most[-1:], node[-1:]]
            if waiting > BUFFER:
                found = [forest(*(np.concatenate([x[i] for x in found]) for i in range(2)))]
                waiting = len(found[0][0])
                if waiting > BUFFER // 2:
                    yield pairs(found[0])
                    found, waiting = [], 0
        if waiting:
            yield pairs(forest(*(np.concatenate([x[i] for x in found]) for i in range(2))))

    def pairs(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])

    found = levels(source, k).repartition(parallelism(source), "batch").sortWithinPartitions("batch", "kind")
    dealt = found.mapInArrow(lean(run), "anchor bigint, span bigint, node bigint")
    dealt = dealt.repartition(parallelism(source), "anchor").sortWithinPartitions("anchor", "span")
    return dealt.mapInArrow(lean(meet), "a bigint, b bigint").filter("a <> b")


# ---------------------------------------------------------------- prefix tree


class PrefixTree:
    """Sequences in one common order, stored with shared beginnings.

    A branch is the run of shingles from its parent's end to its own; ``low`` and ``high``
    bound the sizes of the sets below it, which are ``sets`` ones from ``begin`` on; ``end`` is
    the set that ends there or -1. Sets are numbered in the order of their sequences.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.known, local = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array(list(map(len, sets)), np.int64)
        parts = np.split(local.astype(np.int64), np.cumsum(size)[:-1])
        self.order = sorted(range(len(sets)), key=lambda i: parts[i].tolist())
        self.size = size[self.order]
        self.token = np.concatenate([parts[i] for i in self.order])
        self.at = np.cumsum(self.size) - self.size
        branches = [[0, 0, 0, -1, -1, 0]]  # first token, depth above, depth, parent, end, first set
        open_, last, closed = [0], None, {}
        for n, i in enumerate(self.order):
            own, shared = parts[i], 0
            if last is not None:
                width = min(len(own), len(last))
                other = np.flatnonzero(own[:width] != last[:width])
                shared = int(other[0]) if len(other) else width
            while branches[open_[-1]][2] > shared:
                gone = open_.pop()
                closed[gone] = n
                if branches[open_[-1]][2] < shared:  # the run is parted where the sets differ
                    start, above, first = branches[gone][0], branches[gone][1], branches[gone][5]
                    branches.append([start, above, shared, open_[-1], -1, first])
                    branches[gone][0], branches[gone][1], branches[gone][3] = start + shared - above, shared, len(branches) - 1
                    open_.append(len(branches) - 1)
            if len(own) > shared:
                branches.append([int(self.at[n]) + shared, shared, len(own), open_[-1], n, n])
                open_.append(len(branches) - 1)
            else:
                branches[open_[-1]][4] = n
            last = own
        self.start, above, self.depth, self.parent, self.end, self.begin = np.array(branches, np.int64).T
        self.sets = np.array([closed.get(i, len(sets)) for i in range(len(branches))], np.int64) - self.begin
        self.length = self.depth - above
        self.low, self.high = (np.array([f(self.size[b : b + n]) for b, n in zip(self.begin, self.sets)]) for f in (np.min, np.max))
        self.child = np.argsort(self.parent, kind="stable")[1:]
        self.children = np.bincount(self.parent[1:], minlength=len(branches))
        self.first = np.cumsum(self.children) - self.children
        self.place = np.zeros(len(self.known), np.int64)

    def walk(self, own: np.ndarray, least: int, most: int, percent: int) -> np.ndarray:
        """The sets of ``least`` to ``most`` shingles that are similar to a sequence.

        All branches that are still open go down together, with the overlap so far and the
        place in ``own`` of the last common shingle; what follows it is all that can be added.
        What is still open after ``LEVELS`` forks is compared set by set from there.
        """
        size, found = len(own), []
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        here = self.known[at] == own
        self.place[at[here]] = np.flatnonzero(here) + 1
        open_, overlap, last = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for _ in range(LEVELS):
            branch, which = _spread(self.first[open_], self.children[open_])
            branch = self.child[branch]
            fit = (self.high[branch] >= least) & (self.low[branch] <= most)
            branch, which = branch[fit], which[fit]
            open_ = branch
            if not len(branch):
                break
            token, _ = _spread(self.start[branch], self.length[branch])
            place = self.place[self.token[token]]
            edges = np.cumsum(self.length[branch]) - self.length[branch]
            overlap = overlap[which] + np.add.reduceat((place > 0).astype(np.int64), edges)
            last = np.maximum(last[which], np.maximum.reduceat(place, edges))
            depth = self.depth[branch]
            done = (self.end[branch] >= 0) & (depth >= least) & (depth <= most) & ((100 + percent) * overlap >= percent * (size + depth))
            found.append(self.end[branch[done]])
            # Of the sizes below, the one for which the most overlap is left over.
            left = size - last
            best = np.clip(left + depth, np.maximum(self.low[branch], least), np.minimum(self.high[branch], most))
            fit = ((100 + percent) * (overlap + np.minimum(left, best - depth)) >= percent * (size + best)) & (self.children[branch] > 0)
            open_, overlap, last = branch[fit], overlap[fit], last[fit]
        if len(open_):
            ended = (self.end[open_] >= 0).astype(np.int64)  # the set that ends at the branch is the first
            some, which = _spread(self.begin[open_] + ended, self.sets[open_] - ended)
            fit = (self.size[some] >= least) & (self.size[some] <= most)
            some, which = some[fit], which[fit]
            if len(some):
                depth = self.depth[open_][which]
                length = self.size[some] - depth
                token, _ = _spread(self.at[some] + depth, length)
                more = np.add.reduceat((self.place[self.token[token]] > 0).astype(np.int64), np.cumsum(length) - length)
                found.append(some[(100 + percent) * (overlap[which] + more) >= percent * (size + self.size[some])])
        self.place[at[here]] = 0
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _spread(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers ``first .. first + length - 1`` of every row, and the row of each."""
    which = np.repeat(np.arange(len(first)), length)
    return np.arange(len(which)) + np.repeat(first - (np.cumsum(length) - length), length), which


def ordered(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets with numbers for their shingles, in one order: those of many of the sets first."""
    known, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.empty(len(known), np.int64)
    number[np.argsort(-count, kind="stable")] = np.arange(len(known))
    size = np.array(list(map(len, sets)), np.int64)
    at = np.sort(np.repeat(np.arange(len(sets)), size) << 32 | number[at]) & 0xFFFFFFFF
    return np.split(at, np.cumsum(size)[:-1])


#: What a row does in its cell: be in the tree, walk it, both.
STAY, WALK, BOTH = 0, 1, 2


def cell_links(role: list[int], label: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the labels of the sets of a cell, none of them superfluous."""
    parent, links = {}, []

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    staying = [n for n, r in enumerate(role) if r != WALK]
    if not staying:
        return links
    sets = ordered(sets)
    tree = PrefixTree([sets[n] for n in staying])
    for n, r in enumerate(role):
        if r != STAY:
            size = len(sets[n])
            # Where all sets walk, each looks for those up to its own size.
            most = size if r == BOTH else 100 * size // percent
            for other in tree.walk(sets[n], -(-percent * size // 100), most, percent).tolist():
                m = staying[tree.order[other]]
                a, b = find(label[m]), find(label[n])
                if a != b:
                    parent[a] = b
                    links.append((label[m], label[n]))
    return links


def tree_links(rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: labels that are linked in a cell ``(block, i, j)``, and the smallest label that
    they reach there."""

    def run(batches):
        cell, held, seen = None, [], set()
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j"))))
            names = list(zip(*(batch.column(c).to_pylist() for c in ("role", "node", "label"))))
            lists = batch.column("own")
            for n, (now, name) in enumerate(zip(cells, names)):
                if now != cell:
                    yield from pairs(held)
                    cell, held, seen = now, [], set()
                if name not in seen:  # rows may share a key and a text
                    seen.add(name)
                    held.append((*name, lists[n].values.to_numpy()))
        yield from pairs(held)

    def pairs(held):
        if len(held) > 1:
            role, _, label, sets = map(list, zip(*held))
            links = cell_links(role, label, sets, percent)
            if links:
                a, b = forest(*np.array(links, np.int64).T)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = rows.repartition(parallelism(rows), "block", "i", "j").sortWithinPartitions("block", "i", "j", "role", "node")
    return rows.select("block", "i", "j", "role", "node", "label", "own").mapInArrow(lean(run), "a bigint, b bigint")


def fetched(source: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``cells(id, node, block, i, j, role, label)`` with the sets.

    A set is made from the text of one row with its key and goes to all its cells.
    """
    place = F.struct("block", "i", "j", "role", "label")
    wanted = stored(cells.groupBy("id", "node").agg(F.collect_list(place).alias("cells")), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = source.join(few, F.col("_key").eqNullSafe(F.col("id"))).select("_text", "node", "cells")
    kind = texts.schema["cells"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                node, kept, own = part.column("node").to_pylist(), [], []
                for n, t in enumerate(part.column("_text").to_pylist()):
                    found = shingle_set(t, k)
                    if len(found) and _name(found) == node[n]:  # rows may share a key
                        kept.append(n)
                        own.append(found.view(np.int64))
                rows = part.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("cells"), pa.array(own, pa.list_(pa.int64()))], names=["node", "cells", "own"])

    rows = texts.mapInArrow(lean(run), f"node bigint, cells {kind}, own array<bigint>")
    return rows.select("node", "own", F.inline("cells"))


def chunked(rows: DataFrame, order: list[str], cell: int, out: str, group: tuple[str, ...] = ("block",)) -> DataFrame:
    """Numbers, per block, runs of about ``cell`` shingles in the order."""
    upto = running(rows, order, {"_upto": F.col("size")}, group=list(group))
    return upto.withColumn(out, F.floor((F.col("_upto") - F.col("size")) / cell)).drop("_upto")


def similar_sets(df: DataFrame, key: str, text: str, k: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """``(key, n_shingles, component_id)`` per row: the size of its set and the smallest key that
    links of at least ``percent`` per cent of the union reach.

    Null and empty texts and texts without words have empty sets and are linked with nothing.
    Equal sets are one set, so copies cost no comparison. Rows that share a key are rows of
    their own; a null key is the smallest of its component only if it has no other.
    """
    source = df.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    docs = stored(named(source, k), "sets")
    blocks = components(stored(block_links(source, k, percent), "block_links")).select("node", F.col("root").alias("block"))
    nodes = docs.filter("node is not null").groupBy("node").agg(F.min("key").alias("id"), F.first("size").alias("size"))
    members = stored(chunked(nodes.join(blocks, "node"), ["size", "node"], cell, "i"), "members")
    zero, one = F.lit(0).cast("bigint"), F.col("node").alias("label")

    def linked(cells, name):
        return stored(tree_links(fetched(source, cells, k), percent), name)

    def cells(rows, role, j=zero, label=one):
        return rows.select("id", "node", "block", "i", j.alias("j"), F.lit(role).alias("role"), label)

    roots = linked(cells(members, BOTH), "tree_links").toDF("node", "root")
    if members.filter("i > 0").limit(1).count():
        room = docs.agg(F.sum("size")).first()[0] // SHARE + 1
        roots = _across(members, roots, linked, cells, cell, percent, room)
    rooted = docs.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("key").alias("component_id"))
    out = rooted.join(least, "root", "left")
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def _across(members: DataFrame, roots: DataFrame, linked, cells, cell: int, percent: int, room: int) -> DataFrame:
    """``(node, root)`` of ``members(block, i, node, id, size)``, with the links between the chunks
    of a block; ``roots`` has those inside of chunks.

    A group goes by its smallest set, which stands for it. Its name changes at most twice: once
    where its chunk's groups are compared, once by what is reached through ``components``. Where
    pairs of chunks have more than ``room`` shingles, they are compared one part after the other,
    so that what is shuffled at once never outgrows the texts.
    """

    def renamed(rows, names):
        return rows.join(names.toDF("label", "_new"), "label", "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")

    inside = stored(renamed(members.withColumn("label", F.col("node")), roots), "inside")
    many = inside.filter("i > 0").select("block").distinct()
    large = inside.join(many, "block", "left_semi")
    first = chunked(large.filter("node = label").drop("i", "label"), ["node"], cell, "i")
    now = stored(renamed(large, linked(cells(first, BOTH), "chunk_links")), "labels")
    rest = inside.join(many, "block", "left_anti").select("node", F.col("label").alias("root"))
    weight = now.groupBy("block", "label").agg(F.sum("size").alias("n"))
    largest = weight.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    apart = stored(chunked(now.join(largest, "block").filter("label <> largest").drop("largest", "i"), ["size", "node"], cell, "j"), "apart")
    if not apart.count():
        return rest.union(now.select("node", F.col("label").alias("root")))

    def bounds(rows, at):
        return rows.groupBy("block", at).agg(F.min("size").alias(f"low_{at}"), F.max("size").alias(f"high_{at}"), F.sum("size").alias(f"n_{at}"))

    near = (100 * F.col("high_i") >= percent * F.col("low_j")) & (100 * F.col("high_j") >= percent * F.col("low_i"))
    pairs = bounds(now, "i").join(bounds(apart, "j"), "block").filter(near).select("block", "i", "j", (F.col("n_i") + F.col("n_j")).alias("size"))
    pairs = stored(pairs, "chunk_pairs")
    rounds, found = 1 + (pairs.agg(F.sum("size")).first()[0] or 0) // room, []
    if rounds > 1:
        pairs = stored(chunked(pairs, ["block", "i", "j"], room, "round", ()), "chunk_rounds")
    for n in range(rounds):
        some = (pairs.filter(F.col("round") == n) if rounds > 1 else pairs).select("block", "i", "j")
        stay = cells(now.join(some, ["block", "i"]), STAY, j=F.col("j"), label=F.col("label"))
        walk = cells(apart.join(some, ["block", "j"]), WALK, j=F.col("j"), label=F.col("label"))
        found.append(linked(stay.union(walk), "apart_links"))
        if rounds > 1:  # shuffle files go when the driver's garbage does
            gc.collect()
            now.sparkSession.sparkContext._jvm.System.gc()
    last = renamed(now, components(reduce(DataFrame.union, found)))
    return rest.union(last.select("node", F.col("label").alias("root")))


def op12_prefix_tree_join(spark, sf_dir) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), "doc_id", "text")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.m)
SELECT r.doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
