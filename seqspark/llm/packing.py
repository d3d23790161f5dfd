"""Best-two-fit packing of token pieces into fixed-size sequences.

The packer depends on lengths only, so it runs on the histogram of lengths (at most
``capacity`` counts): a bin is filled greedily with the longest pieces that fit, then its
smallest piece gives way to the two unpacked pieces that fill the widened gap best. A bin
is repeated as often as the counts allow, which is what packing one by one would do. Pieces
get a rank among those of their length by a distributed global order and look up their
place in the plan, so all pieces take part in one packing and none goes through the driver.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import kept, slices, stored, table, trim
from seqspark.operators.ordering import running

CAPACITY = 4096
END_ID = 1
CHUNK = 1 << 18
#: Words remembered at once, about 200 bytes each.
CACHE = 1 << 18
#: A word is remembered when it is new to a second group of texts, as most words never are. So many
#: places, dealt by hash, tell whether it was; words that share one are remembered sooner.
PLACES = 1 << 22
#: Words longer than this are encoded each time.
CACHED_WORD = 64


class Known(dict):
    """Ids of words; a word that is looked up and not there is encoded and noted as ``fresh``."""

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.tokenizer, self.model, self.fresh = tokenizer, tokenizer.model, []

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self._ids(word)
        self.fresh.append(word)
        return ids

    def _ids(self, word: str) -> bytes:
        """Ids of a word. No step before the merges changes or parts lower-case Latin-1 letters, but
        that each of their bytes is written as a character."""
        if len(word) > CACHED_WORD or not LOWER(word):
            found = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids
        else:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(BYTES)
            found = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(found)}I", *found)


class WordEncoder:
    """Ids of whole texts, with the ids of frequent words remembered.

    The vocabulary drops white space and never merges across it, so the ids of a text are
    those of its blank-separated words in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.tokenizer)
        self.once = bytearray(PLACES)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = [[] for _ in texts]
        for part in _parts(texts):
            if len(self.known) > CACHE:
                self.known = Known(self.tokenizer)
            known, once = self.known, self.once
            for i, text in part:
                out[i].append(b"".join(map(known.__getitem__, _words(text))))
            for w in known.fresh:
                at = hash(w) % PLACES
                if len(w) > CACHED_WORD or not once[at]:
                    once[at] = 1
                    del known[w]
            known.fresh.clear()
        return [b"".join(o) for o in out]


def _class(pattern: str) -> str:
    """The Latin-1 characters of a pattern one by one, which are searched for much faster."""
    return "[" + "".join(re.escape(c) for c in map(chr, range(256)) if re.match(pattern, c)) + "]"


SIGN, LETTER = _class(r"[^\w\s']"), _class(r"[^\W\d_]")
#: Signs after a letter and before a blank: they are cut off there in any case. The pattern begins
#: with a sign, which is found faster than a place after a letter.
TAIL = re.compile(rf"{SIGN}(?<={LETTER}{SIGN}){SIGN}*(?=[ \n\t\r]|\Z)")
#: Words of lower-case Latin-1 letters, none of which changes when it is lower-cased.
LOWER = re.compile("[" + "".join(c for c in map(chr, range(256)) if c.isalpha() and c.lower() == c) + "]+").fullmatch
#: How the vocabulary writes bytes that are no visible Latin-1 character.
BYTES = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}


def _words(text: str) -> list[str]:
    """Blank-separated words. In Western European text, which composes no characters, they are
    lower-cased and signs at their ends are words of their own, so that fewer are new."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            text = TAIL.sub(r" \g<0>", text.lower())
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that words stay known from task to task; another
    operator that runs there later gives the memory back."""
    return kept(f"encoder {path}", lambda: WordEncoder(path))


def _parts(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Texts in groups of about ``CHUNK`` characters; longer ones are cut at blanks."""
    group, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(at + CHUNK, len(text))
            if end < len(text):
                blank = text.find(" ", end)
                end = len(text) if blank < 0 else blank
            group.append((i, text[at:end]))
            size += end - at
            at = end
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def token_pieces(df: DataFrame, key: str, text: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Token pieces of every row: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A row's ids are those of its text (null or empty: none) and ``end_id``; rows over
    ``capacity`` are cut into full pieces and a rest. ``ids`` adds the ids themselves.
    """
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "_text"):
                keys, coded = part.column("_key"), words.encode([t or "" for t in part.column("_text").to_pylist()])
                rows, cols = [], ([], [], [], [], [])
                for r, data in enumerate(coded):
                    data += end
                    for p, at in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[at : at + 4 * capacity]
                        rows.append(r)
                        for c, v in zip(cols, (p, at // 4, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<u4").astype(np.int32) if ids else None)):
                            c.append(v)
                arrays = [keys.take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:4]]]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[4], pa.list_(pa.int32()))] if ids else [])], names=names)
            trim()

    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    return source.mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as ``(length -> pieces, copies)`` that use up ``counts[length]`` exactly."""
    left = counts.astype(np.int64).copy()
    grid = np.arange(capacity + 1)

    def fitting() -> np.ndarray:
        """Largest length in stock that fits each gap (0: none)."""
        return np.maximum.accumulate(np.where(left > 0, grid, 0))

    plan, fit = [], fitting()
    while fit[capacity]:
        before, used, gap = left.copy(), [], capacity

        def take(n: int) -> None:
            nonlocal fit, gap
            used.append(n)
            gap -= n
            left[n] -= 1
            if not left[n]:
                fit = fitting()

        while fit[gap]:
            take(int(fit[gap]))
        if gap and len(used) > 1:
            room = gap + used[-1]
            a = np.flatnonzero(left[:room])
            b = fit[np.minimum(room - a, a)]
            b = np.where((b == a) & (left[a] < 2), fit[np.maximum(a - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            if len(both) and both.max() > used[-1]:
                i, least = int(both.argmax()), used.pop()
                gap, one, two = room, int(a[i]), int(b[i])
                left[least] += 1
                fit = fitting()
                take(one)
                take(two)
        sizes, pieces = np.unique(used, return_counts=True)
        copies = int((before[sizes] // pieces).min())
        left = before
        left[sizes] -= pieces * copies
        fit = fitting()
        plan.append((dict(zip(sizes.tolist()[::-1], pieces.tolist()[::-1])), copies))
    return plan


def places(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """Per length and range of ranks: first bin, pieces per bin, offset in the bin."""
    used = np.zeros(capacity + 1, np.int64)
    rows, bin_ = [], 0
    for sizes, copies in plan:
        at = 0
        for size, pieces in sizes.items():
            rows.append((size, used[size], bin_, pieces, at))
            used[size] += pieces * copies
            at += size * pieces
        bin_ += copies
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "pieces", "at"), cols))


#: Rank and length in one sortable number.
RANK_BITS = 48


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``order`` settles which of several pieces of one length goes where; null keys come
    first and equal rows are interchangeable. An empty table stays empty. A length may
    belong to any share of the rows: ranks are made over the whole order, not per length.
    """
    seen = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in seen:
        if not 1 <= r["length"] <= capacity:
            raise ValueError(f"length {r['length']} is not between 1 and {capacity}")
        counts[r["length"]] = r["count"]
    plan = places(best_two_fit(counts, capacity), capacity)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    ranked = running(pieces, ["length", *order], {"_rank": F.lit(1).cast("bigint")})
    keys = (plan["length"] << RANK_BITS) + plan["rank"]

    def run(batches):
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() - 1 - first[size]
            row = np.searchsorted(keys, (size << RANK_BITS) + rank, side="right") - 1
            nth = rank - plan["rank"][row]
            each = plan["pieces"][row]
            bin_, at = plan["bin"][row] + nth // each, plan["at"][row] + nth % each * size
            kept = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bin_, pa.int64()), pa.array(at, pa.int64())], names=names)

    names = [*pieces.columns, "sequence_id", "offset"]
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences."""
    pieces = stored(token_pieces(docs, "doc_id", "text", tokenizer, capacity), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_two_fit(spark, sf_dir) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
