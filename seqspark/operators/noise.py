"""Word-level noise on arrays of pieces; every function is Column in, Column out.

Pieces are grouped into words first (``words_of``); dropping, blanking and moving then
act on whole words and stay inside the row. ``acc`` is the row's hash (seed and ids).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from seqspark.consts import BPE_MARK
from seqspark.functions.arrays import let
from seqspark.functions.hashing import fold_unit, folds, units
from seqspark.session import fenced

END = "</s>"
UNKNOWN = "<unk>"


def words_of(pieces: Column, mark: str | None = BPE_MARK, end_mark: str | None = None) -> Column:
    """``[how, y@@, ou]`` to ``[[how], [y@@, ou]]``."""
    if not mark and not end_mark:
        return F.transform(pieces, lambda p: F.array(p))

    def closed(p: Column) -> Column:
        return ~p.endswith(mark) if mark else p.endswith(end_mark)

    def cut(p: Column) -> Column:
        places = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | closed(F.get(p, i - 1)))
        return let(
            starts,
            lambda s: F.transform(s, lambda a, i: F.slice(p, a + 1, F.coalesce(F.get(s, i + 1), F.size(p)) - a)),
        )

    return let(pieces, cut)


def word_index(pieces: Column, mark: str | None = BPE_MARK, end_mark: str | None = None) -> Column:
    """Index of the word each piece belongs to."""
    return F.flatten(F.transform(words_of(pieces, mark, end_mark), lambda w, i: F.array_repeat(i, F.size(w))))


def _ended(words: Column) -> Column:
    """Does the last word carry the end mark?"""
    last = F.get(words, F.size(words) - 1)
    return F.coalesce(F.get(last, F.size(last) - 1) == END, F.lit(False))


def _drop_words(words: Column, p: float, acc: Column, blank: str | None, regroup) -> Column:
    def thin(n: Column) -> Column:
        if blank is None:
            return F.filter(words, lambda w, i: (i == n) | (fold_unit(acc, i) >= p))
        return F.transform(
            words, lambda w, i: F.when((i == n) | (fold_unit(acc, i) >= p), w).otherwise(F.array_repeat(F.lit(blank), F.size(w)))
        )

    def guard(out: Column) -> Column:
        few = (F.size(out) <= 1) & (F.size(F.flatten(out)) <= 1) & (F.size(words) > 0)
        all_ = F.flatten(words)
        spare = F.get(all_, F.floor(fold_unit(acc, 1_000_000_007) * F.size(all_)).cast("int"))
        return F.when(few, regroup(F.concat(F.array(spare), F.flatten(out)))).otherwise(out)

    pinned = F.when(_ended(words), F.size(words) - 1).otherwise(F.lit(-1))
    return let(let(pinned, thin), guard)


def _shuffle_words(words: Column, k: int, acc: Column) -> Column:
    keyed = F.transform(
        words,
        lambda w, i: F.struct(
            (i + F.when(i == 0, F.lit(-1.0)).otherwise(fold_unit(acc, i) * k)).alias("key"), i.alias("i"), w.alias("w")
        ),
    )
    return F.transform(F.sort_array(keyed), lambda s: s["w"])


def word_dropout(
    pieces: Column, p: float, acc: Column, blank: str | None = None, mark: str | None = BPE_MARK, end_mark: str | None = None
) -> Column:
    """Drop (or blank) whole words with probability ``p``; the end mark always stays.

    When at most one piece is left, one random original piece is put in front.
    """
    if p == 0:
        return pieces

    def regroup(x: Column) -> Column:
        return words_of(x, mark, end_mark)

    nested = F.struct(regroup(pieces).alias("w"), acc.alias("acc"))
    return F.flatten(let(nested, lambda x: _drop_words(x["w"], p, x["acc"], blank, regroup)))


def word_shuffle(pieces: Column, k: int, acc: Column, mark: str | None = BPE_MARK, end_mark: str | None = None) -> Column:
    """Sort words by index plus a draw in [0, k); the first word and the end mark stay."""
    if k == 0:
        return pieces
    if k <= 1:
        raise ValueError("the shuffle distance is 0 or greater than 1")

    def run(x: Column) -> Column:
        p = x["p"]
        ended = F.coalesce(F.get(p, F.size(p) - 1) == END, F.lit(False))
        body = F.when(ended, F.slice(p, 1, F.size(p) - 1)).otherwise(p)
        tail = F.when(ended, F.array(F.lit(END))).otherwise(F.array().cast("array<string>"))
        moved = let(words_of(body, mark, end_mark), lambda w: _shuffle_words(w, k, x["acc"]))
        return F.concat(F.flatten(moved), tail)

    return let(F.struct(pieces.alias("p"), acc.alias("acc")), run)


def noise(pieces: str, acc: str, distance: int, dropout: float, blanking: float, mark: str | None = BPE_MARK):
    """``DataFrame.transform`` step: shuffle, then drop, then blank, each with its own salt.

    All three at once on the flat pieces of an Arrow batch; results are those of
    ``word_shuffle`` and ``word_dropout`` one after the other; a null row becomes empty.
    """
    if distance and distance <= 1:
        raise ValueError("the shuffle distance is 0 or greater than 1")

    @F.arrow_udf("array<string>")
    def noised(batch: pa.Array, seeds: pa.Array) -> pa.Array:
        return _noised(batch, seeds, distance, dropout, blanking, mark)

    def run(df):
        return fenced(df, pieces, acc).withColumn(pieces, noised(F.col(pieces), F.col(acc))).select(*df.columns)

    return run


class _Words:
    """Pieces (positions in a flat array) of rows, with the word each belongs to."""

    def __init__(self, at: np.ndarray, row: np.ndarray, rows: int, closed: np.ndarray):
        self.at, self.row, self.rows = at, row, rows
        self.size = np.bincount(row, minlength=rows)
        self.first = np.cumsum(self.size) - self.size
        opens = np.ones(len(at), bool)
        opens[1:] = (row[1:] != row[:-1]) | closed[at[:-1]]
        number = np.cumsum(opens)
        self.opens = opens
        self.word = number - (number[self.first[row]] if len(at) else 0)

    def last(self) -> np.ndarray:
        """Is the piece the last of its row?"""
        return np.arange(len(self.at)) == (self.first + self.size - 1)[self.row]


def _noised(batch: pa.Array, seeds: pa.Array, distance: int, dropout: float, blanking: float, mark: str | None) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, rows = batch.flatten(), len(batch)
    acc = pc.fill_null(seeds, 0).to_numpy(zero_copy_only=False)
    closed = np.ones(len(flat), bool)
    if mark:
        closed = ~pc.fill_null(pc.ends_with(flat, mark), False).to_numpy(zero_copy_only=False)
    ended = pc.fill_null(pc.equal(flat, END), False).to_numpy(zero_copy_only=False)
    at, row = np.arange(len(flat)), np.repeat(np.arange(rows), sizes)
    if distance:
        every = _Words(at, row, rows, closed)
        tail = every.last() & ended[at]
        body = _Words(at[~tail], row[~tail], rows, closed)
        key = np.full(len(at), np.inf)
        draw = units(folds(acc, 101)[body.row], body.word) * distance
        key[~tail] = body.word + np.where(body.word == 0, -1.0, draw)
        word = np.zeros(len(at), np.int64)
        word[~tail] = body.word
        order = np.lexsort((at, word, key, row))
        at, row = at[order], row[order]
    for salt, p, blank in ((102, dropout, False), (103, blanking, True)):
        if p:
            at, row = _thinned(_Words(at, row, rows, closed), folds(acc, salt), p, blank, ended, len(flat))
            closed, ended = np.append(closed[: len(flat)], True), np.append(ended[: len(flat)], False)
    values = pc.take(pa.concat_arrays([flat, pa.array([UNKNOWN], flat.type)]), pa.array(at))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _thinned(w: _Words, acc: np.ndarray, p: float, blank: bool, ended: np.ndarray, unknown: int):
    """Pieces after dropping (or blanking) words; too short rows get a spare piece in front."""
    last_word = np.zeros(w.rows, np.int64) - 1
    tail = w.last()
    last_word[w.row[tail]] = np.where(ended[w.at[tail]], w.word[tail], -1)
    keep = (w.word == last_word[w.row]) | (units(acc[w.row], w.word) >= p)
    out, row = (np.where(keep, w.at, unknown), w.row) if blank else (w.at[keep], w.row[keep])
    words = np.bincount(w.row[w.opens & (keep | blank)], minlength=w.rows)
    few = np.flatnonzero((words <= 1) & (np.bincount(row, minlength=w.rows) <= 1) & (w.size > 0))
    spare = w.at[w.first[few] + np.floor(units(acc[few], np.int64(1_000_000_007)) * w.size[few]).astype(np.int64)]
    out, row = np.concatenate([spare, out]), np.concatenate([few, row])
    order = np.argsort(row, kind="stable")
    return out[order], row[order]
