"""Replayable randomness as plain integer arithmetic.

``unit(seed, id, pos)`` is a number in [0, 1) that depends on nothing but its
arguments, so a lost task recomputes the same draw. Each argument is folded in with
``y -> y**5 mod (2**31 - 1)`` (a permutation, because gcd(5, p - 1) = 1); all
intermediate products fit into a signed 64-bit integer, so any SQL engine gives the
same values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from seqspark.functions.arrays import let

P = 2147483647
MUL = 16807
ADD = 12345


def _fifth(y: Column) -> Column:
    return let(y, lambda v: let(v * v % P, lambda square: square * square % P * v % P))


def fold(acc, value) -> Column:
    """Mix one more value (in [0, p): an index or a salt) into a running hash."""
    acc = F.lit(acc).cast("bigint") if isinstance(acc, int) else acc
    return _fifth((acc * MUL + ADD + value) % P)


def base(seed: int, *values: Column) -> Column:
    """Hash of a seed and columns in [0, p); computed once per row for ``fold`` in lambdas."""
    acc = pow((seed * MUL + ADD) % P, 5, P)
    for value in values:
        acc = fold(acc, F.pmod(value.cast("bigint"), F.lit(P)))
    return acc if isinstance(acc, Column) else F.lit(acc).cast("bigint")


def unit(seed: int, *values: Column) -> Column:
    """Uniform number in [0, 1)."""
    return base(seed, *values) / F.lit(float(P))


def fold_unit(acc: Column, value) -> Column:
    return fold(acc, value) / F.lit(float(P))


# The same on NumPy arrays of whole numbers, for functions over Arrow batches.


def folds(acc: np.ndarray, value) -> np.ndarray:
    y = (acc * np.int64(MUL) + ADD + value) % P
    square = y * y % P
    return square * square % P * y % P


def units(acc: np.ndarray, value) -> np.ndarray:
    return folds(acc, value) / float(P)
