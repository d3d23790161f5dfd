"""Row-local sequence functions over ``array<int>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seqspark.consts import EOS, PAD, UNK


def let(value: Column, body) -> Column:
    """Bind a row-level value to a lambda variable, so that it is computed once per row.

    A plain expression inside ``transform`` or ``filter`` would be evaluated again for each
    element, and the optimizer may inline a helper column back into the lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ints(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def drop_last(t: Column) -> Column:
    return F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))


def last(t: Column) -> Column:
    return F.get(t, F.size(t) - 1)


def append_eos(t: Column, eos: int = EOS) -> Column:
    return F.concat(t, ints(eos))


def ends_with(t: Column, eos: int = EOS) -> Column:
    return F.coalesce(last(t) == eos, F.lit(False))


def ensure_eos(t: Column, eos: int = EOS) -> Column:
    return F.when(ends_with(t, eos), t).otherwise(append_eos(t, eos))


def strip_eos(t: Column, eos: int = EOS) -> Column:
    return F.when(ends_with(t, eos), drop_last(t)).otherwise(t)


def pad_to(t: Column, width: Column, left: bool, pad: int = PAD) -> Column:
    fill = F.array_repeat(F.lit(pad).cast("int"), (width - F.size(t)).cast("int"))
    return F.concat(fill, t) if left else F.concat(t, fill)


def eos_to_front(t: Column, eos: int = EOS) -> Column:
    """Teacher-forcing input; fails on a row that does not end with EOS."""
    rotated = F.concat(ints(eos), drop_last(t))
    return F.when(ends_with(t, eos), rotated).otherwise(
        F.raise_error("sequence does not end with EOS").cast("array<int>")
    )


def strip_pad(t: Column, pad: int = PAD) -> Column:
    return F.array_remove(t, F.lit(pad).cast("int"))


def flip_padding(t: Column, to_left: bool, pad: int = PAD) -> Column:
    return pad_to(strip_pad(t, pad), F.size(t), to_left, pad)


def position_ids(t: Column, pad: int = PAD) -> Column:
    """``pad`` stays, the i-th other position becomes ``pad + i``.

    Padding sits on one side, so the offset of the first real token is the number of
    leading pads.
    """
    lead = F.greatest(_first_other(t, pad), F.lit(1)).cast("int") - 1
    return let(
        lead,
        lambda n: F.transform(
            t, lambda x, i: F.when(x == pad, F.lit(pad)).otherwise(i - n + pad + 1).cast("int")
        ),
    )


def _first_other(t: Column, pad: int) -> Column:
    flags = F.transform(t, lambda x: (x != pad).cast("int"))
    return F.array_position(flags, F.lit(1))


def truncate_vocab(t: Column, size: int, unk: int = UNK) -> Column:
    return F.transform(t, lambda x: F.when(x >= size, F.lit(unk)).otherwise(x).cast("int"))
