"""Bits as little-endian arrays of TINYINT, and the comparison and selection operators.

`Bits` remembers the integer it was made from, so a conversion there and back costs nothing; comparisons
work on the integer itself and never on single bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import I64, Kind, add64, flip, less_unsigned


@dataclass(frozen=True)
class Bits:
    """The bits of an integer column of a kind."""

    value: Column
    kind: Kind

    def array(self) -> Column:
        # A lambda over the places: an array of as many expressions is too much for one generated method and slower.
        x = self.value.cast("bigint")
        return F.transform(F.sequence(F.lit(0), F.lit(self.kind.bits - 1)), lambda i: F.call_function("shiftright", x, i).bitwiseAND(F.lit(1)).cast("tinyint"))


def a2b(x: Column, k: Kind) -> Bits:
    return Bits(x, k)


def b2a(bits: Bits | Column, k: Kind) -> Column:
    """The integer of some bits; those of a `Bits` come back as they were."""
    if isinstance(bits, Bits):
        if bits.kind.bits != k.bits:
            raise ValueError(f"{bits.kind.bits} bits can't become {k.name}")
        return bits.value
    placed = F.transform(bits, lambda x, i: F.call_function("shiftleft", x.cast("bigint"), i))
    whole = F.aggregate(placed, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))
    if k.signed and k.bits < 64:
        whole = F.shiftright(F.shiftleft(whole, 64 - k.bits), 64 - k.bits)
    return whole.cast(k.spark)


def _bit(c: Column) -> Column:
    return c.cast("tinyint")


def greater(a: Column, b: Column, k: Kind) -> Column:
    return _bit(flip(a, k) > flip(b, k))


def less(a: Column, b: Column, k: Kind) -> Column:
    return _bit(flip(a, k) < flip(b, k))


def greater_equal(a: Column, b: Column, k: Kind) -> Column:
    return _bit(flip(a, k) >= flip(b, k))


def less_equal(a: Column, b: Column, k: Kind) -> Column:
    return _bit(flip(a, k) <= flip(b, k))


def equal(a: Column, b: Column) -> Column:
    return _bit(a == b)


def not_equal(a: Column, b: Column) -> Column:
    return _bit(a != b)


def not_(a: Column) -> Column:
    return _bit(1 - a)


def or_(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def minimum(a: Column, b: Column, k: Kind) -> Column:
    return F.when(flip(a, k) <= flip(b, k), a).otherwise(b)


def maximum(a: Column, b: Column, k: Kind) -> Column:
    return F.when(flip(a, k) >= flip(b, k), a).otherwise(b)


def mux(flag: Column, one: Column, zero: Column) -> Column:
    """`one` where the flag is 1, else `zero`, for bits and integers alike."""
    return F.when(flag.cast("int") == 1, one).otherwise(zero)


def clip_2k(x: Column, k: int, of: Kind = I64) -> Column:
    """x held between 0 and 2^k, for a signed kind with at least k + 2 bits."""
    if k > of.bits - 2:
        raise ValueError("k is too large")
    return F.least(F.greatest(x.cast("bigint"), F.lit(0).cast("bigint")), F.lit(1 << k).cast("bigint"))


def binary_add(a: Column, b: Column, k: Kind) -> tuple[Column, Column]:
    """Sum of unsigned bit patterns of the kind's width, and the carry out."""
    if k.bits == 64:
        total = add64(a.cast("bigint"), b.cast("bigint"))
        return total, _bit(less_unsigned(total, a.cast("bigint")))
    mask = F.lit((1 << k.bits) - 1).cast("bigint")
    whole = a.cast("bigint").bitwiseAND(mask) + b.cast("bigint").bitwiseAND(mask)
    return whole.bitwiseAND(mask), _bit(F.shiftright(whole, k.bits))


def one_hot(x: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _bit(i == x))


def cumulative_or(bits: Column) -> Column:
    """For each bit, whether it or a higher one is set."""
    n = F.size(bits)
    return F.transform(bits, lambda _, i: F.array_max(F.slice(bits, i + 1, n - i)))


def reduce_mul(bits: Column) -> Column:
    """The AND of an array of bits."""
    return F.aggregate(bits, F.lit(1).cast("tinyint"), lambda acc, x: acc.bitwiseAND(x))


def bit_length(x: Column) -> Column:
    """The place of the highest set bit plus one, for positive x; exact, unlike a logarithm."""
    return F.length(F.bin(x))
