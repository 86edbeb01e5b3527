"""Scalar kinds and exact modular arithmetic as Column expressions.

Everything here is right with ANSI mode on or off: no expression relies on silent overflow. Sixty-four-bit
results are made from limbs that stay in BIGINT, so they run in generated code; unsigned 64-bit values
are kept as BIGINT bit patterns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW32 = 0xFFFFFFFF
SIGN = -(1 << 63)


@dataclass(frozen=True)
class Kind:
    """A scalar kind: its width in bits and whether it is signed."""

    name: str
    bits: int
    signed: bool

    @property
    def spark(self) -> str:
        """The column type that holds it."""
        if self.bits == 1:
            return "tinyint"
        return {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[self.bits] if self.signed or self.bits == 64 else {8: "smallint", 16: "int", 32: "bigint"}[self.bits]


BIT = Kind("bit", 1, False)
U8, I8, U16, I16 = Kind("u8", 8, False), Kind("i8", 8, True), Kind("u16", 16, False), Kind("i16", 16, True)
U32, I32, U64, I64 = Kind("u32", 32, False), Kind("i32", 32, True), Kind("u64", 64, False), Kind("i64", 64, True)
KINDS = {k.name: k for k in (BIT, U8, I8, U16, I16, U32, I32, U64, I64)}


def kind(name: str | Kind) -> Kind:
    if isinstance(name, Kind):
        return name
    if name in ("u128", "i128"):
        raise ValueError(f"{name} values are structs of two halves; see functions.wide")
    return KINDS[name]


def _long(x: Column) -> Column:
    return x.cast("bigint")


def wrap(x: Column, k: Kind) -> Column:
    """A BIGINT expression brought into the range of a kind of at most 32 bits; 64-bit values stay."""
    if k.bits == 64:
        return _long(x)
    size = 1 << k.bits
    if k.signed:
        return (F.pmod(_long(x) + (size >> 1), F.lit(size)) - (size >> 1)).cast(k.spark)
    return F.pmod(_long(x), F.lit(size)).cast(k.spark)


def _upper(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def sum64(*terms: Column) -> Column:
    """The sum of a few columns modulo 2^64 on bit patterns. One sum of many terms is smaller than nested ones."""
    longs = [_long(t) for t in terms]
    low = reduce(lambda a, b: a + b, [t.bitwiseAND(F.lit(LOW32)) for t in longs])
    high = reduce(lambda a, b: a + b, [*map(_upper, longs), _upper(low)])
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))


def add64(a: Column, b: Column) -> Column:
    return sum64(a, b)


def neg64(a: Column) -> Column:
    return add64(F.bitwise_not(_long(a)), F.lit(1))


def sub64(a: Column, b: Column) -> Column:
    return sum64(a, F.bitwise_not(_long(b)), F.lit(1))


def mul64(a: Column, b: Column) -> Column:
    """a * b modulo 2^64: halves of a times quarters of b, whose products and their sums fit a BIGINT."""
    a, b = _long(a), _long(b)
    low16 = lambda x: x.bitwiseAND(F.lit(0xFFFF))
    a0, a1 = a.bitwiseAND(F.lit(LOW32)), _upper(a)
    b0, b1, b2, b3 = low16(b), low16(F.shiftrightunsigned(b, 16)), low16(_upper(b)), F.shiftrightunsigned(b, 48)
    cross = a0 * b1
    low = a0 * b0 + F.shiftleft(low16(cross), 16)
    high = _upper(low) + F.shiftrightunsigned(cross, 16) + a0 * b2 + a1 * b0 + F.shiftleft(low16(a0 * b3) + low16(a1 * b1), 16)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))


def add(a: Column, b: Column, k: Kind) -> Column:
    if k.bits == 1:
        return a.bitwiseXOR(b)
    return add64(_long(a), _long(b)) if k.bits == 64 else wrap(_long(a) + _long(b), k)


def add_all(terms: list[Column], k: Kind) -> Column:
    return sum64(*terms) if k.bits == 64 else reduce(lambda a, b: add(a, b, k), terms)


def subtract(a: Column, b: Column, k: Kind) -> Column:
    if k.bits == 1:
        return a.bitwiseXOR(b)
    return sub64(_long(a), _long(b)) if k.bits == 64 else wrap(_long(a) - _long(b), k)


def multiply(a: Column, b: Column, k: Kind) -> Column:
    """Products of 32-bit kinds may pass 2^63, so they are made as 64-bit ones; 2^32 divides 2^64."""
    if k.bits == 1:
        return a.bitwiseAND(b)
    if k.bits >= 32 and not (k.bits == 32 and k.signed):
        whole = mul64(_long(a), _long(b))
        return whole if k.bits == 64 else whole.bitwiseAND(F.lit((1 << k.bits) - 1)).cast(k.spark)
    return wrap(_long(a) * _long(b), k)


def mixed_multiply(x: Column, bit: Column) -> Column:
    """An integer times a bit."""
    return F.when(bit.cast("int") == 1, x).otherwise(F.lit(0).cast("bigint"))


def quotient(a: Column, b: Column | int) -> Column:
    """a div b toward zero, as BIGINT, for b that isn't zero; the least value by -1 wraps."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return F.when((a == F.lit(SIGN)) & (b == -1), a).otherwise(F.call_function("div", a, F.when((a == F.lit(SIGN)) & (b == -1), F.lit(1)).otherwise(b)))


def truncate(x: Column, scale: int, k: Kind = I64) -> Column:
    """Division by a positive constant, toward zero for signed kinds."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    if k.bits == 64 and not k.signed:
        return unsigned_divmod(x, F.lit(scale).cast("bigint"))[0] if scale < 1 << 63 else F.lit(0).cast("bigint")
    if scale >= 1 << 63:
        return F.lit(0).cast("bigint")
    return F.call_function("div", _long(x), F.lit(scale).cast("bigint")).cast(k.spark)


def unsigned_divmod(a: Column, b: Column) -> tuple[Column, Column]:
    """Quotient and remainder of unsigned 64-bit patterns for b > 0 as a signed number; a may be any pattern."""
    half = F.call_function("div", F.shiftrightunsigned(a, 1), b)
    guess = F.shiftleft(half, 1)
    rest = sub64(a, mul64(guess, b))
    over = less_unsigned(rest, b)
    return F.when(over, guess).otherwise(guess + 1), F.when(over, rest).otherwise(sub64(rest, b))


def flip(x: Column, k: Kind) -> Column:
    """A key whose signed order is the kind's order."""
    return _long(x).bitwiseXOR(F.lit(SIGN)) if k.bits == 64 and not k.signed else _long(x)


def less_unsigned(a: Column, b: Column) -> Column:
    return flip(a, U64) < flip(b, U64)


def sum_wrapped(x: Column, k: Kind = I64) -> Column:
    """An aggregate: the sum modulo 2^bits. Decimal(28) inputs give a decimal(38) sum, which holds 10^19 rows."""
    return wrap_decimal(F.sum(x.cast("decimal(28,0)")), k)


def wrap_decimal(x: Column, k: Kind = I64) -> Column:
    """An exact decimal brought into the range of a kind, as its column type."""
    if k.bits == 1:
        return F.pmod(x, F.lit(2).cast("decimal(38,0)")).cast("tinyint")
    size = F.lit(str(1 << k.bits)).cast("decimal(38,0)")
    if k.signed or k.bits == 64:
        half = F.lit(str(1 << (k.bits - 1))).cast("decimal(38,0)")
        return (F.pmod((x + half).cast("decimal(38,0)"), size) - half).cast("bigint").cast(k.spark)
    return F.pmod(x.cast("decimal(38,0)"), size).cast("bigint").cast(k.spark)
