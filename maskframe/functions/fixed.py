"""Fixed-point functions: integers that stand for x * 2^f.

Iterations are unrolled into one expression each step of which stands in a one-element lambda, so a step's
result is computed once however often the next one uses it. In the ranges that their functions take, the
steps' products fit a BIGINT, so they use plain arithmetic; with ANSI mode on, arguments far beyond the
range fail instead of giving garbage.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import bit_length
from .scalars import I64, SIGN, Kind, add64, mul64, quotient, sub64, unsigned_divmod

FRACTION = 15


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def encode(x: Column, f: int = FRACTION) -> Column:
    """round(x * 2^f)."""
    return F.round(x * float(1 << f)).cast("bigint")


def decode(x: Column, f: int = FRACTION) -> Column:
    return x / float(1 << f)


def fixed_multiply(a: Column, b: Column, f: int = FRACTION, debug: bool = False) -> Column:
    """a * b / 2^f toward zero, modulo 2^64 before the division; `debug` fails where the product isn't safe."""
    out = F.call_function("div", mul64(a, b), F.lit(1 << f).cast("bigint"))
    if debug:
        out = F.when(multiplication_safe(a, b), out).otherwise(F.raise_error("multiplication may overflow").cast("bigint"))
    return out


def multiplication_safe(a: Column, b: Column) -> Column:
    """No two set bits i and j, signs folded away, with i + j >= 56.

    The largest such sum is that of the highest bits, so only they count."""
    fold = lambda x: F.when(x < 0, F.bitwise_not(x)).otherwise(x)
    x, y = fold(a), fold(b)
    return (x == 0) | (y == 0) | (bit_length(x) + bit_length(y) - 2 < 56)


def floor_divide(a: Column, b: Column, k: Kind = I64) -> tuple[Column, Column]:
    """Quotient toward minus infinity and remainder with the divisor's sign; 0/0 is (0, 0) and x/0 is (0, x)."""
    if k.bits == 64 and not k.signed:
        q, r = unsigned_divmod(a, F.when(b == 0, F.lit(1)).otherwise(b))
        large = b < 0  # 2^63 or more: the quotient is 0 or 1
        once = a.bitwiseXOR(F.lit(SIGN)) >= b.bitwiseXOR(F.lit(SIGN))
        q = F.when(b == 0, F.lit(0)).when(large, once.cast("bigint")).otherwise(q)
        return q, F.when(b == 0, a).when(large, F.when(once, sub64(a, b)).otherwise(a)).otherwise(r)
    a, b = a.cast("bigint"), b.cast("bigint")
    safe = F.when(b == 0, F.lit(1).cast("bigint")).otherwise(b)
    low = (a == F.lit(SIGN)) & (b == -1)
    rest = F.when(low, F.lit(0)).otherwise(a % F.when(low, F.lit(1)).otherwise(safe))
    off = (rest != 0) & ((a < 0) != (safe < 0))
    q = quotient(a, safe) - off.cast("bigint")
    r = rest + F.when(off, safe).otherwise(F.lit(0).cast("bigint"))
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(q).cast(k.spark), F.when(b == 0, a).otherwise(r).cast(k.spark)


def _shift_down(x: Column, cap: int) -> Column:
    return F.call_function("div", x, F.lit(1 << cap).cast("bigint"))


# Fixed recipes: starting guesses, the order of truncations and the numbers of steps decide the last bits of
# these functions, and are as results to be matched have them.


def inverse_guess(x: Column, cap: int) -> Column:
    """2^(cap-1-k) for the highest set bit k of x in (0, 2^cap); 0 for others."""
    if cap == 0:
        return F.lit(1).cast("bigint")
    k = bit_length(x) - 1
    return F.when((x > 0) & (k < cap), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(cap - 1) - k).cast("int"))).otherwise(F.lit(0).cast("bigint"))


def goldschmidt_divide(dividend: Column, divisor: Column, iterations: int = 5, cap: int = 10, guess: Column | None = None) -> Column:
    """About dividend * 2^cap / divisor for positive numbers below 2^cap (divisor)."""
    two = F.lit(1 << (cap + 1)).cast("bigint")

    def step(a: Column, b: Column, left: int) -> Column:
        if not left:
            return a
        w = two - b
        pair = F.struct(_shift_down(a * w, cap).alias("a"), _shift_down(b * w, cap).alias("b"))
        return let(pair, lambda p: step(p["a"], p["b"], left - 1))

    w = inverse_guess(divisor, cap) if guess is None else guess
    first = let(w, lambda w: F.struct((dividend * w).alias("a"), (divisor * w).alias("b")))
    return let(first, lambda p: step(p["a"], p["b"], iterations - 1))


def precise_divide(num: Column, den: Column, cap: int = 30, iterations: int = 7) -> Column:
    """Goldschmidt division with exact wide intermediates, without the scale: about num / den * 2^cap, then / 2^cap.

    For 0 <= num < 2^50 and 0 < den < 2^cap the products stay below 2^115, within decimal(38,0)."""
    wide = "decimal(38,0)"
    two, one = F.lit(str(1 << (cap + 1))).cast(wide), F.lit(str(1 << cap)).cast(wide)
    down = lambda x: ((x - F.pmod(x, one)) / one).cast(wide)
    guess = inverse_guess(den, cap).cast(wide)

    def step(a: Column, b: Column, left: int) -> Column:
        if not left:
            return a
        w = (two - b).cast(wide)
        pair = F.struct(down((a * w).cast(wide)).alias("a"), down((b * w).cast(wide)).alias("b"))
        return let(pair, lambda p: step(p["a"], p["b"], left - 1))

    first = F.struct((num.cast(wide) * guess).cast(wide).alias("a"), (den.cast(wide) * guess).cast(wide).alias("b"))
    return down(let(first, lambda p: step(p["a"], p["b"], iterations - 1))).cast("bigint")


def newton_inverse(x: Column, iterations: int = 5, cap: int = 10, guess: Column | None = None) -> Column:
    """About 2^cap / x for x in (0, 2^cap)."""
    two = F.lit(1 << (cap + 1)).cast("bigint")

    def step(y: Column, left: int) -> Column:
        if not left:
            return y
        return let(_shift_down((two - y * x) * y, cap), lambda z: step(z, left - 1))

    return let(inverse_guess(x, cap) if guess is None else guess, lambda y: step(y, iterations))


def inverse_sqrt(x: Column, iterations: int = 5, cap: int = 10, guess: Column | None = None) -> Column:
    """About 2^cap / sqrt(x) for x in (0, 4^cap), cap from 2 to 31."""
    if not 2 <= cap <= 31:
        raise ValueError("cap must be from 2 to 31")
    half3 = F.lit(3 << (cap - 1)).cast("bigint")
    digit = F.floor((bit_length(x) - 1) / 2).cast("int")  # the highest base-4 digit that isn't zero
    first = F.when((x > 0) & (digit < cap), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(cap - 1) - digit)).otherwise(F.lit(0).cast("bigint"))

    def step(y: Column, left: int) -> Column:
        if not left:
            return y
        term = F.call_function("div", x * y * y, F.lit(1 << (cap + 1)).cast("bigint"))
        return let(_shift_down((half3 - term) * y, cap), lambda z: step(z, left - 1))

    return let(first if guess is None else guess, lambda y: step(y, iterations))


def taylor_exp(x: Column, terms: int = 5, f: int = FRACTION) -> Column:
    """exp of a fixed-point number: powers of two for the integer part, a Taylor sum for the fraction, 0 below -10."""
    per_ln2 = int((1 << f) / math.log(2))
    ln2 = int(math.log(2) * (1 << f))
    top = math.ceil(math.log2(31 - f))
    scaled = F.call_function("div", x * per_ln2, F.lit(1 << f).cast("bigint"))

    def whole(z: Column) -> Column:
        power = F.lit(1).cast("bigint")
        for j in range(top):
            power = power * F.when(F.shiftright(z, f + j).bitwiseAND(F.lit(1)) == 1, F.lit(1 << (1 << j)).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
        y = F.call_function("div", z.bitwiseAND(F.lit((1 << f) - 1)) * ln2, F.lit(1 << f).cast("bigint"))

        def series(y: Column, coef: Column, total: Column, i: int) -> Column:
            total = total + coef
            if i == terms - 1:
                return total
            return let(F.call_function("div", coef * y, F.lit((i + 1) << f).cast("bigint")), lambda c: series(y, c, total, i + 1))

        fraction = F.lit(1).cast("bigint") if f == 0 else let(y, lambda y: series(y, F.lit(1 << f).cast("bigint"), F.lit(0).cast("bigint"), 0))
        up = fraction * power
        down = let(up, lambda u: F.when(z < 0, F.call_function("div", u, F.lit(1 << (1 << top)).cast("bigint"))).otherwise(u))
        return F.when(z >= -10 * (1 << f), down).otherwise(F.lit(0).cast("bigint"))

    return let(scaled, whole)


# Piecewise-linear functions ---------------------------------------------------------------------


def _sigmoid(x: np.float32) -> np.float32:
    return np.float32(1) / (np.float32(1) + np.exp(-x, dtype=np.float32))


def _gelu(x: np.float32) -> np.float32:
    c = np.float32(math.sqrt(2 / math.pi))
    return np.float32(0.5) * x * (np.float32(1) + np.tanh(c * (x + np.float32(0.044715) * x * x * x), dtype=np.float32))


def _gelu_slope(x: np.float32) -> np.float32:
    c, d = np.float32(math.sqrt(2 / math.pi)), np.float32(0.044715)
    t = np.tanh(c * (x + d * x * x * x), dtype=np.float32)
    return np.float32(0.5) * (np.float32(1) + t) + np.float32(0.5) * x * (np.float32(1) - t * t) * c * (np.float32(1) + np.float32(3) * d * x * x)


# The curves' bounds, flat sides and bucket bits; knots in single precision.
#: Function, left, right, flat to the left, flat to the right, default number of bucket bits.
CURVES: dict[str, tuple[Callable, float, float, bool, bool, int]] = {
    "exp": (lambda x: np.exp(x, dtype=np.float32), -16.0, 16.0, True, False, 6),
    "sigmoid": (_sigmoid, -8.0, 8.0, True, True, 5),
    "gelu": (_gelu, -4.0, 4.0, True, False, 5),
    "gelu_slope": (_gelu_slope, -4.0, 4.0, True, True, 5),
}


def _toward_zero(a: int, b: int) -> int:
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def curve_table(name: str, f: int = FRACTION, bucket_bits: int | None = None) -> tuple[list[int], list[int], int, int]:
    """Slopes and offsets for each bucket with one more at either side, the left bound and the bucket's width, all in fixed point.

    Knots are taken in single precision, one before the left bound and one after the right one."""
    of, left, right, flat_left, flat_right, default = CURVES[name]
    scale = 1 << (bucket_bits or default)
    one = np.float32(1 << f)
    knots = [np.float32(left) + np.float32(right - left) * np.float32(i) / np.float32(scale) for i in range(-1, scale + 2)]
    xs, ys = [int(k * one) for k in knots], [int(np.float32(of(k)) * one) for k in knots]
    slopes = [_toward_zero((y1 - y0) << f, x1 - x0) for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:])]
    offsets = [(y0 << f) - s * x0 for s, x0, y0 in zip(slopes, xs, ys)]
    if flat_left:
        slopes[0], offsets[0] = 0, ys[0] << f
    if flat_right:
        slopes[-1], offsets[-1] = 0, ys[-2] << f
    return slopes, offsets, int(left * (1 << f)), int((right - left) * (1 << f)) // scale


def approximate(name: str, x: Column, f: int = FRACTION, bucket_bits: int | None = None) -> Column:
    """A curve at a fixed-point number by a table of lines; the bucket is found by one division toward zero."""
    slopes, offsets, left, width = curve_table(name, f, bucket_bits)
    last = len(slopes) - 1
    at = F.call_function("div", sub64(x, F.lit(left)), F.lit(width).cast("bigint"))
    place = F.when(at < 0, F.lit(0)).otherwise(F.least(at + 1, F.lit(last).cast("bigint"))).cast("int")
    # Constant arrays and no lambda: all of it runs in generated code, which computes the place once.
    slope, offset = (F.get(F.array(*(F.lit(v).cast("bigint") for v in t)), place) for t in (slopes, offsets))
    return F.call_function("div", add64(mul64(slope, x), offset), F.lit(1 << f).cast("bigint"))
