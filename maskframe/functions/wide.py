"""128-bit integers as structs of two BIGINT halves (hi, lo): arithmetic modulo 2^128, comparison, division.

Both halves are bit patterns, and lo is always unsigned. Nothing relies on silent overflow, so results
don't depend on ANSI mode. Expressions name a half more than once; generated code computes it once.

`multiply`, `multiply64` and `floor_divide` take any operands and bind them in lambdas, which Spark interprets.
`product` and `product64` stay in generated code but name an operand dozens of times, so theirs should be
columns: `with_halves` puts intermediate results into columns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import let
from .scalars import SIGN, add64, flip, less_unsigned, mul64, sub64, sum64

I128, U128 = "i128", "u128"
TYPE = "struct<hi:bigint,lo:bigint>"


def wide(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))


def literal(x: int) -> Column:
    """A constant from -2^127 to 2^128 - 1."""
    if not -(1 << 127) <= x < 1 << 128:
        raise ValueError(f"{x} has more than 128 bits")
    half = lambda v: F.lit(v - (1 << 64) if v >= 1 << 63 else v)
    return wide(half((x >> 64) & ((1 << 64) - 1)), half(x & ((1 << 64) - 1)))


def from_signed(x: Column) -> Column:
    """A BIGINT with its sign carried on."""
    return wide(F.shiftright(x.cast("bigint"), 63), x)


def from_unsigned(x: Column) -> Column:
    """A 64-bit pattern, unsigned."""
    return wide(F.lit(0), x)


def with_halves(df: DataFrame, **values: Column) -> DataFrame:
    """Each value as two columns, name_hi and name_lo; named apart, they aren't merged with what uses them."""
    return df.withColumns({f"{n}_{h}": v[h] for n, v in values.items() for h in ("hi", "lo")})


def named(name: str) -> Column:
    """The value that `with_halves` put into columns."""
    return wide(F.col(f"{name}_hi"), F.col(f"{name}_lo"))


def _bit(condition: Column) -> Column:
    return condition.cast("bigint")


def add(a: Column, b: Column) -> Column:
    lo = add64(a["lo"], b["lo"])
    return wide(sum64(a["hi"], b["hi"], _bit(less_unsigned(lo, a["lo"]))), lo)


def negate(a: Column) -> Column:
    return add(wide(F.bitwise_not(a["hi"]), F.bitwise_not(a["lo"])), literal(1))


def subtract(a: Column, b: Column) -> Column:
    borrow = _bit(less_unsigned(a["lo"], b["lo"]))
    return wide(sub64(sub64(a["hi"], b["hi"]), borrow), sub64(a["lo"], b["lo"]))


def _upper_product(a: Column, b: Column) -> Column:
    """The upper half of the unsigned product of two 64-bit patterns: 32-bit by 16-bit parts, carried from the lowest on."""
    parts_a = [a.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(a, 32)]
    parts_b = [F.shiftrightunsigned(b, 16 * j).bitwiseAND(F.lit(0xFFFF)) for j in range(4)]
    columns: list[list[Column]] = [[] for _ in range(6)]
    for i, x in enumerate(parts_a):
        for j, y in enumerate(parts_b):
            columns[2 * i + j].append(x * y)
    carry, digit = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for terms in columns[:5]:
        whole = carry
        for t in terms:
            whole = whole + t
        carry, digit = F.shiftrightunsigned(whole, 16), whole.bitwiseAND(F.lit(0xFFFF))
    for t in columns[5]:
        carry = carry + t
    return F.shiftleft(carry, 16).bitwiseOR(digit)


def product64(a: Column, b: Column) -> Column:
    """The whole product of two unsigned 64-bit patterns in columns."""
    return wide(_upper_product(a, b), mul64(a, b))


def product(a: Column, b: Column) -> Column:
    """The product of operands whose halves are columns."""
    return wide(sum64(_upper_product(a["lo"], b["lo"]), mul64(a["hi"], b["lo"]), mul64(a["lo"], b["hi"])), mul64(a["lo"], b["lo"]))


def multiply64(a: Column, b: Column) -> Column:
    """The whole product of two unsigned 64-bit patterns."""
    return let(F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), lambda p: product64(p["a"], p["b"]))


def multiply(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: product(p["a"], p["b"]))


def _top(x: Column, kind: str) -> Column:
    return x["hi"] if kind == I128 else x["hi"].bitwiseXOR(F.lit(SIGN))


def less(a: Column, b: Column, kind: str = I128) -> Column:
    x, y = _top(a, kind), _top(b, kind)
    return (x < y) | ((x == y) & less_unsigned(a["lo"], b["lo"]))


def equal(a: Column, b: Column) -> Column:
    return (a["hi"] == b["hi"]) & (a["lo"] == b["lo"])


def sort_key(a: Column, kind: str = I128) -> Column:
    """A struct whose order is the kind's order."""
    from .scalars import U64

    return F.struct(_top(a, kind).alias("hi"), flip(a["lo"], U64).alias("lo"))


def shift_left_one(a: Column) -> Column:
    return wide(F.shiftleft(a["hi"], 1).bitwiseOR(F.shiftrightunsigned(a["lo"], 63)), F.shiftleft(a["lo"], 1))


#: Divisors below this take 16 bits of the dividend at a time: a remainder and 16 bits more fit a BIGINT.
SMALL = 1 << 46


def _divmod_small(a: Column, b: Column) -> Column:
    digits = [F.shiftrightunsigned(a[h], s).bitwiseAND(F.lit(0xFFFF)) for h in ("hi", "lo") for s in (48, 32, 16, 0)]

    def step(acc: Column, rest: list[Column]) -> Column:
        """acc: hi and lo of the quotient so far, and the remainder."""
        if not rest:
            return F.struct(wide(acc["hi"], acc["lo"]).alias("q"), from_unsigned(acc["r"]).alias("r"))

        def put(t: Column) -> Column:
            q = F.call_function("div", t, b)
            hi = F.shiftleft(acc["hi"], 16).bitwiseOR(F.shiftrightunsigned(acc["lo"], 48))
            return F.struct(hi.alias("hi"), F.shiftleft(acc["lo"], 16).bitwiseOR(q).alias("lo"), (t % b).alias("r"))

        return let(let(acc["r"] * 65536 + rest[0], put), lambda x: step(x, rest[1:]))

    zero = F.lit(0).cast("bigint")
    return let(F.struct(zero.alias("hi"), zero.alias("lo"), zero.alias("r")), lambda x: step(x, digits))


def divmod_unsigned(a: Column, b: Column) -> Column:
    """A struct (q, r) of quotient and remainder, 16 bits at a time for small divisors, else a bit at a time; x/0 is (0, x)."""

    def step(p: Column):
        def one(acc: Column, k: Column) -> Column:
            word = F.when(k >= 64, p["a"]["hi"]).otherwise(p["a"]["lo"])
            bit = F.call_function("shiftrightunsigned", word, F.pmod(k, F.lit(64))).bitwiseAND(F.lit(1))
            # A remainder of 2^127 or more loses its top bit in the shift, and is then larger than b in any case.
            out = acc["r"]["hi"] < 0
            moved = shift_left_one(acc["r"])
            moved = wide(moved["hi"], moved["lo"].bitwiseOR(bit))

            def settle(r: Column) -> Column:
                fits = out | ~less(r, p["b"], U128)
                q = shift_left_one(acc["q"])
                return F.struct(
                    wide(q["hi"], q["lo"].bitwiseOR(_bit(fits))).alias("q"),
                    wide(F.when(fits, subtract(r, p["b"])["hi"]).otherwise(r["hi"]), F.when(fits, subtract(r, p["b"])["lo"]).otherwise(r["lo"])).alias("r"),
                )

            return let(moved, settle)

        zero = F.struct(literal(0).alias("q"), literal(0).alias("r"))
        void = equal(p["b"], literal(0))
        found = F.aggregate(F.sequence(F.lit(127), F.lit(0)), zero, one)
        small = (p["b"]["hi"] == 0) & (p["b"]["lo"] > 0) & (p["b"]["lo"] < SMALL)
        found = F.when(small, _divmod_small(p["a"], p["b"]["lo"])).otherwise(found)
        return F.when(void, F.struct(literal(0).alias("q"), p["a"].alias("r"))).otherwise(found)

    return let(F.struct(a.alias("a"), b.alias("b")), step)


def floor_divide(a: Column, b: Column, kind: str = I128) -> Column:
    """A struct (q, r): toward minus infinity for i128, the remainder with the divisor's sign; x/0 is (0, x)."""
    if kind == U128:
        return divmod_unsigned(a, b)

    def signed(p: Column) -> Column:
        low_a, low_b = p["a"]["hi"] < 0, p["b"]["hi"] < 0
        size = lambda x, low: wide(F.when(low, negate(x)["hi"]).otherwise(x["hi"]), F.when(low, negate(x)["lo"]).otherwise(x["lo"]))

        def settle(d: Column) -> Column:
            q = F.when(low_a != low_b, negate(d["q"])).otherwise(d["q"])
            r = F.when(low_a, negate(d["r"])).otherwise(d["r"])
            off = ~equal(d["r"], literal(0)) & (low_a != low_b)
            down = F.struct(subtract(q, literal(1)).alias("q"), add(r, p["b"]).alias("r"))
            return F.when(equal(p["b"], literal(0)), F.struct(literal(0).alias("q"), p["a"].alias("r"))).when(off, down).otherwise(F.struct(q.alias("q"), r.alias("r")))

        return let(divmod_unsigned(size(p["a"], low_a), size(p["b"], low_b)), settle)

    return let(F.struct(a.alias("a"), b.alias("b")), signed)


def with_floor_parts(df: DataFrame, a: str, b: str, q: str, r: str) -> DataFrame:
    """`floor_divide` of the signed named values a and b, whose parts become the named values q and r.

    Divisors below 2^46 in size are made positive and divide 16 bits at a time, of which the first are signed:
    that gives the quotient toward minus infinity at once. Only rows with other divisors are interpreted."""
    zero, x, y = F.lit(0).cast("bigint"), named(a), named(b)
    small = ((y["hi"] == 0) & (y["lo"] > 0) & (y["lo"] < SMALL)) | ((y["hi"] == -1) & (y["lo"] < 0) & (y["lo"] > -SMALL))
    df = df.withColumns({"_small": small, "_low": y["hi"] < 0})
    small, low, minus = F.col("_small"), F.col("_low"), negate(x)
    size = {f"_{h}": F.when(~small, zero).when(low, minus[h]).otherwise(x[h]) for h in ("hi", "lo")}
    # -2^127 has no negative among 128 bits, but its first digit has.
    least = small & low & (x["hi"] == SIGN) & (x["lo"] == 0)
    by = F.when(small, F.abs(y["lo"])).when(~small, F.lit(1).cast("bigint"))
    df = df.withColumns({**size, "_by": by, "_least": least, "_far": F.when(~small, floor_divide(x, y))})
    by = F.col("_by")
    t = F.when(F.col("_least"), F.lit(1 << 15).cast("bigint")).otherwise(F.shiftright("_hi", 48))
    df = df.withColumns({"_t": t, "_r0": F.pmod(t, by)}).withColumn("_d0", F.call_function("div", F.col("_t") - F.col("_r0"), by))
    for i, (half, shift) in enumerate([("_hi", 32), ("_hi", 16), ("_hi", 0), ("_lo", 48), ("_lo", 32), ("_lo", 16), ("_lo", 0)], 1):
        df = df.withColumn("_t", F.col(f"_r{i - 1}") * 65536 + F.shiftrightunsigned(half, shift).bitwiseAND(F.lit(0xFFFF)))
        df = df.withColumns({f"_d{i}": F.call_function("div", F.col("_t"), by), f"_r{i}": F.col("_t") % by})
    digits = [F.col(f"_d{i}") for i in range(8)]
    word = lambda d: F.shiftleft(d[0], 48).bitwiseOR(F.shiftleft(d[1], 32)).bitwiseOR(F.shiftleft(d[2], 16)).bitwiseOR(d[3])
    df = df.withColumns({"_q_hi": word(digits[:4]), "_q_lo": word(digits[4:]), "_r": F.col("_r7")})
    near = {q: wide(F.col("_q_hi"), F.col("_q_lo")), r: from_signed(F.when(low, -F.col("_r")).otherwise(F.col("_r")))}
    far = {q: F.col("_far")["q"], r: F.col("_far")["r"]}
    # The near parts are null where an operand is, and 0 in rows of the other way.
    df = with_halves(df, **{n: wide(*(v[h].bitwiseOR(F.coalesce(far[n][h], zero)) for h in ("hi", "lo"))) for n, v in near.items()})
    return df.drop("_small", "_low", *size, "_by", "_least", "_far", "_q_hi", "_q_lo", "_r", "_t", *(f"_{n}{i}" for n in "dr" for i in range(8)))


def _shift_toward_zero(x: Column, k: int, kind: str) -> Column:
    """Division by 2^k, k from 0 to 127: negative values are raised by 2^k - 1 before the shift."""
    if kind == I128:
        up = literal((1 << k) - 1)
        x = add(x, wide(*(F.when(x["hi"] < 0, up[h]).otherwise(F.lit(0).cast("bigint")) for h in ("hi", "lo"))))
    down = F.shiftright if kind == I128 else F.shiftrightunsigned
    if k == 0:
        return x
    if k >= 64:
        return wide(down(x["hi"], 63) if kind == I128 else F.lit(0), down(x["hi"], k - 64))
    return wide(down(x["hi"], k), F.shiftrightunsigned(x["lo"], k).bitwiseOR(F.shiftleft(x["hi"], 64 - k)))


def truncate(x: Column, scale: int, kind: str = I128) -> Column:
    """Division by a positive constant toward zero; by a power of two it stays in generated code."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    if scale & (scale - 1) == 0 and scale < 1 << 128:
        return _shift_toward_zero(x, scale.bit_length() - 1, kind)
    if kind == U128:
        return divmod_unsigned(x, literal(scale))["q"]

    def signed(v: Column) -> Column:
        low = v["hi"] < 0
        q = divmod_unsigned(wide(F.when(low, negate(v)["hi"]).otherwise(v["hi"]), F.when(low, negate(v)["lo"]).otherwise(v["lo"])), literal(scale))["q"]
        return let(q, lambda q: F.when(low, negate(q)).otherwise(q))

    return let(x, signed)


def bits(a: Column) -> Column:
    """128 bits, the lowest first."""
    places = F.sequence(F.lit(0), F.lit(63))
    half = lambda x: F.transform(places, lambda i: F.call_function("shiftrightunsigned", x, i).bitwiseAND(F.lit(1)).cast("tinyint"))
    return F.concat(half(a["lo"]), half(a["hi"]))


def from_bits(b: Column) -> Column:
    def word(start: int) -> Column:
        placed = F.transform(F.slice(b, start, 64), lambda x, i: F.call_function("shiftleft", x.cast("bigint"), i))
        return F.aggregate(placed, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))

    return wide(word(65), word(1))
