"""Additive sharing of columns among three parties, as a functional simulation.

This gives no confidentiality: a Spark cluster is one trust domain. Shares are replicated (party i holds
shares i and i+1), linear operations act on each share, and reveal adds the three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import Kind, add, add_all, multiply, subtract
from .hashing import random_column

PUBLIC, SHARED = "public", "shared"


def share(x: Column, kind: Kind, seed: int, pos: Column) -> Column:
    """A struct of three shares that add up to x modulo 2^bits (XOR for bits)."""
    mask = (lambda h: h.bitwiseAND(F.lit(1)).cast("tinyint")) if kind.bits == 1 else (lambda h: h if kind.bits == 64 else h.bitwiseAND(F.lit((1 << (kind.bits - 1)) - 1)).cast(kind.spark))
    s0, s1 = mask(random_column(2 * seed, pos)), mask(random_column(2 * seed + 1, pos))
    return F.struct(s0.alias("s0"), s1.alias("s1"), subtract(subtract(x, s0, kind), s1, kind).alias("s2"))


def reveal(shares: Column, kind: Kind) -> Column:
    return add_all([shares[f"s{i}"] for i in range(3)], kind)


def party_view(shares: Column, party: int) -> Column:
    """What a party holds: its share and the next one; the third is void."""
    held = {party, (party + 1) % 3}
    return F.struct(*((shares[f"s{i}"] if i in held else F.lit(None).cast("bigint")).alias(f"s{i}") for i in range(3)))


def add_shares(a: Column, b: Column, kind: Kind) -> Column:
    return F.struct(*(add(a[f"s{i}"], b[f"s{i}"], kind).alias(f"s{i}") for i in range(3)))


def scale_shares(a: Column, by: Column, kind: Kind) -> Column:
    """Shares times a public value."""
    return F.struct(*(multiply(a[f"s{i}"], by, kind).alias(f"s{i}") for i in range(3)))


def multiply_shares(a: Column, b: Column, kind: Kind) -> Column:
    """Each party adds the products it can make from what it holds."""

    def local(i: int) -> Column:
        j = (i + 1) % 3
        return add_all([multiply(a[f"s{p}"], b[f"s{q}"], kind) for p, q in ((i, i), (i, j), (j, i))], kind)

    return F.struct(*(local(i).alias(f"s{i}") for i in range(3)))


def share_table(df: DataFrame, columns: dict[str, Kind], seed: int, pos: str) -> DataFrame:
    """Columns replaced by their shares."""
    return df.withColumns({c: share(F.col(c), k, seed + i, F.col(pos)) for i, (c, k) in enumerate(columns.items())})


def reveal_table(df: DataFrame, columns: dict[str, Kind]) -> DataFrame:
    return df.withColumns({c: reveal(F.col(c), k) for c, k in columns.items()})
