"""Joins of masked tables: inner, left, union and full, in compact and in padded form.

Keys map left names to right names. The result has all left columns, then the right ones that are no
keys. Keys should be unique among valid rows of a side; that is checked only if asked for, since it costs
an aggregation. A NULL key never matches, and its row survives left, union and full joins. Without cell
masks a missing cell is 0, with them it is NULL. Sides aren't hinted: Spark broadcasts a side it knows to
be small and splits frequent keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .table import POS, VALID, assert_unique, last_of_duplicates, zero_cells

KINDS = ("inner", "left", "union", "full")


def _prepared(left: DataFrame, right: DataFrame, keys: dict[str, str], on_duplicate: str) -> tuple[DataFrame, list[str], list[str]]:
    if not keys:
        raise ValueError("a join needs keys")
    for a, b in keys.items():
        if left.schema[a].dataType != right.schema[b].dataType:
            raise TypeError(f"keys {a} and {b} differ in type")
    names = [c for c in right.columns if c not in keys.values()]
    if clash := set(names) & set(left.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    back = {b: a for a, b in keys.items()}
    right = right.select(*(F.col(c).alias(back.get(c, c)) for c in right.columns))
    if on_duplicate == "error":
        right = assert_unique(right, list(keys), "right side")
    elif on_duplicate == "last":
        right = last_of_duplicates(right, list(keys))
    return right, list(keys), names


def join(left: DataFrame, right: DataFrame, kind: str, keys: dict[str, str], masked: bool = False, on_duplicate: str = "ignore") -> DataFrame:
    """A join of compact tables. on_duplicate: 'ignore' (SQL semantics), 'error', or 'last' (needs `_pos` on the right)."""
    right, on, names = _prepared(left, right, keys, on_duplicate)
    if kind == "inner":
        return left.join(right, on).select(*left.columns, *names)
    if kind == "left":
        out = left.join(right, on, "left").select(*left.columns, *names)
        return out if masked else zero_cells(out, names)
    if kind == "union":
        alone = left.join(right.select(*on), on, "left_anti")
        out = alone.unionByName(right, allowMissingColumns=True).select(*left.columns, *names)
        return out if masked else zero_cells(out, [c for c in out.columns if c not in on])
    if kind == "full":
        out = left.join(right, on, "full").select(*left.columns, *names)
        return out if masked else zero_cells(out, [c for c in out.columns if c not in on])
    raise ValueError(f"kind must be one of {KINDS}")


def semi_join(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The left rows with a match: a set intersection by key."""
    return left.join(right.select(*(F.col(b).alias(a) for a, b in keys.items())), list(keys), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    return left.join(right.select(*(F.col(b).alias(a) for a, b in keys.items())), list(keys), "left_anti")


def padded_join(left: DataFrame, right: DataFrame, kind: str, keys: dict[str, str]) -> DataFrame:
    """A join of padded tables, slot by slot, with void slots zeroed.

    Inner and left joins have the left side's slots. Union and full joins have the left slots, then the
    right ones. Cell masks (`<column>_valid`) are used if the tables have them: a key with mask 0 never
    matches. Of valid rows of a side with equal keys only the one in the last slot is matched by the other side."""
    back = {b: a for a, b in keys.items()}
    masks = {c for c in (*left.columns, *right.columns) if c.endswith(VALID) and c != VALID}
    name = lambda c: back.get(c.removesuffix(VALID), c.removesuffix(VALID)) + VALID if c in masks else back.get(c, c)
    right = right.select(*(F.col(c).alias(name(c)) for c in right.columns))
    taken = set(keys) | {k + VALID for k in keys}
    own = [c for c in left.columns if c not in (VALID, POS)]
    extra = [c for c in right.columns if c not in (VALID, POS) and c not in taken]

    def usable(df: DataFrame):
        ok = F.col(VALID) == 1
        for k in keys:
            if k + VALID in df.columns:
                ok = ok & (F.col(k + VALID) == 1)
        return ok

    def matched(df: DataFrame, other: DataFrame, add: list[str]) -> DataFrame:
        """df with `_hit` and the other side's columns."""
        found = last_of_duplicates(other.where(usable(other)).select(*keys, *add, POS), list(keys)).withColumn("_hit", F.lit(1))
        mine = df.withColumns({f"_k_{k}": F.when(usable(df), F.col(k)) for k in keys})
        found = found.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *add, "_hit")
        return mine.join(found, [f"_k_{k}" for k in keys], "left").drop(*(f"_k_{k}" for k in keys))

    def slots(df: DataFrame, valid, columns: list[str]) -> DataFrame:
        """Void rows and cells zeroed."""
        out = df.withColumn("_keep", valid.cast("tinyint"))
        for c in columns:
            if c + VALID in columns:
                out = out.withColumn(c, F.when(F.coalesce(F.col(c + VALID), F.lit(0)) == 1, F.col(c)))
        out = zero_cells(out, columns, F.col("_keep") == 1)
        return out.select(F.col("_keep").alias(VALID), POS, *columns)

    columns = own + extra
    if kind in ("inner", "left"):
        both = matched(left, right, extra)
        hit = F.col("_hit").isNotNull()
        return slots(both, (F.col(VALID) == 1) & hit if kind == "inner" else F.col(VALID) == 1, columns)
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    first = matched(left, right, [])
    for c in extra:
        first = first.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    first = slots(first, (F.col(VALID) == 1) & F.col("_hit").isNull(), columns)
    mine = [c for c in own if c not in taken]
    second = matched(right, left, mine) if kind == "full" else right
    if kind == "union":
        for c in mine:
            second = second.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    n = left.agg(F.count("*").alias("_n"))
    second = slots(second, F.col(VALID) == 1, columns).crossJoin(F.broadcast(n)).withColumn(POS, F.col(POS) + F.col("_n")).drop("_n")  # one row
    return first.unionByName(second)
