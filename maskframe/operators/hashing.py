"""Sharding, cuckoo tables and index maps."""

from __future__ import annotations

from collections.abc import Callable
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import Kind, wrap
from .table import POS, VALID, zero_cells

DUMMY = -1  # all bits set: the largest unsigned value


def _cut(x: Column, bits: int) -> Column:
    return x if bits == 64 else x.bitwiseAND(F.lit((1 << bits) - 1))


def random_column(seed: int, pos: Column, kind_bits: int = 64) -> Column:
    """Keyed pseudo-random values by place: the same for the same seed, whatever the partitioning."""
    return _cut(F.xxhash64(F.lit(seed).cast("bigint"), pos), kind_bits)


def prf(key: Column, iv: int, pos: Column, kind_bits: int = 64) -> Column:
    """A keyed pseudo-random function of a place: the first 16 hexadecimal digits of a SHA-256 digest, of which fewer bits are the low ones."""
    digest = F.sha2(F.concat_ws("|", key.cast("string"), F.lit(str(iv)), pos.cast("string")), 256)
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return _cut(F.shiftleft(number(1), 32).bitwiseOR(number(9)), kind_bits)


def in_kind(x: Column, kind: Kind) -> Column:
    """A 64-bit pattern's low bits as a value of a kind."""
    return wrap(_cut(x, kind.bits), kind)


def _draw(pos: Column, of: object, name: str, draw: Callable[[Column], Column]) -> Column:
    """A value of a type: a kind, [n, type] for a vector, a tuple or a dict of types. Parts are drawn by their path."""
    if isinstance(of, Kind):
        return in_kind(draw(F.concat_ws("/", pos.cast("string"), F.lit(name))), of)
    if isinstance(of, list):
        n, part = of
        return F.array(*(_draw(pos, part, f"{name}.{i}", draw) for i in range(n)))
    if isinstance(of, tuple):
        return F.struct(*(_draw(pos, part, f"{name}.{i}", draw).alias(f"_{i}") for i, part in enumerate(of)))
    return F.struct(*(_draw(pos, part, f"{name}.{k}", draw).alias(k) for k, part in of.items()))


def random_value(seed: int, pos: Column, of: object) -> Column:
    """A pseudo-random value of any type (see `_draw`) for each place."""
    return _draw(pos, of, "r", lambda path: F.xxhash64(F.lit(seed).cast("bigint"), path))


def prf_value(key: Column, iv: int, pos: Column, of: object) -> Column:
    """A value of any type by the keyed function."""
    return _draw(pos, of, "p", lambda path: prf(key, iv, path))


def random_tensor(spark: SparkSession, seed: int, shape: list[int], kind: Kind) -> DataFrame:
    """A coordinate table of pseudo-random values, made in parallel."""
    place, out = F.col("id"), []
    for n in reversed(shape):
        out.append(place % n)
        place = F.call_function("div", place, F.lit(n).cast("bigint"))
    names = [c.alias(f"i{k}") for k, c in enumerate(reversed(out))]
    return spark.range(prod(shape)).select(*names, in_kind(random_column(seed, F.col("id")), kind).alias("v"))


def random_permutation(df: DataFrame, seed: int, pos: str = POS) -> DataFrame:
    """(pos, v): a permutation of the places by the order of keyed hashes."""
    from .order import positions

    keyed = df.select(F.col(pos).cast("bigint").alias("v"), random_column(seed, F.col(pos).cast("bigint")).alias("_h"))
    return positions(keyed, "_h", "v", pos).select(pos, "v")


def permutation_from_prf(df: DataFrame, key: Column, iv: int, pos: str = POS) -> DataFrame:
    """(pos, v): a permutation of the places by the order of a keyed function's values."""
    from .order import positions

    keyed = df.select(F.col(pos).cast("bigint").alias("v"), prf(key, iv, F.col(pos).cast("bigint")).alias("_h"))
    return positions(keyed, "_h", "v", pos).select(pos, "v")


def shards(df: DataFrame, n: int, keys: list[str], shard_size: int | None = None, by: Column | None = None, pos: str = POS, cell_masks: bool = False) -> DataFrame:
    """df with `_shard` (by hash of the keys, or `by` modulo n) and `_slot`, its place there.

    With a shard size each shard is filled up with void rows, and more rows are an error. Void rows have
    `_valid` 0 and zeros; with cell masks there is no mask of rows, but one of each cell (`<column>_valid`),
    which is 0 in void rows and where the cell is NULL."""
    if not keys or len(set(keys)) != len(keys) or set(keys) - set(df.columns):
        raise ValueError(f"shard keys must be different columns: {keys}")
    shard = F.pmod(by if by is not None else F.xxhash64(*keys), F.lit(n)).cast("int")
    rows = df.withColumn("_shard", shard)
    # Slots by two levels: parts of a shard number their rows, and the parts' counts are few.
    parts = 256
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(pos), F.lit(parts)))
    counts = rows.groupBy("_shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("_shard", "_part", (F.sum("_n").over(Window.partitionBy("_shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy(pos))
    out = rows.withColumn("_slot", within).join(F.broadcast(before), ["_shard", "_part"])  # n * parts rows
    out = out.withColumn("_slot", (F.col("_before") + F.col("_slot") - 1).cast("bigint")).drop("_part", "_before")
    if shard_size is None:
        return out
    fits = F.when(F.col("_slot") < shard_size, F.col("_slot")).otherwise(F.raise_error("a shard is too small").cast("bigint"))
    out = out.withColumns({"_slot": fits, VALID: F.lit(1).cast("tinyint")})
    slots = df.sparkSession.range(n * shard_size).select(F.call_function("div", F.col("id"), F.lit(shard_size).cast("bigint")).cast("int").alias("_shard"), (F.col("id") % shard_size).alias("_slot"))
    padded = slots.join(out, ["_shard", "_slot"], "left")
    if cell_masks:
        padded = padded.drop(VALID).withColumns({c + VALID: F.col(c).isNotNull().cast("tinyint") for c in df.columns})
    return zero_cells(padded, [c for c in padded.columns if c not in ("_shard", "_slot")])


def cuckoo_place(values: list[int], matrices: list[list[int]], bits: int, seed: int = 0, tries: int = 100) -> list[int]:
    """Slots of a cuckoo table of 2^bits: the row in each, or DUMMY. A hash is a bit matrix over GF(2), a row a mask."""
    table = [DUMMY] * (1 << bits)
    place = lambda v, h: sum(((v & row).bit_count() & 1) << k for k, row in enumerate(matrices[h]))
    used = [0] * len(values)
    rng = np.random.default_rng(seed)
    for row in range(len(values)):
        item, h, moves = row, 0, 0
        while True:
            spots = [place(values[item], k) for k in range(len(matrices))]
            free = next((k for k, s in enumerate(spots) if table[s] == DUMMY), None)
            h = free if free is not None else int(rng.integers(len(matrices)))
            item, table[spots[h]] = table[spots[h]], item
            used[row] = h
            if item == DUMMY:
                break
            moves += 1
            if moves > tries:
                raise ValueError("the cuckoo table can't be built")
    return table


def cuckoo_tables(df: DataFrame, set_id: str, row: str, value: str, matrices: list[list[int]], bits: int, seed: int = 0) -> DataFrame:
    """(set, slot, row) of one cuckoo table for each set. A table is built in one task: insertion is sequential, and a table is bounded by 2^bits."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        rows = pdf[row].tolist()
        table = cuckoo_place([int(v) & (1 << 64) - 1 for v in pdf[value]], matrices, bits, seed)
        return pd.DataFrame({set_id: pdf[set_id].iloc[0], "slot": np.arange(len(table)), "row": [DUMMY if i == DUMMY else rows[i] for i in table]})

    kind = df.schema[set_id].dataType.simpleString()
    return df.select(set_id, row, value).groupBy(set_id).applyInPandas(build, f"{set_id} {kind}, slot bigint, row bigint")


def cuckoo_to_permutation(table: DataFrame, seed: int = 0) -> DataFrame:
    """(slot, row) with each dummy replaced by an index below the table's size that no slot has; each is used once."""
    from .order import positions

    slots = table.select("slot", "row")
    free = slots.select(F.col("slot").alias("row")).join(slots.where(F.col("row") != DUMMY).select("row"), "row", "left_anti")
    free = positions(free.withColumn("_h", random_column(seed, F.col("row"))), "_h", "row", "_k").select("row", "_k")
    empty = positions(slots.where(F.col("row") == DUMMY).select("slot"), "slot", None, "_k")
    return slots.where(F.col("row") != DUMMY).unionByName(empty.join(free, "_k").select("slot", "row"))


def decompose_switching(index: DataFrame, n: int, pos: str = POS, value: str = "v") -> tuple[DataFrame, DataFrame, DataFrame]:
    """An index map i -> v[i] into n rows as three steps: a permutation with deletion, a duplication, a permutation.

    Returns (pos, v) that puts each used row first of its copies; (pos, v, bit) where bit 1 takes the place
    before; and (pos, v) that brings each copy to its place."""
    from .order import positions

    sorted_map = positions(index.select(F.col(pos).alias("_to"), F.col(value).alias("_from")), "_from", "_to", pos)
    # The first copy of each row by an aggregate; the join back splits a row that many places use.
    firsts = sorted_map.groupBy("_from").agg(F.min(pos).alias("_first"))
    marked = sorted_map.join(firsts, "_from").withColumn("_head", F.col(pos) == F.col("_first"))
    m = index.count()
    used = firsts.select(F.col("_first").alias(pos), F.col("_from").alias("v"))
    spare = index.sparkSession.range(n).select(F.col("id").alias("v")).join(used.select("v"), "v", "left_anti")
    spare = positions(spare, "v", None, "_k")
    gaps = positions(marked.where(~F.col("_head")).select(pos), pos, None, "_k")
    first = used.unionByName(gaps.join(spare, "_k").select(pos, "v"))
    second = marked.select(pos, F.col("_first").alias("v"), (~F.col("_head")).cast("tinyint").alias("bit"))
    third = marked.select(F.col("_to").alias(pos), F.col(pos).alias("v"))
    if m > n:
        raise ValueError("an index map can't be longer than its source")
    return first, second, third
