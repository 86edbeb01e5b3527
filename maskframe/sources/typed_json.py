"""Typed values as JSON documents: scalars, arrays, tuples, named tuples and vectors.

{"kind": "scalar" | "array", "type": "i32", "value": ...}, {"kind": "tuple" | "vector", "value": [...]},
{"kind": "named tuple", "value": [{"name": ..., "value": {...}}]}. Tables are named tuples of arrays of
one length.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import Kind, kind
from ..operators.table import POS


def check(x: int, k: Kind) -> int:
    low, high = (-(1 << (k.bits - 1)), 1 << (k.bits - 1)) if k.signed else (0, 1 << k.bits)
    if not low <= x < high:
        raise ValueError(f"{x} is no {k.name}")
    return x - (1 << 64) if k.bits == 64 and x >= 1 << 63 else x


def _nested(values, k: Kind):
    return [_nested(v, k) for v in values] if isinstance(values, list) else check(int(values), k)


def load(doc) -> object:
    """The value as ints, nested lists, tuples and dicts; 64-bit unsigned values as signed patterns."""
    what = doc["kind"]
    if what in ("scalar", "array"):
        out = _nested(doc["value"], kind(doc["type"]))
        if what == "array":
            np.array(out)  # rows of different lengths are an error
        return out
    if what == "vector":
        return [load(v) for v in doc["value"]]
    if what == "tuple":
        return tuple(load(v) for v in doc["value"])
    if what == "named tuple":
        return {f["name"]: load(f["value"]) for f in doc["value"]}
    raise ValueError(f"unknown kind {what}")


def loads(text: str) -> object:
    doc = json.loads(text)
    return [load(d) for d in doc] if isinstance(doc, list) else load(doc)


def dump(value, type_name: str | None = None) -> dict:
    """The document of a scalar or nested list of a kind, or of tuples and dicts of (value, kind name) pairs."""
    if isinstance(value, dict):
        return {"kind": "named tuple", "value": [{"name": n, "value": dump(*v)} for n, v in value.items()]}
    if isinstance(value, tuple):
        return {"kind": "tuple", "value": [dump(*v) for v in value]}
    k = kind(type_name)
    show = lambda x: [show(y) for y in x] if isinstance(x, list) else x + (1 << 64) if k.bits == 64 and not k.signed and x < 0 else x
    return {"kind": "array" if isinstance(value, list) else "scalar", "type": k.name, "value": show(value)}


def read_table(spark: SparkSession, text: str) -> DataFrame:
    """A table from a named tuple of arrays, with `_pos`. Such documents are small: they are held by the driver."""
    doc = json.loads(text)
    fields = {f["name"]: f["value"] for f in doc["value"]}
    columns = {n: load(v) for n, v in fields.items()}
    lengths = {len(c) for c in columns.values()}
    if len(lengths) != 1:
        raise ValueError("columns differ in length")
    deep = lambda c: 1 + deep(c[0]) if isinstance(c, list) and c else 0
    shape = lambda n: "array<" * (deep(columns[n]) - 1) + kind(fields[n]["type"]).spark + ">" * (deep(columns[n]) - 1)
    schema = f"{POS} bigint, " + ", ".join(f"`{n}` {shape(n)}" for n in columns)
    return spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*columns.values()))], schema)


def write_table(df: DataFrame, path: str, pos: str = POS) -> None:
    """A table as one JSON object a row, in files of its partitions: the form for large results."""
    df.orderBy(pos).write.json(path) if pos in df.columns else df.write.json(path)


def read_rows(spark: SparkSession, path: str, columns: dict[str, Kind], cells: dict[str, int] | None = None, pos: str = POS) -> DataFrame:
    """What `write_table` wrote, read in parallel: kinds by column, and how deep the arrays are in those with array cells."""
    deep = lambda c: (cells or {}).get(c, 0)
    schema = f"`{pos}` bigint, " + ", ".join(f"`{c}` {'array<' * deep(c)}{k.spark}{'>' * deep(c)}" for c, k in columns.items())
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def zero_inputs(types: list[tuple[str, list[int]]]) -> list[dict]:
    """Documents of zeros for (kind name, shape)."""
    fill = lambda shape: [fill(shape[1:]) for _ in range(shape[0])] if shape else 0
    return [dump(fill(shape), name) for name, shape in types]


def split_parties(df: DataFrame, columns: dict[str, Kind], seed: int, pos: str = POS) -> list[DataFrame]:
    """What each of three parties holds of a table's shares."""
    from ..operators.sharing import party_view, share_table

    shared = share_table(df, columns, seed, pos)
    return [shared.select(*(party_view(F.col(c), p).alias(c) if c in columns else F.col(c) for c in df.columns)) for p in range(3)]
