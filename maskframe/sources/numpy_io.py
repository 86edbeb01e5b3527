"""NumPy arrays in and out: integer arrays as coordinate tables or as tables with array cells.

Arrays in memory are as large as the driver allows. Files (`.npy`) are read by Spark's own readers, so they
may be in any store; a file is one row there, so large arrays come as many files of their leading axis."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import KINDS, Kind
from ..operators.table import POS

#: Kinds by NumPy type; booleans are bits.
DTYPES = {"bool": "bit", **{f"{'u' * (not s)}int{b}": f"{'i' if s else 'u'}{b}" for b in (8, 16, 32, 64) for s in (True, False)}}


def kind_of(array: np.ndarray) -> Kind:
    if array.dtype.name not in DTYPES:
        raise TypeError(f"{array.dtype} isn't an integer type of up to 64 bits")
    return KINDS[DTYPES[array.dtype.name]]


def _held(array: np.ndarray) -> np.ndarray:
    """The values as their column type holds them: 64-bit unsigned ones as signed patterns."""
    return array.view(np.int64) if array.dtype == np.uint64 else array.astype(np.int64)


def _coordinates(array: np.ndarray, first: int = 0) -> pa.Table:
    places = np.indices(array.shape, np.int64).reshape(array.ndim, array.size)
    columns = {f"i{k}": places[k] + (first if k == 0 else 0) for k in range(array.ndim)}
    return pa.table(columns | {"v": _held(np.ascontiguousarray(array)).reshape(-1)})


def from_numpy(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """(i0, i1, ..., v) with v in the column type of the array's kind."""
    kind = kind_of(array)
    return spark.createDataFrame(_coordinates(array)).withColumn("v", F.col("v").cast(kind.spark))


def to_numpy(df: DataFrame, shape: list[int], kind: Kind, most: int = 1 << 26) -> np.ndarray:
    """A dense array from a coordinate table; cells left out are 0. Shapes of over `most` cells are refused, as the driver holds them."""
    if int(np.prod(shape, dtype=object)) > most:
        raise ValueError(f"{shape} has over {most} cells")
    name = next(n for n, k in DTYPES.items() if k == kind.name)
    found = df.toArrow()
    values = found.column("v").to_numpy().astype(np.int64)
    out = np.zeros(shape, np.int64)
    if not shape:
        values = values.sum()
    out[tuple(found.column(c).to_numpy() for c in df.columns if c != "v")] = values
    return out.view(np.uint64) if name == "uint64" else out.astype(name)


def table_from_numpy(spark: SparkSession, columns: dict[str, np.ndarray]) -> DataFrame:
    """A table with `_pos` from arrays of one length; further axes become array cells."""
    if len({len(a) for a in columns.values()}) != 1:
        raise ValueError("columns differ in length")
    arrays = {POS: pa.array(np.arange(len(next(iter(columns.values())))))}
    for name, a in columns.items():
        arrays[name] = pa.array(_held(a).tolist())
    df = spark.createDataFrame(pa.table(arrays))
    deep = lambda a: "array<" * (a.ndim - 1) + kind_of(a).spark + ">" * (a.ndim - 1)
    return df.select(POS, *(F.col(n).cast(deep(a)).alias(n) for n, a in columns.items()))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, first in zip(batch.column("content").to_pylist(), batch.column("first").to_pylist()):
            yield from _coordinates(np.load(io.BytesIO(content), allow_pickle=False), first).to_batches(1 << 16)


def read_npy(spark: SparkSession, path: str, kind: Kind, rank: int) -> DataFrame:
    """The coordinate table of an array in one file, or in files named by the first index of their part (0.npy, 1000.npy, ...)."""
    files = spark.read.format("binaryFile").load(path)
    first = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.npy$", 1)
    rows = files.select("content", F.when(first == "", 0).otherwise(first.cast("bigint")).cast("bigint").alias("first"))
    schema = ", ".join([*(f"i{k} bigint" for k in range(rank)), "v bigint"])
    return rows.mapInArrow(_read, schema).withColumn("v", F.col("v").cast(kind.spark))
