"""Plumbing shared by the corpus operators: column helpers, text buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import materialise, scratch_path, sized  # noqa: F401  (used by the operators)

_local: dict[str, str] = {}

#: Bytes of text that a Python worker handles at once; work arrays take a small multiple of this.
CHUNK_BYTES = 1 << 20


def shipped(df: DataFrame) -> DataFrame:
    """df, after its executors have been given this package (once a session), for functions that run there."""
    context = df.sparkSession.sparkContext
    if _local.get("shipped") != context.applicationId:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="maskframe-")  # on the driver, which serves the file from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _local["shipped"] = context.applicationId
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trainable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most `limit` bytes of text (or one row), and their texts; null is empty."""
    for batch in batches:
        column = batch.column(text)
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = size = 0
        for i, n in enumerate([*lengths, limit]):
            if i > start and (size + n > limit or i == len(lengths)):
                yield batch.slice(start, i - start), [t or b"" for t in column.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n


def slices(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that only these become Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (finaliser with two odd multipliers)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema)
