"""Scratch tables in the folder that all executors share.

They cut a lineage: what reads one repeats a stage when an executor is lost, not the chain behind it. A
scope deletes what was written within it; what is left goes when the process ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
#: Paths of scratch tables that haven't been dropped, and the session that wrote each.
_written: dict[str, SparkSession] = {}
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset a temporary one serves in local mode; a cluster has to name it."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "path" not in _local:
        _local["path"] = tempfile.mkdtemp(prefix="maskframe-")
        atexit.register(shutil.rmtree, _local["path"], ignore_errors=True)
    return _local["path"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which belongs to the scopes that are open."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    for scope in _scopes.get():
        scope.append(path)
    return path


def drop(paths: list[str]) -> None:
    """Delete scratch tables; what was built from them can't be read any more."""
    for path in paths:
        if (spark := _written.pop(path, None)) is not None:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scope() -> Iterator[list[str]]:
    """A list of the paths made while it is open, by this thread only; the caller drops those it no longer needs."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield paths
    finally:
        _scopes.reset(token)


@atexit.register
def _drop_all() -> None:
    try:
        drop(list(_written))
    except Exception:  # the JVM is gone; a driver that is killed leaves its tables to the folder's owner
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which `sized` lets a table be broadcast.
FEW_ROWS = 100_000


def sized(df: DataFrame, few_rows: int = FEW_ROWS) -> DataFrame:
    """A written table as the other side of a join: broadcast if it is counted to have few rows, else merged by sorting.

    Its size in bytes would mislead the planner, as scratch tables are compressed."""
    return F.broadcast(df) if df.count() <= few_rows else df.hint("merge")
