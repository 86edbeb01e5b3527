"""Sources and sinks: typed JSON values, Parquet with a checked schema, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a schema, only its columns, whose types must agree."""
    from ..operators.table import assert_schema

    df = spark.read.parquet(path)
    return df if schema is None else assert_schema(df, schema)
