"""Masked tables in two forms.

Compact: void rows are gone and void cells are NULL. Padded: every slot is kept with `_valid` (0 or 1)
and `_pos`; void rows and void cells hold zeros, and a cell's own mask stands in `<column>_valid` if the
table has cell masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALID, POS = "_valid", "_pos"


def zero_of(kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit(0).cast(kind) if isinstance(kind, (T.NumericType, T.BooleanType)) else F.lit("").cast(kind)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (VALID, POS) and not (c.endswith(VALID) and c.removesuffix(VALID) in df.columns)]


def zero_cells(df: DataFrame, columns: list[str], when: Column | None = None) -> DataFrame:
    """Zeros in place of NULL (where `when` is false, too). Array cells get as many zeros as the longest cell of any row has."""
    out = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.ArrayType):
            width = df.agg(F.max(F.size(c))).first()[0] or 0
            zero = F.array_repeat(F.lit(0).cast(kind.elementType), width)
        else:
            zero = zero_of(kind)
        value = F.coalesce(F.col(c), zero)
        out[c] = value if when is None else F.when(when, value).otherwise(zero)
    return df.withColumns(out)


def to_compact(df: DataFrame, keep_pos: bool = False) -> DataFrame:
    """The valid rows, with NULL for cells whose own mask is 0."""
    masked = {c: F.when(F.col(c + VALID) == 1, F.col(c)) for c in data_columns(df) if c + VALID in df.columns}
    rows = df.where(F.col(VALID) == 1) if VALID in df.columns else df
    rows = rows.withColumns(masked) if masked else rows
    return rows.select(*([POS] if keep_pos and POS in df.columns else []), *data_columns(df))


def to_padded(df: DataFrame, valid: Column, pos: Column, cell_masks: bool = False) -> DataFrame:
    """All rows with their mask and place; void cells are zeroed and, if asked for, masked."""
    columns = df.columns
    rows = df.select(F.coalesce(valid.cast("tinyint"), F.lit(0).cast("tinyint")).alias(VALID), pos.cast("bigint").alias(POS), *columns)
    if cell_masks:
        rows = rows.withColumns({c + VALID: (F.col(c).isNotNull() & (F.col(VALID) == 1)).cast("tinyint") for c in columns})
    return zero_cells(rows, columns, F.col(VALID) == 1)


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, failing when it is used if keys repeat among rows without NULL keys. Costs an aggregation by key."""
    full = df.dropna(subset=keys)
    repeated = full.groupBy(*keys).count().where("count > 1").limit(1)
    check = repeated.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.raise_error(F.lit(f"{what}: keys repeat")).cast("boolean")).otherwise(F.lit(True)).alias("_unique"))
    return df.crossJoin(F.broadcast(check)).where("_unique").drop("_unique")  # one row: the check itself


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of a schema, which it must have with the same types."""
    for f in schema:
        if f.name not in df.columns:
            raise ValueError(f"column {f.name} is missing")
        if df.schema[f.name].dataType != f.dataType:
            raise TypeError(f"{f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*schema.names)


def last_of_duplicates(df: DataFrame, keys: list[str], pos: str = POS) -> DataFrame:
    """The row with the greatest place for each key; rows with a NULL key all stay."""
    rest = [c for c in df.columns if c not in keys]
    full = df.dropna(subset=keys)
    best = full.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_row")).select(*keys, "_row.*").select(*df.columns)
    void = df.where(" or ".join(f"`{k}` is null" for k in keys))
    return best.unionByName(void)
