"""Tables as CSV: integers, fixed-point numbers, booleans and strings, void cells empty, void rows left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def int_cell(x: Column) -> Column:
    return x.cast("string")


def unsigned_cell(x: Column) -> Column:
    """A 64-bit pattern as an unsigned number."""
    return F.conv(F.hex(x), 16, 10)


def float_cell(x: Column, fraction_bits: int, decimals: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{decimals}f", x.cast("double") / float(1 << fraction_bits)))


def bool_cell(x: Column) -> Column:
    return F.when(x.cast("int") != 0, "true").when(x.isNotNull(), "false")


def string_cell(body: Column, length: Column) -> Column:
    """UTF-8 bytes in an array, of which the first `length` count."""
    used = F.slice(body, F.lit(1), length.cast("int"))
    return F.decode(F.unhex(F.array_join(F.transform(used, lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")), "")), "UTF-8")


def csv_table(df: DataFrame, cells: dict[str, Column], sort_columns: bool = False) -> DataFrame:
    """Rows of strings, NULL for void cells; rows with void cells only are left out."""
    names = sorted(cells) if sort_columns else list(cells)
    if not names:
        raise ValueError("no columns")
    rows = df.select(*(cells[n].alias(n) for n in names))
    return rows.where(F.coalesce(*names).isNotNull()).na.fill("")


def write_csv(df: DataFrame, path: str, cells: dict[str, Column], sort_columns: bool = False, sort_rows: bool = False) -> None:
    """Part files with a header; sorted rows are in the order of their strings, over all parts."""
    rows = csv_table(df, cells, sort_columns)
    (rows.orderBy(*rows.columns) if sort_rows else rows).write.option("header", True).option("emptyValue", "").option("quoteAll", False).csv(path)
