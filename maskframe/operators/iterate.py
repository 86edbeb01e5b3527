"""Call, iterate and assertions.

`iterate` over an array cell is one expression. Over rows a map needs no order, an associative step is a
running aggregate in even shares, and a general step runs over one ordered group a task, so it takes
groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iterate_cell(values: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """A struct of the last state and the outputs of step(state, x) -> (state, output) over an array."""
    start = F.struct(state.alias("state"), F.array().cast(f"array<{out_type}>").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        new, y = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], F.array(y.cast(out_type))).alias("out"))

    return F.aggregate(values, start, one)


def iterate_map(values: Column, of: Callable[[Column], Column]) -> Column:
    """An iteration without a state: a map."""
    return F.transform(values, of)


def iterate_groups(df: DataFrame, group: list[str], order: str, state, step: Callable, schema: str) -> DataFrame:
    """A general ordered fold of each group: step(state, row dict) -> (state, output dict). A group is held by one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now, rows = state, []
        for row in pdf.sort_values(order, kind="stable").to_dict("records"):
            now, out = step(now, row)
            rows.append(out)
        return pd.DataFrame(rows)

    return df.groupBy(*group).applyInPandas(run, schema)


def checked(value: Column, condition: Column, message: str) -> Column:
    """The value, or an error where the condition isn't true. The check lives in the value, so it isn't pruned while that is used."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def observed(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """df itself; metrics are reported when it has run."""
    return df.observe(name, *(metrics or (F.count("*").alias("rows"),)))


def annotated(value: Column, name: str, **notes: object) -> Column:
    """The value itself under a name, with notes that travel with the column as its metadata."""
    return value.alias(name, metadata=notes)


def notes_of(df: DataFrame, column: str) -> dict:
    return dict(df.schema[column].metadata)
