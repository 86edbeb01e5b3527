"""ROC-AUC over any number of rows.

Rows are first counted by prediction, then the counts get running sums in even shares; no task sees all
rows, and equal predictions count one half."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running


def auc_counts(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row: twice the number of rightly ordered pairs (ties one), the numbers of positives and of negatives, all exact."""
    by_score = df.select(label.cast("int").alias("_y"), score.cast("bigint").alias("_s")).groupBy("_s").agg(F.sum("_y").cast("bigint").alias("_p"), F.sum(1 - F.col("_y")).cast("bigint").alias("_n"))
    below = running(by_score, "_s", {"_upto": F.col("_n")})
    twice = F.col("_p").cast("decimal(19,0)") * (2 * F.col("_upto") - F.col("_n")).cast("decimal(19,0)")
    return below.agg(F.coalesce(F.sum(twice.cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias("twice_ordered"), F.coalesce(F.sum("_p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("_n"), F.lit(0)).alias("negatives"))


def auc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row, one column `auc`; NULL without both kinds of label."""
    c = auc_counts(df, label, score)
    pairs = 2 * F.col("positives").cast("double") * F.col("negatives")
    return c.select((F.col("twice_ordered").cast("double") / F.when(pairs > 0, pairs)).alias("auc"))


def auc_fixed(df: DataFrame, label: Column, score: Column, f: int = 15) -> DataFrame:
    """The AUC in fixed point, rounded down."""
    c = auc_counts(df, label, score)
    pairs = (F.col("positives").cast("decimal(18,0)") * F.col("negatives").cast("decimal(18,0)")).cast("decimal(36,0)") * 2
    whole = (F.col("twice_ordered") * (1 << f)).cast("decimal(38,0)")
    return c.select(((whole - F.pmod(whole, F.when(pairs > 0, pairs).cast("decimal(38,0)"))) / pairs).cast("bigint").alias("auc"))
