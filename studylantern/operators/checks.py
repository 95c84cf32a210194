"""Integrity checks: the violations of a constraint, as a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their row count; keys containing a null never conflict."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def check_fk(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child values without a parent row, with their row count.

    Counting first means the join moves each distinct value once, however
    many child rows share it.
    """
    used = child.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    return used.join(parent.select(F.col(parent_col).alias(col)), col, "left_anti")


def check_domain(df: DataFrame, col: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose value is outside the list; null passes."""
    return df.filter(~F.col(col).isin(*values))


def check_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n_rows) for every listed column that holds nulls; one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "n_rows").filter(F.col("n_rows") > 0)
