"""Contracts of the tables that operators exchange, and checks of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = ("sample_id", "train_id", "similarity")
SPLIT = ("sample_id", "split", "role")
CURVE = ("subset", "threshold", "spectral_parameter", "test_size", "mean_novelty")


def require(df: DataFrame, columns: list[str] | tuple[str, ...], what: str = "table") -> DataFrame:
    """The table itself, or ``ValueError`` naming the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def finite(column: str):
    """Neither null, NaN nor infinite (Spark takes NaN as larger than all numbers)."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
