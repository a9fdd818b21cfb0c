"""One-row results used inside other plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Column:
    """The single row of a frame as a struct.

    It is an uncorrelated scalar subquery: evaluated once, usable in filters that reach the
    scan, and an error when the frame has a second row. No rows give NULL.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns])).scalar()
