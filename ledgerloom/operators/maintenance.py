"""Patches to stored tables: added columns, relabelled dimensions, rescaled measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patch_column(target: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """Add one column from a patch keyed like the target.

    Refuses a column that is already there. A row the patch does not cover raises when the
    result is read, so an incomplete patch cannot be stored.
    """
    if column in target.columns:
        raise ValueError(f"{column} is already present; the patch was applied before")
    patched = target.join(patch.select(key, column), key, "left")
    return patched.withColumn(
        column,
        F.coalesce(column, F.raise_error(F.concat(F.lit(f"no {column} for {key} "), F.col(key).cast("string")))),
    )


def relabel(dimension: DataFrame, mapping: DataFrame, key: str, column: str) -> DataFrame:
    """Replace labels by key; keys without a new label keep the old one.

    ``mapping`` is ``(key, new_label)``.
    """
    new = mapping.select(key, F.col("new_label").alias("__new"))
    return dimension.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(
        *dimension.columns
    )


def relabel_audit(relabelled: DataFrame, column: str, old_pattern: str) -> DataFrame:
    """One row: labels, distinct labels, and labels still in the old style."""
    labels = relabelled.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return labels.agg(
        F.sum("n").alias("labels"),
        F.count(column).alias("distinct_labels"),
        F.coalesce(F.sum(F.when(F.col(column).like(old_pattern), F.col("n"))), F.lit(0)).alias("old_style_left"),
    ).withColumn("one_to_one", F.col("labels") == F.col("distinct_labels"))


def rescale(df: DataFrame, columns: Sequence[str], factor: float) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(factor)) for c in columns})


def yearly_range(df: DataFrame, day: str, value: str, low: float, high: float) -> DataFrame:
    """Total per year and whether it lies in the range."""
    years = df.groupBy(F.year(day).alias("year_num")).agg(F.sum(value).alias("total"))
    return years.withColumn("in_range", F.col("total").between(low, high))
