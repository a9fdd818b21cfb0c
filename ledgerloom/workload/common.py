"""Shared by the runnable queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import kept, tune
from ledgerloom.sources.files import SHARED_STEPS
from ledgerloom.sources.warehouse import Warehouse, distributor, furniture

Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles, widen whole numbers to bigint, write dates as ``YYYY-MM-DD``."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # adding 0.0 turns a negative zero into zero
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def with_steps_kept(wh: Warehouse, steps: Sequence[str] = SHARED_STEPS) -> Warehouse:
    """The warehouse with the joins that several of its facts start from made once, each from those before it."""
    for step in steps:
        wh = wh.replaced(**{step: kept(wh[step])})
    return wh


def on_distributor(build: Callable[[Warehouse], DataFrame], digits: int = 4) -> Query:
    return lambda spark, folder: tidy(build(distributor(tune(spark), folder)), digits)


def on_furniture(build: Callable[[Warehouse], DataFrame], digits: int = 4) -> Query:
    return lambda spark, folder: tidy(build(furniture(tune(spark), folder)), digits)


def on_raw(build: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame], digits: int = 6) -> Query:
    """For jobs over single raw tables: the callable gets a reader by table name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return tidy(build(spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet")), digits)

    return run
