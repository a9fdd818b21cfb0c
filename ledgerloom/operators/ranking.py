"""Ranking and order statistics that never sort a whole table in one task.

Order statistics read their input once for each level of their bracket and once more: give
them a frame that is cheap to read again, such as an aggregate passed through
``session.computed_once``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import one_row
from ledgerloom.session import computed_once

# rank error of the quantile sketch is at most 1 / SKETCH_ACCURACY of the rows
SKETCH_ACCURACY = 50_000
# the rows inside a bracket are cut into this many parts, and it narrows to four of them
PARTS = 200
NARROWINGS = 2


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows. End the order with a unique key so that ties are settled."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, group: Sequence[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each group.

    Spark pushes the ``row_number() <= n`` limit below the exchange, so a hot group sends
    at most n rows per task.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.where(F.col(rank) <= n)


def with_total(df: DataFrame, total: Column, name: str) -> DataFrame:
    """Every row with one grand total: a scalar subquery, not an unpartitioned window."""
    df = computed_once(df)
    return df.withColumn(name, df.agg(total).scalar())


def with_share(df: DataFrame, value: str, name: str = "pct_of_total") -> DataFrame:
    total = f"__{value}_total"
    return with_total(df, F.sum(value), total).withColumn(
        name, F.try_divide(F.col(value) * 100.0, F.col(total))
    ).drop(total)


def _fractions(parts: range, of: int) -> Column:
    """A constant array, parsed as one expression."""
    return F.expr(f"array({', '.join(f'{i / of!r}D' for i in parts)})")


def rank_bracket(
    df: DataFrame, value: str, fraction: float, position: Column, accuracy: int = SKETCH_ACCURACY, parts: int = PARTS,
    narrowings: int = NARROWINGS,
) -> DataFrame:
    """One row: the row count ``n``, the wanted ``rank``, and values ``low`` and ``high`` around it.

    A mergeable quantile sketch of all rows gives the first bracket, about six parts in
    ``accuracy`` of them. Each narrowing counts the rows below the bracket, sketches those
    inside, and keeps the four of ``parts`` parts around the rank. The number of levels is
    fixed, and each is a scalar subquery of the next: nothing runs while the plan is made.
    """
    x = F.col(value)
    margin = 3.0 / accuracy
    ends = [max(0.0, fraction - margin), min(1.0, fraction + margin)]
    bracket = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(x, ends, accuracy).alias("ends")).select(
        "n", position.cast("bigint").alias("rank"), F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")
    )
    grid = _fractions(range(parts + 1), parts)
    for _ in range(narrowings):
        inside = x.between(F.col("b.low"), F.col("b.high"))
        sketched = df.withColumn("b", one_row(bracket)).agg(
            F.first("b").alias("b"),
            F.count(F.when(x < F.col("b.low"), 1)).alias("under"),
            F.count(F.when(inside, 1)).alias("held"),
            F.percentile_approx(F.when(inside, x), grid, max(accuracy, 10 * parts)).alias("grid"),
        )
        spot = F.try_divide((F.col("b.rank") - F.col("under")) * F.lit(parts), F.col("held"))
        # a rank just outside keeps the edge it stands beside

        def edge(part: Column) -> Column:
            return F.get("grid", F.least(F.greatest(part, F.lit(0)), F.lit(parts)).cast("int"))

        bracket = sketched.select(
            "b.n", "b.rank", edge(F.floor(spot) - 1).alias("low"), edge(F.ceil(spot) + 1).alias("high")
        )
    return bracket


def order_statistic(df: DataFrame, value: str, fraction: float, position: Column) -> DataFrame:
    """One row: the exact values of a numeric column at a rank and at the next rank.

    ``position`` gives the zero-based rank from the smallest as a function of the row
    count ``n``, and ``fraction`` is where that rank lies (0 to 1). ``rank_bracket`` narrows
    the values to some five rows in a hundred million; rows under and over the bracket
    collapse into one counted row each, and only the distinct values inside are ordered in one
    place. The sketches decide how much is ordered, never the result: a rank outside the
    bracket raises.
    """
    x = F.col(value)
    rows = df.where(x.isNotNull()).select(x)
    bracket = rank_bracket(rows, value, fraction, position)
    zone = F.when(x < F.col("b.low"), 0).when(x <= F.col("b.high"), 1).otherwise(2)
    counted = (
        rows.withColumn("b", one_row(bracket))
        .groupBy(zone.alias("zone"), F.when(zone == 1, x).alias("v"))
        .agg(
            F.count(F.lit(1)).alias("c"), F.min(x).alias("lowest"), F.max(x).alias("highest"),
            F.first("b.n").alias("n"), F.first("b.rank").alias("rank"),
        )
    )
    ordered = Window.orderBy("zone", "v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("last", F.sum("c").over(ordered) - 1).withColumn("first", F.col("last") - F.col("c") + 1)

    def at(rank: Column) -> Column:
        # an end zone knows only the value next to the bracket
        known = (
            F.when(F.col("zone") == 1, F.col("v"))
            .when((F.col("zone") == 0) & (rank == F.col("last")), F.col("highest"))
            .when((F.col("zone") == 2) & (rank == F.col("first")), F.col("lowest"))
            .otherwise(F.raise_error(F.lit("rank outside the sketch bracket")))
        )
        return F.max(F.when(rank.between(F.col("first"), F.col("last")), known))

    return ranked.agg(
        at(F.col("rank")).alias("value"),
        at(F.least(F.col("rank") + 1, F.col("n") - 1)).alias("next_value"),
        F.first("n").alias("n"),
        F.first("rank").alias("rank"),
    )


def exact_quantile(df: DataFrame, value: str, p: float, name: str = "q") -> DataFrame:
    """One row: the linearly interpolated quantile, equal to ``percentile(value, p)``."""
    spot = F.lit(float(p)) * (F.col("n") - 1)
    at = order_statistic(df.select(F.col(value).cast("double").alias(value)), value, p, F.floor(spot))
    weight = spot - F.col("rank")
    return at.select((F.col("value") + (F.col("next_value") - F.col("value")) * weight).alias(name))


def top_fraction_share(df: DataFrame, value: str, fraction: float, name: str = "share") -> DataFrame:
    """One row: the share of the total held by the largest ``ceil(n * fraction)`` rows.

    Found from the smallest value that makes the cut, with no ranking of the rows: rows
    above it count in full, and equal rows fill the places that are left.
    """
    places = F.ceil(F.col("n") * F.lit(fraction))
    cut = order_statistic(df, value, 1.0 - fraction, F.greatest(F.col("n") - places, F.lit(0))).select(
        F.col("value").alias("cut"), places.alias("places")
    )
    x = F.col(value)
    sums = df.withColumn("c", one_row(cut)).agg(
        F.sum(F.when(x > F.col("c.cut"), x)).alias("above"),
        F.count(F.when(x > F.col("c.cut"), 1)).alias("n_above"),
        F.sum(x).alias("total"),
        F.first("c.cut").alias("cut"),
        F.first("c.places").alias("places"),
    )
    held = F.coalesce("above", F.lit(0.0)) + (F.col("places") - F.col("n_above")) * F.col("cut")
    return sums.select(F.try_divide(held, F.col("total")).alias(name))


def neighbour_gaps(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """``(value, lower, gap)``: each distinct value with the next smaller one.

    The values are cut into bins at the quantiles of a sketch, a scalar subquery of the plan,
    so no task orders more than about one bin's share. A bin hands its largest value to the
    next one: the first value of a bin takes its neighbour from the bin summaries.
    """
    x = F.col(value)
    rows = computed_once(df.where(x.isNotNull()).select(x.cast("double").alias(value)).distinct())
    grid = _fractions(range(1, bins), bins)
    cuts = rows.agg(F.array_distinct(F.percentile_approx(x, grid, 16 * bins)).alias("cuts"))
    edged = rows.withColumn("cuts", cuts.scalar())
    binned = edged.withColumn("bin", F.size(F.filter("cuts", lambda c: c < x))).drop("cuts")
    within = binned.withColumn("lower", F.lag(value).over(Window.partitionBy("bin").orderBy(value)))
    summary = binned.groupBy("bin").agg(F.max(value).alias("highest"))
    below = summary.select("bin", F.lag("highest").over(Window.orderBy("bin")).alias("below"))
    return within.join(F.broadcast(below), "bin").select(
        x.alias("value"), F.coalesce("lower", "below").alias("lower"),
        (x - F.coalesce("lower", "below")).alias("gap"),
    )
