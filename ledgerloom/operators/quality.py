"""Data-quality and acceptance checks.

Every check returns rows ``check_id, label, expected, actual, passed``; ``report`` puts
them together. Large tables are reduced to a few rows inside each check.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.scalars import one_row

CHECK_COLUMNS = ["check_id", "label", "expected", "actual", "passed"]


def _check(one_row: DataFrame, check_id: str, label: str, expected: str | Column, actual: Column, passed: Column) -> DataFrame:
    return _checks(one_row, [(check_id, label, expected, actual, passed)])


def _checks(one_row: DataFrame, entries: Sequence[tuple[str, str, str | Column, Column, Column]]) -> DataFrame:
    """Several checks from one row of aggregates, which is computed once."""
    rows = [
        F.struct(
            F.lit(check_id).alias("check_id"),
            F.lit(label).alias("label"),
            F.lit(expected).alias("expected"),
            actual.cast("double").alias("actual"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
        )
        for check_id, label, expected, actual, passed in entries
    ]
    return one_row.select(F.inline(F.array(*rows)))


def report(checks: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select(*CHECK_COLUMNS) for c in checks])


def row_counts(wh: Mapping[str, DataFrame], expected: Mapping[str, int | Column], tolerance: float = 0.05) -> DataFrame:
    """Row count of each table within a fraction of what is expected: a number, or a scalar subquery."""
    rows = F.count(F.lit(1))
    wanted = F.col("wanted")
    return report(
        _check(
            wh[name].agg(rows.alias("n")).withColumn("wanted", F.lit(n).cast("bigint")), f"rows:{name}", "row count",
            wanted.cast("string"), F.col("n"), F.abs(F.col("n") - wanted) <= tolerance * wanted,
        )
        for name, n in expected.items()
    )


def orphans(wh: Any, tables: Sequence[str] | None = None) -> DataFrame:
    """Rows whose foreign key has no target, for every declared key.

    Each table is read once: its keys become ``(relation, value)`` rows that are counted
    before they meet the targets, so a hot key arrives as one row. A NULL key is no orphan.
    Targets are made distinct only where their key is not declared unique.
    """
    hops = [h for h in wh.catalog.foreign_keys(wh.tenant) if tables is None or h.left in tables]
    by_table: dict[str, list[Any]] = {}
    for hop in hops:
        by_table.setdefault(hop.left, []).append(hop)

    def name(hop: Any) -> str:
        return f"{hop.left}.{hop.left_key}"

    def target(hop: Any) -> str:
        return f"{hop.right}.{hop.right_key}"

    # whole numbers and days travel as bigint, which groups and joins faster than text
    types = {wh.catalog.struct(wh.tenant, h.right)[h.right_key].dataType for h in hops}
    plain = all(isinstance(t, (T.LongType, T.IntegerType, T.DateType)) for t in types)

    def carried(table: str, column: str) -> Column:
        if not plain:
            return F.col(column).cast("string")
        is_day = isinstance(wh.catalog.struct(wh.tenant, table)[column].dataType, T.DateType)
        return (F.unix_date(column) if is_day else F.col(column)).cast("bigint")

    targets = sorted({(h.right, h.right_key) for h in hops})
    number = {f"{t}.{k}": i for i, (t, k) in enumerate(targets)}

    def keys(table: str) -> DataFrame:
        entries = [
            F.struct(
                F.lit(hops.index(h)).alias("relation"), F.lit(number[target(h)]).alias("target"),
                carried(table, h.left_key).alias("value"),
            )
            for h in by_table[table]
        ]
        return wh[table].select(F.inline(F.array(*entries))).where("value is not null")

    used = reduce(DataFrame.unionByName, [keys(t) for t in by_table])
    counted = used.groupBy("relation", "target", "value").agg(F.count(F.lit(1)).alias("n"))

    def values(table: str, key: str) -> DataFrame:
        found = wh[table].select(F.lit(number[f"{table}.{key}"]).alias("target"), carried(table, key).alias("value"))
        return found if wh.catalog.table(wh.tenant, table).primary_key == key else found.distinct()

    present = reduce(DataFrame.unionByName, [values(t, k) for t, k in targets])
    missing = counted.join(present, ["target", "value"], "left_anti").groupBy("relation").agg(F.sum("n").alias("n"))
    relations = wh.spark.createDataFrame(
        [(i, name(h), target(h)) for i, h in enumerate(hops)], "relation int, key string, target string"
    )
    return relations.join(F.broadcast(missing), "relation", "left").select(
        F.concat(F.lit("fk:"), "key").alias("check_id"),
        F.concat(F.lit("resolves in "), "target").alias("label"),
        F.lit("0").alias("expected"),
        F.coalesce("n", F.lit(0)).cast("double").alias("actual"),
        F.col("n").isNull().alias("passed"),
    )


def date_spine(calendar: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """One row per day with no gap, and the exact bounds when given."""
    span = calendar.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("full_date").alias("days"),
        F.min("full_date").alias("lo"), F.max("full_date").alias("hi"),
    )
    gaps = F.datediff("hi", "lo") + 1 - F.col("days")
    checks = [
        ("spine:gaps", "missing days", "0", gaps, gaps == 0),
        ("spine:repeats", "repeated days", "0", F.col("n") - F.col("days"), F.col("n") == F.col("days")),
    ]
    for label, column, wanted in (("first day", "lo", first), ("last day", "hi", last)):
        if wanted is not None:
            off = F.datediff(F.col(column), F.lit(wanted))
            checks.append((f"spine:{column}", label, str(wanted), off, off == 0))
    return _checks(span, checks)


def spike(
    rates: DataFrame, is_target: Column, rate: str, at_least: float, others_at_most: float | None = None,
    times_others: float | None = None, check_id: str = "spike",
) -> DataFrame:
    """The target period stands out: at least a level, with the others under a level or a
    multiple below it."""
    sides = rates.agg(
        F.max(F.when(is_target, F.col(rate))).alias("target"), F.max(F.when(~is_target, F.col(rate))).alias("others")
    )
    passed = F.col("target") >= at_least
    text = f">= {at_least:g}"
    if others_at_most is not None:
        passed &= F.coalesce("others", F.lit(0.0)) <= others_at_most
        text += f", others <= {others_at_most:g}"
    if times_others is not None:
        passed &= F.col("target") >= times_others * F.coalesce("others", F.lit(0.0))
        text += f", {times_others:g}x others"
    return _check(sides, check_id, "target period stands out", text, F.col("target"), passed)


def dark_since(orders: DataFrame, entity: Column, day: str, since: date, check_id: str) -> DataFrame:
    """No rows of the entity on or after a day."""
    found = orders.where(entity & (F.col(day) >= F.lit(since))).agg(F.count(F.lit(1)).alias("n"))
    return _check(found, check_id, f"no activity since {since}", "0", F.col("n"), F.col("n") == 0)


def compression(periods: DataFrame, order: str, value: str, at_least: float, check_id: str = "compression") -> DataFrame:
    """Fall from the first to the last period."""
    fall = periods.agg((F.min_by(value, order) - F.max_by(value, order)).alias("fall"))
    return _check(fall, check_id, "fall from first to last", f">= {at_least:g}", F.col("fall"), F.col("fall") >= at_least)


def share_at_least(df: DataFrame, condition: Column, percent: float, check_id: str) -> DataFrame:
    share = df.agg((F.count(F.when(condition, 1)) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share"))
    return _check(share, check_id, "share of rows", f">= {percent:g}", F.col("share"), F.col("share") >= percent)


def category_counts(df: DataFrame, column: str, expected: Mapping[str, int]) -> DataFrame:
    """Exact number of rows per category, in one pass."""
    counts = df.agg(*[F.count(F.when(F.col(column) == v, 1)).alias(f"n{i}") for i, v in enumerate(expected)])
    return _checks(
        counts,
        [
            (f"count:{column}={v}", "rows in category", str(n), F.col(f"n{i}"), F.col(f"n{i}") == n)
            for i, (v, n) in enumerate(expected.items())
        ],
    )


def grows(periods: DataFrame, order: str, value: str, check_id: str = "growth") -> DataFrame:
    """Each period above the one before. ``periods`` holds one row per period."""
    before = F.lag(value).over(Window.orderBy(order))
    steps = periods.withColumn("before", before).agg(
        F.count(F.when(F.col(value) <= F.col("before"), 1)).alias("falls"), F.count(F.lit(1)).alias("n")
    )
    return _check(steps, check_id, "periods that do not grow", "0", F.col("falls"), (F.col("falls") == 0) & (F.col("n") > 1))


def primary_keys(wh: Any, tables: Sequence[str] | None = None) -> DataFrame:
    """No NULL and no repeated primary key."""
    checks = []
    for table in wh.catalog.of_tenant(wh.tenant):
        key = table.primary_key
        if key is None or (tables is not None and table.name not in tables):
            continue
        counted = wh[table.name].groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        sums = counted.agg(
            F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count(F.when(F.col("k").isNotNull() & (F.col("n") > 1), 1)).alias("repeats"),
        )
        checks.append(
            _checks(
                sums,
                [
                    (f"pk:{table.name}:null", f"{key} is NULL", "0", F.col("nulls"), F.col("nulls") == 0),
                    (f"pk:{table.name}:repeat", f"{key} repeats", "0", F.col("repeats"), F.col("repeats") == 0),
                ],
            )
        )
    return report(checks)


def accepted_values(wh: Any, tables: Sequence[str] | None = None) -> DataFrame:
    """Rows outside the declared values of every enumerated column; one pass per table."""
    checks = []
    for table in wh.catalog.of_tenant(wh.tenant):
        listed = [c for c in table.columns if c.values]
        if not listed or (tables is not None and table.name not in tables):
            continue
        outside = [F.count(F.when(~F.col(c.name).isin(list(c.values)), 1)).alias(c.name) for c in listed]
        counts = wh[table.name].agg(*outside)
        checks.append(
            _checks(
                counts,
                [
                    (f"values:{table.name}.{c.name}", "in " + "|".join(c.values), "0", F.col(c.name), F.col(c.name) == 0)
                    for c in listed
                ],
            )
        )
    return report(checks)


def top_n_sane(top: DataFrame, label: str, amount: str, n: int, check_id: str = "top_n") -> DataFrame:
    """Exactly n rows, each with a label and a positive amount."""
    good = F.count(F.when(F.col(label).isNotNull() & (F.col(label) != "") & (F.col(amount) > 0), 1))
    counts = top.agg(F.count(F.lit(1)).alias("n"), good.alias("good"))
    return _check(counts, check_id, "usable rows", str(n), F.col("good"), (F.col("n") == n) & (F.col("good") == n))


def in_band(one_row: DataFrame, value: str, low: float, high: float, check_id: str) -> DataFrame:
    """A value within a band; a missing value or row fails."""
    known = one_row.agg(F.max(value).alias(value))
    return _check(known, check_id, "within band", f"{low:g}..{high:g}", F.col(value), F.col(value).between(low, high))


def gradient(groups: DataFrame, order: str, measures: Sequence[str], wanted_groups: int) -> DataFrame:
    """Every measure strictly rises over the ordered groups. ``groups`` is one row per group."""
    ordered = Window.orderBy(order)
    steps = groups.select(
        *[(F.col(m) > F.lag(m).over(ordered)).alias(m) for m in measures]
    ).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(~F.col(m), 1)).alias(m) for m in measures],
    )
    return _checks(
        steps,
        [
            (
                f"gradient:{m}", f"steps over {order} that do not rise", "0", F.col(m),
                (F.col(m) == 0) & (F.col("n") == wanted_groups),
            )
            for m in measures
        ],
    )


def separated(groups: DataFrame, group: str, value: str, high: str, low: str, at_least: float, check_id: str) -> DataFrame:
    pick = lambda g: F.max(F.when(F.col(group) == g, F.col(value)))
    gap = groups.agg((pick(high) - pick(low)).alias("gap"))
    return _check(gap, check_id, f"{high} above {low}", f">= {at_least:g}", F.col("gap"), F.col("gap") >= at_least)


def only_values(df: DataFrame, column: str, allowed: Sequence[str], check_id: str) -> DataFrame:
    """No row outside a set of groups."""
    outside = df.agg(F.count(F.when(~F.col(column).isin(list(allowed)) | F.col(column).isNull(), 1)).alias("n"))
    return _check(outside, check_id, f"{column} outside {'|'.join(allowed)}", "0", F.col("n"), F.col("n") == 0)


def largest_is(df: DataFrame, label: str, value: str, wanted: str, check_id: str) -> DataFrame:
    top = df.agg(F.max(value).alias("best"), F.max(F.when(F.col(label) == wanted, F.col(value))).alias("wanted"))
    return _check(top, check_id, f"{wanted} is the largest", wanted, F.col("wanted"), F.col("wanted") == F.col("best"))


def flat(df: DataFrame, value: str, within: float, check_id: str) -> DataFrame:
    spread = df.agg((F.max(value) - F.min(value)).alias("spread"))
    return _check(spread, check_id, "spread", f"< {within:g}", F.col("spread"), F.col("spread") < within)


def isolated(results: DataFrame, id_column: str, tenant: str, check_id: str = "isolation") -> DataFrame:
    """No id of another tenant among ``tenant:name`` ids."""
    foreign = F.count(F.when(~F.startswith(F.col(id_column), F.lit(f"{tenant}:")), 1))
    return _check(results.agg(foreign.alias("n")), check_id, f"ids outside {tenant}", "0", F.col("n"), F.col("n") == 0)


def tenant_probe(results: DataFrame, queries: DataFrame, owners: DataFrame, check_id: str = "isolation") -> DataFrame:
    """A check for each tenant: its queries found something, and nothing of another tenant.

    ``results`` is ``(query_id, id)``, ``queries`` ``(query_id, tenant)``, ``owners`` ``(id, tenant)``.
    """
    found = results.select("query_id", "id").join(owners.withColumnRenamed("tenant", "owner"), "id")
    per_query = found.groupBy("query_id").agg(F.collect_set("owner").alias("owners"))
    seen = queries.join(per_query, "query_id", "left").groupBy("tenant").agg(
        F.count("owners").alias("answered"),
        F.count(F.when(F.size(F.array_remove("owners", F.col("tenant"))) > 0, 1)).alias("n"),
    )
    return _check(
        seen, F.concat(F.lit(f"{check_id}:"), "tenant"), "queries that reach another tenant", "0", F.col("n"),
        (F.col("n") == 0) & (F.col("answered") > 0),
    )


def parity(left: DataFrame, right: DataFrame, sums: Mapping[str, Column], check_id: str, digits: int = 2) -> DataFrame:
    """Row count and totals of two copies agree."""
    aggregates = [F.count(F.lit(1)).alias("rows"), *[F.round(F.sum(c), digits).alias(n) for n, c in sums.items()]]
    other = right.agg(*[a.alias(f"r{i}") for i, a in enumerate(aggregates)])
    both = left.agg(*[a.alias(f"l{i}") for i, a in enumerate(aggregates)]).withColumn("r", one_row(other)).select("*", "r.*")
    names = ["rows", *sums]
    return _checks(
        both,
        [
            (
                f"{check_id}:{n}", "difference between the copies", "0",
                F.col(f"l{i}") - F.col(f"r{i}"), F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")),
            )
            for i, n in enumerate(names)
        ],
    )


def content_digests(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Per part: the number of rows and a digest of their contents that no order of rows changes.

    Two 64-bit hashes a row, which see NULLs and where they stand, are combined by exclusive or
    and by sums of 24 bits, so parts merge on the map side and repeated rows count. Doubles are
    compared exactly. Columns of equal names must have equal types on both sides.
    """
    shown = [F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]
    seen = [*shown, *[c.isNull() for c in shown]]
    rows = df.select(*by, F.xxhash64(*seen).alias("__x"), F.xxhash64(F.lit(1), *seen).alias("__y"))
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFF))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.struct(
            F.bit_xor("__x").alias("x"), F.bit_xor("__y").alias("y"),
            F.sum(low("__x")).alias("sum_x"), F.sum(low("__y")).alias("sum_y"),
        ).alias("digest"),
    )


def differing_parts(
    left: DataFrame, right: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """The parts whose rows are not the same on both sides: ``by``, ``left_rows`` and ``right_rows``."""
    sides = [
        content_digests(df, by, columns or left.columns).withColumn("side", F.lit(tag))
        for df, tag in ((left, "left"), (right, "right"))
    ]
    of = lambda tag, c: F.max(F.when(F.col("side") == tag, F.col(c)))
    met = sides[0].unionByName(sides[1]).groupBy(*by).agg(
        F.coalesce(of("left", "rows"), F.lit(0)).alias("left_rows"), F.coalesce(of("right", "rows"), F.lit(0)).alias("right_rows"),
        of("left", "digest").alias("a"), of("right", "digest").alias("b"),
    )
    return met.where("left_rows <> right_rows or not (a <=> b)").drop("a", "b")


def content_parity(
    left: DataFrame, right: DataFrame, by: Sequence[str], check_id: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """No part of two copies differs in any row."""
    n = differing_parts(left, right, by, columns).agg(F.count(F.lit(1)).alias("n"))
    return _check(n, check_id, "parts that differ", "0", F.col("n"), F.col("n") == 0)
