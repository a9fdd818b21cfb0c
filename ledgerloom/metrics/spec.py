"""Governed metrics: a declared formula that can be sliced, filtered and compared.

A metric is one or more *legs*. A leg aggregates one fact; the metric's value is an
expression over the parts of all legs. Computing a leg

1. applies the row filter and the period to the fact, so both reach the scan;
2. aggregates by the foreign keys that lead to the wanted dimensions *before* joining
   them, so a hot key is combined on the map side and the joins see one row per key;
3. joins the dimensions along the declared foreign keys and aggregates to the wanted
   grain.

A fact that the warehouse spreads from a smaller step has one row per key and day, so nothing
combines before the join: there the dimensions are joined with the step, before it is spread.

Legs meet at that grain by a union and one small aggregation, not by fact-to-fact joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Hop
from ledgerloom.functions.dates import CALENDAR_ATTRIBUTES
from ledgerloom.functions.labels import sentiment_label
from ledgerloom.periods import Period, month_column

Where = Mapping[str, Any]

COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Part:
    """A decomposable aggregate of a SQL expression."""

    kind: str
    expr: str

    def first(self, name: str) -> Column:
        return FIRST[self.kind](F.expr(self.expr)).alias(name)

    def combine(self, name: str) -> Column:
        return COMBINE[self.kind](F.col(name)).alias(name)


def total(expr: str) -> Part:
    return Part("sum", expr)


def count(expr: str = "1") -> Part:
    return Part("count", expr)


def lowest(expr: str) -> Part:
    return Part("min", expr)


def highest(expr: str) -> Part:
    return Part("max", expr)


@dataclass(frozen=True)
class Leg:
    fact: str
    parts: Mapping[str, Part]
    keep: str | None = None
    day: str | None = None
    # two-level: aggregate to this grain first, then ``outer`` over its rows
    per: tuple[str, ...] = ()
    outer: Mapping[str, Part] = field(default_factory=dict)
    # dimension attributes the fact itself carries, as expressions over its columns
    local: Mapping[str, str] = field(default_factory=dict)
    # dimensions reached through a parent fact: table -> (own column, parent, its unique column)
    borrow: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)
    # the parent's date, where ``dim_date`` is borrowed
    borrowed_day: str | None = None
    # the finer fact this one sums up, for dimensions and periods that the sums have lost
    detail: Leg | None = None
    # a frame to use instead of the stored fact, with the fact's keys
    source: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None
    # the same for a fact of states: what stood at the end of the period
    as_of: Callable[[Mapping[str, DataFrame], Period | None], DataFrame] | None = None


def output_names(by: Sequence[str]) -> list[str]:
    """Column names of the wanted attributes; equal names get their table in front."""
    short = [attribute.split(".")[1] for attribute in by]
    return [s if short.count(s) == 1 else a.replace(".", "_") for a, s in zip(by, short)]


def _matches(value: Column, wanted: Any) -> Column:
    return value.isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else value == F.lit(wanted)


def leg_path(catalog: Any, tenant: str, leg: Leg, table: str) -> list[Hop]:
    """The joins from a leg's fact to a dimension, through a parent fact where it is borrowed."""
    if table not in leg.borrow:
        return catalog.path(tenant, leg.fact, table)
    key, parent, parent_key = leg.borrow[table]
    onward = [] if table == "dim_date" else catalog.path(tenant, parent, table)
    return [Hop(leg.fact, key, parent, parent_key), *onward]


def reaches(catalog: Any, tenant: str, leg: Leg, attribute: str) -> bool:
    """Whether a leg can be sliced by an attribute, by the declared keys alone."""
    table, column = attribute.split(".")
    if attribute in leg.local:
        return True
    if table == "dim_date":
        return column in CALENDAR_ATTRIBUTES and (leg.day is not None or table in leg.borrow)
    try:
        leg_path(catalog, tenant, leg, table)
    except ValueError:
        return False
    return column in [c.name for c in catalog.table(tenant, table).columns]


def at_detail(catalog: Any, tenant: str, leg: Leg, attributes: Sequence[str], period: Period | None) -> Leg:
    """The leg, or the leg over the finer fact where only that one knows what is asked."""
    dated = leg.day is not None or "dim_date" in leg.borrow
    enough = (period is None or dated) and all(reaches(catalog, tenant, leg, a) for a in attributes)
    return leg if enough or leg.detail is None else leg.detail


def aggregate_leg(
    wh: Any,
    leg: Leg,
    by: Sequence[str] = (),
    period: Period | None = None,
    where: Where | None = None,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The leg's parts at the grain ``by`` plus the ``extra`` columns of the fact."""
    where, extra = dict(where or {}), dict(extra or {})
    leg = at_detail(wh.catalog, wh.tenant, leg, [*by, *where], period)
    borrowed = leg.day is None and "dim_date" in leg.borrow
    if period is not None and not borrowed and leg.day is None:
        raise ValueError(f"{leg.fact} carries no date, so it cannot be limited to a period")

    attributes = list(dict.fromkeys([*by, *where]))
    slot = {attribute: f"__a{i}" for i, attribute in enumerate(attributes)}
    on_fact: dict[str, Column] = {}
    to_join: dict[str, list[str]] = {}
    for attribute in attributes:
        table, column = attribute.split(".")
        if attribute in leg.local:
            on_fact[attribute] = F.expr(leg.local[attribute])
        elif table == "dim_date" and not borrowed:
            if leg.day is None:
                raise ValueError(f"{leg.fact} carries no date, so it cannot be sliced by {attribute}")
            on_fact[attribute] = CALENDAR_ATTRIBUTES[column](F.col(leg.day))
        else:
            to_join.setdefault(table, []).append(attribute)
    if borrowed and period is not None:
        to_join.setdefault("dim_date", [])
    paths = {table: leg_path(wh.catalog, wh.tenant, leg, table) for table in to_join}

    spread = None if leg.as_of or leg.source else wh.spreads.get(leg.fact)
    before = [table for table, path in paths.items() if spread and path[0].left_key == spread.key]
    carried: list[str] = []
    if leg.as_of:
        frame = leg.as_of(wh, period)
    elif before:
        frame = wh[spread.step].withColumn(f"__k_{spread.key}", F.col(spread.key))
        for table in before:
            names = to_join.pop(table)
            frame = _join_path(wh, frame, paths.pop(table), {a.split(".")[1]: slot[a] for a in names})
            for attribute in names:
                if attribute in where:
                    frame = frame.where(_matches(F.col(slot[attribute]), where[attribute]))
            carried += [slot[a] for a in names if a in by]
        frame = spread.rows(wh, frame, carried)
    else:
        frame = leg.source(wh) if leg.source else wh[leg.fact]
    if leg.keep:
        frame = frame.where(F.expr(leg.keep))
    if period is not None and not borrowed:
        frame = frame.where(period.on(F.col(leg.day)))
        if month_column(leg.day) in frame.columns:
            frame = frame.where(period.on_month(F.col(month_column(leg.day))))
    for attribute, value in on_fact.items():
        if attribute in where:
            frame = frame.where(_matches(value, where[attribute]))

    keys = {f"__k_{path[0].left_key}": F.col(path[0].left_key) for path in paths.values()}
    per = {f"__p{i}": F.expr(p) for i, p in enumerate(leg.per)}
    local = {slot[a]: c for a, c in on_fact.items() if a in by}
    grain = [*[slot[a] for a in by], *extra]

    first = [part.first(name) for name, part in leg.parts.items()]
    again = [part.combine(name) for name, part in leg.parts.items()]
    groups = {**local, **{c: F.col(c) for c in carried}, **keys, **per, **extra}
    frame = _grouped(frame, [c.alias(n) for n, c in groups.items()], first)
    for table, path in paths.items():
        if borrowed and table == "dim_date":
            frame = _join_path(wh, frame, path, {leg.borrowed_day: "__day"}, period and period.on(F.col(leg.borrowed_day)))
            for attribute in to_join[table]:
                frame = frame.withColumn(slot[attribute], CALENDAR_ATTRIBUTES[attribute.split(".")[1]](F.col("__day")))
        else:
            frame = _join_path(wh, frame, path, {a.split(".")[1]: slot[a] for a in to_join[table]})
    for attribute in (a for names in to_join.values() for a in names):
        if attribute in where:
            frame = frame.where(_matches(F.col(slot[attribute]), where[attribute]))
    if paths:
        frame = _grouped(frame, [*grain, *per], again)
    if leg.per:
        renamed = {p: c for p, c in zip(leg.per, per)}
        outer = [
            FIRST[part.kind](F.col(renamed[part.expr]) if part.expr in renamed else F.expr(part.expr)).alias(name)
            for name, part in leg.outer.items()
        ]
        frame = frame.groupBy(*grain).agg(*outer)
    names = output_names(by)
    parts = list(leg.outer if leg.per else leg.parts)
    return frame.select(*[F.col(slot[a]).alias(n) for a, n in zip(by, names)], *extra, *parts)


def _grouped(frame: DataFrame, keys: Sequence[Any], parts: Sequence[Column]) -> DataFrame:
    return frame.groupBy(*keys).agg(*parts) if parts else frame.select(*keys).distinct()


def _join_path(
    wh: Any, frame: DataFrame, path: Sequence[Any], attributes: Mapping[str, str], only: Column | None = None
) -> DataFrame:
    """Join along a path and carry attributes of its end; ``only`` filters the end's rows."""
    key = f"__k_{path[0].left_key}"
    for i, hop in enumerate(path):
        last = i == len(path) - 1
        carried = (
            [F.col(c).alias(n) for c, n in attributes.items()]
            if last
            else [F.col(path[i + 1].left_key).alias(f"__n{i}")]
        )
        rows = wh[hop.right].where(only) if last and only is not None else wh[hop.right]
        right = rows.select(F.col(hop.right_key).alias("__right"), *carried)
        frame = frame.join(right, F.col(key) == F.col("__right")).drop("__right")
        key = f"__n{i}"
    return frame


def meet(legs: Sequence[DataFrame], grain: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Bring leg results together at their common grain; a missing count is 0."""
    if len(legs) == 1:
        return legs[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs)
    parts = [c for c in stacked.columns if c not in grain]
    kept = [
        (F.coalesce(F.max(p), F.lit(0)) if p in counts else F.max(p)).alias(p) for p in parts
    ]
    return stacked.groupBy(*grain).agg(*kept)


@dataclass(frozen=True)
class Metric:
    name: str
    tenant: str
    domain: str
    sentiment: str  # positive | negative | none
    owner: str
    format: str
    description: str
    dimensions: tuple[str, ...]
    legs: tuple[Leg, ...] = ()
    values: Mapping[str, str] = field(default_factory=dict)  # output column -> expression over parts
    default_by: tuple[str, ...] = ()
    share: str | None = None  # output column that also gets ``pct_of_total``
    custom: Callable[..., DataFrame] | None = None
    grain: str = ""
    synonyms: tuple[str, ...] = ()
    questions: tuple[str, ...] = ()
    formula: str = ""
    complete: bool = False  # keep only groups in which every value is known

    @property
    def id(self) -> str:
        return f"{self.tenant}:{self.name}"

    @property
    def value(self) -> str:
        return next(iter(self.values), self.name)

    @property
    def _counts(self) -> list[str]:
        return [n for leg in self.legs for n, p in (leg.outer if leg.per else leg.parts).items() if p.kind == "count"]

    def unreachable(self, catalog: Any) -> list[str]:
        """Declared dimensions that a leg cannot be sliced by."""
        found = []
        for leg in self.legs:
            for attribute in self.dimensions:
                finer = at_detail(catalog, self.tenant, leg, [attribute], None)
                if not reaches(catalog, self.tenant, finer, attribute):
                    found.append(attribute)
        return found

    def check_dimensions(self, attributes: Sequence[str]) -> None:
        refused = [a for a in attributes if a not in self.dimensions]
        if refused:
            raise ValueError(f"{self.id} may not be sliced by {refused}; allowed: {list(self.dimensions)}")

    def compute(
        self,
        wh: Any,
        by: Sequence[str] | None = None,
        period: Period | None = None,
        where: Where | None = None,
        extra: Mapping[str, Column] | None = None,
        **params: Any,
    ) -> DataFrame:
        """One row per combination of ``by`` with the metric's value columns."""
        if wh.tenant != self.tenant:
            raise ValueError(f"{self.id} cannot run on tenant {wh.tenant!r}")
        by = tuple(self.default_by if by is None else by)
        self.check_dimensions([*by, *(where or {})])
        if self.custom:
            return self.custom(wh, by=by, period=period, where=where, **params)
        legs = [aggregate_leg(wh, leg, by, period, where, extra) for leg in self.legs]
        grain = [*output_names(by), *(extra or {})]
        result = meet(legs, grain, self._counts).select(*grain, *[F.expr(e).alias(n) for n, e in self.values.items()])
        if self.complete:
            result = result.dropna(subset=list(self.values))
        if self.share:
            from ledgerloom.operators.ranking import with_share

            result = with_share(result, self.share)
        return result

    def compare(
        self,
        wh: Any,
        current: Period,
        prior: Period,
        by: Sequence[str] = (),
        where: Where | None = None,
    ) -> DataFrame:
        """Current and prior value, change and percentage change.

        Both periods are read in one pass. Without a prior baseline the change is NULL.
        """
        if self.custom or current.overlaps(prior) or any(leg.borrowed_day or leg.detail for leg in self.legs):
            names = output_names(by)
            sides = [
                self.compute(wh, by=by, period=p, where=where).select(
                    *names, F.lit(tag).alias("period"), F.col(self.value).cast("double").alias("value")
                )
                for tag, p in (("current", current), ("prior", prior))
            ]
            tagged = sides[0].unionByName(sides[1])
        else:
            names = output_names(by)
            self.check_dimensions([*by, *(where or {})])
            day = self.legs[0].day
            if day is None or any(leg.day is None for leg in self.legs):
                raise ValueError(f"{self.id} carries no date, so periods cannot be compared")
            sides = []
            for leg in self.legs:
                tag = F.when(current.on(F.col(leg.day)), "current").when(prior.on(F.col(leg.day)), "prior")
                span = Period(min(current.start, prior.start), max(current.end, prior.end))
                sides.append(aggregate_leg(wh, leg, by, span, where, {"period": tag}).where("period is not null"))
            tagged = meet(sides, [*names, "period"], self._counts).select(
                *names, "period", F.expr(self.values[self.value]).cast("double").alias("value")
            )
        side = lambda tag: F.max(F.when(F.col("period") == tag, F.col("value")))
        both = tagged.groupBy(*names).agg(side("current").alias("current_value"), side("prior").alias("prior_value"))
        change = F.col("current_value") - F.col("prior_value")
        return both.select(
            *names, "current_value", "prior_value",
            change.alias("delta"),
            F.try_divide(change * 100.0, F.col("prior_value")).alias("pct_change"),
            sentiment_label(F.lit(self.sentiment)).alias("sentiment"),
        )
