"""Several metrics at one grain, with one pass over a fact for all that ask the same of it.

Legs that read the same fact at the same grain become one leg that carries the parts of all;
equal parts are computed once. Row filters move into the parts where legs differ in them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.metrics.spec import Leg, Metric, Part, aggregate_leg, at_detail, count, meet, output_names
from ledgerloom.periods import Period

HERE = "rows of the leg"


def _alike(leg: Leg, by: Sequence[str], period: Period | None) -> tuple[Any, ...]:
    """What legs must agree in to share a pass; borrowed and local attributes count where they are used."""
    tables = {a.split(".")[0] for a in by} | ({"dim_date"} if period else set())
    bare = {*leg.parts, *leg.per}
    return (
        leg.fact, leg.source, leg.as_of, leg.day, leg.per, leg.borrowed_day,
        leg.keep if leg.per else None,
        tuple(sorted((a, e) for a, e in leg.local.items() if a in by)),
        tuple(sorted((t, b) for t, b in leg.borrow.items() if t in tables)),
        # an outer expression of more than a name is not rewritten, so its leg stays alone
        id(leg) if any(p.expr not in bare for p in leg.outer.values()) else None,
    )


def merged(legs: Sequence[Leg], prefix: str) -> tuple[Leg, list[dict[str, str]]]:
    """One leg for legs that are alike, and where each leg's parts are found in it.

    ``HERE`` counts the leg's own rows, so that a group it does not have can be told from one
    without values.
    """
    keeps = list(dict.fromkeys(leg.keep for leg in legs))
    inner: dict[Part, str] = {}
    outer: dict[Part, str] = {}

    def named(table: dict[Part, str], part: Part, mark: str) -> str:
        return table.setdefault(part, f"{prefix}{mark}{len(table)}")

    places = []
    for leg in legs:
        if leg.per:
            own = {name: named(inner, part, "i") for name, part in leg.parts.items()}
            found = {n: named(outer, replace(p, expr=own.get(p.expr, p.expr)), "o") for n, p in leg.outer.items()}
            found[HERE] = named(outer, count(), "o")
        else:
            only = (lambda p: p) if len(keeps) == 1 else (lambda p, keep=leg.keep: _where(p, keep))
            found = {n: named(inner, only(p), "i") for n, p in {**leg.parts, HERE: count()}.items()}
        places.append(found)
    keep = None if None in keeps else " or ".join(f"({k})" for k in keeps)
    parts = {name: part for part, name in inner.items()}
    return replace(legs[0], parts=parts, outer={n: p for p, n in outer.items()}, keep=keep), places


def _where(part: Part, keep: str | None) -> Part:
    return part if keep is None else Part(part.kind, f"case when {keep} then {part.expr} end")


def together(wh: Any, metrics: Sequence[Metric], by: Sequence[str] = (), period: Period | None = None) -> DataFrame:
    """One row per group: each metric's value under its name, and ``has_<name>``.

    ``has_<name>`` says whether ``metric.compute`` would return that group. Metrics of several
    outputs give their first one, without shares; metrics with code of their own are refused.
    """
    for m in metrics:
        if m.tenant != wh.tenant or m.custom:
            raise ValueError(f"{m.id} cannot be computed together with others of {wh.tenant}")
        m.check_dimensions(by)
    passes: dict[tuple[Any, ...], list[tuple[int, Leg]]] = {}
    for i, m in enumerate(metrics):
        for leg in m.legs:
            leg = at_detail(wh.catalog, wh.tenant, leg, by, period)
            passes.setdefault(_alike(leg, by, period), []).append((i, leg))
    found: list[dict[str, str]] = [{} for _ in metrics]
    here: list[list[str]] = [[] for _ in metrics]
    frames, counts = [], []
    for n, asked in enumerate(passes.values()):
        leg, places = merged([leg for _, leg in asked], f"__m{n}")
        counts += [name for name, p in (leg.outer if leg.per else leg.parts).items() if p.kind == "count"]
        for (i, _), place in zip(asked, places):
            found[i] |= place
            here[i].append(place[HERE])
        frames.append(aggregate_leg(wh, leg, by, period))
    grain = output_names(by)
    wide = meet(frames, grain, counts)
    for i, m in enumerate(metrics):
        parts = {name: place for name, place in found[i].items() if name != HERE}
        values = wide.withColumns({name: F.col(place) for name, place in parts.items()})
        known = [f"({e}) is not null" for e in m.values.values()] if m.complete else []
        rows = " + ".join(here[i]) + " > 0" if by else "true"
        values = values.withColumns(
            {f"__v{i}": F.expr(m.values[m.value]), f"__h{i}": F.expr(" and ".join([rows, *known]))}
        )
        # the names of parts are free again for the next metric
        wide = values.drop(*parts)
    shown = [c for i, m in enumerate(metrics) for c in (F.col(f"__v{i}").alias(m.name), F.col(f"__h{i}").alias(f"has_{m.name}"))]
    return wide.select(*grain, *shown)
