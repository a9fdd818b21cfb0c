"""Declared tables: typed columns, keys, value domains, and join paths over foreign keys.

Everything is keyed by ``(tenant, table)``, so two tenants may both own a ``dim_date``.
A catalogue is data: build it from Python, or load it from a JSON file of tables.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SIMPLE_TYPES = {
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "DATE": T.DateType(),
    "BOOLEAN": T.BooleanType(),
    "DECIMAL": T.DecimalType(18, 2),
}


def spark_type(declared: str) -> T.DataType:
    """An unknown type is read as a string."""
    name = declared.strip().upper()
    sized = re.fullmatch(r"DECIMAL\((\d+),\s*(\d+)\)", name)
    if sized:
        return T.DecimalType(int(sized[1]), int(sized[2]))
    return SIMPLE_TYPES.get(name, T.StringType())


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "VARCHAR"
    primary_key: bool = False
    foreign_key: str | None = None  # "table.column"
    values: tuple[str, ...] = ()
    nullable: bool = True
    description: str = ""


@dataclass(frozen=True)
class Table:
    tenant: str
    name: str
    columns: tuple[Column, ...]
    kind: str = "fact"  # fact | dimension | bridge
    description: str = ""

    @property
    def primary_key(self) -> str | None:
        return next((c.name for c in self.columns if c.primary_key), None)

    def struct(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, spark_type(c.type), c.nullable and not c.primary_key) for c in self.columns]
        )


@dataclass(frozen=True)
class Hop:
    """One step of a join path: ``left.left_key = right.right_key``."""

    left: str
    left_key: str
    right: str
    right_key: str


@dataclass
class Catalog:
    tables: dict[tuple[str, str], Table] = field(default_factory=dict)

    @classmethod
    def of(cls, tables: Iterable[Table]) -> Catalog:
        catalog = cls()
        for table in tables:
            catalog.add(table)
        return catalog

    @classmethod
    def from_json(cls, path: str) -> Catalog:
        with open(path, encoding="utf-8") as handle:
            entries = json.load(handle)["tables"]
        return cls.of(
            Table(
                tenant=e["tenant"],
                name=e["name"],
                kind=e.get("type", "fact"),
                description=e.get("description", ""),
                columns=tuple(Column(**{**c, "values": tuple(c.get("values", ()))}) for c in e["columns"]),
            )
            for e in entries
        )

    def add(self, table: Table) -> None:
        key = (table.tenant, table.name)
        if key in self.tables:
            raise ValueError(f"duplicate table {table.tenant}:{table.name}")
        self.tables[key] = table

    def table(self, tenant: str, name: str) -> Table:
        return self.tables[(tenant, name)]

    def of_tenant(self, tenant: str) -> list[Table]:
        found = [t for (owner, _), t in self.tables.items() if owner == tenant]
        if not found:
            raise ValueError(f"unknown tenant {tenant!r}; known: {sorted({o for o, _ in self.tables})}")
        return found

    def struct(self, tenant: str, name: str) -> T.StructType:
        return self.table(tenant, name).struct()

    def foreign_keys(self, tenant: str) -> list[Hop]:
        hops = []
        for table in self.of_tenant(tenant):
            for column in table.columns:
                if column.foreign_key:
                    right, right_key = column.foreign_key.split(".")
                    hops.append(Hop(table.name, column.name, right, right_key))
        return hops

    def path(self, tenant: str, fact: str, dimension: str) -> list[Hop]:
        """Shortest chain of foreign keys from a fact to a dimension.

        A bridge table (item to supplier) is entered through a key it shares with the
        fact, so a fact without a supplier can still be sliced by supplier. Ties go to
        the key that is declared first.
        """
        hops = self.foreign_keys(tenant)
        bridges = [t.name for t in self.of_tenant(tenant) if t.kind == "bridge"]
        queue: deque[tuple[str, list[Hop]]] = deque([(fact, [])])
        seen = {fact}
        while queue:
            here, path = queue.popleft()
            if here == dimension:
                return path
            onward = [h for h in hops if h.left == here]
            for direct in list(onward):
                for bridge in bridges:
                    for entry in hops:
                        shared = (entry.left, entry.right) == (bridge, direct.right)
                        if shared and here not in bridges:
                            onward.append(Hop(here, direct.left_key, bridge, entry.left_key))
            for hop in onward:
                if hop.right not in seen:
                    seen.add(hop.right)
                    queue.append((hop.right, [*path, hop]))
        raise ValueError(f"no join path from {tenant}:{fact} to {dimension}")

    def ids(self) -> list[str]:
        return [f"{tenant}:{name}" for tenant, name in self.tables]

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        """The catalogue as rows, one per column."""
        rows = [
            (t.tenant, t.name, t.description, i, c.name, c.type, c.description, c.primary_key, c.foreign_key)
            for t in self.tables.values()
            for i, c in enumerate(t.columns)
        ]
        return spark.createDataFrame(
            rows,
            "tenant string, table_name string, table_description string, position int, column_name string, "
            "column_type string, column_description string, primary_key boolean, foreign_key string",
        )


def unique_ids(*groups: Iterable[str]) -> list[str]:
    """All ids together; a repeated id is an error."""
    seen: set[str] = set()
    for one in (i for group in groups for i in group):
        if one in seen:
            raise ValueError(f"duplicate catalogue id {one}")
        seen.add(one)
    return sorted(seen)
