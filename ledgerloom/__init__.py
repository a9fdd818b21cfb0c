"""Business analytics over an ERP star schema, written as Spark DataFrame jobs."""

from ledgerloom.catalog import Catalog, Column, Table
from ledgerloom.periods import Period
from ledgerloom.session import build_session, tune

__all__ = ["Catalog", "Column", "Period", "Table", "build_session", "tune"]
