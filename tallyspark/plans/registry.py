"""All queries of the library's own operators, and their SQL, by the operator's id."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Tables, prefix

#: The day that all queries look back from.
AS_OF = date(1998, 3, 17)
START, END = date(1998, 3, 1), date(1998, 4, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the domain's Tables as a query, with its SQL over the same views."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = prefix() + sql
        return f

    return add


from . import dashboards, files, inventories, ledgers, reconciliations, scalars, texts  # noqa: E402, F401
