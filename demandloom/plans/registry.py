"""Query registry: a Spark plan and, where SQL can say it, an ANSI equivalent.

SQL texts name derived retail tables; ``with_views`` prepends the definitions
they need, so each registered text runs on the plain source tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandloom.plans.views import VIEWS
from demandloom.sources.retail import Retail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def needed(sql: str, found: list[str] | None = None) -> list[str]:
    """Names of the views a text uses, dependencies first."""
    found = [] if found is None else found
    for name, body in VIEWS.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            needed(body, found)
            if name not in found:
                found.append(name)
    return found


def with_views(sql: str) -> str:
    """Prepend view definitions; a leading WITH of the text joins the same list."""
    views = [f"{name} AS ({VIEWS[name].strip()})" for name in needed(sql)]
    body = sql.strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a function of ``Retail`` under ``name``."""

    def register(fn: Callable[[Retail], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Retail(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
