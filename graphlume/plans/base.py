"""How queries and their SQL are written down side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlume.operators.graph import PropertyGraph, from_tables
from graphlume.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TRADE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Relationship types of the trade graph by class, as ``cardinality_classes`` finds them.
MANY_TO_ONE, MANY_TO_MANY = ["IN_REGION", "CUST_IN", "SUPP_IN", "PLACED_BY"], ["CONTAINS", "SUPPLIED_BY"]


def _shift(digits: int) -> float:
    return 1.3 * 10.0 ** -(digits + 2)


def _sure(sql: str) -> str:
    """``round(x, d)`` as ``round(x + shift, d)``, as ``r`` does it."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, comma, end = 1, None, m.end()
        while depth:
            c = sql[end]
            depth += (c in "([") - (c in ")]")
            comma = end if c == "," and depth == 1 else comma
            end += 1
        out += [sql[at : m.end()], _sure(sql[m.end() : comma]), f" + {_shift(int(sql[comma + 1 : end - 1])):.2e}", sql[comma:end]]
        at = end
    return "".join([*out, sql[at:]])


def query(sql: str | None = None):
    """Register a query by its function's name, with the SQL that gives the same rows if SQL can."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _sure(sql)
        return f

    return register


def trade(spark: SparkSession, d: str) -> PropertyGraph:
    return from_tables({name: table(spark, d, name) for name in TRADE})


def r(value: Column | str, digits: int = 6) -> Column:
    """Sums of doubles depend on their order in the last places, so both sides are rounded; means of decimals
    end in exact halves of the last place kept, so both sides are shifted by about a hundredth of that place first."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(_shift(digits)), digits)
