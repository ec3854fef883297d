"""Distances on the schema graph and the weighting of indicators by them.

A schema has tens of labels and types, so distances are found on the driver from the catalog.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlume.operators.graph import as_number

Triples = Iterable[tuple[str, str, str]]


def _distances(neighbours: dict[str, set[str]], start: str) -> dict[str, int]:
    found, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for b in sorted(neighbours.get(a, ())):
            if b not in found:
                found[b] = found[a] + 1
                queue.append(b)
    return found


def schema_hops(triples: Triples, start: str, directed: bool = False) -> list[tuple[str, str, int | None]]:
    """(kind, name, hops): labels by steps between labels, a type one more than the nearest of its labels; None if unreachable."""
    triples = list(triples)
    near: dict[str, set[str]] = {}
    labels = {start}
    for a, _, b in triples:
        labels |= {a, b}
        near.setdefault(a, set()).add(b)
        if not directed:
            near.setdefault(b, set()).add(a)
    at = _distances(near, start)
    out: list[tuple[str, str, int | None]] = [("label", x, at.get(x)) for x in sorted(labels)]
    for t in sorted({t for _, t, _ in triples}):
        ends = [at[x] for a, t2, b in triples if t2 == t for x in (a, b) if x in at]
        out.append(("relationship", t, 1 + min(ends) if ends else None))
    return out


def schema_distances(triples: Triples, start: str) -> list[tuple[str, str, int | None]]:
    """(kind, name, distance) on the graph of labels and types: labels half their depth, types half of depth + 1; raises for an unknown start."""
    triples = list(triples)
    near: dict[str, set[str]] = {}
    for a, t, b in triples:
        for x in (f"L:{a}", f"L:{b}"):
            near.setdefault(x, set()).add(f"R:{t}")
            near.setdefault(f"R:{t}", set()).add(x)
    if f"L:{start}" not in near:
        raise ValueError(f"no label {start}")
    at = _distances(near, f"L:{start}")
    out = []
    for x in sorted(near):
        depth = at.get(x)
        kind = "label" if x[0] == "L" else "relationship"
        out.append((kind, x[2:], None if depth is None else (depth // 2 if kind == "label" else (depth + 1) // 2)))
    return sorted(out, key=lambda r: (r[0], r[1]))


def hops_table(spark: SparkSession, rows: list[tuple[str, str, int | None]]) -> DataFrame:
    return spark.createDataFrame(rows, "kind string, name string, hops int")


def coefficients(columns: list[str], hops: list[tuple[str, str, int | None]], skip: Iterable[str] = ()) -> dict[str, float]:
    """1 / (hops + 1) of the longest element name that, with '_', begins the column; 1 where it is unreachable or none does."""
    by_name = {name: h for _, name, h in hops}
    names, skipped, out = sorted(by_name, key=len, reverse=True), set(skip), {}
    for c in columns:
        name = next((n for n in names if c.startswith(n + "_")), None)
        h = by_name.get(name) if name is not None else None
        out[c] = 1.0 if c in skipped or h is None else 1.0 / (h + 1)
    return out


def weighted(df: DataFrame, hops: list[tuple[str, str, int | None]], skip: Iterable[str] = ()) -> DataFrame:
    """Indicators times their coefficient; the first column, the id, stays."""
    first, *rest = df.columns
    by = coefficients(rest, hops, skip)
    numbers = {c for c, t in df.dtypes if t not in ("string", "boolean", "date", "timestamp") and not t.startswith(("array", "map", "struct"))}
    return df.select(f"`{first}`", *((as_number(c) * by[c]).alias(c) if c in numbers and by[c] != 1.0 else F.col(f"`{c}`") for c in rest))
