"""Indicators of the nodes of a label: many-to-one closure, many-to-many aggregates, in-degrees, and their join.

Paths are enumerated on the schema, not on the data: a closure is a chain of left joins
with static columns, so that unused properties are never read. Where a many-to-one type
leads to several nodes after all (its rows are not unique), one of them is taken: the one
with the least id, and of its edges the one with the least properties.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlume.operators.graph import Edges, PropertyGraph, as_number

AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


@dataclass(frozen=True)
class Path:
    steps: tuple[Edges, ...]

    @property
    def end(self) -> str:
        return self.steps[-1].end

    @property
    def text(self) -> str:
        return "/".join(f"{e.type}>{e.end}" for e in self.steps)


def paths(graph: PropertyGraph, label: str, types: list[str], depth: int = 5) -> list[Path]:
    """Directed schema paths over ``types``, no edge type-and-pair twice, shortest first and then by their text."""
    found: list[Path] = []
    frontier: list[tuple[Edges, ...]] = [()]
    for _ in range(depth):
        longer = []
        for steps in frontier:
            at = steps[-1].end if steps else label
            longer += [(*steps, e) for e in graph.edges if e.start == at and e.type in types and e not in steps]
        found += sorted((Path(s) for s in longer), key=lambda p: p.text)
        frontier = longer
    return found


def _single(e: Edges, columns: list[str]) -> DataFrame:
    """At most one edge per source: the one with the least target."""
    if columns:
        return e.table.groupBy("src").agg(F.min(F.struct("dst", *(as_number(c).alias(c) for c in columns))).alias("x")).select("src", "x.*")
    return e.table.groupBy("src").agg(F.min("dst").alias("dst"))


def closure(graph: PropertyGraph, label: str, types: list[str], depth: int = 5, keep: list[str] | None = None, nodes: bool = True, relations: bool = False) -> DataFrame:
    """``id`` and the numeric properties reached over many-to-one paths: ``<Label>_<prop>`` of nodes, ``<TYPE>_<prop>`` of edges.

    The node itself counts as a path of length 0 and wins a clash of names, then the shorter path,
    then the first by text. ``keep`` restricts to these property names (null: all). Nodes without paths stay.
    """
    wanted = lambda names: [n for n in names if keep is None or n in keep]
    base = graph.nodes[label]
    out = base.select("id", *(as_number(p).alias(f"{label}_{p}") for p in wanted(graph.properties(label)) if nodes))
    columns: dict[str, list[Column]] = {c: [F.col(f"`{c}`")] for c in out.columns if c != "id"}
    joined: dict[tuple, str] = {(): "id"}
    for n, path in enumerate(paths(graph, label, types, depth)):
        e, here = path.steps[-1], f"_p{n}"
        edge_props, node_props = wanted(e.properties) if relations else [], wanted(graph.properties(path.end)) if nodes else []
        deeper = any(len(p.steps) > len(path.steps) and p.steps[: len(path.steps)] == path.steps for p in paths(graph, label, types, depth))
        if not (edge_props or node_props or deeper):
            continue
        step = _single(e, edge_props).select(F.col("src").alias(f"{here}_src"), F.col("dst").alias(here), *(F.col(f"`{p}`").alias(f"{here}_e_{p}") for p in edge_props))
        out = out.join(step, out[joined[path.steps[:-1]]] == step[f"{here}_src"], "left").drop(f"{here}_src")
        for p in edge_props:
            columns.setdefault(f"{e.type}_{p}", []).append(F.col(f"`{here}_e_{p}`"))
        if node_props:
            target = graph.nodes[path.end].select(F.col("id").alias(f"{here}_id"), *(as_number(p).alias(f"{here}_n_{p}") for p in node_props))
            out = out.join(target, out[here] == target[f"{here}_id"], "left").drop(f"{here}_id")
            for p in node_props:
                columns.setdefault(f"{path.end}_{p}", []).append(F.col(f"`{here}_n_{p}`"))
        joined[path.steps] = here
    return out.select("id", *(F.coalesce(*found).alias(name) for name, found in columns.items()))


def read_rules(rules: dict[str, str] | None) -> dict[str, str]:
    return {k.strip().lower(): v.strip().lower() for k, v in (rules or {}).items()}


def _function(rules: dict[str, str], prop: str) -> str:
    """The rule's function, ``avg`` where there is none or an unknown one."""
    found = rules.get(prop.lower(), "avg")
    return found if found in AGGREGATES else "avg"


def aggregate_many(graph: PropertyGraph, label: str, types: list[str] | None, rules: dict[str, str] | None = None, neighbours: bool = True, relations: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``id`` and one column per type and property: ``TYPE__neighbor__func_prop`` over the nodes at the other ends of
    all edges of the type, in either direction, and ``TYPE__rel__func_prop`` over the edges. Parallel edges count each.

    Without types (none or an empty list) the label's loose many-to-many types are detected. Nodes without edges keep nulls.
    """
    from graphlume.operators.structure import loose_many_types

    out = graph.nodes[label].select("id")
    for found in _many(graph, label, types, rules, neighbours, relations, keep):
        out = out.join(found, "id", "left")
    return out


def _many(graph: PropertyGraph, label: str, types: list[str] | None, rules: dict[str, str] | None, neighbours: bool, relations: bool, keep: list[str] | None) -> list[DataFrame]:
    """The aggregates of each type, for the nodes that have edges of it."""
    from graphlume.operators.structure import loose_many_types

    rules = read_rules(rules)
    if not types:
        types = [r["type"] for r in loose_many_types(graph, label).orderBy("type").collect()]
    out = []
    for name in types:
        parts, aggregates = [], {}
        for e, own, other, label2 in graph.incident(label, [name]):
            rows = e.table.where("src != dst") if e.start == e.end and own == "dst" else e.table
            rels = [p for p in e.properties if relations and (keep is None or p in keep)]
            props = [p for p in graph.properties(label2) if neighbours and (keep is None or p in keep)]
            view = rows.select(F.col(own).alias("id"), F.col(other).alias("_other"), *(as_number(p).alias(f"r_{p}") for p in rels))
            if props:
                view = view.join(graph.nodes[label2].select(F.col("id").alias("_other"), *(as_number(p).alias(f"n_{p}") for p in props)), "_other", "left")
            parts.append(view.drop("_other"))
            for kind, names in (("rel", rels), ("neighbor", props)):
                for p in names:
                    f = _function(rules, p)
                    aggregates[f"{name}__{kind}__{f}_{p}"] = (f, f"{kind[0]}_{p}")
        if parts and aggregates:
            every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            out.append(every.groupBy("id").agg(*(AGGREGATES[f](F.col(f"`{c}`")).alias(n) for n, (f, c) in aggregates.items())))
    return out


def in_degrees(graph: PropertyGraph, label: str) -> DataFrame:
    """``id`` and the number of incoming edges per type, types in alphabetical order, 0 where there are none.

    Types come from the catalog, so the pivot needs no pass to find them."""
    found, names = _degrees(graph, label)
    out = graph.nodes[label].select("id")
    if found is None:
        return out
    return out.join(found, "id", "left").na.fill(0, names).select("id", *(f"`{n}`" for n in names))


def _degrees(graph: PropertyGraph, label: str) -> tuple[DataFrame | None, list[str]]:
    into = [e for e in graph.edges if e.end == label]
    if not into:
        return None, []
    rows = reduce(DataFrame.unionByName, [e.table.select(F.lit(e.type).alias("type"), F.col("dst").alias("id")) for e in into])
    names = sorted({e.type for e in into})
    return rows.groupBy("id").pivot("type", names).count().select("id", *(F.col(f"`{n}`").cast("long").alias(n) for n in names)), names


def outer_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, out_id: str = "id") -> DataFrame:
    """Full outer join on the ids; the left value is preferred in columns that both have."""
    a = left.select(F.col(left_id).cast("long").alias("_l"), *(F.col(f"`{c}`").alias(f"l_{c}") for c in left.columns if c != left_id))
    b = right.select(F.col(right_id).cast("long").alias("_r"), *(F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns if c != right_id))
    both = a.join(b, F.col("_l") == F.col("_r"), "full_outer")
    mine, theirs = [c for c in left.columns if c != left_id], [c for c in right.columns if c != right_id]
    columns = [F.coalesce(F.col(f"`l_{c}`"), F.col(f"`r_{c}`")).alias(c) if c in theirs else F.col(f"`l_{c}`").alias(c) for c in mine]
    columns += [F.col(f"`r_{c}`").alias(c) for c in theirs if c not in mine]
    return both.select(F.coalesce("_l", "_r").alias(out_id), *columns)


def indicators(graph: PropertyGraph, label: str, many_to_one: list[str], many_to_many: list[str] | None, rules: dict[str, str] | None = None, depth: int = 5, keep: list[str] | None = None, relations: bool = True) -> DataFrame:
    """The indicator table of a label: closure over nodes and edges, many-to-many aggregates and in-degrees, ``outid`` first.

    All start from the label's nodes and are joined to them on ``id``, so that one partitioning serves all.
    In a clash of names the first of these has the column, and the later one fills its nulls."""
    out = closure(graph, label, many_to_one, depth, keep, relations=relations)
    degrees, names = _degrees(graph, label)
    for found in [*_many(graph, label, many_to_many, rules, True, relations, keep), *([degrees] if degrees is not None else [])]:
        clash = [c for c in found.columns if c != "id" and c in out.columns]
        met = out.join(found.withColumnsRenamed({c: f"_2_{c}" for c in clash}), "id", "left")
        out = met.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col(f"`_2_{c}`")) for c in clash}).drop(*(f"_2_{c}" for c in clash))
    return out.na.fill(0, names).withColumnRenamed("id", "outid")
