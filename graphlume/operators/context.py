"""The context of one node: its properties, those of its neighbours and edges, and those along many-to-one paths, with provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlume.operators.graph import Edges, PropertyGraph
from graphlume.session import cut

COLUMNS = ["type", "source", "label", "property", "value"]


def _text(df: DataFrame, kind: str, element: Column, source: Column, label: str, names: list[str]) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(n).alias("property"), F.col(f"`{n}`").cast("string").alias("value")) for n in names))
    long = df.select(F.lit(kind).alias("type"), element.alias("element"), source.alias("source"), F.lit(label).alias("label"), F.explode(entries).alias("x"))
    return long.select("type", "element", "source", "label", "x.property", "x.value").where("value is not null")


def _edge_key(e: Edges) -> Column:
    """Edges have no key of their own: one is told by its ends and properties."""
    return F.to_json(F.struct(F.lit(e.type), "src", "dst", *(f"`{c}`" for c in e.table.columns if c not in ("src", "dst"))))


def node_context(graph: PropertyGraph, label: str, node_id: int, allowed: list[str], depth: int | None = None) -> DataFrame:
    """``type, source, label, property, value`` (as text) of a node's context; nothing for an unknown node.

    The node itself has an empty source; direct neighbours and incident edges, in any direction, the type;
    then outgoing steps over the allowed types, each node once, give ``[r0, L1, r1, …]``. Of several
    sources for one property of one element the shortest stays, then the first by text. Steps end where
    nothing new is reached, or after ``depth`` of them if that is given.
    """
    names = lambda df: [c for c in df.columns if c not in ("id", "src", "dst")]
    start = graph.nodes[label].where(F.col("id") == node_id)
    none = F.array().cast("array<string>")
    parts = []
    if names(start):
        parts.append(_text(start, "node", F.concat(F.lit(f"{label}:"), F.col("id").cast("string")), none, label, names(start)))
    for e, own, other, label2 in graph.incident(label):
        here = e.table.where(F.col(own) == node_id)
        source = F.array(F.lit(e.type))
        if names(e.table):
            parts.append(_text(here, "edge", _edge_key(e), source, e.type, names(e.table)))
        target = graph.nodes[label2]
        if names(target):
            met = target.join(here.select(F.col(other).alias("id")).distinct(), "id", "left_semi")
            parts.append(_text(met, "node", F.concat(F.lit(f"{label2}:"), F.col("id").cast("string")), source, label2, names(target)))
    visited = {label: graph.spark.createDataFrame([(node_id,)], "id long")}
    frontier = {label: visited[label].withColumn("source", none)}
    step_no = 0
    while depth is None or step_no < depth:
        step_no += 1
        reached: dict[str, list[DataFrame]] = {}
        for at, rows in frontier.items():
            for e in graph.edges:
                if e.start != at or e.type not in allowed:
                    continue
                # the first step's source is its type; later ones add the label stepped from
                grown = F.when(F.size("source") == 0, F.array(F.lit(e.type))).otherwise(F.concat("source", F.array(F.lit(at), F.lit(e.type))))
                step = e.table.join(rows.withColumnRenamed("id", "src"), "src").withColumn("source", grown)
                if names(e.table):
                    parts.append(_text(step.drop("source").withColumn("_s", step["source"]), "edge", _edge_key(e), F.col("_s"), e.type, names(e.table)))
                reached.setdefault(e.end, []).append(step.select(F.col("dst").alias("id"), "source"))
        frontier = {}
        for at, found in reached.items():
            new = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min_by("source", F.struct(F.size("source"), F.array_join("source", "/"))).alias("source"))
            if at in visited:
                new = new.join(visited[at], "id", "left_anti")
            frontier[at] = new = cut(new)  # read by the next steps, by what was visited and by the properties
            visited[at] = visited[at].unionByName(new.select("id")) if at in visited else new.select("id")
            target = graph.nodes[at]
            if names(target):
                met = target.join(new, "id")
                parts.append(_text(met, "node", F.concat(F.lit(f"{at}:"), F.col("id").cast("string")), F.col("source"), at, names(target)))
        frontier = {at: rows for at, rows in frontier.items() if any(e.start == at and e.type in allowed for e in graph.edges) and not rows.isEmpty()}
        if not frontier:
            break
    if not parts:
        return graph.spark.createDataFrame([], "type string, source array<string>, label string, property string, value string")
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy("type", "element", "property").agg(F.min_by(F.struct("source", "label", "value"), F.struct(F.size("source"), F.array_join("source", "/"))).alias("x"))
    return best.select("type", "x.source", "x.label", "property", "x.value")


def pick_node(graph: PropertyGraph, label: str, seed: int = 0) -> DataFrame:
    """One node's ``id``, the least by the MD5 of seed and id: the same for the same data and seed, in any engine."""
    return graph.nodes[label].select("id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(1)


def shortest_first(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", F.size("source")).orderBy("_n", "type", "label", "property").drop("_n")


__all__ = ["COLUMNS", "node_context", "pick_node", "shortest_first"]
