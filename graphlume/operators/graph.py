"""Property graphs as tables: one node table per label, one edge table per relationship type and label pair.

The catalog (labels, properties and their types, label pairs) is read from the schemas
once, so every later plan lists the columns it needs and the scans read no others.
Numbers are tested by schema type; NaN in a numeric property counts as missing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(schema: T.StructType, but: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order; lists of numbers are not numeric."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in set(but)]


def q(name: str) -> Column:
    """A column by its exact name: blanks, '#', '%' and dots are part of names here."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_number(name: str) -> Column:
    """A property as DOUBLE, NaN as null."""
    return F.nanvl(q(name).cast("double"), F.lit(None).cast("double"))


@dataclass(frozen=True)
class Edges:
    """Edges of one type between two labels: ``src``, ``dst`` and properties."""

    type: str
    start: str
    end: str
    table: DataFrame

    @property
    def properties(self) -> list[str]:
        return numeric(self.table.schema, ("src", "dst", "edge_id"))


@dataclass
class PropertyGraph:
    """``nodes``: label -> table with ``id``; ``edges``: the edge tables."""

    nodes: dict[str, DataFrame]
    edges: list[Edges] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.nodes.values())).sparkSession

    @property
    def types(self) -> list[str]:
        return list(dict.fromkeys(e.type for e in self.edges))

    def properties(self, label: str) -> list[str]:
        return numeric(self.nodes[label].schema, ("id",))

    def of_type(self, name: str) -> list[Edges]:
        return [e for e in self.edges if e.type == name]

    def label(self, name: str) -> DataFrame:
        return self.nodes[name]

    def all_nodes(self) -> DataFrame:
        """``label, id`` of every node."""
        tables = [df.select(F.lit(name).alias("label"), F.col("id").cast("long").alias("id")) for name, df in self.nodes.items()]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def lookup(self, label: str, ids: Iterable[int]) -> DataFrame:
        return self.nodes[label].where(F.col("id").isin(list(ids)))

    def incident(self, label: str, types: Iterable[str] | None = None) -> list[tuple[Edges, str, str, str]]:
        """Edge tables at a label, as (edges, own end, other end, other label); a type between equal labels comes twice."""
        wanted = set(types) if types is not None else None
        found = []
        for e in self.edges:
            if wanted is None or e.type in wanted:
                found += [(e, "src", "dst", e.end)] * (e.start == label) + [(e, "dst", "src", e.start)] * (e.end == label)
        return found

    def touching(self, label: str, types: Iterable[str] | None = None) -> DataFrame | None:
        """``type, id, other_label, other`` of all edges at nodes of a label in either direction; self-loops once."""
        parts = []
        for e, own, other, label2 in self.incident(label, types):
            rows = e.table
            if e.start == e.end and own == "dst":
                rows = rows.where("src != dst")
            parts.append(rows.select(F.lit(e.type).alias("type"), F.col(own).alias("id"), F.lit(label2).alias("other_label"), F.col(other).alias("other")))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def schema_edges(self) -> DataFrame:
        """``start, type, end``: the schema graph, from the catalog."""
        rows = sorted({(e.start, e.type, e.end) for e in self.edges})
        return self.spark.createDataFrame(rows, "start string, type string, end string")

    def schema_edges_from_data(self) -> DataFrame:
        """The schema graph of those edges that have rows."""
        out = None
        for e in self.edges:
            one = e.table.limit(1).select(F.lit(e.start).alias("start"), F.lit(e.type).alias("type"), F.lit(e.end).alias("end"))
            out = one if out is None else out.unionByName(one)
        return out

    def catalog(self) -> DataFrame:
        """``kind, element, property, type`` of every numeric property."""
        rows = []
        for label, df in self.nodes.items():
            rows += [("node", label, p, df.schema[p].dataType.simpleString()) for p in self.properties(label)]
        for e in self.edges:
            rows += [("rel", e.type, p, e.table.schema[p].dataType.simpleString()) for p in e.properties]
        return self.spark.createDataFrame(sorted(set(rows)), "kind string, element string, property string, type string")

    def index_candidates(self, drop_suffixes: Iterable[str] = ()) -> DataFrame:
        """``kind, element, property``: numeric properties an index would serve. Spark has none; the list is for planning (clustering, bucketing)."""
        ends = tuple(drop_suffixes)
        rows = [r for r in self.catalog().select("kind", "element", "property").collect() if not (ends and r["property"].endswith(ends))]
        return self.spark.createDataFrame(rows, "kind string, element string, property string")


def from_tables(tables: dict[str, DataFrame]) -> PropertyGraph:
    """The order-trade graph: each table's key is the node id, each foreign key an edge type, each line an edge."""
    t = tables

    def node(name: str, key: str, *drop: str) -> DataFrame:
        return t[name].select(F.col(key).cast("long").alias("id"), *(c for c in t[name].columns if c not in (key, *drop)))

    nodes = {
        "region": node("region", "r_regionkey"), "nation": node("nation", "n_nationkey", "n_regionkey"), "customer": node("customer", "c_custkey", "c_nationkey"),
        "supplier": node("supplier", "s_suppkey", "s_nationkey"), "part": node("part", "p_partkey"), "orders": node("orders", "o_orderkey", "o_custkey"),
    }

    def edge(name: str, start: str, end: str, table: str, src: str, dst: str, *props: str) -> Edges:
        return Edges(name, start, end, t[table].select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), *props))

    line = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return PropertyGraph(nodes, [
        edge("IN_REGION", "nation", "region", "nation", "n_nationkey", "n_regionkey"),
        edge("CUST_IN", "customer", "nation", "customer", "c_custkey", "c_nationkey"),
        edge("SUPP_IN", "supplier", "nation", "supplier", "s_suppkey", "s_nationkey"),
        edge("PLACED_BY", "orders", "customer", "orders", "o_orderkey", "o_custkey"),
        edge("CONTAINS", "orders", "part", "lineitem", "l_orderkey", "l_partkey", *line),
        edge("SUPPLIED_BY", "orders", "supplier", "lineitem", "l_orderkey", "l_suppkey", *line),
    ])
