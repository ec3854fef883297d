"""Structure of a property graph: cardinalities of relationships, many-to-many types, density of properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlume.operators.graph import PropertyGraph, as_number


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def cardinality_class(min_out: Column, max_out: Column, min_in: Column, max_in: Column) -> Column:
    """First match wins; a type that is optional on both sides counts as one-to-many."""
    return (
        F.when((min_out >= 1) & (max_out <= 1) & (min_in >= 1) & (max_in <= 1), "one-to-one")
        .when((min_out >= 0) & (max_in <= 1), "one-to-many").when((max_out <= 1) & (min_in >= 0), "many-to-one").otherwise("many-to-many")
    )


def cardinalities_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cardinality of each (type, start label set, end label set).

    ``nodes``: ``id, labels ARRAY<STRING>``; ``edges``: ``type, src, dst``. Degrees are over all
    nodes of a label set: 0 for those without such an edge. Edges whose ends are no nodes are ignored.
    """
    sets = nodes.select("id", F.array_join("labels", "|").alias("set"))
    population = sets.groupBy("set").agg(F.count("*").alias("population"))
    ends = edges.join(sets.toDF("src", "start_labels"), "src").join(sets.toDF("dst", "end_labels"), "dst")
    keys = ["type", "start_labels", "end_labels"]

    def side(end: str, prefix: str, own: str) -> DataFrame:
        degree = ends.groupBy(*keys, end).agg(F.count("*").alias("d")).groupBy(*keys).agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        counted = degree.join(population.toDF(own, "population"), own)
        return counted.select(*keys, F.col("population").alias(f"{prefix}_population"), F.when(F.col("n") < F.col("population"), 0).otherwise(F.col("lo")).alias(f"min_{prefix}"), F.col("hi").alias(f"max_{prefix}"))

    both = side("src", "out", "start_labels").join(side("dst", "in", "end_labels"), keys)
    return both.withColumn("cardinality", cardinality_class(F.col("min_out"), F.col("max_out"), F.col("min_in"), F.col("max_in")))


def cardinalities(graph: PropertyGraph) -> DataFrame:
    """``cardinalities_of`` for a graph whose labels are its tables: no join is needed to know an edge's labels."""
    found = []
    for e in graph.edges:
        def side(end: str, label: str, prefix: str, table: DataFrame = e.table) -> DataFrame:
            degree = table.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("d"))
            own = graph.nodes[label].select("id").join(degree, "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
            return own.agg(F.count("*").alias(f"{prefix}_population"), F.min("d").alias(f"min_{prefix}"), F.max("d").alias(f"max_{prefix}"))

        names = {"type": e.type, "start_labels": e.start, "end_labels": e.end}
        out, into = side("src", e.start, "out"), side("dst", e.end, "in")
        key = F.lit(e.type).alias("type")
        both = out.withColumn("type", key).join(F.broadcast(into.withColumn("type", key)), "type")  # one row each
        found.append(both.select(*(F.lit(v).alias(k) for k, v in names.items()), "out_population", "min_out", "max_out", "in_population", "min_in", "max_in"))
    return _union(found).withColumn("cardinality", cardinality_class(F.col("min_out"), F.col("max_out"), F.col("min_in"), F.col("max_in")))


def detect_cardinalities(graph: PropertyGraph) -> tuple[list[str], list[str]]:
    """(many-to-one types, many-to-many types), as the catalog's size; a type can be in both."""
    rows = cardinalities(graph).select("type", "cardinality").collect()
    return [r["type"] for r in rows if r["cardinality"] == "many-to-one"], [r["type"] for r in rows if r["cardinality"] == "many-to-many"]


def loose_many_types(graph: PropertyGraph, label: str) -> DataFrame:
    """``type``: types of which some node of the label has more than one edge, in any direction."""
    return graph.touching(label).groupBy("type", "id").agg(F.count("*").alias("n")).where("n > 1").select("type").distinct()


def strict_many_types(graph: PropertyGraph, label: str) -> DataFrame:
    """``type``: some node of the label has several outgoing edges of it, and some target several incoming ones."""
    parts = []
    for e in graph.edges:
        if e.start == label:
            many_out = e.table.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(e.type).alias("type")).distinct()
            many_in = e.table.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(e.type).alias("type")).distinct()
            parts.append(many_out.join(many_in, "type", "left_semi"))
    return _union(parts).distinct()


def densities(graph: PropertyGraph) -> DataFrame:
    """``kind, element, property, n, n_present, ratio`` of every numeric property, one aggregate per table."""
    parts = []
    for kind, name, df, props in [("node", l, graph.nodes[l], graph.properties(l)) for l in graph.nodes] + [("rel", e.type, e.table, e.properties) for e in graph.edges]:
        if props:
            counted = df.agg(F.count("*").alias("n"), *(F.count(as_number(p)).alias(f"p{i}") for i, p in enumerate(props)))
            entries = F.array(*(F.struct(F.lit(p).alias("property"), F.col(f"p{i}").alias("n_present")) for i, p in enumerate(props)))
            parts.append(counted.select(F.lit(kind).alias("kind"), F.lit(name).alias("element"), "n", F.explode(entries).alias("x")).select("kind", "element", "x.property", "n", "x.n_present"))
    return _union(parts).withColumn("ratio", F.try_divide(F.col("n_present"), F.col("n")))


def dense(graph: PropertyGraph, least: float) -> DataFrame:
    return densities(graph).where(F.col("ratio") >= least)


def sparse(graph: PropertyGraph, least: float) -> DataFrame:
    return densities(graph).where(F.col("ratio") < least)


def mean_properties(graph: PropertyGraph, label: str) -> DataFrame:
    """``label, mean_properties``: how many numeric properties a node of the label has on average."""
    present = sum((as_number(p).isNotNull().cast("int") for p in graph.properties(label)), F.lit(0))
    return graph.nodes[label].agg(F.avg(present.cast("double")).alias("mean_properties")).select(F.lit(label).alias("label"), "mean_properties")


def count_properties(graph: PropertyGraph) -> DataFrame:
    """``kind, n``: distinct names of numeric properties of nodes, of relationships and of both together."""
    names = graph.catalog().select("kind", "property").distinct()
    return names.groupBy("kind").agg(F.count_distinct("property").alias("n")).unionByName(names.agg(F.count_distinct("property").alias("n")).select(F.lit("any").alias("kind"), "n"))


def aggregation_template(graph: PropertyGraph, label: str, types: list[str]) -> DataFrame:
    """``attribute, aggregation_function``: numeric attributes of many-to-many neighbours and edges, the function left empty."""
    names = set()
    for e, _, _, other in graph.incident(label, types):
        names |= {*e.properties, *graph.properties(other)}
    return graph.spark.createDataFrame([(n, "") for n in sorted(names)], "attribute string, aggregation_function string").orderBy("attribute")
