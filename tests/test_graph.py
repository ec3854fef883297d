"""The graph operators on a hand-made graph of a few nodes."""

import pytest
from pyspark.sql import functions as F

from graphlume.operators import collect, context, hops, structure
from graphlume.operators.graph import Edges, PropertyGraph, numeric

NODE = "id long, x double, `y #` double, name string, zs array<int>"


@pytest.fixture(scope="module")
def graph(spark):
    a = spark.createDataFrame([(1, 1.0, None, "a1", [1]), (2, 2.0, 5.0, "a2", None), (3, float("nan"), 6.0, None, []), (4, 4.0, 7.0, "a4", [2])], NODE)
    b = spark.createDataFrame([(1, 10.0, 1.0, "b1", None), (2, 20.0, 2.0, "b2", None), (3, 30.0, 3.0, "b3", None)], NODE)
    c = spark.createDataFrame([(1, 100.0, 1.0, "c1", None), (2, 200.0, 2.0, "c2", None), (3, 300.0, 3.0, "c3", None)], NODE)
    e = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    w = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 2, 3.0), (2, 3, None)], "src long, dst long, w double")
    return PropertyGraph({"A": a, "B": b, "C": c}, [
        Edges("M1", "A", "B", e([(1, 1), (2, 1), (3, 1), (4, 2)])), Edges("M2", "B", "C", e([(1, 1), (2, 1), (3, 2)])), Edges("N1", "A", "A", w),
        Edges("O1", "A", "C", e([(1, 1), (2, 2)])), Edges("P1", "B", "C", e([(1, 1), (2, 2), (3, 3)])),
    ])


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_numeric_properties_are_scalars(graph):
    assert graph.properties("A") == ["x", "y #"] and numeric(graph.nodes["A"].schema) == ["id", "x", "y #"]


def test_cardinalities(graph):
    got = {r["type"]: r["cardinality"] for r in structure.cardinalities(graph).collect()}
    assert got == {"M1": "many-to-one", "M2": "many-to-one", "N1": "many-to-many", "O1": "one-to-many", "P1": "one-to-one"}
    assert structure.detect_cardinalities(graph) == (["M1", "M2"], ["N1"])


def test_cardinalities_of_label_sets(spark):
    nodes = spark.createDataFrame([(1, ["A"]), (2, ["A", "X"]), (3, ["B"]), (4, ["B"])], "id long, labels array<string>")
    edges = spark.createDataFrame([("R", 1, 3), ("R", 2, 3), ("R", 2, 4), ("R", 2, 99)], "type string, src long, dst long")
    got = rows(structure.cardinalities_of(nodes, edges), "start_labels", "end_labels", "min_out", "max_out", "min_in", "max_in", "cardinality")
    assert got == [("A", "B", 1, 1, 0, 1, "one-to-many"), ("A|X", "B", 2, 2, 1, 1, "one-to-many")]


def test_many_types(graph):
    assert rows(structure.loose_many_types(graph, "A")) == [("N1",)]
    assert rows(structure.strict_many_types(graph, "A")) == [("N1",)]


def test_closure(graph):
    got = rows(collect.closure(graph, "A", ["M1", "M2"], keep=["x"]))
    assert got == [(1, 1.0, 10.0, 100.0), (2, 2.0, 10.0, 100.0), (3, None, 10.0, 100.0), (4, 4.0, 20.0, 100.0)]


def test_closure_of_edges_and_cycles(graph):
    found = collect.closure(graph, "A", ["N1"], nodes=True, relations=True, keep=["x", "w"])
    # the node's own value wins over those of nodes reached
    assert rows(found.select("id", "A_x", "N1_w"))[0] == (1, 1.0, 1.0)


def test_aggregates_over_both_directions(graph):
    found = {r["id"]: r for r in collect.aggregate_many(graph, "A", ["N1"], {"x": "sum", "W": "max", "y #": "count"}).collect()}
    # node 1: itself once (self-loop), node 2 twice; node 2: node 1 twice, node 3 (no number)
    assert found[1]["N1__neighbor__sum_x"] == 1.0 + 2.0 + 2.0 and found[2]["N1__neighbor__sum_x"] == 1.0 + 1.0 and found[3]["N1__neighbor__sum_x"] == 2.0 and found[4]["N1__neighbor__sum_x"] is None
    assert found[1]["N1__rel__max_w"] == 3.0 and found[3]["N1__rel__max_w"] is None and found[1]["N1__neighbor__count_y #"] == 2
    assert collect.aggregate_many(graph, "A", []).columns == collect.aggregate_many(graph, "A", None).columns


def test_in_degrees(graph):
    assert rows(collect.in_degrees(graph, "C")) == [(1, 2, 1, 1), (2, 1, 1, 1), (3, 0, 0, 1)]
    assert collect.in_degrees(graph, "C").columns == ["id", "M2", "O1", "P1"]


def test_outer_join(spark):
    a = spark.createDataFrame([(1, 1.0, "p"), (2, None, "q")], "k long, v double, only_a string")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "m int, v double")
    assert rows(collect.outer_join(a, b, "k", "m", "outid")) == [(1, 1.0, "p"), (2, 5.0, "q"), (3, 6.0, None)]


def test_indicators_have_one_row_per_node(graph):
    found = collect.indicators(graph, "A", ["M1", "M2"], ["N1"])
    assert found.columns[0] == "outid" and found.count() == 4 and "N1" in found.columns and "C_y #" in found.columns


def test_hops():
    triples = [("A", "M", "B"), ("B", "N", "C"), ("D", "P", "D")]
    assert hops.schema_hops(triples, "A") == [("label", "A", 0), ("label", "B", 1), ("label", "C", 2), ("label", "D", None), ("relationship", "M", 1), ("relationship", "N", 2), ("relationship", "P", None)]
    assert dict((n, h) for _, n, h in hops.schema_hops(triples, "C", directed=True))["A"] is None
    assert ("relationship", "N", 2) in hops.schema_distances(triples, "A")
    with pytest.raises(ValueError):
        hops.schema_distances(triples, "Z")


def test_weights():
    table = [("label", "A", 0), ("label", "A_B", 1), ("label", "Z", None), ("relationship", "R", 3)]
    got = hops.coefficients(["A_x", "A_B_x", "Z_x", "R", "R_x", "other", "A_skip"], table, ["A_skip"])
    assert got == {"A_x": 1.0, "A_B_x": 0.5, "Z_x": 1.0, "R": 1.0, "R_x": 0.25, "other": 1.0, "A_skip": 1.0}


def test_context(graph):
    got = context.node_context(graph, "A", 1, ["M1", "M2"])
    found = {(r["label"], r["property"], r["value"]): r["source"] for r in got.collect()}
    assert found["A", "name", "a1"] == [] and found["B", "name", "b1"] == ["M1"] and found["C", "name", "c1"] == ["O1"] and found["N1", "w", "3.0"] == ["N1"]
    assert context.node_context(graph, "A", 4, ["M1", "M2"]).where("label = 'C'").first()["source"] == ["M1", "B", "M2"]
    assert context.node_context(graph, "A", 77, ["M1"]).count() == 0


def test_densities(graph):
    got = {(r["element"], r["property"]): (r["n"], r["n_present"]) for r in structure.densities(graph).collect()}
    assert got["A", "x"] == (4, 3) and got["N1", "w"] == (4, 3)


def test_empty_label(spark):
    empty = PropertyGraph({"A": spark.createDataFrame([], NODE), "B": spark.createDataFrame([], NODE)}, [Edges("M", "A", "B", spark.createDataFrame([], "src long, dst long, w double"))])
    assert collect.indicators(empty, "A", ["M"], ["M"]).count() == 0
    assert structure.densities(empty).where(F.col("ratio").isNotNull()).count() == 0


def test_context_of_a_chain_longer_than_any_cap(spark):
    nodes = spark.range(70).select("id", (F.col("id") * 10).alias("p"))
    chain = spark.range(69).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = context.node_context(PropertyGraph({"A": nodes}, [Edges("NEXT", "A", "A", chain)]), "A", 0, ["NEXT"])
    assert found.where("type = 'node'").count() == 70


def test_indicators_hold_edge_properties(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, x double"), spark.createDataFrame([(7, 5.0)], "id long, y double")
    edges = spark.createDataFrame([(1, 7, 0.5)], "src long, dst long, w double")
    found = collect.indicators(PropertyGraph({"A": a, "B": b}, [Edges("M", "A", "B", edges)]), "A", ["M"], ["M"])
    assert {tuple(r) for r in found.select("outid", "A_x", "B_y", "M_w", "M__rel__avg_w").collect()} == {(1, 1.0, 5.0, 0.5, 0.5), (2, 2.0, None, None, None)}
