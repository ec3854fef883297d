"""Command line: ``python -m graphlume.cli COMMAND …``. Tables of a graph are Parquet or CSV files in a folder.

``indicators``  collect, validate and weight the indicators of a label of the trade graph
``partition``   search for clustering and comparison indicators of an indicator table
``validate``    validate an indicator table from CSV
``context``     the context of one node
``template``    the aggregation template of a label
``runs``        aggregate a folder of solver logs
``query``       run a registered query of the core and show or write its rows
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphlume.operators import collect, context, hops, kernels, runlog, search, structure, validate
from graphlume.operators.graph import PropertyGraph, from_tables
from graphlume.session import cut, local_session, table
from graphlume.sources import files


def _graph(spark: SparkSession, folder: str) -> PropertyGraph:
    return from_tables({n: table(spark, folder, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})


def indicators(spark: SparkSession, a: argparse.Namespace) -> None:
    graph = _graph(spark, a.folder)
    clock = [time.time()]

    def phase() -> float:
        clock.append(time.time())
        return clock[-1] - clock[-2]

    keep, times = None, {}
    if a.pushdown:  # choose properties by density before they are collected
        keep = sorted({r["property"] for r in structure.dense(graph, 1 - a.null).collect()})
    times["time_Preprocessing"] = phase()
    one, many = structure.detect_cardinalities(graph)
    times["time_Cardinalities"] = phase()
    rules = files.read_rules(spark, a.rules) if a.rules else None
    own = [t for t in many if graph.incident(a.label, [t])]
    found = collect.indicators(graph, a.label, one, own, rules, keep=keep)
    kept, unwanted = validate.drop_suffixes(found, a.unwanted or [])
    kept = cut(kept)
    n_all = len(kept.columns) - 1
    times["time_Indicators"] = phase()
    kept, correlated = validate.drop_correlated(kept, a.correlation)
    kept, report = validate.process(kept, a.null, a.low, a.high)
    if not a.keep_nulls:
        kept = validate.drop_null_rows(kept)
    triples = sorted({(e.start, e.type, e.end) for e in graph.edges})
    kept = hops.weighted(kept, hops.schema_hops(triples, a.label))
    kept = cut(kept)
    files.write_csv(kept, f"{a.out}/indicators")
    files.write_csv(unwanted.unionByName(correlated).unionByName(report), f"{a.out}/report")
    times["time_Validation"] = phase()
    config = files.GraphConfig.read(a.config) if a.config else files.GraphConfig("trade")
    n_nodes = config.number_of_node or graph.all_nodes().count()
    n_edges = config.number_of_edge or sum(e.table.count() for e in graph.edges)
    counts = {"N": n_nodes, "E": n_edges, "label": a.label, "n_all": n_all, "n_kept": len(kept.columns) - 1, "nodes": kept.count(), "avgLabelProp": structure.mean_properties(graph, a.label).first()["mean_properties"]}
    files.append_results(runlog.collection_row(spark, a.run, a.pushdown, config.name, counts, times), f"{a.out}/results")


def partition(spark: SparkSession, a: argparse.Namespace) -> None:
    df = validate.drop_null_rows(files.load_indicators(spark, a.path, delimiter=a.delimiter))
    key, columns = df.columns[0], df.columns[1:]
    scaled = cut(validate.minmax_scale(df, key, columns))
    print(f"LOADED {a.path} |D|= {scaled.count()}  n= {len(columns)}")
    began, used = time.time(), time.process_time()
    problem = search.Problem(scaled, key, columns, a.k, a.kernel, a.seed)
    solution, score = search.search(problem, a.method, steps=a.steps)
    print(f"[best solution]: [{';'.join(map(str, solution))}] | {score}")
    sides = search.mask(solution, columns, -1)
    if sides:
        labelled = problem.df.join(problem.labels(solution), key)
        print(f"[Silhouette] {kernels.silhouette(labelled, key, sides).first()[0]}")
    print(f"[CPU time] {time.process_time() - used:.6f} seconds")  # of the driver; the executors' is not known here
    print(f"[Wall time] {time.time() - began:.6f} seconds")


def validated(spark: SparkSession, a: argparse.Namespace) -> None:
    table = files.load_indicators(spark, a.input) if not a.allow_non_numeric else validate.text_as_ranks(files.load_text(spark, a.input))
    kept, report = validate.process(table, a.null_thresh, a.distinct_low, a.distinct_high)
    files.write_csv(kept, a.output)
    files.write_csv(report, a.report)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphlume", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--cores", default="*")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("indicators")
    c.add_argument("folder"), c.add_argument("label"), c.add_argument("out"), c.add_argument("-a", "--rules"), c.add_argument("-u", "--unwanted", nargs="*")
    c.add_argument("-dl", "--low", type=float, default=1e-6), c.add_argument("-dh", "--high", type=float, default=1.0), c.add_argument("-c", "--correlation", type=float, default=0.98), c.add_argument("-n", "--null", type=float, default=0.1)
    c.add_argument("--pushdown", action="store_true"), c.add_argument("--keep-nulls", action="store_true"), c.add_argument("--config", help="JSON with name, number_of_node and number_of_edge"), c.add_argument("-r", "--run", type=int, default=0)
    c = sub.add_parser("partition")
    c.add_argument("path"), c.add_argument("-k", type=int, default=3), c.add_argument("-m", "--method", default="sls"), c.add_argument("--kernel", default="fcm2"), c.add_argument("-d", "--delimiter", default=","), c.add_argument("-s", "--steps", type=int, default=10), c.add_argument("--seed", type=int, default=0)
    c = sub.add_parser("validate")
    c.add_argument("--input", required=True), c.add_argument("--output", required=True), c.add_argument("--report", required=True)
    c.add_argument("--null-thresh", type=float, default=0.3), c.add_argument("--distinct-low", type=float, default=0.02), c.add_argument("--distinct-high", type=float, default=0.98), c.add_argument("--allow-non-numeric", action="store_true", help="texts count as their rank in order")
    c = sub.add_parser("context")
    c.add_argument("folder"), c.add_argument("label"), c.add_argument("node", type=int)
    c = sub.add_parser("template")
    c.add_argument("folder"), c.add_argument("label"), c.add_argument("-o", "--out", required=True)
    c = sub.add_parser("runs")
    c.add_argument("log_dir"), c.add_argument("--out", required=True)
    c = sub.add_parser("query")
    c.add_argument("name"), c.add_argument("folder"), c.add_argument("-o", "--out")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = local_session(a.cores)
    if a.command == "indicators":
        indicators(spark, a)
    elif a.command == "partition":
        partition(spark, a)
    elif a.command == "validate":
        validated(spark, a)
    elif a.command == "context":
        graph = _graph(spark, a.folder)
        one, _ = structure.detect_cardinalities(graph)
        context.shortest_first(context.node_context(graph, a.label, a.node, one)).show(200, False)
    elif a.command == "template":
        graph = _graph(spark, a.folder)
        types = [r["type"] for r in structure.loose_many_types(graph, a.label).collect()]
        files.write_csv(structure.aggregation_template(graph, a.label, types), a.out)
    elif a.command == "runs":
        runs = cut(runlog.parse_logs(files.read_logs(spark, a.log_dir)))
        for name, df in {"runs": runs.drop("clusters", "all_bar_scores"), "aggregates": runlog.aggregate_runs(runs, ["data", "heuristic", "k"], ["cpu_time", "wall_time", "best_score"]), "positions": runlog.score_positions(runs), "charts": runlog.chart_tables(runs, "cpu_time"), "agreement": runlog.ari_pairs(runs, ["data", "heuristic", "k"], "run", "clusters")}.items():
            files.write_csv(df, f"{a.out}/{name}")
    else:
        from graphlume.plans import registry

        queries = registry.queries()
        df = queries[a.name](spark, a.folder)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.select(*(F.col(f"`{c}`") for c in df.columns)).show(50, False)


if __name__ == "__main__":
    main()
