"""Analytics of experiment runs: logs, aggregates, score ranges, agreement of solutions, chart tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlume.session import cut

#: The forms of log file names and log lines.
FILE_NAME = r"^([a-zA-Z0-9_-]+)_(lp|ls|rd|sls|exp)_(\d+)_(\d+)\.log$"
SOLUTION = r"\[best solution\]\s*:\s*\[([^\]]+)\]"
SCORE = r"\[best solution\][^\|]*\|\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
CPU = r"\[CPU time\]\s*([0-9.]+(?:[eE][+-]?\d+)?)\s*seconds"
WALL = r"\[Wall time\]\s*([0-9.]+(?:[eE][+-]?\d+)?)\s*seconds"
ROWS, FEATURES = r"\|D\|\s*=\s*(\d+)", r"\bn\s*=\s*(\d+)"
ALL_SCORES = r"\|\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
#: The order in which heuristics are shown.
HEURISTICS = ("lp", "ls", "rd", "sls", "exp")


def heuristic_order(name: Column) -> Column:
    place = F.lit(len(HEURISTICS))
    for i, h in enumerate(HEURISTICS):
        place = F.when(name == h, i).otherwise(place)
    return place


def _first(text: Column, pattern: str, kind: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast(kind)


def parse_logs(logs: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """One row per log whose name has the known form; what a log does not state is null."""
    name, body = F.regexp_extract(F.col(file), r"([^/\\]+)$", 1), F.col(text)
    listed = F.transform(F.split(F.regexp_extract(body, SOLUTION, 1), r"[;,\s]+"), lambda x: x.try_cast("int"))
    return logs.where(name.rlike(FILE_NAME)).select(
        F.regexp_extract(name, FILE_NAME, 1).alias("data"), F.regexp_extract(name, FILE_NAME, 2).alias("heuristic"), F.regexp_extract(name, FILE_NAME, 3).cast("int").alias("k"), F.regexp_extract(name, FILE_NAME, 4).cast("int").alias("run"),
        _first(body, ROWS, "int").alias("D"), _first(body, FEATURES, "int").alias("n"), _first(body, CPU, "double").alias("cpu_time"), _first(body, WALL, "double").alias("wall_time"), _first(body, SCORE, "double").alias("best_score"),
        F.when(body.rlike(SOLUTION), F.filter(listed, lambda x: x.isNotNull())).alias("clusters"),
        F.transform(F.regexp_extract_all(body, F.lit(ALL_SCORES), F.lit(1)), lambda x: x.try_cast("double")).alias("all_bar_scores"),
    )


def aggregate_runs(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``*keys, runs`` and mean, sample deviation and count of each value; null keys are groups of their own."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *(f(finite(v)).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))))


def two_levels(runs: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """``*outer, mean, std, groups``: over the means of the inner groups."""
    first = aggregate_runs(runs, inner, [value]).where(F.col(f"{value}_mean").isNotNull())
    return first.groupBy(*outer).agg(F.avg(f"{value}_mean").alias("mean"), F.stddev_samp(f"{value}_mean").alias("std"), F.count("*").alias("groups"))


def chart_tables(runs: DataFrame, value: str) -> DataFrame:
    """``chart, heuristic, data, k, D, n, mean, std, runs``: the groupings of all charts in one aggregate (grouping sets)."""
    valid = runs.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    sets = [["heuristic"], ["heuristic", "data"], ["heuristic", "k"], ["heuristic", "D"], ["heuristic", "n"]]
    columns = ["heuristic", "data", "k", "D", "n"]
    grouped = valid.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    # the grouping id tells a missing key from a null one
    level = F.grouping_id(*columns)
    found = grouped.agg(level.alias("gid"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("runs"))
    names = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): "_".join(s) for s in sets}
    chart = F.lit(None).cast("string")
    for gid, name in names.items():
        chart = F.when(F.col("gid") == gid, name).otherwise(chart)
    return found.select(chart.alias("chart"), *columns, "mean", "std", "runs")


def score_positions(runs: DataFrame, by: str = "data", score: str = "best_score", scores: str = "all_bar_scores", clip: bool = True) -> DataFrame:
    """``by, heuristic, mean_best, std_best, lo, hi, position, std_norm``: where a heuristic's mean best score lies in the range of all scores.

    A range of zero gives null; ``clip`` keeps positions within 0 to 1."""
    each = runs.select(by, F.explode(scores).alias("s")).where(F.col("s").isNotNull() & ~F.isnan("s"))
    ends = each.groupBy(by).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    means = runs.groupBy(by, "heuristic").agg(F.avg(score).alias("mean_best"), F.stddev_samp(score).alias("std_best"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    at = (F.col("mean_best") - F.col("lo")) / width
    if clip:
        at = F.when(at.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), at)))
    return means.join(ends, by, "left").withColumn("position", at).withColumn("std_norm", F.col("std_best") / width)


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(a: Column, b: Column) -> Column:
    """Adjusted Rand index of two label arrays: 1 for up to one element or a zero denominator, null for different lengths.

    The contingency counts are formed within the row: labels of a solution are few."""
    pairs = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))

    def total(items: Column) -> Column:
        counts = F.transform(F.array_distinct(items), lambda v: F.size(F.filter(items, lambda w: w == v)).cast("double"))
        return F.aggregate(counts, F.lit(0.0), lambda s, n: s + n * (n - 1) / 2)

    n = F.size(a).cast("double")
    cells, rows, columns, every = total(pairs), total(a), total(b), _pairs(n)
    expected = rows * columns / F.nullif(every, F.lit(0.0))
    bottom = (rows + columns) / 2 - expected
    return F.when(F.size(a) != F.size(b), None).when(n <= 1, 1.0).when(bottom == 0, 1.0).otherwise((cells - expected) / F.nullif(bottom, F.lit(0.0)))


def ari_pairs(runs: DataFrame, keys: list[str], run: str, labels: str) -> DataFrame:
    """``*keys, pairs, mean_ari``: agreement of the solutions of all pairs of runs of a group; runs of different length make no pair.

    No pair of runs is formed. The index of two runs needs, beside each run's own number R of element
    pairs with equal labels, only how many element pairs are equal in both. Summed over the runs of two
    classes of equal R that is the scalar product of the classes' counts by element pair. So runs are
    added up by (group, length, R), of which there are few, and only these classes meet each other.
    """
    own = runs.where(F.col(labels).isNotNull()).select(*keys, F.col(labels).alias("v"), F.size(labels).alias("n"))
    equal = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.greatest(F.col("n") - i - 1, F.lit(0))), lambda y: (x == y).cast("long"))))
    sized = own.withColumn("e", equal).withColumn("r", F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + x))
    classes = [*keys, "n", "r"]
    size = sized.groupBy(*classes).agg(F.count("*").alias("m"))
    counts = sized.select(*classes, F.posexplode("e").alias("at", "x")).where("x = 1").groupBy(*classes, "at").agg(F.count("*").alias("c"))
    packed = counts.groupBy(*classes).agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("c"))  # element pairs of a solution
    every = F.sequence(F.lit(0), F.greatest(F.col("n") * (F.col("n") - 1) / 2 - 1, F.lit(0)).cast("int"))
    none = F.create_map().cast("map<int,bigint>")
    dense = cut(size.join(packed, classes, "left").withColumn("c", F.coalesce("c", none)).withColumn("c", F.transform(every, lambda i: F.coalesce(F.try_element_at("c", i), F.lit(0).cast("long")))))
    left, right = dense.withColumnsRenamed({"r": "r1", "m": "m1", "c": "c1"}), dense.withColumnsRenamed({"r": "r2", "m": "m2", "c": "c2"})
    met = left.join(right, [*keys, "n"]).where("r1 <= r2")
    same = F.col("r1") == F.col("r2")
    product = F.aggregate(F.zip_with("c1", "c2", lambda a, b: F.when(same, a * (a - 1) / 2).otherwise((a * b).cast("double"))), F.lit(0.0), lambda s, x: s + x)
    pairs = F.when(same, F.col("m1") * (F.col("m1") - 1) / 2).otherwise((F.col("m1") * F.col("m2")).cast("double"))
    expected = F.try_divide(F.col("r1") * F.col("r2"), F.col("n") * (F.col("n") - 1) / 2)
    bottom = (F.col("r1") + F.col("r2")) / 2 - expected
    total = F.when((F.col("n") <= 1) | (bottom == 0), pairs).otherwise(F.try_divide(product - pairs * expected, bottom))
    found = met.select(*keys, pairs.alias("w"), total.alias("t")).where("w > 0")
    return found.groupBy(*keys).agg(F.sum("w").cast("long").alias("pairs"), (F.sum("t") / F.sum("w")).alias("mean_ari"))


def mean_ari(per_group: DataFrame, keys: list[str]) -> DataFrame:
    return per_group.groupBy(*keys).agg(F.avg("mean_ari").alias("mean"), F.stddev_samp("mean_ari").alias("std"))


def ari_levels(per_group: DataFrame) -> DataFrame:
    """``level, data, heuristic, mean, std``: over the groups of a data set and heuristic, and of a heuristic."""
    levels = [mean_ari(per_group, keys).select(F.lit("_".join(keys)).alias("level"), (F.col("data") if "data" in keys else F.lit(None).cast("string")).alias("data"), "heuristic", "mean", "std") for keys in (["data", "heuristic"], ["heuristic"])]
    return levels[0].unionByName(levels[1])


def log_text(runs: DataFrame, labels: str) -> DataFrame:
    """``file, text``: runs as the logs from which ``parse_logs`` reads them; ``labels`` is the solution as text (``1;0;-1``)."""
    line = lambda head, c, tail="": F.concat(F.lit(head), F.col(c).cast("string"), F.lit(f"{tail}\n"))
    present = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    finite = runs.withColumns({c: present(c) for c in ("cpu_time", "wall_time", "best_score")})
    scores = F.array_join(F.transform("all_bar_scores", lambda x: F.concat(F.lit("| "), x.cast("string"))), "\n")
    solution = F.concat(F.lit("[best solution]: ["), F.col(labels), F.lit("] | "), F.col("best_score").cast("string"), F.lit("\n"))
    text = F.concat_ws("", F.concat(F.lit("LOADED "), F.col("data"), F.lit(" ")), F.concat(F.lit("|D|= "), F.col("D").cast("string"), F.lit("  ")), line("n= ", "n"), line("[CPU time] ", "cpu_time", " seconds"), line("[Wall time] ", "wall_time", " seconds"), solution, scores)
    return finite.select("file", text.alias("text"))


def log_scale(df: DataFrame, value: str) -> DataFrame:
    """``log``: whether a chart of the values needs a logarithmic scale: all positive and over a range of 50."""
    return df.agg(F.coalesce((F.min(value) > 0) & (F.try_divide(F.max(value), F.min(value)) >= 50), F.lit(False)).alias("log"))


def error_bars(mean: Column, std: Column, log: bool) -> tuple[Column, Column]:
    """(down, up): least(std, mean) and std; on a logarithmic scale by a factor from the capped variation."""
    std = F.coalesce(std, F.lit(0.0))
    if not log:
        return F.least(std, mean), std
    cv = F.least(F.lit(2.0), F.coalesce(F.try_divide(std, mean), F.lit(0.0)))
    factor = F.exp(F.sqrt(F.ln(1 + cv * cv)))
    return mean - mean / factor, mean * factor - mean


PUSHDOWN_METRICS = ("time_total", "time_Indicators", "time_Validation")


def compare_pushdown(results: DataFrame, metrics: tuple[str, ...] = PUSHDOWN_METRICS) -> DataFrame:
    """``label, pushdown, ratio, metric, mean, std``: groups with null keys are left out; a missing deviation is 0."""
    keys = ["label", "pushdown", "ratio_prop_dropped"]
    kept = results.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    found = kept.groupBy(*keys).agg(*(f(F.col(m)).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
    rows = F.array(*(F.struct(F.lit(m.lower()).alias("metric"), F.col(f"mean_{m}").alias("mean"), F.coalesce(F.col(f"std_{m}"), F.lit(0.0)).alias("std")) for m in metrics))
    return found.select("label", "pushdown", F.col("ratio_prop_dropped").alias("ratio"), F.explode(rows).alias("x")).select("label", "pushdown", "ratio", "x.*")


def average_times(results: DataFrame, order: list[str]) -> DataFrame:
    """``database, label``: means of the time columns, of the others the first present value in the given order. Null keys are groups."""
    times = [c for c in results.columns if c.startswith("time_")]
    others = [c for c in results.columns if c not in (*times, "database", "label", *order)]
    place = F.struct(*(f"`{c}`" for c in order))
    first = [F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), place)).alias(c) for c in others]
    return results.groupBy("database", "label").agg(*first, *(F.avg(F.col(f"`{t}`")).alias(t) for t in times))


def assert_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """``df`` with names in lower case and without surrounding blanks; raises if one of ``needed`` is missing."""
    named = df.toDF(*(c.strip().lower() for c in df.columns))
    missing = [c for c in needed if c.strip().lower() not in named.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return named


def collection_row(spark, run: int, pushdown: bool, database: str, counts: dict[str, float | int | None], times: dict[str, float]) -> DataFrame:
    """One row of run results in the order of the published table; ``ratio_prop_dropped`` from ``n_all`` and ``n_kept``."""
    whole, kept = counts["n_all"], counts["n_kept"]
    phases = ("time_Preprocessing", "time_Cardinalities", "time_Indicators", "time_Validation")
    row = (run, pushdown, database, counts["N"], counts["E"], counts["label"], kept, counts["nodes"], counts["avgLabelProp"], *(times[t] for t in phases), sum(times[t] for t in phases), 100.0 * (whole - kept) / whole if whole else None)
    names = "run int, pushdown boolean, database string, N long, E long, label string, `indicators#` int, `nodes#` long, avgLabelProp double, " + ", ".join(f"{t} double" for t in phases) + ", time_total double, ratio_prop_dropped double"
    return spark.createDataFrame([row], names)


def melted_means(results: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``*keys, metric, value``: means, one row per metric; groups without a value have a null."""
    return results.groupBy(*keys).agg(*(F.avg(F.col(f"`{v}`")).alias(v) for v in values)).unpivot(keys, values, "metric", "value")


def result_rows(measured: DataFrame) -> DataFrame:
    """Run results with ``ratio_prop_dropped`` = 100 (all - kept) / all from ``n_all`` and ``n_kept``."""
    return measured.withColumn("ratio_prop_dropped", F.try_divide(100.0 * (F.col("n_all") - F.col("n_kept")), F.col("n_all")))


def experiment_grid(spark, data: list[str], heuristics: tuple[str, ...] = HEURISTICS, ks: tuple[int, ...] = (2, 3, 4, 5), samples: int = 5) -> DataFrame:
    """``data, heuristic, k, run``: the deterministic heuristic ``exp`` once, the others ``samples`` times."""
    rows = [(d, h, k, r) for d in data for h in heuristics for k in ks for r in range(1 if h == "exp" else samples)]
    return spark.createDataFrame(rows, "data string, heuristic string, k int, run int")


def pushdown_grid(spark, runs: int, ratios: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """``pushdown, null_ratio, run``"""
    return spark.createDataFrame([(p, x, r) for p in (False, True) for x in ratios for r in range(runs)], "pushdown boolean, null_ratio double, run int")


def run_experiments(grid: DataFrame, run, done: DataFrame | None = None, seed: int = 0):
    """``run(data, heuristic, k, run)`` for each configuration of the grid that ``done`` does not hold, in a seeded random order.

    Yields (configuration, result); an experiment is itself distributed, so they run one after the other."""
    keys = ["data", "heuristic", "k", "run"]
    left = grid.join(done.select(keys).distinct(), keys, "left_anti") if done is not None else grid
    for row in left.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).toLocalIterator():
        yield tuple(row), run(*row)
