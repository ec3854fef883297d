"""Validation of an indicator table: density, distinctness, correlation, suffixes, rows with nulls, scaling.

All columns are profiled in one aggregate and all pairs in a few (``CHUNK`` expressions
each); which columns stay is then decided on the driver from those numbers alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlume.operators.graph import as_number
from graphlume.operators.ordered import ranks, running_sum, salted_join
from graphlume.session import cut

REPORT = "column string, action string, reason string, null_ratio double, distinct_ratio double, dtype_before string"
CHUNK = 2000


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, n_present, n_distinct, null_ratio, distinct_ratio`` of all columns in one aggregate.

    The ratio of distinct values is over present ones; both are null for an empty table or column."""
    found = df.agg(F.count("*").alias("n"), *(F.count(as_number(c)).alias(f"c{i}") for i, c in enumerate(columns)), *(F.count_distinct(as_number(c)).alias(f"d{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_present"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)))
    long = found.select("n", F.explode(rows).alias("x")).select("x.column", "n", "x.n_present", "x.n_distinct")
    return long.withColumn("null_ratio", 1 - F.try_divide(F.col("n_present"), F.col("n"))).withColumn("distinct_ratio", F.try_divide(F.col("n_distinct"), F.col("n_present")))


def process(df: DataFrame, null_thresh: float = 0.3, distinct_low: float = 0.02, distinct_high: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """(kept columns with the first one, report): drops sparse, empty, too constant and too unique columns, in this order.

    Text columns are read as numbers where they are. Raises ValueError with fewer than two columns."""
    if len(df.columns) < 2:
        raise ValueError("at least an id and one indicator are needed")
    first, *rest = df.columns
    types = dict(df.dtypes)
    coerced = df.select(f"`{first}`", *(F.col(f"`{c}`").try_cast("double").alias(c) for c in rest))
    found = {r["column"]: r for r in profile(coerced, rest).collect()}  # one row per column
    kept, report = [first], []
    for c in rest:
        r = found[c]
        nulls = r["null_ratio"] if r["null_ratio"] is not None else 1.0
        if nulls > null_thresh:
            why = "null_ratio"
        elif not r["n_present"]:
            why = "all_null"
        elif r["distinct_ratio"] < distinct_low:
            why = "distinct_low"
        elif r["distinct_ratio"] > distinct_high:
            why = "distinct_high"
        else:
            why = None
            kept.append(c)
        report.append((c, "dropped" if why else "kept", why, float(nulls), r["distinct_ratio"], types[c]))
    return coerced.select(*(f"`{c}`" for c in kept)), df.sparkSession.createDataFrame(report, REPORT)


def text_as_ranks(df: DataFrame) -> DataFrame:
    """Columns that hold other texts than numbers as the ranks of their texts (equal ones alike); the first column, the id, stays."""
    first, *rest = df.columns
    texts = [c for c in rest if dict(df.dtypes)[c] == "string"]
    if texts:
        other = df.agg(*(F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"n{i}") for i, c in enumerate(texts))).first()
        for i, c in enumerate(texts):
            if other[f"n{i}"]:
                placed = ranks(df.select(F.col(f"`{c}`").alias("v")), [], "v")
                df = salted_join(df, placed.select(F.col("v").alias(c), F.col("rank").alias("_rank")), [c], first, "left").withColumn(c, F.col("_rank")).drop("_rank")
    return df.select(*(f"`{c}`" for c in [first, *rest]))


def _pearson(a: Column, b: Column) -> Column:
    """Pearson over rows where both are present; null where either is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` for every pair of columns in table order; pairs are chunked, not joined."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    out = None
    for at in range(0, len(pairs), CHUNK):
        part = pairs[at : at + CHUNK]
        row = df.agg(*(_pearson(as_number(a), as_number(b)).alias(f"r{i}") for i, (a, b) in enumerate(part)))
        entries = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(part)))
        long = row.select(F.explode(entries).alias("x")).select("x.*")
        out = long if out is None else out.unionByName(long)
    return out


def average_ranks(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Average ranks of each column's present values; other columns of ``keep`` stay.

    All columns go through one long table (row, column, value): equal values move as one row with their count, ranks are
    running sums of the counts, and rows are put together again by their number in a written table."""
    wide = cut(df.select(*keep, *(as_number(c).alias(c) for c in columns))).withColumn("_row", F.monotonically_increasing_id())
    entries = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("value")) for c in columns))
    long = wide.select("_row", F.explode(entries).alias("x")).select("_row", "x.feature", "x.value").where("value is not null")
    ranked = salted_join(long, ranks(long, ["feature"], "value"), ["feature", "value"], "_row")
    found = ranked.groupBy("_row").agg(*(F.max(F.when(F.col("feature") == c, F.col("rank"))).alias(c) for c in columns))
    if not keep:
        return found.drop("_row")
    return wide.select("_row", *keep).join(found, "_row", "left").drop("_row")


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of average ranks, over the rows where all columns are present."""
    complete = df.select(*(as_number(c).alias(c) for c in columns)).na.drop("any")
    return pearson_pairs(average_ranks(complete, columns, []), columns)


def drop_correlated(df: DataFrame, threshold: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """Left to right, a column still kept removes every later one correlated with it beyond the threshold. First column: the id."""
    first, *rest = df.columns
    r = {(x["a"], x["b"]): x["r"] for x in pearson_pairs(df, rest).collect()}
    gone: dict[str, str] = {}
    for i, a in enumerate(rest):
        if a not in gone:
            for b in rest[i + 1 :]:
                if b not in gone and r[a, b] is not None and abs(r[a, b]) > threshold:
                    gone[b] = a
    types = dict(df.dtypes)
    report = [(b, "dropped", f"correlated with {gone[b]}", None, None, types[b]) for b in rest if b in gone]
    return df.select(*(f"`{c}`" for c in df.columns if c not in gone)), df.sparkSession.createDataFrame(report, REPORT)


def drop_suffixes(df: DataFrame, suffixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Without the columns that end so; the first column, the id, always stays."""
    ends = tuple(suffixes)
    gone = [c for c in df.columns[1:] if ends and c.endswith(ends)]
    types = dict(df.dtypes)
    return df.drop(*(f"{c}" for c in gone)), df.sparkSession.createDataFrame([(c, "dropped", "unwanted", None, None, types[c]) for c in gone], REPORT)


def drop_null_rows(df: DataFrame) -> DataFrame:
    condition = F.lit(True)
    for c in df.columns:
        condition = condition & F.col(f"`{c}`").isNotNull()
    return df.where(condition)


def null_row_counts(df: DataFrame) -> DataFrame:
    """``n_before, n_after``: rows in all and rows without a null."""
    whole = F.lit(True)
    for c in df.columns:
        whole = whole & F.col(f"`{c}`").isNotNull()
    return df.agg(F.count("*").alias("n_before"), F.count_if(whole).alias("n_after"))


def percentile_scale(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, column, scaled``: (average rank - 1) / (n - 1) of present values; 0.5 for a single or constant value; null stays."""
    x = as_number(column)
    counts = df.where(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count("*").alias("_c"))
    ranks = running_sum(counts, [], ["_v"], "_c", "_b").select("_v", (F.col("_b") + (F.col("_c") + 1) / 2).alias("_r"))
    whole = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()  # one row
    scaled = F.lit(0.5) if whole["n"] < 2 or whole["lo"] == whole["hi"] else (F.col("_r") - 1) / (whole["n"] - 1)
    return df.select(key, x.alias(column)).join(ranks, F.col(f"`{column}`") == F.col("_v"), "left").select(key, f"`{column}`", F.when(F.col("_v").isNotNull(), scaled).alias("scaled"))


def minmax_scale(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column to 0..1; a constant one to 0."""
    ends = df.agg(*(F.min(as_number(c)).alias(f"lo{i}") for i, c in enumerate(columns)), *(F.max(as_number(c)).alias(f"hi{i}") for i, c in enumerate(columns))).first()  # one row
    out = []
    for i, c in enumerate(columns):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        scaled = F.lit(None).cast("double") if lo is None else (F.lit(0.0) * as_number(c) if hi == lo else (as_number(c) - lo) / (hi - lo))
        out.append(scaled.alias(c))
    return df.select(key, *out)


def empty_report(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REPORT)
