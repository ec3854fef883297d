"""Metrics that tell clustering from comparison indicators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlume.operators.graph import as_number
from graphlume.operators.ordered import near_tiles, tiles, with_previous
from graphlume.session import cut

#: Thresholds of the categories.
BC_THRESHOLD, CV_MAX, MIN_N = 0.55, 0.05, 5


def unpivoted(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """``*keep, feature, value`` of the present values."""
    entries = F.array(*(F.struct(F.lit(c).alias("feature"), as_number(c).alias("value")) for c in columns))
    long = df.select(*(f"`{k}`" for k in keep or []), F.explode(entries).alias("x"))
    return long.select(*(f"`{k}`" for k in keep or []), "x.feature", "x.value").where("value is not null")


def bimodality(long: DataFrame) -> DataFrame:
    """``feature, n, bc``: (skewness² + 1) / kurtosis with population moments; null below 5 values, 0 for a constant."""
    # moments around the mean by a second pass over the centred values: raw power sums would cancel
    means = long.groupBy("feature").agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    z = long.join(F.broadcast(means), "feature").withColumn("d", F.col("value") - F.col("m"))  # one row per column of the table
    power = z.groupBy("feature", "n").agg(*(F.avg(F.pow("d", F.lit(float(i)))).alias(f"m{i}") for i in (2, 3, 4)))
    skew = F.col("m3") / F.pow("m2", F.lit(1.5))
    kurtosis = F.col("m4") / (F.col("m2") * F.col("m2"))
    bc = F.when(F.col("n") < MIN_N, F.lit(None)).when(F.col("m2") == 0, 0.0).otherwise((skew * skew + 1) / kurtosis)
    return power.select("feature", "n", bc.cast("double").alias("bc"))


def gap_cv(long: DataFrame) -> DataFrame:
    """``feature, cv``: coefficient of variation (population) of the gaps between sorted values; infinite if all are equal, null below 2.

    Equal values give gaps of 0, so only distinct values with their counts are put in order."""
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("c"))
    gaps = with_previous(counts, ["feature"], ["value"], "value", "before").withColumn("gap", F.col("value") - F.col("before"))
    sums = gaps.groupBy("feature").agg(F.sum("c").alias("n"), F.sum("gap").alias("s"), F.max("gap").alias("top"))
    n_gaps = F.col("n") - 1
    mean = F.coalesce("s", F.lit(0.0)) / n_gaps
    centred = gaps.join(F.broadcast(sums.withColumn("mean", F.when(n_gaps > 0, mean)).select("feature", "mean", "n")), "feature")  # one row per column of the table
    squares = centred.groupBy("feature", "mean", "n").agg(F.sum(F.when(F.col("gap").isNotNull(), F.pow(F.col("gap") - F.col("mean"), F.lit(2.0)))).alias("q"), F.count("gap").alias("positive"))
    zeros = F.col("n") - 1 - F.col("positive")
    variance = (F.coalesce("q", F.lit(0.0)) + zeros * F.col("mean") * F.col("mean")) / (F.col("n") - 1)
    cv = F.when(F.col("n") < 2, F.lit(None)).when(F.col("mean") <= 0, F.lit(float("inf"))).otherwise(F.sqrt(variance) / F.col("mean"))
    return squares.select("feature", cv.cast("double").alias("cv"))


def category(n: Column, bc: Column, cv: Column, bc_threshold: float = BC_THRESHOLD, cv_max: float = CV_MAX, min_n: int = MIN_N) -> Column:
    return F.when(n < min_n, "unused").when(cv <= cv_max, "comparison").when(bc > bc_threshold, "clustering").otherwise("unused")


def feature_categories(long: DataFrame, **limits) -> DataFrame:
    """``feature, n, bc, cv, category``"""
    both = bimodality(long).join(gap_cv(long), "feature")
    return both.withColumn("category", category(F.col("n"), F.col("bc"), F.col("cv"), **limits))


def ranked_categories(long: DataFrame, most_clustering: int = 2, least_comparison: int = 1, cv_max: float = CV_MAX, min_n: int = MIN_N) -> DataFrame:
    """The lowest gap CVs are comparison, of the others the highest BCs clustering, a CV within the limit comparison, the rest unused. Ties by name."""
    both = bimodality(long).join(gap_cv(long), "feature")
    everything = Window.partitionBy(F.lit(1))  # one row per column of the table
    ranked = both.withColumn("by_cv", F.row_number().over(everything.orderBy(F.asc_nulls_last("cv"), "feature"))).withColumn("by_bc", F.row_number().over(everything.orderBy(F.desc_nulls_last("bc"), "feature")))
    found = F.when(F.col("n") < min_n, "unused").when(F.col("by_cv") <= least_comparison, "comparison").when(F.col("by_bc") <= most_clustering, "clustering").when(F.col("cv") <= cv_max, "comparison").otherwise("unused")
    return ranked.select("feature", "n", "bc", "cv", found.alias("category"))


METRICS = ["cv_values", "cv_gaps", "bc", "laplacian"]


def metric_table(df: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """``feature, cv_values, cv_gaps, bc, laplacian`` of standardised columns (population deviation), lowest Laplacian score first; null where a column is constant.

    ``key`` identifies a row; rows with a missing value have no neighbours and do not count in the Laplacian score."""
    long = unpivoted(df, columns)
    # standardising changes neither BC nor gap CV; the CV of the values is of the raw ones
    stats = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    moments = {r["feature"]: (r["m"], r["s"]) for r in stats.collect()}  # one row per column of the table
    standard = df.select(f"`{key}`", *((as_number(c) * 0.0 if c not in moments or not moments[c][1] else (as_number(c) - moments[c][0]) / moments[c][1]).alias(c) for c in columns))
    scores = laplacian_scores(standard, key, columns, k).withColumnRenamed("score", "laplacian")
    spread = stats.select("feature", F.try_divide("s", "m").alias("cv_values"))
    found = spread.join(gap_cv(long).withColumnRenamed("cv", "cv_gaps"), "feature").join(bimodality(long).select("feature", "bc"), "feature").join(scores, "feature", "left")
    return found.orderBy(F.asc_nulls_last("laplacian"), "feature")


def metric_correlations(table: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """``a, b, r``: Pearson correlation of each two metrics over the features that have both."""
    from graphlume.operators.validate import pearson_pairs

    return pearson_pairs(table, metrics or METRICS)


def _nearest_of(ids: np.ndarray, x: np.ndarray, keys: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) of the ``k`` nearest others of each row, ties by key."""
    d = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d += (x[:, i, None] - y[None, :, i]) ** 2
    d[ids[:, None] == keys[None, :]] = np.inf
    at = min(k, len(y)) - 1
    a, b = np.nonzero((d <= np.partition(d, at, axis=1)[:, at, None]) & np.isfinite(d))
    order = np.lexsort((keys[b], d[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k], d[a[place < k], b[place < k]]


def nearest(df: DataFrame, key: str, columns: list[str], k: int = 5, block: int = 500) -> DataFrame:
    """``a, b``: the ``k`` nearest other rows of each row (squared Euclid, ties by key), exactly. Rows with a missing value have no neighbours.

    Rows near each other are packed in tiles. A tile's own rows give each an upper bound of its k-th distance; the
    greatest of them is the tile's reach, and only tiles whose boxes lie within it meet. Of a tile only those rows go to
    another one whose own bound reaches its box. Tiles are plain arrays, which Python reads without an object per row."""
    kind, n = df.schema[key].dataType.simpleString(), len(columns)
    rows = df.select(F.col(key).alias("id"), F.array(*(as_number(c) for c in columns)).alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    tiled = cut(tiles(rows, "x", "id", block).select("tile", "low", "high", F.col("rows.id").alias("ids"), F.flatten("rows.x").alias("x")))

    def square(x: np.ndarray) -> np.ndarray:
        return np.asarray(x, dtype=float).reshape(-1, n)

    def reach(batches):
        for batch in batches:
            for tile, low, high, ids, x in zip(batch["tile"], batch["low"], batch["high"], batch["ids"], batch["x"]):
                a, _, d = _nearest_of(ids, square(x), ids, square(x), k)
                bounds = np.full(len(ids), np.inf)
                last = np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) == k - 1)
                bounds[a[last]] = d[last]
                yield pd.DataFrame({"tile": [tile], "low": [low], "high": [high], "reach": [float(bounds.max())], "bounds": [bounds]})

    def reaching(batches):
        for batch in batches:
            for other, low, high, ids, x, bounds in zip(batch["other"], batch["low"], batch["high"], batch["ids"], batch["x"], batch["bounds"]):
                x, apart = square(x), np.zeros(len(ids))
                for i in range(n):
                    apart += np.maximum(0.0, np.maximum(low[i] - x[:, i], x[:, i] - high[i])) ** 2
                near = apart <= bounds
                if near.any():
                    yield pd.DataFrame({"other": [other], "asked": [ids[near]], "at": [x[near].ravel()], "bounds": [bounds[near]]})

    def best(batches):
        for batch in batches:
            for asked, at, bounds, ids, x in zip(batch["asked"], batch["at"], batch["bounds"], batch["ids"], batch["x"]):
                a, b, d = _nearest_of(asked, square(at), ids, square(x), k)
                near = d <= bounds[a]
                yield pd.DataFrame({"a": asked[a[near]], "b": ids[b[near]], "d": d[near]})

    numbers = "array<double>"
    known = cut(tiled.mapInPandas(reach, f"tile long, low {numbers}, high {numbers}, reach double, bounds {numbers}"))
    met = near_tiles(known).join(known.select(F.col("tile").alias("other"), "low", "high"), "other")
    packed = tiled.select("tile", "ids", "x").join(known.select("tile", "bounds").hint("merge"), "tile")
    asks = met.join(packed.hint("merge"), "tile").select("other", "low", "high", "ids", "x", "bounds").mapInPandas(reaching, f"other long, asked array<{kind}>, at {numbers}, bounds {numbers}")
    pairs = asks.join(tiled.select(F.col("tile").alias("other"), "ids", "x").hint("merge"), "other")
    found = pairs.select("asked", "at", "bounds", "ids", "x").mapInPandas(best, f"a {kind}, b {kind}, d double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k).select("a", "b")


def laplacian_scores(df: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """``feature, score`` on the symmetric nearest-neighbour graph with weights of 1: f'Lf / f'Df of the centred feature."""
    edges = cut(nearest(df, key, columns, k))  # read twice
    both = edges.union(edges.select("b", "a")).distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("deg"))
    long = unpivoted(df, columns, [key]).withColumnRenamed(key, "a").join(degree, "a")
    mean = long.groupBy("feature").agg((F.sum(F.col("value") * F.col("deg")) / F.sum("deg")).alias("mean"))
    centred = long.join(F.broadcast(mean), "feature").withColumn("f", F.col("value") - F.col("mean"))  # one row per column of the table
    weight = centred.groupBy("feature").agg(F.sum(F.col("f") * F.col("f") * F.col("deg")).alias("fdf"))
    met = both.join(centred.select("a", "feature", "f"), "a").join(centred.select(F.col("a").alias("b"), "feature", F.col("f").alias("g")), ["b", "feature"])
    rough = met.groupBy("feature").agg((F.sum(F.pow(F.col("f") - F.col("g"), F.lit(2.0))) / 2).alias("flf"))
    return rough.join(weight, "feature").select("feature", F.try_divide("flf", "fdf").alias("score"))


def knee(values: list[float]) -> float | None:
    """Knee of the sorted values, convex and increasing; concave if that lies at the end. None below three values.

    The difference of the normalised curve from the diagonal is greatest at the knee."""
    y = sorted(v for v in values if v is not None and not math.isnan(v))
    if len(y) < 3 or y[0] == y[-1]:
        return None
    xs = [i / (len(y) - 1) for i in range(len(y))]
    ys = [(v - y[0]) / (y[-1] - y[0]) for v in y]
    at = max(range(len(y)), key=lambda i: (xs[i] - ys[i], -i))
    if at in (0, len(y) - 1):
        at = max(range(len(y)), key=lambda i: (ys[i] - xs[i], -i))
    return y[at]


def knee_split(scores: DataFrame, spacing: DataFrame) -> DataFrame:
    """``feature, score, cv, category``: a Laplacian score up to the knee is clustering; of the others a gap CV above the knee comparison, the rest unused."""
    both = scores.join(spacing, "feature")
    small = both.select("score", "cv").collect()  # one row per column of the table
    a, b = knee([r["score"] for r in small]), knee([r["cv"] for r in small if r["score"] is not None])
    found = F.when(F.col("score") > (math.inf if a is None else a), F.when(F.col("cv") > (math.inf if b is None else b), "comparison").otherwise("unused")).otherwise("clustering")
    return both.withColumn("category", found)


def dip(values: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Hartigan and Hartigan's dip of a sample (of values with their counts, if given): the largest gap between its distribution and the nearest unimodal one.

    Computed by narrowing the modal interval with the greatest convex minorant and least concave majorant."""
    points, place = np.unique(np.asarray(values, dtype=float), return_inverse=True)
    counts = np.bincount(place, counts).astype(np.int64) if len(points) else np.empty(0, dtype=np.int64)
    n = int(counts.sum())
    if n < 2 or len(points) == 1:
        return 1.0 / (2 * n) if n else 0.0
    after = np.cumsum(counts) / n
    before = after - counts / n
    left, right, found = 0, len(points) - 1, 1.0 / n

    def hull(at: np.ndarray, heights: np.ndarray, sign: float) -> list[int]:
        chain: list[int] = []
        for i in range(len(at)):
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if sign * (heights[b] - heights[a]) * (at[i] - at[a]) < sign * (heights[i] - heights[a]) * (at[b] - at[a]):
                    break
                chain.pop()
            chain.append(i)
        return chain

    while True:
        at, lo, hi = points[left : right + 1], before[left : right + 1], after[left : right + 1]
        minorant, majorant = hull(at, lo, 1.0), hull(at, hi, -1.0)
        gap_min = np.interp(at[majorant], at[minorant], lo[minorant])
        gap_maj = np.interp(at[minorant], at[majorant], hi[majorant])
        d_up, d_low = np.abs(hi[majorant] - gap_min), np.abs(gap_maj - lo[minorant])
        widest = max(d_up.max(), d_low.max())
        if widest <= found:
            break
        if d_up.max() >= d_low.max():
            j = int(np.argmax(d_up))
            new_right = majorant[j]
            new_left = max((i for i in minorant if at[i] <= at[new_right]), default=0)
            new_right_at, new_left_at = min((i for i in majorant if i >= new_right)), new_left
        else:
            j = int(np.argmax(d_low))
            new_left_at = minorant[j]
            new_right_at = min((i for i in majorant if i >= new_left_at), default=len(at) - 1)
        inner_left = np.abs(hi[: new_left_at + 1] - np.interp(at[: new_left_at + 1], at[minorant], lo[minorant]))
        inner_right = np.abs(np.interp(at[new_right_at:], at[majorant], hi[majorant]) - lo[new_right_at:])
        found = max(found, inner_left.max() if new_left_at else 0.0, inner_right.max() if new_right_at < len(at) - 1 else 0.0)
        if new_left_at == 0 and new_right_at == len(at) - 1 or new_right_at <= new_left_at:
            break
        left, right = left + new_left_at, left + new_right_at
    return found / 2


def dip_statistics(long: DataFrame) -> DataFrame:
    """``feature, n, dip``. The statistic depends on a feature's values only through their distribution, so equal values are one
    point with their count; a feature's distinct values come together in one task."""
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("c"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["c"].sum())
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "n": [n], "dip": [dip(pdf["value"].to_numpy(), pdf["c"].to_numpy())]})

    return counts.groupBy("feature").applyInPandas(one, "feature string, n long, dip double")


def column_groups(metrics: DataFrame, column: str, groups: int) -> DataFrame:
    """``feature, grp``: one metric's values in ``groups`` groups by k-means with fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    valid = metrics.where(F.col(column).isNotNull() & (F.abs(F.col(column)) < float("inf")))
    vectors = VectorAssembler(inputCols=[column], outputCol="v").transform(valid)
    return KMeans(k=groups, seed=42, featuresCol="v", predictionCol="grp").fit(vectors).transform(vectors).select("feature", "grp")
