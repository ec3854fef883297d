"""Percentiles of very many numbers by merging centroid digests.

A digest of a group is its sorted values clustered into centroids whose weight is bounded
by a function of their quantile: narrow at both ends, widest in the middle. Digests merge
by clustering their centroids again, so digests of partitions make one of a load and
digests of loads one of a month. All groups of a batch are clustered at once with array
operations; what a task holds is bounded by ``HELD`` numbers, after which it passes on
what it has as a partial digest.

Two statements of error go with each percentile, both as a share of the group's values:
``bound``, from the digest alone (the weight of the two centroids between which the
percentile lies), and ``rank_error``, from a second pass that counts the values below and
up to the estimate.

Defined results: null, NaN and infinite values do not count; null is a group key like any
other; a group without a value has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlume.operators.ordered import salted_join
from graphlume.session import cut

SIZE, HELD = 200, 2_000_000
#: Parts in which the partial digests of one group meet first.
MERGED_IN = 16
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
SCHEMA = "grp string, n long, low double, high double, means array<double>, weights array<double>"


def cluster(codes: np.ndarray, means: np.ndarray, weights: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of each group, sorted by group and mean: those whose middle falls into the same step of the size function are one."""
    order = np.lexsort((means, codes))
    codes, means, weights = codes[order], means[order], weights[order]
    if not len(codes):
        return codes, means, weights
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(codes)])))
    total = np.add.reduceat(weights, starts)
    done = np.cumsum(weights)
    before = np.repeat(done[starts] - weights[starts], sizes)
    q = (done - weights / 2 - before) / np.repeat(total, sizes)
    step = np.floor(size * (np.arcsin(np.clip(2 * q - 1, -1, 1)) / np.pi + 0.5))
    first = np.concatenate(([True], (codes[1:] != codes[:-1]) | (step[1:] != step[:-1])))
    at = np.flatnonzero(first)
    summed = np.add.reduceat(weights, at)
    centre = np.add.reduceat(means * weights / np.repeat(summed, np.diff(np.concatenate((at, [len(codes)])))), at)
    return codes[at], centre, summed


def _pack(names: list[str], codes: np.ndarray, means: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    present = codes[starts]
    return pd.DataFrame({
        "grp": [names[c] for c in present], "n": np.add.reduceat(weights, starts).round().astype(np.int64), "low": low[present], "high": high[present],
        "means": np.split(means, starts[1:]), "weights": np.split(weights, starts[1:]),
    })


class _Held:
    """What a task has of its groups: centroids, clustered again whenever there are too many."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.low, self.high, self.count = np.empty(0), np.empty(0), 0

    def add(self, groups: pd.Series, means: np.ndarray, weights: np.ndarray, lows: np.ndarray, highs: np.ndarray, lengths: np.ndarray | None = None) -> None:
        local, names = pd.factorize(groups)
        mapped = np.array([self.numbers.setdefault(g, len(self.numbers)) for g in names], dtype=np.int64)
        codes = mapped[local]
        grown = len(self.numbers) - len(self.low)
        self.low, self.high = np.concatenate((self.low, np.full(grown, np.inf))), np.concatenate((self.high, np.full(grown, -np.inf)))
        np.minimum.at(self.low, codes, lows)
        np.maximum.at(self.high, codes, highs)
        self.parts.append((codes if lengths is None else np.repeat(codes, lengths), means, weights))
        self.count += len(means)
        if self.count > HELD:
            self.shrink()

    def shrink(self) -> None:
        merged = cluster(*(np.concatenate(x) for x in zip(*self.parts)), self.size)
        self.parts, self.count = [merged], len(merged[0])

    def frames(self) -> Iterator[pd.DataFrame]:
        if self.parts:
            self.shrink()
            yield _pack(list(self.numbers), *self.parts[0], self.low, self.high)
        self.clear()


def _from_values(size: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(size)
        for batch in batches:
            x = batch["x"].to_numpy(dtype=np.float64)
            held.add(batch["grp"], x, np.ones(len(x)), x, x)
            if held.count > HELD // 2:
                yield from held.frames()
        yield from held.frames()

    return build


def _from_digests(size: int):
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(size)
        for batch in batches:
            if not len(batch):
                continue
            # rows come sorted by group: groups before the batch's first one are complete
            if held.numbers and batch["grp"].iloc[0] not in held.numbers and held.count > HELD // 2:
                yield from held.frames()
            lengths = batch["means"].map(len).to_numpy()
            held.add(batch["grp"], np.concatenate(batch["means"].to_list()), np.concatenate(batch["weights"].to_list()), batch["low"].to_numpy(), batch["high"].to_numpy(), lengths)
        yield from held.frames()

    return merge


def _key(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def merged(partial: DataFrame, size: int = SIZE) -> DataFrame:
    """One digest per group from any number of partial ones: those of one group meet in parts first, so that no task merges all of a hot group's."""
    part = F.pmod(F.xxhash64("means"), F.lit(MERGED_IN))
    some = partial.repartition("grp", part).sortWithinPartitions("grp").mapInPandas(_from_digests(size), SCHEMA)
    return some.repartition("grp").sortWithinPartitions("grp").mapInPandas(_from_digests(size), SCHEMA)


def digest(df: DataFrame, keys: list[str], value: str, size: int = SIZE) -> DataFrame:
    """The digest of each group; ``grp`` holds the keys as JSON."""
    x = F.col(value).cast("double")
    finite = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(_key(keys).alias("grp"), x.alias("x"))
    return merged(finite.mapInPandas(_from_values(size), SCHEMA), size)


def regrouped(digests: DataFrame, schema: str, keys: dict[str, Column], size: int = SIZE) -> DataFrame:
    """Digests of coarser groups: ``keys`` are columns over the old keys, which ``schema`` describes."""
    old = digests.withColumn("_k", F.from_json("grp", schema)).select("_k.*", "n", "low", "high", "means", "weights")
    return merged(old.select(_key([c.alias(k) for k, c in keys.items()]).alias("grp"), "n", "low", "high", "means", "weights"), size)


def quantiles(low: float, high: float, means: np.ndarray, weights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates between the centroids' middles, and the rank error they can have."""
    total = weights.sum()
    middle = (np.cumsum(weights) - weights / 2) / total
    value = np.interp(at, np.concatenate(([0.0], middle, [1.0])), np.concatenate(([low], means, [high])))
    padded = np.concatenate((weights[:1], weights, weights[-1:]))
    right = np.searchsorted(middle, at)
    return value, np.minimum(1.0, (padded[right] + padded[right + 1]) / total)


def estimates(digests: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``grp, n, values, bounds`` with one entry per percentile."""
    at = np.array(percentiles)

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [quantiles(lo, hi, m, w, at) for lo, hi, m, w in zip(batch["low"], batch["high"], batch["means"], batch["weights"])]
            yield pd.DataFrame({"grp": batch["grp"], "n": batch["n"], "values": [f[0] for f in found], "bounds": [f[1] for f in found]})

    return digests.mapInPandas(estimate, "grp string, n long, values array<double>, bounds array<double>")


def certified(estimated: DataFrame, df: DataFrame, keys: list[str], value: str, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``grp, n, percentile, value, bound, rank_error``; ``df`` holds the values themselves, and best a column that tells its rows apart.

    The estimates (one row per group) are written once: their size decides whether they are broadcast, so that values are
    counted where they lie, or meet the values of a group in parts by the hash of the whole row."""
    x = F.col(value).cast("double")
    estimated = cut(estimated)
    spread = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    finite = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(_key(keys).alias("grp"), x.alias("x"), spread.alias("spread"))
    met = salted_join(finite, estimated.select("grp", "values"), ["grp"], "spread")
    counts = [F.count_if(F.col("x") < F.col("values")[i]).alias(f"below{i}") for i in range(len(percentiles))] + [F.count_if(F.col("x") <= F.col("values")[i]).alias(f"upto{i}") for i in range(len(percentiles))]
    counted = met.groupBy("grp").agg(F.count("*").alias("n_counted"), *counts)
    joined = estimated.join(counted, "grp")
    rows = []
    for i, p in enumerate(percentiles):
        rank = F.lit(p) * F.col("n_counted")
        error = F.greatest(F.lit(0.0), F.col(f"below{i}") - rank, rank - F.col(f"upto{i}")) / F.col("n_counted")
        rows.append(F.struct(F.lit(p).alias("percentile"), F.col("values")[i].alias("value"), F.col("bounds")[i].alias("bound"), error.alias("rank_error")))
    return joined.select("grp", F.col("n_counted").alias("n"), F.explode(F.array(*rows)).alias("r")).select("grp", "n", "r.*")
