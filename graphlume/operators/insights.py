"""Insights: the most different pairs of nodes in each cluster, and what its members share.

The k most different pairs of a cluster under L1 over q comparison columns are found exactly
and without listing all pairs. |x - y| is the greatest of s·(x - y) over the sign vectors s,
so a pair that ranks among the first k has one end among the k + 1 greatest s·x and the other
among the k + 1 least, for its own s. Each task keeps those ends of each cluster and sign
vector; they are few, meet again in parts of a cluster and then as one, and only their pairs
are formed. Beyond ``MOST_SIGNS`` columns the sign vectors would be too many; there, rows meet
in pairs of blocks, whose distances are one matrix each.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlume.operators.graph import as_number
from graphlume.operators.metrics import unpivoted
from graphlume.operators.ordered import block_pairs, percentiles

#: Columns up to which the 2^(q - 1) sign vectors are tried.
MOST_SIGNS = 10


def feature_ranges(df: DataFrame, columns: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """``feature, lo, hi``: least and greatest value, or percentiles (linear interpolation); (0, 1) without values, ±1 around a constant."""
    long = unpivoted(df, columns)
    found = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")) if low is None else percentiles(long, ["feature"], "value", [low / 100, high / 100]).toDF("feature", "lo", "hi")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string").join(found, "feature", "left")
    constant = F.col("lo") == F.col("hi")
    return every.select("feature", F.when(F.col("lo").isNull(), 0.0).when(constant, F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"), F.when(F.col("hi").isNull(), 1.0).when(constant, F.col("hi") + 1).otherwise(F.col("hi")).alias("hi"))


def cluster_stats(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """``label, feature, mean, std, n`` of present values: sample deviation, 0 for one value."""
    found = unpivoted(labelled, columns, ["label"]).groupBy("label", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))
    return found.withColumn("std", F.when(F.col("n") == 1, 0.0).otherwise(F.col("std")))


def tightest(labelled: DataFrame, columns: list[str], top: int) -> DataFrame:
    """The features of each cluster with the least deviation, more values first on ties, then by name."""
    order = Window.partitionBy("label").orderBy(F.asc_nulls_last("std"), F.desc("n"), "feature")  # one row per column of the table in each cluster
    return cluster_stats(labelled, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _ends(x: np.ndarray, ids: np.ndarray, signs: np.ndarray, m: int) -> np.ndarray:
    """Rows that are among the ``m`` greatest or least under some sign vector, the least ids on ties (at nine decimals)."""
    if len(x) <= 2 * m:
        return np.arange(len(x))
    chosen: set[int] = set()
    for p in np.round(x @ signs.T, 9).T:
        for q in (p, -p):
            edge = -np.partition(-q, m - 1)[m - 1]
            above, level = np.flatnonzero(q > edge), np.flatnonzero(q == edge)
            level = level[np.argsort(ids[level], kind="stable")[: m - len(above)]]
            chosen.update(above.tolist(), level.tolist())
    return np.array(sorted(chosen))


def _pairs_of(ids: np.ndarray, x: np.ndarray, keys: np.ndarray, y: np.ndarray, k: int) -> list[tuple[float, object, object]]:
    """The ``k`` best (score, a, b) with a < b, ties by keys (scores at nine decimals)."""
    d = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d += np.abs(x[:, i, None] - y[None, :, i])
    d[ids[:, None] >= keys[None, :]] = -1.0
    rounded = np.round(d, 9)
    at = max(rounded.size - k, 0)
    a, b = np.nonzero((rounded >= np.partition(rounded, at, axis=None)[at]) & (d >= 0))
    order = np.lexsort((keys[b], ids[a], -rounded[a, b]))[:k]
    return [(float(d[a[i], b[i]]), ids[a[i]], keys[b[i]]) for i in order]


def top_pairs(labelled: DataFrame, key: str, compared: list[str], k: int, block: int = 1000) -> DataFrame:
    """``label, rank, a, b, score``: the k pairs of each cluster with the greatest L1 over ``compared``; ties (at nine decimals) by keys. Rows need all values."""
    rows = labelled.select("label", F.col(key).alias("id"), F.array(*(as_number(c) for c in compared)).alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    kind, name = labelled.schema[key].dataType.simpleString(), labelled.schema["label"].dataType.simpleString()
    found = _by_signs(rows, name, kind, len(compared), k) if 0 < len(compared) <= MOST_SIGNS else _by_blocks(rows, name, kind, k, block)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("score", 9)), "a", "b"))  # k rows for each part of a cluster
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("label", "rank", "a", "b", "score")


def _by_signs(rows: DataFrame, name: str, kind: str, q: int, k: int) -> DataFrame:
    signs = np.array([[1, *s] for s in itertools.product((1, -1), repeat=q - 1)], dtype=float)
    schema = f"label {name}, id {kind}, x array<double>"

    def ends(batches):
        """Ends so far of each cluster, given on when there are too many clusters to hold."""
        held: dict = {}
        for batch in batches:
            for label, part in batch.groupby("label", dropna=False):
                label = None if pd.isna(label) else label
                part = pd.concat([held[label], part]) if label in held else part
                x = np.array(part["x"].to_list(), dtype=float)
                held[label] = part.iloc[_ends(x, part["id"].to_numpy(), signs, k + 1)]
            if sum(map(len, held.values())) > 200_000:
                yield pd.concat(held.values())
                held = {}
        if held:
            yield pd.concat(held.values())

    def pairs(batches):
        for part in batches:
            ids, x = part["id"].to_numpy(), np.array(part["x"].to_list(), dtype=float)
            best = _pairs_of(ids, x, ids, x, k)
            label = part["label"].iloc[0]
            yield pd.DataFrame({"label": [label] * len(best), "a": [r[1] for r in best], "b": [r[2] for r in best], "score": [r[0] for r in best]})

    few = rows.mapInPandas(ends, schema)
    for salts in (64, 1):  # a cluster's ends of all tasks meet in parts first
        few = few.repartition("label", F.pmod(F.xxhash64("id"), F.lit(salts))).mapInPandas(ends, schema)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[_ends(np.array(part["x"].to_list(), dtype=float), part["id"].to_numpy(), signs, k + 1)]
        return next(pairs(iter([part])))

    return few.groupBy("label").applyInPandas(one, f"label {name}, a {kind}, b {kind}, score double")


def _by_blocks(rows: DataFrame, name: str, kind: str, k: int, block: int) -> DataFrame:
    blocks = block_pairs(rows, block, ["label"]).where("_a <= _b")

    def best(batches):
        for batch in batches:
            for label, asked, others in zip(batch["label"], batch["asked"], batch["rows"]):
                (ids, x), (keys, y) = ((np.array([r["id"] for r in part]), np.array([r["x"] for r in part], dtype=float).reshape(len(part), -1)) for part in (asked, others))
                out = _pairs_of(ids, x, keys, y, k)
                if not np.array_equal(ids, keys):
                    out = sorted(out + _pairs_of(keys, y, ids, x, k), key=lambda r: (-round(r[0], 9), r[1], r[2]))[:k]
                yield pd.DataFrame({"label": [label] * len(out), "a": [r[1] for r in out], "b": [r[2] for r in out], "score": [r[0] for r in out]})

    return blocks.select("label", "asked", "rows").mapInPandas(best, f"label {name}, a {kind}, b {kind}, score double")


def side_by_side(pairs: DataFrame, originals: DataFrame, key: str, columns: list[str], most: int, fallback: DataFrame | None = None) -> DataFrame:
    """``label, rank, a, b, feature, va, vb, diff, place, hidden``: the original values of each pair by feature, greatest difference first.

    ``hidden`` is the sum of the differences beyond the first ``most`` features. A key that occurs
    twice among the originals gives its least row; one that is missing, its row in ``fallback``."""
    def values(side: str) -> DataFrame:
        table = originals.groupBy(key).agg(F.min(F.struct(*(as_number(c).alias(c) for c in columns))).alias("x"))
        if fallback is not None:
            spare = fallback.groupBy(key).agg(F.min(F.struct(*(as_number(c).alias(c) for c in columns))).alias("y"))
            table = table.join(spare, key, "full_outer").select(key, F.coalesce("x", "y").alias("x"))
        return table.select(F.col(key).alias(side), F.col("x").alias(f"x{side}"))

    both = pairs.join(values("a"), "a", "left").join(values("b"), "b", "left")
    entries = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"xa.`{c}`").alias("va"), F.col(f"xb.`{c}`").alias("vb"), F.abs(F.col(f"xa.`{c}`") - F.col(f"xb.`{c}`")).alias("diff")) for c in columns))
    long = both.select("label", "rank", "a", "b", F.explode(entries).alias("f")).select("label", "rank", "a", "b", "f.*")
    pair = Window.partitionBy("label", "rank")  # one row per column of the table
    placed = long.withColumn("place", F.row_number().over(pair.orderBy(F.desc_nulls_last("diff"), "feature")))
    hidden = F.coalesce(F.sum(F.when(F.col("place") > most, F.col("diff"))).over(pair), F.lit(0.0))
    return placed.withColumn("hidden", hidden).where(F.col("place") <= most)


def with_info(pairs: DataFrame, nodes: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Pairs with ``info_a`` and ``info_b``: the nodes' properties as text, empty for a missing node."""
    text = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), F.col(f"`{n}`").cast("string")) for n in names))
    info = nodes.select(F.col(key).alias("_k"), text.alias("_t"))
    a, b = info.toDF("a", "info_a"), info.toDF("b", "info_b")
    return pairs.join(a, "a", "left").join(b, "b", "left").na.fill("", ["info_a", "info_b"])


def radar(value: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - lo) / (hi - lo)))


def extract(labelled: DataFrame, originals: DataFrame, key: str, columns: list[str], compared: list[str], k: int = 3, top: int = 3, most: int = 5) -> dict[str, DataFrame]:
    """All insight tables of a clustered indicator table: ranges, tightest features, pairs, and pairs side by side."""
    everything = [*dict.fromkeys([*columns, *compared])]
    with_labels = originals.join(labelled.select(key, "label"), key)
    pairs = top_pairs(labelled, key, compared, k)
    return {"ranges": feature_ranges(originals, everything), "tightest": tightest(with_labels, columns, top), "pairs": pairs, "side_by_side": side_by_side(pairs, originals, key, compared, most, labelled)}
