"""Clusters of records alike in a set of entries and in a number: bisecting k-means with an exact check.

Records become points: equal ones (same set, same number) are one point. Two points are
alike if their sets share at least ``similarity`` of all their entries and their numbers
differ by at most ``tolerance`` of the larger. Clusters are what alike pairs link.

1. Bisecting k-means. The points are one node; a node is split in two by 2-means (started at
   the mean of the coordinate that varies most, two refinements) until it is compact: all its
   points are alike to the one nearest its centre. Coordinates are whole numbers and sums of
   them exact, so that a node is split in the same way wherever it is: nodes of more than
   ``local`` points by aggregates over the cluster, all in one round, smaller ones in one task
   each, the most dispersed first. Every eighth level, and where all coordinates are equal, a
   node is split by a bit of a hash.
2. A compact leaf is linked by its centre. Whether two leaves belong together depends on
   alike pairs between them, which k-means does not see; so leaves are checked exactly.
   Two alike sets share two of the rarest entries of each (the prefix their similarity
   leaves; one entry where a set is so small that its partner may share no more), and their
   numbers lie in the same or in neighbouring logarithmic bands: only leaves that meet under
   such a key are compared, by those members that bear the key. Keys with few bearers
   of other leaves are joined; under keys with many, bearers meet in pairs of blocks, of which each gives no
   more links than it has leaves.
3. Leaves so linked are joined by repeated contraction of the (small) graph of leaves.

No group is ever listed pair by pair: points of one leaf are never compared with each
other. Defined results: a record with a null, NaN or infinite number or without entries is
in no cluster; repeated entries of a record count once; a record id counts once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlume.operators.ordered import salted_join
from graphlume.session import cut, drop

LOCAL, DIMENSIONS = 8000, 128
#: A coordinate of 1 as a whole number, and refinements of a split.
SCALE, REFINEMENTS = 1024, 2
#: How much the number's logarithm weighs beside the (unit) vector of entries.
NUMBER_WEIGHT = 0.5
#: Sets up to this size use keys of two entries; others, keys of one.
PAIR_KEYS = 66
#: Bearers of a key from which they meet in blocks, the size of a block, and nodes whose sums the driver holds at once (2 kB each).
HEAVY, BLOCK, NODES_AT_ONCE = 200, 1000, 4096


def _joined(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """All sides of joins here grow with the records, and arrays of hashed entries take many times their file's size in memory: none is broadcast."""
    return salted_join(big, small, on, by, how, merge=True)


def alike(shared: Column, size_a: Column, size_b: Column, a: Column, b: Column, similarity: float, tolerance: float) -> Column:
    near = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
    return (shared >= similarity * (size_a + size_b - shared) - 1e-9) & near


def _vectors(entries: list, numbers: np.ndarray) -> np.ndarray:
    """Hashed entries (of length 1) and the number's logarithm as whole numbers in doubles: sums and products of them are exact."""
    sizes = np.array([len(e) for e in entries], dtype=np.int64)
    out = np.zeros((len(entries), DIMENSIONS + 1))
    flat = np.concatenate(entries) if len(entries) else np.empty(0, dtype=np.int64)
    np.add.at(out, (np.repeat(np.arange(len(entries)), sizes), (flat % DIMENSIONS).astype(np.int64)), np.repeat(np.rint(SCALE / np.sqrt(np.maximum(sizes, 1))), sizes))
    out[:, -1] = np.rint(SCALE * NUMBER_WEIGHT * np.sign(numbers) * np.log1p(np.abs(numbers) * 1000))
    return out


@dataclass(frozen=True)
class _Rule:
    """How a node is split: by a bit of the hash, at the mean of a coordinate, or by the nearer of two centres."""

    bit: int = -1
    axis: int = -1
    n: float = 0.0
    total: float = 0.0
    gap: np.ndarray | None = None
    bound: float = 0.0

    @staticmethod
    def first(depth: int, n: float, total: np.ndarray, squares: np.ndarray) -> _Rule:
        spread = squares / n - (total / n) ** 2
        axis = int(spread.argmax())
        if depth % 8 == 7 or spread[axis] <= 0:
            return _Rule(bit=depth % 63)
        return _Rule(axis=axis, n=n, total=float(total[axis]))

    def refined(self, n: tuple[float, float], total: tuple[np.ndarray, np.ndarray]) -> _Rule:
        """From the counts and sums of the two sides."""
        if self.bit >= 0 or not n[0] or not n[1]:
            return self
        left, right = total[0] / n[0], total[1] / n[1]
        gap = np.rint(64 * (right - left))
        if not gap.any():
            return self
        return _Rule(gap=gap, bound=float(np.floor(32 * ((right**2).sum() - (left**2).sum()))))

    def right(self, v: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if self.bit >= 0:
            return (hashes >> self.bit) & 1 == 1
        if self.gap is None:
            return v[:, self.axis] * self.n > self.total
        return v @ self.gap > self.bound


def _shared(entries: list, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries in common with the centre, sizes) of each set."""
    sizes = np.array([len(e) for e in entries], dtype=np.int64)
    flat = np.concatenate(entries)
    return np.add.reduceat(np.isin(flat, centre), np.concatenate(([0], np.cumsum(sizes)[:-1]))).astype(float), sizes


def _to_one(entries: list, numbers: np.ndarray, centre: np.ndarray, number: float, similarity: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(alike to the centre, distance to it) of each point."""
    shared, sizes = _shared(entries, centre)
    union = sizes + len(centre) - shared
    near = np.abs(numbers - number) <= tolerance * np.maximum(np.abs(numbers), abs(number))
    return (shared >= similarity * union - 1e-9) & near, 1 - shared / union


def _middle(v: np.ndarray, pids: np.ndarray, n: float, total: np.ndarray) -> tuple[float, int]:
    """(squared distance, row) of the point nearest the centre, the least id on ties."""
    away = ((v - np.rint(total / n)) ** 2).sum(axis=1)
    best = np.flatnonzero(away == away.min())
    row = int(best[pids[best].argmin()])
    return float(away[row]), row


class _Node:
    """Points of one task."""

    def __init__(self, points: pd.DataFrame, similarity: float, tolerance: float):
        self.entries, self.numbers, self.pids, self.hashes = points["entries"].to_list(), points["number"].to_numpy(), points["pid"].to_numpy(), points["hash"].to_numpy()
        self.similarity, self.tolerance = similarity, tolerance
        self.vectors = _vectors(self.entries, self.numbers)

    def sums(self, rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        v = self.vectors[rows]
        return float(len(rows)), v.sum(axis=0), (v * v).sum(axis=0)

    def centre(self, rows: np.ndarray, n: float, total: np.ndarray) -> int:
        return int(rows[_middle(self.vectors[rows], self.pids[rows], n, total)[1]])

    def compact(self, rows: np.ndarray, n: float, total: np.ndarray) -> tuple[int, np.ndarray] | None:
        """The centre-nearest point and the distances to it, if all points are alike to it."""
        if len(rows) == 1:
            return int(rows[0]), np.zeros(1)
        numbers = self.numbers[rows]
        low, high = numbers.min(), numbers.max()
        if high - low > 2 * self.tolerance * max(abs(low), abs(high)):
            return None
        centre = self.centre(rows, n, total)
        if (np.abs(numbers - self.numbers[centre]) > self.tolerance * np.maximum(np.abs(numbers), abs(self.numbers[centre]))).any():
            return None
        ok, apart = _to_one([self.entries[i] for i in rows], numbers, self.entries[centre], self.numbers[centre], self.similarity, self.tolerance)
        return (centre, apart) if ok.all() else None

    def sides(self, rows: np.ndarray, depth: int, sums: tuple[float, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v, h = self.vectors[rows], self.hashes[rows]
        rule = _Rule.first(depth, *sums)
        right = rule.right(v, h)
        for _ in range(REFINEMENTS):
            total = v[right].sum(axis=0)
            n = float(right.sum())
            rule = rule.refined((sums[0] - n, n), (sums[1] - total, total))
            right = rule.right(v, h)
        return rows[~right], rows[right]

    def leaves(self, depth: int) -> pd.DataFrame:
        """``pid, leaf, apart`` of each compact leaf, the most dispersed node split first."""
        heap, count, found = [], 0, []

        def wait(rows: np.ndarray, depth: int) -> None:
            n, total, squares = self.sums(rows)
            heapq.heappush(heap, (-float(squares.sum() - (total * total).sum() / n), count, depth, rows, (n, total, squares)))

        wait(np.arange(len(self.pids)), depth)
        while heap:
            _, _, depth, rows, sums = heapq.heappop(heap)
            if leaf := self.compact(rows, *sums[:2]):
                found.append((rows, leaf[0], leaf[1]))
                continue
            for part in self.sides(rows, depth, sums):
                if len(part):
                    count += 1
                    wait(part, depth + 1)
        rows, centres = np.concatenate([f[0] for f in found]), np.repeat([f[1] for f in found], [len(f[0]) for f in found])
        return pd.DataFrame({"pid": self.pids[rows], "leaf": self.pids[centres], "apart": np.concatenate([f[2] for f in found])})


def _finish(similarity: float, tolerance: float):
    """Leaves of one node, for points grouped by node."""

    def finish(points: pd.DataFrame) -> pd.DataFrame:
        depth = len(points["node"].iloc[0]) - 1
        return _Node(points, similarity, tolerance).leaves(depth)

    return finish


_POINT = "pid long, number double, entries array<long>, hash long, node string"


def _per_node(placed: DataFrame, nodes: dict, each, schema: str) -> DataFrame:
    """``each(node, its points of a batch, nodes[node])`` gives a table; points of other nodes are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, part in batch.groupby("node", sort=False):
                if node in nodes:
                    yield each(node, part, nodes[node])

    return placed.mapInPandas(run, schema)


def _sums(placed: DataFrame, rules: dict[str, _Rule | None]) -> dict[tuple[str, bool], tuple[float, np.ndarray, np.ndarray, float, float]]:
    """Count, sums, sums of squares and least and greatest number of each node and side (all left without a rule)."""

    columns = ["node", "right", "n", "low", "high", "total", "squares"]
    schema = "node string, right boolean, n long, low double, high double, total array<long>, squares array<long>"

    def frame(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*key, *state) for key, state in held.items()], columns=columns)

    def add(held: dict, key: tuple[str, bool], n: int, low: float, high: float, total: np.ndarray, squares: np.ndarray) -> None:
        if key in held:
            old = held[key]
            n, low, high, total, squares = n + old[0], min(low, old[1]), max(high, old[2]), total + old[3], squares + old[4]
        held[key] = (n, low, high, total, squares)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}  # NODES_AT_ONCE nodes at most
        for batch in batches:
            for node, part in batch.groupby("node", sort=False):
                if node not in rules:
                    continue
                v, numbers = _vectors(part["entries"].to_list(), part["number"].to_numpy()), part["number"].to_numpy()
                right = rules[node].right(v, part["hash"].to_numpy()) if rules[node] else np.zeros(len(part), dtype=bool)
                for side in (False, True):
                    x, y = v[right == side], numbers[right == side]
                    if len(x):
                        add(held, (node, side), len(x), y.min(), y.max(), x.sum(axis=0).astype(np.int64), (x**2).sum(axis=0).astype(np.int64))
        yield frame(held)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                add(held, (row.node, row.right), row.n, row.low, row.high, row.total, row.squares)
        yield frame(held)

    total = placed.mapInPandas(partial, schema).repartition("node").mapInPandas(merged, schema)
    return {(r["node"], r["right"]): (float(r["n"]), np.array(r["total"], dtype=float), np.array(r["squares"], dtype=float), r["low"], r["high"]) for r in total.collect()}  # NODES_AT_ONCE nodes at most


def _compact(placed: DataFrame, sums: dict, similarity: float, tolerance: float) -> dict[str, tuple[int, np.ndarray, float]]:
    """The compact ones of some nodes, with their centre-nearest point."""
    # all numbers can be near one of theirs only if they lie together; few large nodes do
    maybe = {node: (n, total) for (node, _), (n, total, _, low, high) in sums.items() if high - low <= 2 * tolerance * max(abs(low), abs(high))}
    if not maybe:
        return {}

    def nearest(node: str, part: pd.DataFrame, state: tuple) -> pd.DataFrame:
        away, row = _middle(_vectors(part["entries"].to_list(), part["number"].to_numpy()), part["pid"].to_numpy(), *state)
        return pd.DataFrame({"node": [node], "away": [away], "pid": [part["pid"].iloc[row]], "entries": [part["entries"].iloc[row]], "number": [part["number"].iloc[row]]})

    found = _per_node(placed, maybe, nearest, "node string, away double, pid long, entries array<long>, number double").groupBy("node").agg(F.min(F.struct("away", "pid", "entries", "number")).alias("x")).collect()
    centres = {r["node"]: (r["x"]["pid"], np.array(r["x"]["entries"]), r["x"]["number"]) for r in found}

    def alike_all(node: str, part: pd.DataFrame, centre: tuple) -> pd.DataFrame:
        return pd.DataFrame({"node": [node], "ok": [bool(_to_one(part["entries"].to_list(), part["number"].to_numpy(), centre[1], centre[2], similarity, tolerance)[0].all())]})

    kept = _per_node(placed, centres, alike_all, "node string, ok boolean").groupBy("node").agg(F.min("ok").alias("ok")).where("ok").collect()
    return {r["node"]: centres[r["node"]] for r in kept}


def _leaved(points: DataFrame, local: int, similarity: float, tolerance: float) -> DataFrame:
    """``pid, leaf, apart``: every point's compact leaf."""
    placed = cut(points.select("pid", "number", "entries", F.xxhash64("pid").alias("hash"), F.lit("r").alias("node")))
    done = []
    while True:
        large = sorted(r["node"] for r in placed.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > local).select("node").toLocalIterator())
        if not large:
            break
        for at in range(0, len(large), NODES_AT_ONCE):
            names = dict.fromkeys(large[at : at + NODES_AT_ONCE])
            sums = _sums(placed, names)
            compact = _compact(placed, sums, similarity, tolerance)
            if compact:
                member = lambda node, part, c: pd.DataFrame({"pid": part["pid"], "leaf": c[0], "apart": _to_one(part["entries"].to_list(), part["number"].to_numpy(), c[1], c[2], similarity, tolerance)[1]})
                done.append(cut(_per_node(placed, compact, member, "pid long, leaf long, apart double")))
            rules = {node: _Rule.first(len(node) - 1, *sums[node, False][:3]) for node in names if node not in compact}
            for _ in range(REFINEMENTS if rules else 0):
                sides = _sums(placed, rules)
                none = (0.0, np.zeros(DIMENSIONS + 1))
                rules = {node: rule.refined(*zip(sides.get((node, False), none)[:2], sides.get((node, True), none)[:2])) for node, rule in rules.items()}

            def moved(batches: Iterator[pd.DataFrame], rules: dict = rules, compact: dict = compact) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    batch = batch[~batch["node"].isin(compact)]
                    names = batch["node"].to_numpy().copy()
                    for node, rows in batch.groupby("node", sort=False).indices.items():
                        if node in rules:
                            part = batch.iloc[rows]
                            right = rules[node].right(_vectors(part["entries"].to_list(), part["number"].to_numpy()), part["hash"].to_numpy())
                            names[rows] = np.where(right, f"{node}1", f"{node}0")
                    yield batch.assign(node=names)

            before, placed = placed, cut(placed.mapInPandas(moved, _POINT))
            drop(before)
    done.append(placed.groupBy("node").applyInPandas(_finish(similarity, tolerance), "pid long, leaf long, apart double"))
    return reduce(DataFrame.unionByName, done)


def _keys(entries: Column, number: Column, similarity: float, tolerance: float) -> Column:
    """Keys of which two alike points share at least one. ``entries`` begin with the rarest."""
    size = F.size(entries)
    least = F.ceil(similarity * size - 1e-9).cast("int")  # entries that any partner shares
    singles = F.slice(entries, 1, size - least + 1)
    head = F.slice(entries, 1, F.least(size, size - least + 2))
    pairs = F.flatten(F.transform(head, lambda x, i: F.transform(F.slice(head, i + 2, F.greatest(F.size(head) - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y))))
    one = F.transform(singles, lambda x: F.xxhash64(x, F.lit("one")))
    none = F.array().cast("array<bigint>")
    # a partner may be so small that it shares one entry only, or so large that it has keys of one entry only
    alone = (least < 2) | (size <= 1 / similarity**2) | (size > similarity * PAIR_KEYS - 1)
    chosen = F.concat(F.when((least >= 2) & (size <= PAIR_KEYS), pairs).otherwise(none), F.when(alone, one).otherwise(none))
    if tolerance >= 1:  # numbers of one sign are always near
        return chosen if tolerance >= 2 else F.flatten(F.transform(chosen, lambda k: F.array(F.xxhash64(k, F.lit(0)))))
    if tolerance == 0:
        return F.transform(chosen, lambda k: F.xxhash64(k, number))
    width = -math.log1p(-tolerance) * (1 + 1e-9)
    band = F.when(number == 0, F.lit(0)).otherwise(F.floor(F.ln(F.abs(number)) / width))
    sign = F.signum(number)
    return F.flatten(F.transform(chosen, lambda k: F.array(F.xxhash64(k, sign, band), F.xxhash64(k, sign, band + 1))))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of some links, those that join something not yet joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _heavy_links(bearers: DataFrame, similarity: float, tolerance: float) -> DataFrame:
    """``a, b``: links between leaves under keys with many bearers, which meet in pairs of blocks."""
    sizes = bearers.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_n"))
    placed = _joined(bearers, sizes, ["key"], "pid").withColumn("_b", F.pmod(F.xxhash64("pid"), F.col("_n")))
    packed = cut(placed.groupBy("key", "_b", "_n").agg(F.collect_list(F.struct("leaf", "entries", "number")).alias("rows")))
    asked = packed.withColumnsRenamed({"rows": "asked", "_b": "_a"}).withColumn("_b", F.explode(F.sequence(F.col("_a"), F.col("_n") - 1))).drop("_n")
    met = asked.join(packed.drop("_n").hint("merge"), ["key", "_b"]).select("asked", "rows")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["asked"], batch["rows"]):
                sides = [([r["entries"] for r in part], np.array([r["leaf"] for r in part]), np.array([r["number"] for r in part])) for part in (left, right)]
                words, place = np.unique(np.concatenate([e for entries, _, _ in sides for e in entries]), return_inverse=True)
                seen, at = [], 0
                for entries, _, _ in sides:
                    sizes = np.array([len(e) for e in entries])
                    m = np.zeros((len(entries), len(words)), dtype=np.float32)
                    m[np.repeat(np.arange(len(entries)), sizes), place[at : at + sizes.sum()]] = 1
                    at += sizes.sum()
                    seen.append((m, sizes))
                shared = (seen[0][0] @ seen[1][0].T).astype(float)
                x, y = sides[0][2][:, None], sides[1][2][None]
                ok = (shared >= similarity * (seen[0][1][:, None] + seen[1][1][None] - shared) - 1e-9) & (np.abs(x - y) <= tolerance * np.maximum(np.abs(x), np.abs(y)))
                i, j = np.nonzero(ok & (sides[0][1][:, None] != sides[1][1][None]))
                yield pd.DataFrame(_forest(sides[0][1][i], sides[1][1][j]), columns=["a", "b"])

    return met.mapInPandas(check, "a long, b long")


def _linked_leaves(points: DataFrame, similarity: float, tolerance: float) -> DataFrame:
    """``a, b``: leaves between which there is an alike pair, as many as join what belongs together."""
    keyed = cut(points.select("pid", "leaf", F.explode(F.array_distinct(_keys(F.col("entries"), F.col("number"), similarity, tolerance))).alias("key")))
    # keys that bearers of several leaves share, from one row per key and task
    several = cut(keyed.groupBy("key").agg(F.min("leaf").alias("lo"), F.max("leaf").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("key", "n"))
    bearers = _joined(keyed, several, ["key"], "pid").select("key", "n", "leaf", "pid")
    bearers = cut(bearers.join(points.select("pid", "entries", "number").hint("merge"), "pid"))
    drop(keyed)
    few, many = bearers.where(F.col("n") <= HEAVY).drop("n", "pid"), bearers.where(F.col("n") > HEAVY).drop("n")
    left, right = few.toDF("key", "a", "ea", "na"), few.toDF("key", "b", "eb", "nb")
    shared = F.size(F.array_intersect("ea", "eb"))
    # HEAVY bearers of a key at most meet here; points of one leaf do not
    links = left.join(right.hint("merge"), "key").where(F.col("a") < F.col("b")).where(alike(shared, F.size("ea"), F.size("eb"), F.col("na"), F.col("nb"), similarity, tolerance)).select("a", "b").distinct()
    return links.unionByName(_heavy_links(many, similarity, tolerance).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``leaf, root`` (the least member) of every vertex of an edge list ``a, b``."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    while not edges.isEmpty():
        # large star: neighbours above a vertex go to its least neighbour; small star: the rest do. A hub's rows are spread.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(_joined(both, least, ["a"], "b").where("b > a").select(F.col("m").alias("a"), "b").distinct())
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = _joined(large, down, ["b"], "a").select(F.col("m").alias("x"), "a", "b")
        new = cut(small.select("x", "b").union(small.select("x", "a")).toDF("a", "b").where("a != b").distinct())
        stable = new.count() == edges.count() and new.join(edges.hint("merge"), ["a", "b"], "left_anti").isEmpty()
        drop(large)
        drop(edges)
        edges = new
        if stable:
            break
    return edges.groupBy(F.col("b").alias("leaf")).agg(F.min("a").alias("root")).union(edges.select("a", "a").distinct())


def _from_centre(points: DataFrame, members: DataFrame) -> DataFrame:
    """``pid, away``: the distance of each point to the centre of all records of its cluster (``root``), by sparse aggregates.

    A record is its entries as a vector of length 1 beside the logarithm of its number. Rounded, so that ties are ties in any order of adding up.
    """
    of = cut(points.join(members.groupBy("pid", "root").agg(F.count("*").alias("m")).hint("merge"), "pid"))
    y = NUMBER_WEIGHT * F.signum("number") * F.log1p(F.abs("number") * 1000)
    totals = of.groupBy("root").agg(F.sum("m").alias("n"), (F.sum(F.col("m") * y) / F.sum("m")).alias("mean"))
    flat = of.select("pid", "root", "m", F.sqrt(F.size("entries")).alias("length"), F.explode("entries").alias("entry"))
    weights = cut(flat.groupBy("root", "entry").agg(F.sum(F.col("m") / F.col("length")).alias("w")))
    centres = totals.join(weights.groupBy("root").agg(F.sum(F.col("w") * F.col("w")).alias("ww")).hint("merge"), "root")
    dots = _joined(flat, weights, ["root", "entry"], "pid").groupBy("pid").agg(F.sum(F.col("w") / F.col("length")).alias("dot"))
    both = _joined(of.select("pid", "root", y.alias("y")).join(dots.hint("merge"), "pid"), centres, ["root"], "pid")
    n, off = F.col("n"), F.col("y") - F.col("mean")
    return both.select("pid", F.round(F.sqrt(F.greatest(F.lit(0.0), 1 - 2 * F.col("dot") / n + F.col("ww") / (n * n) + off * off)), 6).alias("away"))


def similarity_clusters(records: DataFrame, similarity: float = 0.6, tolerance: float = 0.1, local: int = LOCAL, away: bool = True) -> DataFrame:
    """``record_id, first_id, leaf, away``: the cluster of each record (its least record id), its leaf and, if asked for, its distance to the cluster's centre.

    ``records`` has ``record_id LONG``, ``entries ARRAY<STRING>`` and ``number DOUBLE``.
    """
    if not 0 < similarity <= 1 or tolerance < 0:
        raise ValueError("similarity must lie within 0 and 1, 0 excluded, and tolerance not below 0")
    valid = F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") < float("inf"))
    rows = records.select("record_id", F.array_distinct(F.array_compact("entries")).alias("entries"), F.col("number").cast("double").alias("number")).where(valid & (F.size("entries") > 0)).dropDuplicates(["record_id"])
    rows = rows.withColumn("entries", F.array_sort(F.transform("entries", lambda e: F.xxhash64(e))))
    rows = cut(rows)
    # equal records are one point, named by the least of them
    points = rows.groupBy("entries", "number").agg(F.min("record_id").alias("pid"))
    counts = points.select(F.explode("entries").alias("entry")).groupBy("entry").agg(F.count("*").alias("n"))
    flat = points.select("pid", "number", F.explode("entries").alias("entry"))
    ordered = _joined(flat, counts, ["entry"], "pid").groupBy("pid", "number").agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("x"))
    points = cut(ordered.select("pid", "number", F.col("x.entry").alias("entries")))
    leaved = cut(points.join(_leaved(points, local, similarity, tolerance).hint("merge"), "pid"))
    roots = cut(components(_linked_leaves(leaved, similarity, tolerance)))
    named = _joined(leaved.select("pid", "leaf"), roots, ["leaf"], "pid", "left").withColumn("root", F.coalesce("root", "leaf"))
    # from points back to records: a point's records bear its entries and number
    pid = _joined(rows, points.select("pid", F.array_sort("entries").alias("entries"), "number"), ["entries", "number"], "record_id").select("record_id", "pid")
    members = cut(_joined(pid, named, ["pid"], "record_id").select("record_id", "pid", "root", "leaf"))
    first = members.groupBy("root").agg(F.min("record_id").alias("first_id"))
    named = _joined(members, first, ["root"], "record_id")
    return _joined(named, _from_centre(points, members), ["pid"], "record_id").select("record_id", "first_id", "leaf", "away") if away else named.select("record_id", "first_id", "leaf")


def described(clustered: DataFrame, typical: int = 3) -> DataFrame:
    """``first_id, size, leaves, typical``: each cluster with the records nearest its centre, ties by least id."""
    # the nearest few of each of 64 parts of a cluster first, so that no task sees a whole large cluster
    salted = clustered.withColumn("part", F.pmod(F.xxhash64("record_id"), F.lit(64)))
    nearest = ("away", "record_id")
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("first_id", "part").orderBy(*nearest))).where(F.col("r") <= typical)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("first_id").orderBy(*nearest))).where(F.col("r") <= typical)
    chosen = few.groupBy("first_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "record_id"))), lambda x: x["record_id"]).alias("typical"))
    sizes = salted.groupBy("first_id", "leaf").agg(F.count("*").alias("n")).groupBy("first_id").agg(F.sum("n").alias("size"), F.count("*").alias("leaves"))
    return sizes.join(chosen.hint("merge"), "first_id")
