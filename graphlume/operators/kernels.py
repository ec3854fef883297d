"""Clustering kernels and the objective over a narrow numeric matrix.

A matrix is a table with a key and DOUBLE columns. Steps are aggregates over (row, cluster);
centres are k rows, which is what an iteration brings to the driver. The objective uses
closed forms: a cluster's sum of pair distances from sorted values and power sums, without
listing pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlume.operators.graph import as_number
from graphlume.operators.metrics import unpivoted
from graphlume.operators.ordered import running_sum, salted_join
from graphlume.session import cut

Centres = list[list[float]]
#: Fuzzifier, tolerance, iterations.
M, TOLERANCE, MOST_ITERATIONS = 2.5, 1e-3, 100


def _value(v: float) -> Column:
    return F.lit(float(v))


def squared(columns: list[str], centre: list[float]) -> Column:
    return sum(((as_number(c) - _value(v)) ** 2 for c, v in zip(columns, centre)), F.lit(0.0))


def absolute(columns: list[str], centre: list[float]) -> Column:
    return sum((F.abs(as_number(c) - _value(v)) for c, v in zip(columns, centre)), F.lit(0.0))


def start_rows(df: DataFrame, key: str, columns: list[str], k: int, seed: int | None = None) -> Centres:
    """``k`` distinct rows: the least keys, or by seeded hash."""
    order = F.col(key) if seed is None else F.xxhash64(key, F.lit(seed))
    return [[float(r[i + 1]) for i in range(len(columns))] for r in df.select(key, *(as_number(c).alias(f"c{i}") for i, c in enumerate(columns))).orderBy(order, key).limit(k).collect()]


def assign(df: DataFrame, columns: list[str], centres: Centres) -> DataFrame:
    """``df`` with ``label``: the nearest centre, the lowest index on ties."""
    distances = [squared(columns, c) for c in centres]
    least = F.least(*distances) if len(distances) > 1 else distances[0]
    label = F.lit(len(centres) - 1)
    for i in range(len(centres) - 2, -1, -1):
        label = F.when(distances[i] == least, i).otherwise(label)
    return df.withColumn("label", label)


def means(assigned: DataFrame, columns: list[str]) -> DataFrame:
    return assigned.groupBy("label").agg(*(F.avg(as_number(c)).alias(c) for c in columns), F.count("*").alias("n"))


def kmeans(df: DataFrame, key: str, columns: list[str], k: int, tolerance: float = TOLERANCE, iterations: int = MOST_ITERATIONS, centres: Centres | None = None, seed: int | None = 0) -> DataFrame:
    """``key, label``. An empty cluster takes a seeded random row; stops when the centres together move less than the tolerance."""
    if k < 1:
        raise ValueError("k must be positive")
    centres = centres or start_rows(df, key, columns, k, seed)
    if len(centres) < k:
        raise ValueError("fewer rows than clusters")
    df = cut(df)
    labels = assign(df, columns, centres)
    for step in range(iterations):
        found = {r["label"]: [r[c] for c in columns] for r in means(labels, columns).collect()}
        spare = start_rows(df, key, columns, k, (seed or 0) + step + 1) if len(found) < k else []
        new = [found.get(i) or spare[i] for i in range(k)]
        moved = math.sqrt(sum((a - b) ** 2 for x, y in zip(new, centres) for a, b in zip(x, y)))
        if moved <= tolerance:
            break
        centres = new
        labels = assign(df, columns, centres)
    return labels.select(key, "label")


def fuzzy_means(df: DataFrame, columns: list[str], u: list[str], m: float = M) -> Centres:
    """Centres weighted by U^m."""
    sums = [F.sum(F.pow(F.col(w), F.lit(m)) * as_number(c)) / F.sum(F.pow(F.col(w), F.lit(m))) for w in u for c in columns]
    row = df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    return [[row[f"s{j * len(columns) + i}"] for i in range(len(columns))] for j in range(len(u))]


def fcm_step(df: DataFrame, columns: list[str], compared: list[str], centres: Centres, compared_centres: Centres, m: float = M) -> DataFrame:
    """``df`` with ``u0…`` and ``v0…``: memberships by squared distance on ``columns`` and by distance on ``compared``.

    The comparison side rewards distance: its D is the negative L1, whose sign cancels in the ratios. Both D are at least 1e-12.
    Distances and memberships are projections one after the other, so that no expression is written out twice."""
    k, e = len(centres), 1.0 / (m - 1)
    d = [F.pow(F.greatest(squared(columns, c), F.lit(1e-12)), F.lit(e)).alias(f"_d{j}") for j, c in enumerate(centres)]
    g = [F.pow(F.greatest(absolute(compared, c), F.lit(1e-12)), F.lit(e)).alias(f"_g{j}") for j, c in enumerate(compared_centres)]
    powers = df.select("*", *d, *g)
    return powers.select(*(f"`{c}`" for c in df.columns), *_shares("_d", "u", k), *_shares("_g", "v", k))


def _shares(power: str, out: str, k: int) -> list[Column]:
    """U_j = 1 / Σ_l (D_j / D_l)^e from columns that hold D^e."""
    return [(1 / sum((F.col(f"{power}{j}") / F.col(f"{power}{i}") for i in range(k)), F.lit(0.0))).alias(f"{out}{j}") for j in range(k)]


def _first_largest(columns: list[Column]) -> Column:
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    label = F.lit(len(columns) - 1)
    for i in range(len(columns) - 2, -1, -1):
        label = F.when(columns[i] == top, i).otherwise(label)
    return label


def dual_fcm(df: DataFrame, key: str, columns: list[str], compared: list[str], k: int, m: float = M, tolerance: float = TOLERANCE, iterations: int = MOST_ITERATIONS, seed: int = 0) -> DataFrame:
    """``key, label``: dual fuzzy c-means from seeded random memberships; label by the mean of both memberships."""
    u, v = [f"u{j}" for j in range(k)], [f"v{j}" for j in range(k)]
    base = [key, *dict.fromkeys([*columns, *compared])]
    # memberships from a hash of the key: the same after the loss of an executor
    raw = lambda j, side: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(side * k + j)), F.lit(1_000_003)) + 1) / 1_000_004.0
    state = cut(df.select(*(f"`{c}`" for c in base)))
    total = [sum((raw(j, s) for j in range(k)), F.lit(0.0)) for s in (0, 1)]
    current = state.select("*", *((raw(j, 0) / total[0]).alias(u[j]) for j in range(k)), *((raw(j, 1) / total[1]).alias(v[j]) for j in range(k)))
    old: tuple[Centres, Centres] | None = None
    for _ in range(iterations):
        new = fuzzy_means(current, columns, u, m), fuzzy_means(current, compared, v, m)
        if old is not None:
            before = fcm_step(state, columns, compared, *old, m).toDF(*state.columns, *(f"o{c}" for c in u + v))
            both = fcm_step(before, columns, compared, *new, m)
            change = both.agg(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"o{c}")) for c in u + v))).alias("x")).first()["x"]
            if change is None or change <= tolerance:
                break
        old = new
        current = fcm_step(state, columns, compared, *new, m)
    return current.select(key, _first_largest([(F.col(a) + F.col(b)) / 2 for a, b in zip(u, v)]).alias("label"))


def medoid_distance(columns: list[str], compared: list[str], x: list[float], y: list[float]) -> Column:
    """Mean squared L2 on clustering columns minus mean L1 on comparison columns."""
    return squared(columns, x) / max(1, len(columns)) - absolute(compared, y) / max(1, len(compared))


def medoid_step(df: DataFrame, key: str, columns: list[str], compared: list[str], medoids: list[tuple], m: float = M, alpha: float = 1.0) -> DataFrame:
    """``df`` with ``u0…``: normalised memberships by the logistic of the distance; a medoid belongs to its own cluster only.

    ``medoids``: (key, clustering values, comparison values)."""
    k, e = len(medoids), 1.0 / (m - 1)
    s = [F.pow(1 / (1 + F.exp(-alpha * medoid_distance(columns, compared, x, y))), F.lit(e)).alias(f"_s{j}") for j, (_, x, y) in enumerate(medoids)]
    own = F.lit(-1)
    for j, (g, _, _) in enumerate(medoids):
        own = F.when(F.col(key) == g, j).otherwise(own)
    # one projection after the other, so that no expression is written out twice
    raw = df.select("*", *s, own.alias("_own")).select(*(f"`{c}`" for c in df.columns), "_own", *_shares("_s", "_u", k))
    total = raw.select("*", sum((F.col(f"_u{j}") for j in range(k)), F.lit(0.0)).alias("_total"))
    return total.select(*(f"`{c}`" for c in df.columns), *(F.when(F.col("_own") == j, 1.0).when(F.col("_own") >= 0, 0.0).otherwise(F.col(f"_u{j}") / F.col("_total")).alias(f"u{j}") for j in range(k)))


def fuzzy_medoids(df: DataFrame, key: str, columns: list[str], compared: list[str], k: int, m: float = M, tolerance: float = TOLERANCE, iterations: int = MOST_ITERATIONS, alpha: float = 1.0, seed: int = 0, candidates: str = "ascending") -> DataFrame:
    """``key, label``: fuzzy c-medoids. New medoids come from the 10 + k rows with the least membership (``candidates='ascending'``,
    the published behaviour) or the greatest; a row serves once. Fewer rows than that: all are candidates."""
    names = [*dict.fromkeys([*columns, *compared])]
    state = cut(df.select(F.col(key), *(as_number(c).alias(c) for c in names)))
    e, p, q = 1.0 / (m - 1), max(1, len(columns)), max(1, len(compared))

    def rows(frame: DataFrame) -> list[tuple]:
        return [(r[key], [r[c] for c in columns], [r[c] for c in compared]) for r in frame.collect()]

    medoids = rows(state.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k))
    if len(medoids) < k:
        raise ValueError("fewer rows than clusters")
    previous, history = None, [medoids]
    current = medoid_step(state, key, columns, compared, medoids, m, alpha)
    for step in range(iterations):
        if previous is not None:
            # both memberships follow from k medoids each, so the change needs one pass and no join
            old = medoid_step(state, key, columns, compared, previous, m, alpha).toDF(*state.columns, *(f"o{j}" for j in range(k)))
            both = medoid_step(old, key, columns, compared, medoids, m, alpha)
            change = both.agg(F.max(F.greatest(F.lit(0.0), *(F.abs(F.col(f"u{j}") - F.col(f"o{j}")) for j in range(k)))).alias("x")).first()["x"]
            if change is None or change <= tolerance:
                break
        used: set = set()
        new = []
        for j in range(k):
            order = F.col(f"u{j}") if candidates == "ascending" else F.desc(f"u{j}")
            tried = rows(current.orderBy(order, key).limit(10 + k))
            costs = [F.sum(F.pow(F.col(f"u{j}"), F.lit(e)) / (1 + F.exp(absolute(compared, y) / q - squared(columns, x) / p))).alias(f"c{i}") for i, (_, x, y) in enumerate(tried)]
            cost = current.agg(*costs).first()
            free = [i for i in range(len(tried)) if tried[i][0] not in used]
            best = min(free, key=lambda i: (cost[f"c{i}"], i))
            used.add(tried[best][0])
            new.append(tried[best])
        previous, medoids = medoids, new
        before = next((i for i, h in enumerate(history) if [x[0] for x in h] == [x[0] for x in new]), None)
        if before is not None and step + 1 - before > 1:
            # a step depends on the medoids alone, so from here they go round: take those of the last iteration
            medoids = history[before + (iterations - before) % (step + 1 - before)]
            current = medoid_step(state, key, columns, compared, medoids, m, alpha)
            break
        history.append(new)
        current = medoid_step(state, key, columns, compared, medoids, m, alpha)
    return current.select(key, _first_largest([F.col(f"u{j}") for j in range(k)]).alias("label"))


def cluster(df: DataFrame, key: str, columns: list[str], compared: list[str], k: int, method: str = "fcm2", seed: int = 0) -> DataFrame:
    """Dispatch by name: ``kmeans``, ``fcm`` or ``fcm2``."""
    if k < 1:
        raise ValueError("k must be positive")
    methods: dict[str, Callable[[], DataFrame]] = {
        "kmeans": lambda: kmeans(df, key, columns, k, seed=seed), "fcm": lambda: dual_fcm(df, key, columns, compared, k, seed=seed),
        "fcm2": lambda: fuzzy_medoids(df, key, columns, compared, k, seed=seed),
    }
    if method not in methods:
        raise ValueError(f"no clustering method {method}")
    return methods[method]()


def pair_sums(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """``label, feature, n, l1, l2``: sums over all pairs of a cluster of |x - y| and (x - y)²."""
    return pair_sums_of(unpivoted(labelled, columns, ["label"]), ["label", "feature"])


def pair_sums_of(long: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, n, l1, l2`` over the pairs of ``value`` with equal keys.

    L1 = Σ (2r - n - 1) x over ascending ranks r; L2 = n Σx² - (Σx)² of values centred in the cluster.
    The ranks run over distinct values with their counts."""
    counts = cut(long.groupBy(*keys, "value").agg(F.count("*").alias("c")))
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("mean"))
    ranked = salted_join(running_sum(counts, keys, ["value"], "c", "b"), totals, keys, "value")
    x = F.col("value") - F.col("mean")
    # c equal values at ranks b + 1 … b + c: their 2r - n - 1 add up to c (2b + c - n)
    return ranked.groupBy(*keys, "n").agg(F.sum(x * F.col("c") * (2 * F.col("b") + F.col("c") - F.col("n"))).alias("l1"), (F.col("n") * F.sum(F.col("c") * x * x) - F.pow(F.sum(F.col("c") * x), F.lit(2.0))).alias("l2"))


def kmeans_many(df: DataFrame, key: str, columns: list[str], sets: list[list[str]], k: int, tolerance: float = TOLERANCE, iterations: int = MOST_ITERATIONS, seed: int = 0) -> DataFrame:
    """``key, *columns, at, label``: ``kmeans`` on each of several sets of columns, all in the same passes over the rows.

    A pass brings ``k`` rows of sums for each set to the driver. Same start, empty clusters and end as ``kmeans``."""
    import numpy as np
    import pandas as pd

    places = [[columns.index(c) for c in s] for s in sets]
    start = np.array(start_rows(df, key, columns, k, seed))
    if len(start) < k:
        raise ValueError("fewer rows than clusters")
    centres = {i: start[:, p] for i, p in enumerate(places)}
    numbers = df.select(F.col(key), *(as_number(c).alias(c) for c in columns))

    def labels(x: np.ndarray, i: int, centre: np.ndarray) -> np.ndarray:
        d = np.zeros((len(x), k))
        for j, place in enumerate(places[i]):
            d += (x[:, place, None] - centre[None, :, j]) ** 2
        return d.argmin(axis=1)

    def sums(now: dict):
        def run(batches):
            held: dict = {}
            for batch in batches:
                x = batch[columns].to_numpy(dtype=float)
                for i, centre in now.items():
                    at = labels(x, i, centre)
                    for j in range(k):
                        part = x[at == j][:, places[i]]
                        if len(part):
                            n, total = held.get((i, j), (0, 0.0))
                            held[i, j] = (n + len(part), total + part.sum(axis=0))
            yield pd.DataFrame([(i, j, n, total) for (i, j), (n, total) in held.items()], columns=["at", "label", "n", "total"])

        return run

    moving = set(centres)
    for step in range(iterations):
        partial = numbers.mapInPandas(sums({i: centres[i] for i in moving}), "at int, label int, n long, total array<double>")
        found: dict = {}
        for r in partial.collect():  # tasks x sets x k rows of sums
            n, total = found.get((r["at"], r["label"]), (0, 0.0))
            found[r["at"], r["label"]] = (n + r["n"], total + np.array(r["total"]))
        spare = None
        for i in sorted(moving):
            new = []
            for j in range(k):
                if (i, j) in found:
                    new.append(found[i, j][1] / found[i, j][0])
                else:
                    spare = spare if spare is not None else np.array(start_rows(df, key, columns, k, seed + step + 1))
                    new.append(spare[j][places[i]])
            new = np.array(new)
            if math.sqrt(((new - centres[i]) ** 2).sum()) <= tolerance:
                moving.discard(i)
            else:
                centres[i] = new
        if not moving:
            break

    def final(batches):
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float)
            for i, centre in centres.items():
                yield batch.assign(at=i, label=labels(x, i, centre))

    kind = df.schema[key].dataType.simpleString()
    return numbers.mapInPandas(final, f"`{key}` {kind}, " + ", ".join(f"`{c}` double" for c in columns) + ", at int, label int")


def objective_many(labelled: DataFrame, columns: list[str], sets: list[list[str]], compared: list[list[str]]) -> DataFrame:
    """``at, objective`` of the labels of each set (``at``), for rows as ``kmeans_many`` gives them."""
    sides = F.create_map(*(F.lit(x) for i, (p, q) in enumerate(zip(sets, compared)) for x in (i, ";" + ";".join([*(f"-{columns.index(c)}" for c in p), *(f"+{columns.index(c)}" for c in q)]) + ";")))
    entries = F.array(*(F.struct(F.lit(f"{sign}{i}").alias("feature"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(columns) for sign in "-+"))
    used = F.filter(entries, lambda x: F.contains(sides[F.col("at")], F.concat(F.lit(";"), x["feature"], F.lit(";"))))
    long = labelled.select("at", "label", F.explode(used).alias("x")).select("at", "label", "x.feature", "x.value").where("value is not null")
    found = pair_sums_of(long, ["at", "label", "feature"])
    share = lambda values: F.create_map(*(F.lit(x) for i, v in enumerate(values) for x in (i, float(v))))[F.col("at")]
    gain, loss = share([len(q) / len(columns) for q in compared]), share([1 - len(p) / len(columns) for p in sets])
    return found.groupBy("at").agg(F.sum(F.when(F.col("feature").startswith("+"), gain * F.col("l1")).otherwise(-loss * F.col("l2"))).alias("objective"))


def objective_parts(labelled: DataFrame, columns: list[str], compared: list[str], skip_last: bool = False) -> DataFrame:
    """``compared_sum, clustered_sum``: L1 over comparison and squared L2 over clustering columns of all pairs within clusters."""
    if skip_last:  # the published tree walk leaves out the cluster with the greatest label
        last = labelled.agg(F.max("label").alias("last"))
        labelled = labelled.join(F.broadcast(last), F.col("label") < F.col("last")).drop("last")
    found = pair_sums(labelled, [*dict.fromkeys([*columns, *compared])])
    return found.agg(
        F.coalesce(F.sum(F.when(F.col("feature").isin(compared), F.col("l1"))), F.lit(0.0)).alias("compared_sum"),
        F.coalesce(F.sum(F.when(F.col("feature").isin(columns), F.col("l2"))), F.lit(0.0)).alias("clustered_sum"),
    )


def objective(labelled: DataFrame, columns: list[str], compared: list[str], n_features: int | None = None, skip_last: bool = False) -> DataFrame:
    """``objective``: (q / d) L1 − (1 − p / d) L2² summed over the pairs of all clusters; d counts unused features too."""
    d = n_features or len(columns) + len(compared)
    parts = objective_parts(labelled, columns, compared, skip_last)
    return parts.select((len(compared) / d * F.col("compared_sum") - (1 - len(columns) / d) * F.col("clustered_sum")).alias("objective"))


def silhouette(labelled: DataFrame, key: str, columns: list[str], block: int = 1000) -> DataFrame:
    """``silhouette``: mean of (b − a) / max(a, b) with Euclidean distance; 0 for a row alone in its cluster. Rows with a missing value do not count.

    A row needs its distances to all rows of its own cluster, and of another cluster only if that can be the nearest: a
    mean distance lies between the distance to the cluster's centre and the root of the mean squared one, both known from
    sums. Rows meet those clusters in pairs of blocks, whose distances are one matrix each."""
    import numpy as np
    import pandas as pd

    kind = labelled.schema[key].dataType.simpleString()
    rows = labelled.select(F.col(key).alias("id"), F.col("label").cast("int").alias("label"), F.array(*(as_number(c) for c in columns)).alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    rows, d = cut(rows), len(columns)
    centre = rows.groupBy("label").agg(F.count("*").alias("size"), F.array(*(F.avg(F.col("x")[i]) for i in range(d))).alias("c"), F.array(*(F.var_pop(F.col("x")[i]) for i in range(d))).alias("v"))
    centres = centre.collect()  # one row per cluster
    table = [(r["label"], r["c"], sum(r["v"])) for r in centres]
    names, middle, spread = np.array([t[0] for t in table]), np.array([t[1] for t in table], dtype=float).reshape(len(table), d), np.array([t[2] for t in table], dtype=float)

    def asked(batches):
        """Each row with the clusters it has to be measured against."""
        for batch in batches:
            x = np.array(batch["x"].to_list(), dtype=float).reshape(len(batch), d)
            low = ((x[:, None, :] - middle[None]) ** 2).sum(axis=2)
            high = np.sqrt(low + spread[None]) * (1 + 1e-9) + 1e-12
            own = batch["label"].to_numpy()[:, None] == names[None]
            high[own] = np.inf
            near = own | (np.sqrt(low) <= high.min(axis=1, initial=np.inf)[:, None])
            a, b = np.nonzero(near)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[a], "label": batch["label"].to_numpy()[a], "x": batch["x"].to_numpy()[a], "other": names[b]})

    wanted = rows.mapInPandas(asked, f"id {kind}, label int, x array<double>, other int")
    sizes = {r["label"]: max(1, -(-r["size"] // block)) for r in centres}
    parts = F.create_map(*(F.lit(v) for pair in sizes.items() for v in pair)) if sizes else F.create_map().cast("map<int,int>")
    packed = rows.groupBy(F.col("label").alias("other"), F.pmod(F.xxhash64("id"), F.coalesce(F.try_element_at(parts, F.col("label")), F.lit(1))).alias("b")).agg(F.collect_list("x").alias("y"))
    asks = wanted.groupBy("other", F.pmod(F.xxhash64("id", F.lit(1)), F.coalesce(F.try_element_at(parts, F.col("label")), F.lit(1))).alias("q"), "label").agg(F.collect_list(F.struct("id", "x")).alias("asked"))

    def sums(batches):
        for batch in batches:
            for label, other, ask, y in zip(batch["label"], batch["other"], batch["asked"], batch["y"]):
                x, y, square = np.array([r["x"] for r in ask], dtype=float), np.array(list(y), dtype=float), 0.0
                for i in range(d):
                    square = square + (x[:, i, None] - y[None, :, i]) ** 2
                yield pd.DataFrame({"id": [r["id"] for r in ask], "label": label, "other": other, "s": np.sqrt(square).sum(axis=1), "n": len(y)})

    near = asks.join(packed, "other").select("label", "other", "asked", "y").mapInPandas(sums, f"id {kind}, label int, other int, s double, n long")
    per = near.groupBy("id", "label", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own, rest = F.col("label") == F.col("other"), F.col("label") != F.col("other")
    each = per.groupBy("id").agg(F.max(F.when(own, F.col("n"))).alias("size"), F.max(F.when(own, F.try_divide(F.col("s"), F.col("n") - 1))).alias("a"), F.min(F.when(rest, F.col("s") / F.col("n"))).alias("b"))
    value = F.when((F.col("size") == 1) | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.agg(F.avg(value).alias("silhouette"))
