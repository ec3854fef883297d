"""Neighbours and ranks in an order, without one task per group.

A window over a key sorts all rows of the key in one task. Here the rows are
range-partitioned by (keys, order), so that a key with a third of all rows spans many
tasks; what has to pass from one partition to the next is one row per partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlume.session import cut


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before in ``order`` within ``keys`` (null for a key's first row).

    ``order`` must be unique within ``keys`` for a defined result; ties keep an arbitrary order.
    The result is written to the checkpoint folder, as partition numbers must not change between its two reads.
    """
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_at", F.spark_partition_id()))
    inside = Window.partitionBy("_at").orderBy(*keys, *order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(inside))
    first = F.row_number().over(inside) == 1
    marked = placed.withColumn("_first", first).withColumn(out, F.when(same & ~first, F.lag(value).over(inside)))
    # the last row of every partition that has rows: as many rows as partitions
    ends = placed.groupBy("_at").agg(F.max_by(F.struct(*keys, F.col(value).alias("_value")), F.struct(*keys, *order)).alias("_end"))
    across = Window.orderBy("_at")
    ends = ends.select(F.col("_at").alias("_at2"), F.lag("_end").over(across).alias("_before"))
    joined = marked.join(F.broadcast(ends), F.col("_at") == F.col("_at2"), "left")
    carried: Column = F.lit(True)
    for k in keys:
        carried = carried & F.col(k).eqNullSafe(F.col(f"_before.{k}"))
    return joined.withColumn(out, F.when(F.col("_first") & F.col("_before").isNotNull() & carried, F.col("_before._value")).otherwise(F.col(out))).drop("_at", "_at2", "_first", "_before")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = 16, merge: bool = False) -> DataFrame:
    """``big`` joined to ``small``, which has at most one row per key, with the rows of one key over ``salts`` tasks.

    ``by`` is the column of ``big`` whose hash spreads the rows of a key. With ``merge``, ``small`` is never broadcast: the
    planner goes by file sizes, which know neither the ``salts`` copies of it nor how well its columns are packed.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(repeated.hint("merge") if merge else repeated, [*on, "_salt"], how).drop("_salt")


def running_sum(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over the rows before in ``order`` within ``keys`` (0 for the first).

    ``order`` must be unique within ``keys``. Sums run within range partitions; what comes before a partition
    is added from one row per key and partition."""
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_at", F.spark_partition_id()))
    before = (Window.unboundedPreceding, -1)
    inside = F.sum(amount).over(Window.partitionBy("_at", *keys).orderBy(*order).rowsBetween(*before))
    totals = placed.groupBy("_at", *keys).agg(F.sum(amount).alias("_t"))
    earlier = F.sum("_t").over(Window.partitionBy(*keys or [F.lit(1)]).orderBy("_at").rowsBetween(*before))  # a key's partitions
    totals = totals.select("_at", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(earlier, F.lit(0)).alias("_e"))
    joined = placed.withColumn(out, F.coalesce(inside, F.lit(0))).join(totals.withColumnRenamed("_at", "_at2"), (F.col("_at") == F.col("_at2")) & _same_keys(keys), "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("_e", F.lit(0))).drop("_at", "_at2", "_e", *(f"_k{i}" for i in range(len(keys))))


def _same_keys(keys: list[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def medians(df: DataFrame, keys: list[str], value: str, out: str = "median", low: float = 0.0, high: float = 1.0, bins: int = 4096) -> DataFrame:
    """Exact medians (mean of the two middle values) of the values within ``low`` to ``high``.

    A first pass counts per key and bin (``bins`` at most per key); a second looks only at
    the bins that hold the middle, with equal values counted together before the shuffle.
    Keys without a value have no row. NaN and null count as no value.
    """
    inside = df.where(F.col(value).between(low, high) & ~F.isnan(value))
    bin_ = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1))
    valued = inside.select(*keys, F.col(value).cast("double").alias("_v"), bin_.alias("_bin"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = valued.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_below", F.coalesce(F.sum("_c").over(by_bin), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    middle = counts.where((F.col("_below") < upper) & (F.col("_below") + F.col("_c") >= lower)).select(*keys, "_bin", "_below", "_n")
    same = valued.groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("_c")).join(middle, [*keys, "_bin"])
    by_value = Window.partitionBy(*keys, "_bin").orderBy("_v")
    ranked = same.withColumn("_to", F.col("_below") + F.sum("_c").over(by_value)).withColumn("_from", F.col("_to") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") < rank) & (F.col("_to") >= rank), F.col("_v")))

    return ranked.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias(out))


def percentiles(long: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """``*keys, p0, p1, …``: exact percentiles with linear interpolation at the shares ``at``.

    Equal values count together; their places come from sums over range partitions, so that no key is one task."""
    counts = long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = cut(running_sum(counts, keys, [value], "_c", "_b"))
    totals = placed.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    met = salted_join(placed, totals, keys, value) if keys else placed.join(F.broadcast(totals))  # without keys, one row
    found = []
    for i, p in enumerate(at):
        place = (F.col("_n") - 1) * p
        for name, x in ((f"_lo{i}", F.floor(place)), (f"_hi{i}", F.ceil(place))):
            found.append(F.max(F.when((F.col("_b") <= x) & (x < F.col("_b") + F.col("_c")), F.col(value))).alias(name))
    ends = met.groupBy(*keys, "_n").agg(*found)
    share = lambda p: (F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)
    return ends.select(*keys, *((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share(p)).alias(f"p{i}") for i, p in enumerate(at)))


def ranks(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``*keys, value, rank``: the average rank (from 1) of each distinct value."""
    counts = long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return running_sum(counts, keys, [value], "_c", "_b").select(*keys, value, (F.col("_b") + (F.col("_c") + 1) / 2).alias("rank"))


def tiles(rows: DataFrame, x: str, key: str, block: int = 1000) -> DataFrame:
    """``tile, low, high, rows``: rows near each other (in the numbers of array ``x``) packed in tiles of at most ``block``.

    Rows are put along a space-filling curve (interleaved bits of the scaled numbers) by range partitions and cut into
    stretches; ``low`` and ``high`` are a tile's least and greatest numbers.
    """
    n = len(rows.select(x).limit(1).collect()[0][0] or []) if not rows.isEmpty() else 0
    bits = max(1, min(16, 60 // max(n, 1)))
    ends = rows.agg(*(f(F.col(x)[i]).alias(f"{m}{i}") for i in range(n) for m, f in (("a", F.min), ("b", F.max)))).first() if n else None
    curve = F.lit(0).cast("long")
    for i in range(n):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        cell = F.lit(0).cast("long") if low is None or not high > low else F.least(F.floor((F.col(x)[i] - low) / (high - low) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
        for bit in range(bits):
            curve = curve.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long")), bit * n + i))
    columns = rows.columns
    placed = cut(rows.withColumn("_z", curve).repartitionByRange("_z", key).withColumn("_at", F.spark_partition_id()))
    numbered = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_at").orderBy("_z", key)) - 1)
    tile = (F.col("_at").cast("long") * (1 << 32) + F.floor(F.col("_r") / block)).alias("tile")
    return numbered.select(tile, *columns).groupBy("tile").agg(
        F.array(*(F.min(F.col(x)[i]) for i in range(n))).alias("low"), F.array(*(F.max(F.col(x)[i]) for i in range(n))).alias("high"), F.collect_list(F.struct(*columns)).alias("rows"),
    )


def near_tiles(tiled: DataFrame) -> DataFrame:
    """``tile, other``: the tiles whose box lies within ``reach`` (a squared distance) of a tile's box; itself too.

    ``tiled`` has ``tile, low, high, reach``. Boxes meet by the cells of a grid over the first two numbers that they
    touch, of which there are about as many as the square root of the tiles, so that no tile meets all others."""
    boxes = cut(tiled.select("tile", "low", "high", "reach"))
    first = boxes.agg(F.count("*").alias("n"), F.max(F.size("low")).alias("k"), *(f(F.try_element_at(c, F.lit(i + 1))).alias(f"{c}{i}") for i in range(2) for c, f in (("low", F.min), ("high", F.max)))).first()
    k = first["k"] or 0
    axes = [i for i in range(min(2, k)) if first[f"low{i}"] is not None and first[f"high{i}"] > first[f"low{i}"]]
    grid = math.ceil(max(first["n"], 1) ** (1 / (2 * max(len(axes), 1))))
    reach = F.sqrt("reach") * (1 + 1e-9)

    def cell(v: Column, i: int) -> Column:
        low, high = first[f"low{i}"], first[f"high{i}"]
        return F.greatest(F.lit(0.0), F.least(F.lit(grid - 1.0), F.floor((v - low) / (high - low) * grid).cast("double"))).cast("int")

    asked, met = boxes.toDF("tile", "low_a", "high_a", "reach"), boxes.select(F.col("tile").alias("other"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    for i in axes:
        asked = asked.withColumn(f"c{i}", F.explode(F.sequence(cell(F.col("low_a")[i] - reach, i), cell(F.col("high_a")[i] + reach, i))))
        met = met.withColumn(f"c{i}", F.explode(F.sequence(cell(F.col("low_b")[i], i), cell(F.col("high_b")[i], i))))
    if not axes:
        asked, met = asked.withColumn("c", F.lit(0)), met.withColumn("c", F.lit(0))
    gaps = [F.greatest(F.lit(0.0), F.col("low_b")[i] - F.col("high_a")[i], F.col("low_a")[i] - F.col("high_b")[i]) for i in range(k)]
    apart = sum((g * g for g in gaps), F.lit(0.0))
    both = asked.join(met, [f"c{i}" for i in axes] or ["c"]).where(apart <= F.col("reach") * (1 + 1e-9))
    return both.select("tile", "other").distinct()


def block_pairs(rows: DataFrame, block: int = 1000, by: list[str] | None = None, key: str = "id") -> DataFrame:
    """``*by, _a, _b, asked, rows``: all rows against all rows, as pairs of packed blocks of about ``block`` rows each.

    For operators that compare each row with every other one (of the same ``by``): what moves is
    n / block copies of the rows, and a task holds two blocks. ``key`` places a row in its block.
    """
    by = by or []
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("long").alias("_n"))
    if by:
        rows = rows.join(F.broadcast(sizes), by)  # one row per group
    else:
        rows = rows.withColumn("_n", F.lit(sizes.first()["_n"] or 1))
    packed = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.col("_n")))
    columns = [c for c in rows.columns if c not in (*by, "_n")]
    packed = packed.groupBy(*by, "_b", "_n").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    asked = packed.withColumnsRenamed({"rows": "asked", "_b": "_a"}).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return asked.join(packed.drop("_n"), [*by, "_b"]).select(*by, "_a", "_b", "asked", "rows")
