"""Profiles of table columns per load: what is missing, ranges, forms of values and changes between loads.

Forms. Every distinct value of a column is described at four levels: itself, its runs of
character classes with their lengths, the runs without lengths, and anything at all. The
levels form a tree. From the leaves up, a node is kept as one expression or replaced by
the expressions below it, whichever describes the column's values in fewer bits (bits to
write the expression, and for each row the bits to tell the expression among all and the
value given the expression). A value may also be an exception: no expression of its own,
each row spelled out. Expressions that remain stand; a value that is an exception does not
conform. Everything is counted with aggregates over all distinct values; none is collected.

Reference lists. A listed value costs nothing to write as an expression, and an expression
stands only if all values it covers are listed. Rows of other values are candidates, and
only these are looked up in the list. Coverage of the expressions is compared between
loads; where an expression covers several listed values its rows bound the change from
above, and loads within the bound are counted again by value.

Defined results: null and NaN are missing, an empty text is a value; a row repeated under
its key counts once; a load without a load before it has no change; a share or median that
does not exist (no rows, no valid values) has no change.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlume.operators.ordered import medians, salted_join
from graphlume.session import cut

#: Bits to write one sign of an expression, to tell one letter or digit of a value, to spell one sign, and to announce an exception.
SIGN_BITS, LETTER_BITS, DIGIT_BITS, ANY_BITS, EXCEPTION_BITS = 8.0, 4.7, 3.4, 8.0, 10.0
ANYTHING, EXCEPTION = ".*", "(exception)"


def _escaped(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def _runs(value: Column) -> Column:
    """Runs of one character class: capitals, small letters, digits, blanks; every other sign is itself."""
    return F.regexp_extract_all(value, F.lit(r"([A-Z]+|[a-z]+|[0-9]+|\s+|[^A-Za-z0-9\s])"), F.lit(1))


def _class_of(run: Column) -> Column:
    return F.when(run.rlike("^[A-Z]"), "[A-Z]").when(run.rlike("^[a-z]"), "[a-z]").when(run.rlike("^[0-9]"), "[0-9]").when(run.rlike(r"^\s"), r"\s").otherwise(_escaped(run))


def _is_class(run: Column) -> Column:
    return run.rlike(r"^[A-Za-z0-9\s]")


def levels(value: Column) -> tuple[Column, Column]:
    """The expressions of a value's two middle levels: with lengths, and without."""
    runs = _runs(value)
    sized = F.transform(runs, lambda r: F.when(_is_class(r), F.concat(_class_of(r), F.lit("{"), F.length(r).cast("string"), F.lit("}"))).otherwise(_class_of(r)))
    loose = F.transform(runs, lambda r: F.when(_is_class(r), F.concat(_class_of(r), F.lit("+"))).otherwise(_class_of(r)))
    return F.array_join(sized, ""), F.array_join(loose, "")


def _content_bits(value: Column) -> Column:
    """Bits to tell a value whose classes and lengths are known."""
    n = {c: F.length(F.regexp_replace(value, f"[^{c}]", "")) for c in ("A-Za-z", "0-9")}
    return n["A-Za-z"] * LETTER_BITS + n["0-9"] * DIGIT_BITS


def induce(values: DataFrame, keys: list[str], reference: DataFrame | None = None) -> DataFrame:
    """The expression of each distinct value: ``*keys, value, n, expression, conforms, listed``.

    ``values`` has ``*keys`` (the column's name, say), ``value`` and ``n`` (rows that bear it).
    ``reference`` has ``*keys`` and ``value``; keys without a reference are judged by form alone and have a null in ``listed``.
    Distinct values and their expressions are written once each, as several aggregates read them.
    """
    values = cut(values)
    sized, loose = levels(F.col("value"))
    leaf = values.withColumn("l2", sized).withColumn("l1", loose).withColumn("listed", F.lit(None).cast("boolean"))
    if reference is not None:
        known = reference.select(*keys, "value").distinct().withColumn("_known", F.lit(True))
        listed_keys = F.broadcast(reference.select(*keys).distinct().withColumn("_keyed", F.lit(True)))  # one row per column of the table
        leaf = leaf.join(known, [*keys, "value"], "left").join(listed_keys, keys, "left").withColumn("listed", F.when(F.col("_keyed"), F.coalesce("_known", F.lit(False)))).drop("_known", "_keyed")
    length, content, n = F.length("value"), _content_bits(F.col("value")), F.col("n").cast("double")
    # one row per column of the table: small enough to broadcast whatever the number of rows
    totals = F.broadcast(values.groupBy(*keys).agg(F.sum("n").cast("double").alias("total")))
    spelled = ANY_BITS * length + 2 * F.log2(length + 1.0)
    own = F.when(F.coalesce("listed", F.lit(False)), 0.0).otherwise(SIGN_BITS * (length + 1) + 2 * F.log2(length + 1.0)) + n * F.log2(F.col("total") / n)
    exception = n * (EXCEPTION_BITS + spelled)
    leaf = leaf.join(totals, keys).withColumn("b3", F.least(own, exception)).withColumn("odd", exception < own)
    # sums of n * content under one expression: enough to cost it at each level
    leaf = leaf.withColumn("c2", n * content).withColumn("c1", n * (content + 2 * F.log2(length + 1.0))).withColumn("c0", n * spelled)

    def up(df: DataFrame, nodes: list[str], own: str, child: str, out: str, keep: list[str]) -> DataFrame:
        """Costs one level higher, as columns of the nodes at that level."""
        level = nodes[-1] if nodes else ""
        node = df.groupBy(*keys, *nodes).agg(F.sum(own).alias("_own"), F.sum(child).alias("_below"), F.sum("n").alias("n"), F.max("total").alias("total"), *(F.sum(c).alias(c) for c in keep))
        written = F.length(level) * SIGN_BITS if level else F.lit(SIGN_BITS * 2)
        whole = written + F.col("_own") + F.col("n") * F.log2(F.col("total") / F.col("n"))
        return node.withColumn(out, F.least(whole, F.col("_below"))).withColumn(f"{out}_split", F.col("_below") <= whole).drop("_own", "_below")

    n2 = cut(up(leaf, ["l1", "l2"], "c2", "b3", "b2", ["c1", "c0"]))
    n1 = up(n2, ["l1"], "c1", "b2", "b1", ["c0"])
    n0 = up(n1, [], "c0", "b1", "b0", [])
    kept = salted_join(n2.select(*keys, "l1", "l2", "b2_split"), n1.select(*keys, "l1", "b1_split"), [*keys, "l1"], "l2").join(F.broadcast(n0.select(*keys, "b0_split")), keys)
    placed = salted_join(leaf, kept, [*keys, "l1", "l2"], "value")
    expression = (
        F.when(~F.col("b0_split"), ANYTHING).when(~F.col("b1_split"), F.col("l1")).when(~F.col("b2_split"), F.col("l2"))
        .when(F.col("odd"), EXCEPTION).otherwise(_escaped(F.col("value")))
    )
    told = placed.select(*keys, "value", "n", expression.alias("expression"), "listed")
    stands = F.col("expression") != EXCEPTION
    if reference is None:
        return told.select(*keys, "value", "n", "expression", stands.alias("conforms"), "listed")
    told = cut(told)
    pure = told.groupBy(*keys, "expression").agg(F.coalesce(F.min("listed"), F.lit(True)).alias("_pure"))
    return salted_join(told, pure, [*keys, "expression"], "value").select(*keys, "value", "n", "expression", (stands & F.col("_pure")).alias("conforms"), "listed")


def once(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(key, *columns).dropDuplicates([key])


def long_columns(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """``*keep, field, value STRING, number DOUBLE``: numbers as numbers, everything else as text; NaN as missing."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in {"double", "float", "integer", "long", "short", "byte", "decimal"}}

    def one(c: str) -> Column:
        quoted = F.col(f"`{c}`")
        number = F.nullif(quoted.cast("double"), F.lit(float("nan"))) if c in numeric else F.lit(None).cast("double")
        text = F.when(number.isNotNull(), quoted.cast("string")) if c in numeric else quoted.cast("string")
        return F.struct(F.lit(c).alias("field"), text.alias("value"), number.alias("number"))

    return df.select(*keep, F.explode(F.array(*map(one, columns))).alias("x")).select(*keep, "x.field", "x.value", "x.number")


def column_profile(df: DataFrame, load: str, columns: list[str], reference: DataFrame | None = None, stream: str | None = None, number: str | None = None) -> DataFrame:
    """One row per load and column: rows, missing, distinct values, least, greatest and mean number, least and greatest text,
    values that do not conform, and the number of expressions its rows use.

    With ``stream`` and ``number``, also the change from the load before (same stream, next lower number): of the share
    missing, of the mean, and of the coverage of expressions (half the sum of the absolute differences of their shares).
    """
    order = [stream, number] if stream and number else []
    long = long_columns(df, [load], columns)
    # rows of one value count together before any shuffle; a column with few values is then small
    counts = cut(long.groupBy(load, "field", "value", "number").agg(F.count("*").alias("n")))
    induced = induce(counts.where("value is not null and number is null").groupBy("field", "value").agg(F.sum("n").alias("n")), ["field"], reference)
    induced = cut(induced.select("field", "value", "expression", (F.col("conforms") | F.coalesce("listed", F.lit(False))).alias("conforms")))
    texts = salted_join(counts.where("value is not null and number is null"), induced, ["field", "value"], load)
    # one row per load, column and expression from here on
    formed = texts.groupBy(load, "field", "expression").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("conforms"), F.col("n")).otherwise(0)).alias("bad"), F.min("value").alias("min_text"), F.max("value").alias("max_text"))
    formed = cut(formed)
    forms = formed.groupBy(load, "field").agg(F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"), F.sum("bad").alias("n_nonconforming"), F.count("*").alias("n_expressions"))
    plain = counts.groupBy(load, "field").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"), F.count("value").alias("n_distinct"),
        F.min("number").alias("min_number"), F.max("number").alias("max_number"), (F.sum(F.col("number") * F.col("n")) / F.sum(F.when(F.col("number").isNotNull(), F.col("n")))).alias("mean_number"),
    )
    out = plain.join(forms, [load, "field"], "left").na.fill(0, ["n_nonconforming", "n_expressions"])
    if not order:
        return out
    loads = df.groupBy(load).agg(F.min(stream).alias("_s"), F.min(number).alias("_n"))
    follows = loads.select(F.col(load).alias("_next"), "_s", F.col("_n") - 1).toDF("_next", "_s", "_n").join(loads, ["_s", "_n"]).select("_next", F.col(load).alias("_was"))
    follows = cut(follows.groupBy("_next").agg(F.min("_was").alias("_was")))
    out = cut(out)
    was = out.select(F.col(load).alias("_was"), "field", F.col("n_rows").alias("_r"), F.col("n_missing").alias("_m"), F.col("mean_number").alias("_a")).join(follows, "_was").select(F.col("_next").alias(load), "field", "_r", "_m", "_a")
    here = formed.select(load, "field", "expression", F.col("n").alias("c1"), F.lit(0).cast("long").alias("c0"))
    there = formed.withColumnRenamed(load, "_was").join(follows, "_was").select(F.col("_next").alias(load), "field", "expression", F.lit(0).cast("long").alias("c1"), F.col("n").alias("c0"))
    each = here.unionByName(there).groupBy(load, "field", "expression").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    sums = each.groupBy(load, "field").agg(F.sum("c1").alias("t1"), F.sum("c0").alias("t0")).where("t1 > 0 and t0 > 0")
    turned = each.join(sums, [load, "field"]).groupBy(load, "field").agg((F.sum(F.abs(F.col("c1") / F.col("t1") - F.col("c0") / F.col("t0"))) / 2).alias("coverage_change"))
    missing = F.col("n_missing") / F.col("n_rows") - F.col("_m") / F.col("_r")
    changed = out.join(was, [load, "field"], "left").join(turned, [load, "field"], "left")
    return changed.withColumn("missing_change", missing).withColumn("mean_change", F.col("mean_number") - F.col("_a")).drop("_r", "_m", "_a")


def findings(df: DataFrame, row: str, load: str, stream: str, number: str, ratios: list[str], names: list[str], reference: DataFrame, missing_by: float = 0.25, median_by: float = 0.15, shares_by: float = 0.3) -> DataFrame:
    """``load_id, row_id, field, finding`` with ``range`` and ``pattern`` for rows, ``missing`` and ``shift`` for loads (``row_id`` 0).

    ``ratios`` are numbers that belong within 0 to 1, ``names`` texts of which ``reference`` (field, value) lists the valid ones.
    The load before is the one of the same ``stream`` with the next lower ``number``.
    """
    rows = cut(once(df, row, [load, stream, number, *ratios, *names]))
    long = long_columns(rows, [row, load, stream, number], ratios)
    named = long_columns(rows, [row, load, stream, number], names)
    ranged = long.where(F.col("number").isNotNull() & ~F.col("number").between(0, 1)).select(F.col(load).alias("load_id"), F.col(row).alias("row_id"), "field", F.lit("range").alias("finding"))

    present = named.where(F.col("value").isNotNull())
    induced = cut(induce(present.groupBy("field", "value").agg(F.count("*").alias("n")), ["field"], reference).drop("n"))
    formed = salted_join(present, induced, ["field", "value"], row)
    # rows outside the standing expressions are candidates; where there is a list they are looked up in it
    odd = formed.where(~F.col("conforms") & ~F.coalesce("listed", F.lit(False))).select(F.col(load).alias("load_id"), F.col(row).alias("row_id"), "field", F.lit("pattern").alias("finding"))

    # one row per load and field, each set against the row of the load before it
    loads = long.unionByName(named).groupBy(load, stream, number, "field").agg(F.count("*").alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("m"))
    loads = cut(loads.join(medians(long, [load, "field"], "number"), [load, "field"], "left"))
    before = loads.select(stream, (F.col(number) + 1).alias(number), "field", F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("median").alias("median0"))
    more = 1_000_000
    missing = (F.col("m") * F.col("n0") - F.col("m0") * F.col("n")) * more > F.col("n") * F.col("n0") * round(missing_by * more)
    moved = F.abs(F.col("median") - F.col("median0")) > median_by
    changed = F.array_compact(F.array(F.when(missing, "missing"), F.when(moved, "shift")))
    pairs = loads.join(before, [stream, number, "field"]).select(F.col(load).alias("load_id"), F.lit(0).cast("long").alias("row_id"), "field", F.explode(changed).alias("finding"))

    # coverage of the expressions by load, against the load before: of both, counts and totals
    part = F.when(F.col("listed").isNotNull(), F.col("value")).otherwise(F.col("expression"))
    cover = cut(formed.where(F.coalesce("listed", "conforms")).groupBy(load, stream, number, "field", "expression", part.alias("part")).agg(F.count("*").alias("c")))
    total = cover.groupBy(load, stream, number, "field").agg(F.sum("c").alias("t"))
    both = total.join(total.select(stream, (F.col(number) + 1).alias(number), "field", F.col("t").alias("t0")), [stream, number, "field"])
    here = cover.select(stream, number, "field", "expression", "part", F.col("c").alias("c1"), F.lit(0).cast("long").alias("c0"))
    there = cover.select(stream, (F.col(number) + 1).alias(number), "field", "expression", "part", F.lit(0).cast("long").alias("c1"), F.col("c").alias("c0"))
    each = here.unionByName(there).groupBy(stream, number, "field", "expression", "part").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).join(both, [stream, number, "field"])
    now, then = F.col("c1") * F.col("t0"), F.col("c0") * F.col("t")
    by_form = each.groupBy(load, "field", "t", "t0", "expression").agg(F.sum(F.abs(now - then)).alias("d"), F.sum(now + then).alias("most"), F.count("*").alias("parts"))
    # an expression of several listed values may hide a change within it: its rows bound the change, and the values decide
    apart = by_form.groupBy(load, "field", "t", "t0").agg(F.sum(F.when(F.col("parts") > 1, F.col("most")).otherwise(F.col("d"))).alias("bound"), F.sum("d").alias("d"))
    least = F.col("t") * F.col("t0") * round(2 * shares_by * more)
    turned = apart.where((F.col("bound") * more > least) & (F.col("d") * more > least)).select(F.col(load).alias("load_id"), F.lit(0).cast("long").alias("row_id"), "field", F.lit("shift").alias("finding"))
    return ranged.unionByName(odd).unionByName(pairs).unionByName(turned)
