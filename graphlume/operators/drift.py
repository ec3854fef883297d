"""Raw delimited files whose fields come, go, change name and type.

Lines are parsed into maps from path (the field a header stands for) to raw text, typed
by the form of the text. Statistics of (file, path, type) decide the kind of a field in
a file; a change is a difference between two files that follow each other in a series.
The consistent table projects typed columns from the maps and reports every value whose
cast fails.

Casts change no value silently. An integer is read from its text, exactly; a decimal in an
integer field is an integer only if nothing follows the point. A unit after a number, or in
the header, must be in the schema's table and is converted; any other text fails. A comma
may group thousands or mark decimals: the values of the same field in the same file decide
("0,943" and "27,95" are decimals, "1,234.5" is grouped), and without such evidence a value
like "27,950" fails. Failed values are null in the table and are reported.

Defined results: a repeated line counts once; a null line is an empty line; a file
without line 0 has no fields; values beyond the header's length have no field, missing
ones are empty; of two headers for one field the exact name wins, then the first, and
the other becomes a field under its own name.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlume.operators.ordered import with_previous
from graphlume.session import cut

#: The fields of a run-results table with their types.
RUN_FIELDS = {
    "run": "int", "pushdown": "boolean", "database": "string", "N": "bigint", "E": "bigint", "label": "string", "indicators#": "int", "nodes#": "bigint",
    "avgLabelProp": "double", "time_Preprocessing": "double", "time_Cardinalities": "double", "time_Indicators": "double", "time_Validation": "double",
    "time_total": "double", "ratio_prop_dropped": "double",
}
#: Words that may stand in a header beside a field's own words.
UNITS = {"s", "sec", "secs", "second", "seconds", "ms", "msec", "min", "mins", "minutes", "h", "us", "ns", "pct", "percent", "mb", "kb", "gb", "cnt", "count", "no", "nr", "num", "number"}
SMALL = {"is", "on", "of", "the", "in", "at", "to", "by", "per", "for", "a", "an", "was", "has", "and", "or", "with", "val", "value", "flag"}

#: What one of a unit is in the unit of the field.
TIMES = {"s": 1.0, "sec": 1.0, "secs": 1.0, "second": 1.0, "seconds": 1.0, "ms": 1e-3, "msec": 1e-3, "us": 1e-6, "ns": 1e-9, "min": 60.0, "mins": 60.0, "minutes": 60.0, "h": 3600.0}
RUN_UNITS = {f: TIMES for f in RUN_FIELDS if f.startswith("time_")} | {"N": {"nodes": 1.0, "node": 1.0}, "nodes#": {"nodes": 1.0, "node": 1.0}, "E": {"edges": 1.0, "edge": 1.0}, "ratio_prop_dropped": {"%": 1.0, "pct": 1.0, "percent": 1.0}}

DELIMITERS = (",", ";", "\t", "|")
#: Lines of a file that one task parses at least.
CHUNK = 100_000


@dataclass(frozen=True)
class Schema:
    """The fields of the consistent table with their types, the units their values may bear, and the words their headers may bear besides."""

    fields: Mapping[str, str] = field(default_factory=lambda: RUN_FIELDS)
    units: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: RUN_UNITS)
    spare: frozenset[str] = frozenset(UNITS | SMALL)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.fields)


RUNS = Schema()


def words(name: str) -> list[str]:
    """Lower-case words of a name: split at signs and where a capital follows a small letter."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)
    return [w for w in re.split(r"[\W_]+", spaced.lower()) if w]


def _shortened(short: str, word: str, alone: bool) -> bool:
    if word.startswith(short):
        return len(short) >= (3 if alone else 1)
    skeleton = not set(short) & set("aeiou") and len(short) >= (3 if alone else 2)
    rest = iter(word)
    return skeleton and short[0] == word[0] and all(c in rest for c in short)


def _bears(header: list[str], field: list[str], spare: frozenset[str]) -> tuple[int, int] | None:
    """(words of the field, words it bears in whole), or None if one is missing or a foreign word is there."""
    free, whole = list(header), 0
    for word in field:
        for size in range(len(free), 0, -1):  # the word itself, perhaps split over several
            joined = [i for i in range(len(free) - size + 1) if "".join(free[i : i + size]) == word]
            if joined:
                del free[joined[0] : joined[0] + size]
                whole += 1
                break
        else:
            at = next((i for i, w in enumerate(free) if _shortened(w, word, len(field) == 1)), None)
            if at is None:
                return None
            del free[at]
    return (len(field), whole) if all(w in spare for w in free) else None


@lru_cache(maxsize=100_000)
def field_of(header: str, fields: tuple[str, ...], spare: frozenset[str] = RUNS.spare) -> str:
    """The field a header stands for; the header itself if there is none or no single best one."""
    if header in fields:
        return header
    own, best = words(header), []
    squashed = "".join(own)
    for field in fields:
        parts = words(field)
        score = (len(parts), len(parts)) if squashed and squashed == "".join(parts) else _bears(own, parts, spare)
        if score:
            best.append((score, field))
    best.sort(key=lambda x: x[0], reverse=True)
    return best[0][1] if best and (len(best) == 1 or best[0][0] > best[1][0]) else header


def fields_of(headers: list[str], fields: tuple[str, ...], spare: frozenset[str] = RUNS.spare) -> list[str | None]:
    """The fields of one file's headers, each at most once; None for a row-number column."""
    found: list[str | None] = [None] * len(headers)
    taken = set()
    for exact in (True, False):
        for i, header in enumerate(headers):
            if not header or header == "Unnamed: 0" or found[i] is not None or exact != (header in fields):
                continue
            field = header if exact else field_of(header, fields, spare)
            if field in taken:
                field = header
            while field in taken:
                field += "'"
            taken.add(field)
            found[i] = field
    return found


def scale_of(header: str, name: str, units: Mapping[str, float]) -> float:
    """What one in a column is in the field's unit, if the header bears a unit beside the field's words; else 1."""
    own = words(name)
    return next((units[w] for w in words(header) if w in units and w not in own), 1.0)


def _outside_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r'"[^"]*+"', "")


def delimiter_of(header: Column) -> Column:
    """The delimiter that occurs most often outside quotes; the first of DELIMITERS on ties."""
    plain = _outside_quotes(header)
    counts = [F.size(F.split(plain, re.escape(d) if d != "\t" else "\t")) for d in DELIMITERS]
    most = F.greatest(*counts)
    chosen = F.lit(DELIMITERS[-1])
    for d, c in reversed(list(zip(DELIMITERS, counts))):
        chosen = F.when(c == most, F.lit(d)).otherwise(chosen)
    return chosen


def _cells(line: Column, delimiter: str) -> Column:
    d = {"|": r"\|", "\t": r"\t"}.get(delimiter, delimiter)
    blank = r"[ ﻿]" if delimiter == "\t" else r"[\s﻿]"
    # a quote counts only where a value begins; possessive, so that a long line needs no deep stack
    pattern = rf'{d}({blank}*+(?:"[^"]*+(?:""[^"]*+)*+")?+[^{d}]*+)'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(pattern), F.lit(1))
    return F.transform(found, lambda c: _clean(c))


def _clean(cell: Column) -> Column:
    trimmed = F.regexp_replace(cell, r"^[\s﻿]+|[\s﻿]+$", "")
    inner = F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)
    unquoted = F.regexp_replace(F.replace(inner, F.lit('""'), F.lit('"')), r"^[\s﻿]+|[\s﻿]+$", "")
    return F.when(trimmed.startswith('"') & trimmed.endswith('"') & (F.length(trimmed) >= 2), unquoted).otherwise(trimmed)


def cells(line: Column, delimiter: Column) -> Column:
    """A line's values without quoting, surrounding blanks and byte-order mark."""
    out = _cells(line, DELIMITERS[0])
    for d in DELIMITERS[1:]:
        out = F.when(delimiter == d, _cells(line, d)).otherwise(out)
    return out


def raw_type(value: Column) -> Column:
    """0 empty, 1 boolean, 2 integer, 3 decimal (exponents included), 4 text."""
    return (
        F.when(value.isNull() | (value == ""), 0).when(F.lower(value).isin("true", "false"), 1)
        .when(value.rlike(r"^[+-]?[0-9]+$"), 2).when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), 3).otherwise(4)
    )


KINDS = ("boolean", "integer", "decimal", "text")


def read_files(lines: DataFrame, schema: Schema = RUNS) -> DataFrame:
    """One row per file: ``file_no, series_no, written_at, chunks, delimiter, headers, fields, scales``. Repeated lines do no harm."""
    text = F.regexp_replace(F.coalesce(F.col("line"), F.lit("")), r"[\r\n]+$", "")
    files = lines.groupBy("file_no").agg(F.min("series_no").alias("series_no"), F.min("written_at").alias("written_at"), F.collect_set(_chunk()).alias("chunks"), F.max(F.when(F.col("line_no") == 0, text)).alias("header"))
    files = files.withColumn("delimiter", delimiter_of(F.coalesce("header", F.lit(""))))
    files = files.withColumn("headers", F.when(F.col("header").isNull(), F.array().cast("array<string>")).otherwise(cells(F.col("header"), F.col("delimiter"))))
    known, units, spare = schema.names, {f: dict(u) for f, u in schema.units.items()}, schema.spare

    @F.pandas_udf("fields array<string>, scales array<double>")
    def stand_for(headers: pd.Series) -> pd.DataFrame:
        fields = headers.map(lambda h: fields_of(list(h), known, spare))
        scales = [[scale_of(h, f, units.get(f, {})) if f else 1.0 for h, f in zip(hs, fs)] for hs, fs in zip(headers, fields)]
        return pd.DataFrame({"fields": fields, "scales": scales})

    return files.withColumn("x", stand_for("headers")).select("*", "x.fields", "x.scales").drop("header", "x")


def _chunk() -> Column:
    return F.floor(F.col("line_no") / CHUNK)


def read_rows(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Data lines as maps, each once: ``file_no, line_no, values map<field, raw text>, scales map<field, double>`` (scales other than 1).

    Lines meet their file's header by (file, chunk of lines), so that a very large file spreads over as many tasks
    as it has chunks, and lines move once for counting and parsing.
    """
    body = lines.where("line_no > 0").select("file_no", _chunk().alias("chunk"), "line_no", F.regexp_replace(F.coalesce(F.col("line"), F.lit("")), r"[\r\n]+$", "").alias("line"))
    body = body.repartition("file_no", "chunk").dropDuplicates(["file_no", "chunk", "line_no"])
    head = files.select("file_no", F.explode("chunks").alias("chunk"), "delimiter", "fields", "scales")
    joined = body.join(head, ["file_no", "chunk"]).withColumn("cells", cells(F.col("line"), F.col("delimiter")))
    pairs = F.filter(F.arrays_zip(F.col("fields").alias("f"), F.slice("cells", F.lit(1), F.greatest(F.size("fields"), F.lit(1))).alias("v")), lambda p: p["f"].isNotNull())
    entries = F.transform(pairs, lambda p: F.struct(p["f"].alias("key"), F.coalesce(p["v"], F.lit("")).alias("value")))
    scaled = F.filter(F.arrays_zip(F.col("fields").alias("key"), F.col("scales").alias("value")), lambda p: p["key"].isNotNull() & (p["value"] != 1))
    return joined.select("file_no", "line_no", F.map_from_entries(entries).alias("values"), F.map_from_entries(scaled).alias("scales"))


def path_types(rows: DataFrame) -> DataFrame:
    """Path-type statistics by file: ``file_no, field, type, n``."""
    return rows.select("file_no", F.explode("values").alias("field", "value")).groupBy("file_no", "field", raw_type(F.col("value")).alias("type")).agg(F.count("*").alias("n"))


def changes(lines: DataFrame, schema: Schema = RUNS) -> DataFrame:
    """``file_no, field, change``: each file against the one written just before it in its series."""
    lines = lines.select("file_no", "series_no", "written_at", "line_no", "line")
    files = read_files(lines, schema)
    ordered = with_previous(files, ["series_no"], ["written_at", "file_no"], "file_no", "previous")
    kinds = path_types(read_rows(lines, ordered)).where("type > 0").groupBy("file_no", "field").agg(F.min("type").alias("least"), F.max("type").alias("most"))
    # the first kind that fits all values: booleans mix with nothing, integers are decimals too
    kind = F.when((F.col("least") == 1) & (F.col("most") > 1), 4).otherwise(F.col("most"))
    named = ordered.select("file_no", F.explode(F.arrays_zip(F.col("fields").alias("f"), F.col("headers").alias("h"))).alias("x")).select("file_no", F.col("x.f").alias("field"), F.col("x.h").alias("header")).where("field is not null")
    state = cut(named.join(kinds.select("file_no", "field", kind.alias("kind")), ["file_no", "field"], "left"))  # read as the file itself and as the one before
    after = ordered.where("previous is not null").select(F.col("previous").alias("file_no"), F.col("file_no").alias("next"))
    followed = ordered.where("previous is not null").select("file_no")
    now = state.join(followed, "file_no", "left_semi").select("file_no", "field", F.lit(1).alias("now"), "header", "kind")
    was = state.join(after, "file_no").select(F.col("next").alias("file_no"), "field", F.lit(0).alias("now"), "header", "kind")

    def of(now: int, column: str) -> Column:
        return F.max(F.when(F.col("now") == now, F.col(column)))

    both = now.unionByName(was).groupBy("file_no", "field").agg(F.max("now").alias("here"), F.min("now").alias("away"), of(1, "header").alias("h1"), of(0, "header").alias("h0"), of(1, "kind").alias("k1"), of(0, "kind").alias("k0"))
    lone = F.col("here") == F.col("away")
    found = F.array(
        F.when(lone & (F.col("here") == 1), "added"), F.when(lone & (F.col("here") == 0), "removed"),
        F.when(~lone & (F.col("h1") != F.col("h0")), "renamed"), F.when(~lone & (F.col("k1") != F.col("k0")), "retyped"),
    )
    return both.select("file_no", "field", F.explode(F.array_compact(found)).alias("change"))


_PLAIN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_GROUPED = r"[+-]?[1-9][0-9]{0,2}(?:,[0-9]{3})+"


def _bare(raw: Column) -> Column:
    """A value without the letters of a unit at its end; an exponent is no unit."""
    return F.regexp_replace(raw, r"\s*[A-Za-zµ%]+$", "")


def comma_of(bare: Column) -> Column:
    """What a value without its unit says of the comma: 'decimal', 'grouping', or null if it has none or could be either."""
    sure = bare.rlike(rf"^[+-]?[1-9][0-9]{{0,2}}(?:(?:,[0-9]{{3}}){{2,}}(?:\.[0-9]+)?|(?:,[0-9]{{3}})+\.[0-9]+)$")
    either = bare.rlike(rf"^{_GROUPED}$")
    return F.when(sure, "grouping").when(bare.rlike(r"^[+-]?[0-9]+,[0-9]+$") & ~either, "decimal")


def _written(bare: Column, comma: Column) -> Column:
    """The number in a text without its unit in plain notation; null if it is none."""
    own = F.coalesce(comma_of(bare), comma)
    grouped = F.when((own == "grouping") & bare.rlike(rf"^{_GROUPED}(?:\.[0-9]+)?$"), F.replace(bare, F.lit(","), F.lit("")))
    decimal = F.when((own == "decimal") & bare.rlike(r"^[+-]?[0-9]+,[0-9]+$"), F.replace(bare, F.lit(","), F.lit(".")))
    return F.when(bare.rlike(f"^{_PLAIN}$"), bare).when(bare.contains(","), F.coalesce(grouped, decimal))


def _boolean(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin("true", "t", "1", "1.0", "on", "yes", "y"), True).when(low.isin("false", "f", "0", "0.0", "off", "no", "n"), False)


def _cast(number: Column, factor: Column, kind: str) -> Column:
    """A number in plain notation as its type, null if it is none of this type."""
    if kind == "double":
        return F.when(factor == 1, number.try_cast("double")).otherwise(number.try_cast("double") * factor)
    exact = number.try_cast("decimal(38,9)")  # an integer from its text: no double in between
    whole = F.when(number.rlike(r"^[+-]?[0-9]+$"), number.try_cast("long")).when(exact == F.floor(exact), exact.try_cast("long"))
    return F.when(factor == 1, whole).when(whole * factor == F.floor(whole * factor), (whole * factor).try_cast("long")).try_cast(kind)


def _raw(name: str) -> Column:
    return F.nullif(F.try_element_at("values", F.lit(name)), F.lit(""))


def _typed_rows(lines: DataFrame, schema: Schema) -> DataFrame:
    """``file_no, line_no, values`` and the schema's fields with their types.

    Numbers of all fields go through one expression over an array, so that the plan does not grow with the schema."""
    lines = lines.select("file_no", "series_no", "written_at", "line_no", "line")
    rows = cut(read_rows(lines, read_files(lines, schema)))
    numeric = [f for f, kind in schema.fields.items() if kind not in ("string", "boolean")]
    told = rows.select("file_no", F.explode(F.map_filter("values", lambda k, v: k.isin(numeric) & v.contains(","))).alias("field", "value"))
    told = told.groupBy("file_no", "field").agg(F.collect_set(comma_of(_bare(F.col("value")))).alias("said")).where("size(said) = 1")
    # files with a comma in a number only, one entry per field of the schema; joined as the planner finds its size allows
    commas = told.groupBy("file_no").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("said")[0]))).alias("commas"))
    rows = rows.join(commas, "file_no", "left")
    factors = F.create_map(*(F.lit(x) for f in numeric for u, v in schema.units.get(f, {}).items() for x in (f"{f} {u}", float(v)))) if any(schema.units.get(f) for f in numeric) else F.create_map().cast("map<string,double>")
    if numeric:
        entries = F.array(*(F.struct(F.lit(f).alias("name"), _raw(f).alias("raw"), F.try_element_at("commas", F.lit(f)).alias("comma"), F.coalesce(F.try_element_at("scales", F.lit(f)), F.lit(1.0)).alias("scale")) for f in numeric))
        bare = lambda x: F.when(x["raw"].rlike(f"^{_PLAIN}$"), x["raw"]).otherwise(_bare(x["raw"]))
        split = F.transform(entries, lambda x: F.struct(x["name"].alias("name"), x["comma"].alias("comma"), x["scale"].alias("scale"), x["raw"].alias("raw"), bare(x).alias("bare")))
        rows = rows.withColumn("_n", split)
        unit = lambda x: F.regexp_replace(F.substring(x["raw"], F.length(x["bare"]) + 1, F.length(x["raw"])), r"\s+", "")
        factor = lambda x: F.when(F.length(x["bare"]) == F.length(x["raw"]), x["scale"]).otherwise(F.try_element_at(factors, F.concat(x["name"], F.lit(" "), unit(x))))
        rows = rows.withColumn("_n", F.transform("_n", lambda x: F.struct(_written(x["bare"], x["comma"]).alias("number"), factor(x).alias("factor"))))
    at = {f: F.col("_n")[i] for i, f in enumerate(numeric)}
    columns = [(_raw(f) if kind == "string" else _boolean(_raw(f)) if kind == "boolean" else _cast(at[f]["number"], at[f]["factor"], kind)).alias(f) for f, kind in schema.fields.items()]
    return rows.select("file_no", "line_no", "values", *columns)


def consistent_table(lines: DataFrame, schema: Schema = RUNS) -> DataFrame:
    """All data lines in one table: ``file_no, line_no``, the schema's fields with their types, and
    ``failed``: the fields whose text could not be cast (their column is null), and ``others``: all further fields."""
    failed = F.array_compact(F.array(*(F.when(_raw(f).isNotNull() & F.col(f"`{f}`").isNull(), F.lit(f)) for f in schema.fields)))
    return _typed_rows(lines, schema).select("file_no", "line_no", *(f"`{f}`" for f in schema.fields), failed.alias("failed"), F.map_filter("values", lambda k, _: ~k.isin(*schema.fields)).alias("others"))


def failed_casts(lines: DataFrame, schema: Schema = RUNS) -> DataFrame:
    """``file_no, field, n, example``: values of each file that the consistent table could not cast."""
    bad = [F.when(_raw(f).isNotNull() & F.col(f"`{f}`").isNull(), F.struct(F.lit(f).alias("field"), _raw(f).alias("raw"))) for f, kind in schema.fields.items() if kind != "string"]
    found = _typed_rows(lines, schema).select("file_no", F.explode(F.array_compact(F.array(*bad))).alias("x"))
    return found.groupBy("file_no", F.col("x.field").alias("field")).agg(F.count("*").alias("n"), F.min("x.raw").alias("example"))
