"""Reading and writing files: indicator CSVs, directories of CSVs, logs, rules, configurations, sinks."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, fields
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlume.operators.graph import as_number


@dataclass(frozen=True)
class GraphConfig:
    """What a configuration says of a graph; unknown keys are ignored, those of a server are not needed."""

    name: str
    labels: list[str] = field(default_factory=list)
    number_of_node: int | None = None
    number_of_edge: int | None = None
    avg_properties_node: float | None = None
    avg_properties_edge: float | None = None

    @staticmethod
    def read(path: str) -> GraphConfig:
        known = {f.name for f in fields(GraphConfig)}
        return GraphConfig(**{k: v for k, v in json.loads(Path(path).read_text()).items() if k in known})


def _csv(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """All columns as text: one pass, and no text is guessed to be a number."""
    return spark.read.csv(path, header=True, sep=delimiter, enforceSchema=False)


def load_indicators(spark: SparkSession, path: str, id_col: str | None = None, delimiter: str = ",", drop_class: bool = False, drop_incomplete: bool = False) -> DataFrame:
    """An indicator table from CSV: the id (default: the first column) as LONG, all others as DOUBLE, empty and bad text as null.

    ``drop_class``: without the last column. ``drop_incomplete``: without the columns that have a null (one aggregate decides).
    """
    raw = _csv(spark, path, delimiter)
    id_col = id_col or raw.columns[0]
    columns = [c for c in raw.columns if c != id_col]
    columns = columns[:-1] if drop_class else columns
    out = raw.select(F.col(f"`{id_col}`").try_cast("long").alias(id_col), *(F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    if drop_incomplete and columns:
        missing = out.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns))).first()
        out = out.select(f"`{id_col}`", *(f"`{c}`" for i, c in enumerate(columns) if not missing[f"m{i}"]))
    return out


def load_text(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV table as text, empty values as null; the first column is the id."""
    raw = _csv(spark, path, delimiter)
    return raw.select(F.col(f"`{raw.columns[0]}`").try_cast("long").alias(raw.columns[0]), *(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns[1:]))


def load_with_originals(spark: SparkSession, processed: str, original: str, id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(processed, original rows that belong to it)."""
    mine, before = load_indicators(spark, processed, id_col), load_indicators(spark, original, id_col)
    key = mine.columns[0]
    return mine, before.join(mine.select(f"`{key}`"), key, "left_semi")


def matrix(df: DataFrame, key: str) -> DataFrame:
    """The numeric matrix of an indicator table: NaN as null."""
    return df.select(f"`{key}`", *(as_number(c).alias(c) for c in df.columns if c != key))


def read_rules(spark: SparkSession, path: str) -> dict[str, str]:
    """Aggregation rules ``attribute,function`` without regard to case; every line is a rule, the heading too."""
    lines = spark.read.csv(path, header=False, schema="attribute string, aggregation_function string")
    rows = lines.select(*(F.lower(F.trim(c)).alias(c) for c in lines.columns)).where("attribute is not null").collect()  # one row per property of the schema
    return {r["attribute"]: r["aggregation_function"] or "" for r in rows}


def csv_headers(spark: SparkSession, directory: str) -> DataFrame:
    """``path, header`` of every CSV file of a directory; null for a file without a line."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/*.csv")
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []  # one entry per file, as the reader's own list
    every = spark.createDataFrame([(x.getPath().toString(),) for x in listed if x.isFile()], "path string")
    if not any(x.getLen() for x in listed):
        return every.withColumn("header", F.lit(None).cast("string"))
    lines = spark.read.text(f"{directory}/*.csv").where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value")
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731 - one source writes file:///, the other file:/
    return every.select("path", plain("path").alias("_p")).join(first.select(plain("path").alias("_p"), "header"), "_p", "left").drop("_p")


def _by_header(spark: SparkSession, directory: str) -> list[DataFrame]:
    """The files of a directory, one table for each different header."""
    named = csv_headers(spark, directory).where("trim(header) != ''").orderBy("path").toLocalIterator()  # one row per file, as the reader's own list
    files: dict[str, list[str]] = {}
    for r in named:
        files.setdefault(r["header"], []).append(r["path"])
    return [_csv(spark, paths) for paths in files.values()]


def read_csv_directory(spark: SparkSession, directory: str) -> DataFrame:
    """All CSV files of a directory by column name, with ``source_file``; missing columns are null. Files without a header are left out: see ``skipped_csv_files``."""
    parts = [df.withColumn("source_file", F.col("_metadata.file_name")) for df in _by_header(spark, directory)]
    if not parts:
        return spark.createDataFrame([], "source_file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def skipped_csv_files(spark: SparkSession, directory: str) -> DataFrame:
    """``file, reason`` of the files that ``read_csv_directory`` leaves out."""
    return csv_headers(spark, directory).where("header is null or trim(header) = ''").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.lit("no header").alias("reason"))


def summarize_csv_directory(spark: SparkSession, directory: str) -> DataFrame:
    """``file, n_rows, n_columns`` of each CSV file with a header: one count over all files of one header."""
    sizes = None
    for df in _by_header(spark, directory):
        names = F.explode(F.array(*(F.lit(p.rpartition("/")[2]) for p in df.inputFiles())))
        every = spark.range(1).select(names.alias("file"))
        counts = df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"))
        one = every.join(counts, "file", "left").select("file", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes if sizes is not None else spark.createDataFrame([], "file string, n_rows long, n_columns int")


def dated(name: str, suffix: str = ".csv", at: float | None = None) -> str:
    """An output name with the day and time: ``name_31-12-24_23-59-58.csv``."""
    return f"{name}_{time.strftime('%d-%m-%y_%H-%M-%S', time.localtime(at))}{suffix}"


def read_logs(spark: SparkSession, directory: str) -> DataFrame:
    """``file, text`` of every log file."""
    return spark.read.text(f"{directory}/*.log", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Run results as Parquet, appended: each append keeps its own schema and no heading is written twice."""
    df.write.mode("append").parquet(path)


def to_latex(df: DataFrame, caption: str = "", digits: int = 3) -> str:
    """A table as LaTeX text, which is as long as the table: for reports."""
    rows = df.toLocalIterator()

    def cell(v: object) -> str:
        text = "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        for sign in "&%$#_{}":
            text = text.replace(sign, "\\" + sign)
        return text

    head = " & ".join(map(cell, df.columns)) + r" \\"
    body = "\n".join(" & ".join(map(cell, r)) + r" \\" for r in rows)
    return "\\begin{table}\n" + (f"\\caption{{{caption}}}\n" if caption else "") + "\\begin{tabular}{" + "l" * len(df.columns) + "}\n\\hline\n" + head + "\n\\hline\n" + body + "\n\\hline\n\\end{tabular}\n\\end{table}\n"
