"""Queries of the table-preparation operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlume.operators import drift, packed, quality
from graphlume.session import table

SIDES = ("clustering", "comparison", "unused")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value packed in solver_logs.clusters and run_results.partition."""
    logs = packed.split_packed(table(spark, sf_dir, "solver_logs"), "log_id", "clusters", integers=True).where("val != ''")
    runs = packed.split_packed(table(spark, sf_dir, "run_results"), "result_id", "partition", SIDES).where("val != ''")
    columns = ["src", "row_key", "side", "pos", "val"]
    return logs.withColumn("src", F.lit("solver_logs")).select(columns).unionByName(runs.withColumn("src", F.lit("run_results")).select(columns))


def p2_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields each dialect explains best, and with how many bits on average."""
    logs = packed.split_packed(table(spark, sf_dir, "solver_logs"), "log_id", "clusters", integers=True).withColumn("src", F.lit("solver_logs"))
    runs = packed.split_packed(table(spark, sf_dir, "run_results"), "result_id", "partition", SIDES).withColumn("src", F.lit("run_results"))
    fields = logs.unionByName(runs).groupBy("src", "row_key").agg(F.first("dialect").alias("dialect"), F.first("bits").alias("bits"), F.count("*").alias("n"))
    return fields.groupBy("src", "dialect").agg(F.count("*").alias("n_fields"), F.sum("n").alias("n_entries"), F.avg("bits").alias("mean_bits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a field from one file of a series to the next."""
    return drift.changes(table(spark, sf_dir, "report_files"))


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All run results of all files in one table of one schema."""
    return drift.consistent_table(table(spark, sf_dir, "report_files"))


def p3_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.failed_casts(table(spark, sf_dir, "report_files"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dtype_names").select(F.lit("dtype_before").alias("field"), F.col("dtype_name").alias("value"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad values and sudden changes of the validation report."""
    report = table(spark, sf_dir, "validation_report")
    return quality.findings(report, "row_id", "load_id", "stream_no", "load_no", ["null_ratio", "distinct_ratio"], ["dtype_before"], _names(spark, sf_dir))


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The rows of the report, each once as first loaded, and all its columns but the load's own key."""
    report = table(spark, sf_dir, "validation_report")
    others = [c for c in report.columns if c not in ("row_id", "load_id", "loaded_at")]
    once = report.groupBy("row_id", "load_id", *(f"`{c}`" for c in others)).agg(F.min("loaded_at").alias("loaded_at"))
    return once, [c for c in once.columns if c != "load_id"]


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every load, and what changed from the load before."""
    report, columns = _report(spark, sf_dir)
    return quality.column_profile(report, "load_id", columns, _names(spark, sf_dir), "stream_no", "load_no")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile's counts and ranges."""
    return p4_profile(spark, sf_dir).select("load_id", "field", "n_rows", "n_missing", "n_distinct", "min_number", "max_number", F.round("missing_change", 12).alias("missing_change"))


def p4_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expressions induced for each text column, with the rows and values they cover."""
    report, columns = _report(spark, sf_dir)
    texts = quality.long_columns(report, [], [c for c in columns if dict(report.dtypes)[c] == "string"])
    induced = quality.induce(texts.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n")), ["field"], _names(spark, sf_dir))
    return induced.groupBy("field", "expression", "conforms").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows"))


QUERIES = {f.__name__: f for f in (p2_found, p2_dialects, p3_found, p3_table, p3_failed_casts, p4_found, p4_profile, p4_counts, p4_expressions)}


_NUMBERS = ["row_id", "stream_no", "load_no", "null_ratio", "distinct_ratio"]
_TEXTS = ["load_at", "loaded_at", "database", "label", "column", "action", "reason", "dtype_before"]

ORACLES = {
    "p4_found": """
with rows as (select distinct on (row_id) row_id, load_id, stream_no, load_no, null_ratio, distinct_ratio, dtype_before from validation_report),
long as (select row_id, load_id, stream_no, load_no, 'null_ratio' as field, case when isnan(null_ratio) then null else null_ratio end as x from rows
         union all select row_id, load_id, stream_no, load_no, 'distinct_ratio', case when isnan(distinct_ratio) then null else distinct_ratio end from rows),
names as (select r.row_id, r.load_id, r.stream_no, r.load_no, r.dtype_before as v, n.dtype_name from rows r left join dtype_names n on r.dtype_before = n.dtype_name),
loads as (select load_id, stream_no, load_no, field, count(*) as n, count(*) - count(x) as m, median(case when x between 0 and 1 then x end) as med from long group by all
          union all select load_id, stream_no, load_no, 'dtype_before', count(*), count(*) - count(v), null from names group by all),
tot as (select load_id, stream_no, load_no, count(dtype_name) as t from names group by all having count(dtype_name) > 0),
cov as (select stream_no, load_no, dtype_name, count(*) as c from names where dtype_name is not null group by all),
tv as (select a.load_id, sum(abs(coalesce(x.c, 0) / a.t - coalesce(y.c, 0) / b.t)) / 2 as d
       from tot a join tot b on a.stream_no = b.stream_no and a.load_no = b.load_no + 1 cross join dtype_names d
       left join cov x on x.stream_no = a.stream_no and x.load_no = a.load_no and x.dtype_name = d.dtype_name
       left join cov y on y.stream_no = b.stream_no and y.load_no = b.load_no and y.dtype_name = d.dtype_name group by a.load_id)
select load_id, row_id, field, 'range' as finding from long where x is not null and not (x between 0 and 1)
union all select load_id, row_id, 'dtype_before', 'pattern' from names where v is not null and dtype_name is null
union all select a.load_id, 0::bigint, a.field, 'missing' from loads a join loads b on a.stream_no = b.stream_no and a.load_no = b.load_no + 1 and a.field = b.field where a.m / a.n - b.m / b.n > 0.25
union all select a.load_id, 0::bigint, a.field, 'shift' from loads a join loads b on a.stream_no = b.stream_no and a.load_no = b.load_no + 1 and a.field = b.field where abs(a.med - b.med) > 0.15
union all select load_id, 0::bigint, 'dtype_before', 'shift' from tv where d > 0.3
""",
    "p4_counts": f"""
with rows as (select load_id, stream_no, load_no, {', '.join(f'"{c}"' for c in _NUMBERS + _TEXTS if c not in ("stream_no", "load_no", "loaded_at"))}, min(loaded_at) as loaded_at from validation_report group by all),
long as ({' union all '.join(f"select load_id, stream_no as s, load_no as n, '{c}' as field, case when not isnan(\"{c}\"::double) then \"{c}\"::double end as x, case when not isnan(\"{c}\"::double) then \"{c}\"::varchar end as v from rows" for c in _NUMBERS)}
  union all {' union all '.join(f"select load_id, stream_no, load_no, '{c}', null, \"{c}\"::varchar from rows" for c in _TEXTS)}),
p as (select load_id, s, n, field, count(*) as n_rows, count(*) - count(v) as n_missing, count(distinct v) as n_distinct, min(x) as min_number, max(x) as max_number from long group by all)
select a.load_id, a.field, a.n_rows, a.n_missing, a.n_distinct, a.min_number, a.max_number, round(a.n_missing / a.n_rows - b.n_missing / b.n_rows, 12) as missing_change from p a left join p b on a.s = b.s and a.n = b.n + 1 and a.field = b.field
""",
}
