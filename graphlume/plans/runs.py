"""Queries: run analytics and small primitives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlume.functions.text import element_name, ends_with_any, finite, merge_maps
from graphlume.operators import collect, packed, runlog, search, validate
from graphlume.plans.base import query, r, trade
from graphlume.plans.collection import indicator_table_nations
from graphlume.session import shared_folder, table
from graphlume.sources import files

def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "solver_logs").dropDuplicates(["log_id"])


_L = "l as (select distinct on (log_id) * from solver_logs order by log_id)"
_FIN = "case when isfinite({0}) then {0} end"


@query(f"""with {_L} select data, heuristic, k, count(*) as runs, round(avg({_FIN.format('cpu_time')}), 5) as cpu_time_mean, round(stddev_samp({_FIN.format('cpu_time')}), 4) as cpu_time_std, count({_FIN.format('cpu_time')}) as cpu_time_n,
  round(avg({_FIN.format('best_score')}), 5) as best_score_mean, round(stddev_samp({_FIN.format('best_score')}), 4) as best_score_std, count({_FIN.format('best_score')}) as best_score_n from l group by 1, 2, 3""")
def run_aggregates(spark: SparkSession, d: str) -> DataFrame:
    found = runlog.aggregate_runs(_runs(spark, d), ["data", "heuristic", "k"], ["cpu_time", "best_score"])
    return found.withColumns({c: r(c, 5 if c.endswith("mean") else 4) for c in found.columns if c.endswith(("mean", "std"))})


@query(f"""with {_L}, i as (select data, heuristic, k, avg({_FIN.format('wall_time')}) as m from l group by 1, 2, 3) select heuristic, round(avg(m), 5) as mean, round(stddev_samp(m), 4) as std, count(*) as groups from i where m is not null group by 1""")
def run_two_levels(spark: SparkSession, d: str) -> DataFrame:
    return runlog.two_levels(_runs(spark, d), ["data", "heuristic", "k"], ["heuristic"], "wall_time").withColumns({"mean": r("mean", 5), "std": r("std", 4)})


@query(f"""with {_L}, e as (select data, unnest(all_bar_scores) as s from l), b as (select data, min(s) as lo, max(s) as hi from e where s is not null and not isnan(s) group by 1), m as (select data, heuristic, avg(best_score) as m, stddev_samp(best_score) as s from l group by 1, 2)
  select m.data, heuristic, round(m, 5) as mean_best, round(s, 5) as std_best, lo, hi, round(greatest(0, least(1, (m - lo) / nullif(hi - lo, 0))), 6) as position, round(s / nullif(hi - lo, 0), 6) as std_norm from m left join b on m.data = b.data""")
def score_range_position(spark: SparkSession, d: str) -> DataFrame:
    found = runlog.score_positions(_runs(spark, d))
    return found.withColumns({"mean_best": r("mean_best", 5), "std_best": r("std_best", 5), "position": r("position"), "std_norm": r("std_norm")})


@query(f"""with {_L}, t as (select *, regexp_extract_all(translate(clusters, '−–﹣－', '----'), '-?[01]') as v from l where regexp_matches(file, '^([a-zA-Z0-9_-]+)_(lp|ls|rd|sls|exp)_([0-9]+)_([0-9]+)\\.log$'))
  select data, heuristic, k, run, "D", n, {_FIN.format('cpu_time')} as cpu_time, {_FIN.format('wall_time')} as wall_time, case when len(v) > 0 then {_FIN.format('best_score')} * 1e9 end as best_score, case when len(v) > 0 and best_score is not null then array_to_string(v, ',') end as clusters,
  len(all_bar_scores) + (case when len(v) > 0 and best_score is not null then 1 else 0 end) as n_scores from t""")
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    """The runs written as logs, scores with exponents, and read again."""
    minus = F.translate("clusters", "−–﹣－", "----")
    runs = _runs(spark, d).withColumn("v", F.nullif(F.array_join(F.regexp_extract_all(minus, F.lit("(-?[01])"), F.lit(1)), ";"), F.lit("")))
    found = runlog.parse_logs(runlog.log_text(runs.withColumn("best_score", F.col("best_score") * 1e9), "v"))
    return found.select(*found.columns[:9], F.array_join(F.transform("clusters", lambda x: x.cast("string")), ",").alias("clusters"), F.size("all_bar_scores").alias("n_scores"))


_SOL = r"""b as (select *, rtrim(regexp_replace(trim(regexp_replace(translate(clusters, '−–﹣－', '----'), '["''\[\](){}<>+]', '', 'g'), e' \n\r\t'), '[ \n\r]*[,;|/\t][ \n\r]*|[ \n\r]+', ';', 'g'), ';') as c from l where trim(clusters, e' \n\r\t') <> ''),
  s as (select *, list_transform(string_split(c, ';'), lambda x, i: case when x = '' then '?' || i else x end) as v from b where c <> '')"""
_ARI = f"""with {_L}, {_SOL}, p as (select a.data, a.heuristic, a.k, a.v as x, b.v as y, a.log_id as i, b.log_id as j, len(a.v) as n from s a join s b on a.data = b.data and a.heuristic = b.heuristic and a.k = b.k and a.log_id < b.log_id and len(a.v) = len(b.v)),
  e as (select data, heuristic, k, i, j, n, unnest(x) as x, unnest(y) as y from p), cell as (select data, heuristic, k, i, j, n, x, y, count(*) as c from e group by all), ra as (select i, j, x, sum(c) as c from cell group by all), rb as (select i, j, y, sum(c) as c from cell group by all),
  t as (select data, heuristic, k, i, j, n, sum(c * (c - 1) / 2) as cc from cell group by all), u as (select i, j, sum(c * (c - 1) / 2) as rr from ra group by all), w as (select i, j, sum(c * (c - 1) / 2) as ss from rb group by all),
  f as (select data, heuristic, k, case when n <= 1 or (rr + ss) / 2 - rr * ss / (n * (n - 1) / 2) = 0 then 1 else (cc - rr * ss / (n * (n - 1) / 2)) / ((rr + ss) / 2 - rr * ss / (n * (n - 1) / 2)) end as ari from t join u using (i, j) join w using (i, j)),
  g as (select data, heuristic, k, count(*) as pairs, avg(ari) as mean_ari from f group by 1, 2, 3)"""


def _agreement(spark: SparkSession, d: str) -> DataFrame:
    """In every notation; an entry left empty keeps its position and equals no other entry, so it is a label of its own."""
    runs = _runs(spark, d)
    entries = packed.split_packed(runs, "log_id", "clusters", integers=True)
    label = F.when(F.col("val") == "", F.concat(F.lit("?"), F.col("pos"))).otherwise(F.col("val"))
    vectors = entries.groupBy(F.col("row_key").alias("log_id")).agg(F.array_sort(F.collect_list(F.struct("pos", label.alias("val"))))["val"].alias("v"))
    solved = runs.select("log_id", "data", "heuristic", "k").join(vectors, "log_id")
    return runlog.ari_pairs(solved, ["data", "heuristic", "k"], "log_id", "v")


@query(_ARI + " select data, heuristic, k, pairs, round(mean_ari, 6) as mean_ari from g")
def ari_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _agreement(spark, d).withColumn("mean_ari", r("mean_ari"))


@query(_ARI + " select heuristic, round(avg(mean_ari), 6) as mean, round(stddev_samp(mean_ari), 6) as std from g group by 1")
def ari_by_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return runlog.mean_ari(_agreement(spark, d), ["heuristic"]).withColumns({"mean": r("mean"), "std": r("std")})


@query(_ARI + """ select 'data_heuristic' as level, data, heuristic, round(avg(mean_ari), 6) as mean, round(stddev_samp(mean_ari), 6) as std from g group by data, heuristic
  union all select 'heuristic', null, heuristic, round(avg(mean_ari), 6), round(stddev_samp(mean_ari), 6) from g group by heuristic""")
def ari_levels(spark: SparkSession, d: str) -> DataFrame:
    return runlog.ari_levels(_agreement(spark, d)).withColumns({"mean": r("mean"), "std": r("std")})


_R = "r as (select distinct on (result_id) * from run_results order by result_id)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_results").dropDuplicates(["result_id"])


@query(f"""with {_R}, u as (select label, pushdown, ratio_prop_dropped as ratio, 'time_total' as metric, "time_total" as v from r union all select label, pushdown, ratio_prop_dropped, 'time_indicators', "time_Indicators" from r
  union all select label, pushdown, ratio_prop_dropped, 'time_validation', "time_Validation" from r) select label, pushdown, ratio, metric, round(avg(v), 6) as mean, round(coalesce(stddev_samp(v), 0), 6) as std from u where label is not null and pushdown is not null and ratio is not null group by 1, 2, 3, 4""")
def pushdown_compare(spark: SparkSession, d: str) -> DataFrame:
    return runlog.compare_pushdown(_results(spark, d)).withColumns({"mean": r("mean"), "std": r("std")})


@query(f"""with {_R} select database, label, arg_min("N", result_id) filter (where "N" is not null) as "N", arg_min("E", result_id) filter (where "E" is not null) as "E", round(avg("time_Indicators"), 6) as "time_Indicators", round(avg(time_total), 6) as time_total from r group by 1, 2""")
def avg_time_by_label(spark: SparkSession, d: str) -> DataFrame:
    small = _results(spark, d).select("result_id", "database", "label", "N", "E", "time_Indicators", "time_total")
    return runlog.average_times(small, ["result_id"]).withColumns({"time_Indicators": r("time_Indicators"), "time_total": r("time_total")})


_TIMES = ["N", "E", "time_Cardinalities", "time_Indicators", "time_Validation", "time_total"]


@query(f"""with {_R}, w as (select {', '.join(f'"{t}"' for t in _TIMES)} from r where {' and '.join(f'"{t}" is not null and not isnan("{t}"::double)' for t in _TIMES)}), k as (select {', '.join(f'rank() over (order by "{t}") + (count(*) over (partition by "{t}") - 1) / 2 as "{t}"' for t in _TIMES)} from w),
  p as ({' union all '.join(f"""select '{a}' as a, '{b}' as b, corr("{a}", "{b}") as x from k""" for i, a in enumerate(_TIMES) for b in _TIMES[i + 1 :])}) select a, b, round(x, 6) as r from p""")
def spearman_times(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of sizes and times over the run results."""
    needed = runlog.assert_columns(_results(spark, d), _TIMES)
    return validate.spearman_pairs(needed.select(*(F.col(t.lower()).alias(t) for t in _TIMES)), _TIMES).withColumn("r", r("r"))


@query(f"""with {_R}, m as (select database, avg("time_Indicators") as a, avg("time_Validation") as b from r group by 1) select database, unnest(['time_Indicators', 'time_Validation']) as metric, unnest([round(a, 6), round(b, 6)]) as value from m""")
def mean_melt(spark: SparkSession, d: str) -> DataFrame:
    return runlog.melted_means(_results(spark, d), ["database"], ["time_Indicators", "time_Validation"]).withColumn("value", r("value"))


@query(f"""with {_L}, m as (select heuristic, avg({_FIN.format('cpu_time')}) as m, stddev_samp({_FIN.format('cpu_time')}) as s from l group by 1), v as (select *, least(2, s / m) as cv from m)
  select heuristic, round(least(s, m), 5) as down, round(s, 5) as up, round(m - m / exp(sqrt(ln(1 + cv * cv))), 4) as log_down, round(m * exp(sqrt(ln(1 + cv * cv))) - m, 4) as log_up from v""")
def asym_error(spark: SparkSession, d: str) -> DataFrame:
    found = runlog.aggregate_runs(_runs(spark, d), ["heuristic"], ["cpu_time"])
    down, up = runlog.error_bars(F.col("cpu_time_mean"), F.col("cpu_time_std"), False)
    low, high = runlog.error_bars(F.col("cpu_time_mean"), F.col("cpu_time_std"), True)
    return found.select("heuristic", r(down, 5).alias("down"), r(up, 5).alias("up"), r(low, 4).alias("log_down"), r(high, 4).alias("log_up"))


@query(f"""with {_L}, f as (select cpu_time as v from l where isfinite(cpu_time) and cpu_time > 0) select min(v) > 0 and max(v) / min(v) >= 50 as log from f""")
def log_scale_choice(spark: SparkSession, d: str) -> DataFrame:
    return runlog.log_scale(_runs(spark, d).select(finite(F.col("cpu_time")).alias("v")).where("v > 0"), "v")


@query(f"""with {_L}, f as (select * from l where isfinite(wall_time)) select case grouping_id(heuristic, data, k, "D", n) when 15 then 'heuristic' when 7 then 'heuristic_data' when 11 then 'heuristic_k' when 13 then 'heuristic_D' when 14 then 'heuristic_n' end as chart,
  heuristic, data, k, "D", n, round(avg(wall_time), 5) as mean, round(stddev_samp(wall_time), 4) as std, count(*) as runs from f group by grouping sets ((heuristic), (heuristic, data), (heuristic, k), (heuristic, "D"), (heuristic, n))""")
def chart_tables(spark: SparkSession, d: str) -> DataFrame:
    return runlog.chart_tables(_runs(spark, d), "wall_time").withColumns({"mean": r("mean", 5), "std": r("std", 4)})


@query(f"""with {_R} select result_id, run, label, "indicators#" as n_kept, "indicators#" + 5 as n_all, round(100.0 * 5 / ("indicators#" + 5), 6) as ratio_prop_dropped from r""")
def run_result_rows(spark: SparkSession, d: str) -> DataFrame:
    measured = _results(spark, d).select("result_id", "run", "label", F.col("indicators#").alias("n_kept"), (F.col("indicators#") + 5).alias("n_all"))
    return runlog.result_rows(measured).withColumn("ratio_prop_dropped", r("ratio_prop_dropped"))


@query("""select d as data, h as heuristic, k::int as k, x::int as run from (select unnest(['petals', 'soccer']) as d), (select unnest(['lp', 'ls', 'rd', 'sls', 'exp']) as h), (select unnest([2, 3, 4, 5]) as k), (select unnest([0, 1, 2, 3, 4]) as x) where h <> 'exp' or x = 0""")
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    return runlog.experiment_grid(spark, ["petals", "soccer"])


@query("""select p as pushdown, n as null_ratio, x::int as run from (select unnest([false, true]) as p), (select unnest([0.1, 0.3, 0.5, 0.7, 0.9])::double as n), (select unnest([0, 1, 2]) as x)""")
def pushdown_grid(spark: SparkSession, d: str) -> DataFrame:
    return runlog.pushdown_grid(spark, 3)


@query("""select a.c_custkey, c_name, null as o_orderkey, 'customer' as source_file from customer a union all select o_custkey, null, o_orderkey, 'orders' from orders""")
def csv_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select("c_custkey", "c_name", F.lit("customer").alias("source_file"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.lit("orders").alias("source_file"))
    return a.unionByName(b, allowMissingColumns=True)


# primitives


@query("""select c_custkey as "id #", c_acctbal as "balance, %", c_name as "na`me" from customer where c_mktsegment = 'BUILDING'""")
def project_quoted(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").select(F.col("c_custkey").alias("id #"), F.col("c_acctbal").alias("balance, %"), F.col("c_name").alias("na`me"), "c_mktsegment")
    return spark.sql("select `id #`, `balance, %`, `na``me` from {t} where c_mktsegment = :segment", args={"segment": "BUILDING"}, t=named)


@query("""select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 20 and l_returnflag in ('A', 'R') and l_shipdate is not null and l_discount between 0.02 and 0.04 and contains(l_linestatus, 'F') and regexp_full_match(l_returnflag, '[AR]')""")
def predicate_mix(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    where = (F.col("l_quantity") >= 20) & F.col("l_returnflag").isin("A", "R") & F.col("l_shipdate").isNotNull() & F.col("l_discount").between(0.02, 0.04) & F.col("l_linestatus").contains("F") & F.col("l_returnflag").rlike("^[AR]$")
    return line.where(where).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""select id, list_contains(labels, 'Country') as is_country, len(list_filter(labels, lambda x: x = 'Country')) = len(labels) as all_country, len(list_filter(labels, lambda x: x like 'C%')) > 0 as any_c from countries""")
def list_predicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "countries").select("id", F.array_contains("labels", "Country").alias("is_country"), F.forall("labels", lambda x: x == "Country").alias("all_country"), F.exists("labels", lambda x: x.startswith("C")).alias("any_c"))


@query("""select id, array_to_string(list_transform(list_filter(labels, lambda x: len(x) > 3), lambda x: upper(x) || '_' || id), '|') as names from countries""")
def list_comprehension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "countries").select("id", F.array_join(F.transform(F.filter("labels", lambda x: F.length(x) > 3), lambda x: F.concat(F.upper(x), F.lit("_"), F.col("id").cast("string"))), "|").alias("names"))


@query("""select p_partkey, p_size from part""")
def solution_mask(spark: SparkSession, d: str) -> DataFrame:
    columns = ["p_retailprice", "p_size"]
    return table(spark, d, "part").select("p_partkey", *search.mask((-1, 1), columns, 1))


@query("""select c_custkey as "key", trim(lower(c_mktsegment)) as segment, c_acctbal as balance from customer where c_acctbal is not null""")
def rename_and_filter(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").select("c_custkey", F.trim(F.lower("c_mktsegment")).alias("segment"), "c_acctbal").withColumnsRenamed({"c_custkey": "key", "c_acctbal": "balance"})
    return named.na.drop(subset=["balance"])


@query("""select n_regionkey as region, array_to_string(list_sort(list(n_name)), ',') as names, len(list(distinct n_name)) as n from nation group by 1""")
def collect_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.size(F.collect_set("n_name")).alias("n"))


@query("select distinct event_type from events")
def distinct_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type").distinct()


@query("""select id, unnest(['latitude', 'physicians']) as property, unnest([case when not isnan(latitude) then latitude end, case when not isnan(physicians) then physicians end]) as value from countries""")
def unwind_properties(spark: SparkSession, d: str) -> DataFrame:
    countries = table(spark, d, "countries").select("id", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("latitude", "physicians")))
    return countries.unpivot("id", ["latitude", "physicians"], "property", "value")


@query("""select id, case when country_name is not null then country_name else 'none' end as name, id * 2 as twice from countries""")
def map_merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    first = F.create_map(F.lit("name"), F.lit("none"), F.lit("twice"), F.lit("0"))
    second = F.map_filter(F.create_map(F.lit("name"), F.col("country_name"), F.lit("twice"), (F.col("id") * 2).cast("string")), lambda _, v: v.isNotNull())
    merged = table(spark, d, "countries").select("id", merge_maps(first, second).alias("m"))
    return merged.select("id", F.col("m")["name"].alias("name"), F.col("m")["twice"].cast("long").alias("twice"))


@query("""select * from (values (':`Airport`', 'Airport', 'AIRPORT', 7, 'Air', 'Airport_x'), (':City', 'City', 'CITY', 4, 'Cit', 'City_x'), ('Country', 'Country', 'COUNTRY', 7, 'Cou', 'Country_x')) v(raw, name, upper_name, size, head, prefixed)""")
def string_cleanup(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.createDataFrame([(":`Airport`",), (":City",), ("Country",)], "raw string")
    name = element_name(F.col("raw"))
    return raw.select("raw", name.alias("name"), F.upper(name).alias("upper_name"), F.length(name).alias("size"), F.substring(name, 1, 3).alias("head"), F.concat_ws("_", name, F.lit("x")).alias("prefixed"))


@query(f"""with {_L} select log_id, case when isfinite(cpu_time) then cpu_time end as cpu_time, try_cast(clusters as double) as number, coalesce(wall_time, -1) as wall_time from l""")
def cast_and_nan(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("log_id", finite(F.col("cpu_time")).alias("cpu_time"), F.col("clusters").try_cast("double").alias("number"), F.coalesce("wall_time", F.lit(-1.0)).alias("wall_time"))


@query("""select p_partkey, round(sqrt(p_retailprice), 6) as root, round(ln(p_retailprice), 6) as log, round(exp(p_size / 10), 4) as e, p_size ** 2 as square, abs(p_size - 25) as off, least(p_size, 30) as low, greatest(p_size, 20) as high from part""")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", r(F.sqrt("p_retailprice")).alias("root"), r(F.ln("p_retailprice")).alias("log"), r(F.exp(size / 10), 4).alias("e"), F.pow(size, F.lit(2)).alias("square"), F.abs(size - 25).alias("off"), F.least(size, F.lit(30)).alias("low"), F.greatest(size, F.lit(20)).alias("high"))


@query(f"""with {_L}, a as (select data, heuristic, count(*) as runs from l where heuristic in ('lp', 'ls', 'rd', 'sls', 'exp') group by 1, 2) select data, heuristic, runs, row_number() over (order by data, list_position(['lp', 'ls', 'rd', 'sls', 'exp'], heuristic))::int as place from a""")
def ordering_rules(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counted = _runs(spark, d).where(F.col("heuristic").isin(*runlog.HEURISTICS)).groupBy("data", "heuristic").agg(F.count("*").alias("runs"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("data", runlog.heuristic_order(F.col("heuristic")))))


@query("""with c as (select n_nationkey, round(avg(c_acctbal), 6) as a from nation left join customer on c_nationkey = n_nationkey group by 1), s as (select n_nationkey, round(avg(s_acctbal), 6) as a from nation left join supplier on s_nationkey = n_nationkey group by 1)
  select 'SUPP_IN' as "column", 'dropped' as action, 'unwanted' as reason, null::double as null_ratio, null::double as distinct_ratio, 'bigint' as dtype_before
  union all select 'CUST_IN__neighbor__avg_c_acctbal', 'kept', null, round(1 - count(a) / count(*), 9), round(count(distinct a) / count(a), 9), 'double' from c
  union all select 'SUPP_IN__neighbor__avg_s_acctbal', 'kept', null, round(1 - count(a) / count(*), 9), round(count(distinct a) / count(a), 9), 'double' from s""")
def report_concat(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline's order: suffixes, then correlation, then density and distinctness; reports one under another."""
    kept, first = validate.drop_suffixes(indicator_table_nations(spark, d).drop("CUST_IN"), ["SUPP_IN"])
    kept, second = validate.drop_correlated(kept, 0.999)
    return first.unionByName(second).unionByName(validate.process(kept, 0.9, 1e-6, 1.0)[1]).withColumns({"null_ratio": r("null_ratio", 9), "distinct_ratio": r("distinct_ratio", 9)})


@query("""select o_orderkey as outid, o_totalprice from orders join customer on o_custkey = c_custkey where o_totalprice > 100000 and not ends_with(o_orderpriority, 'LOW')""")
def semi_and_suffix(spark: SparkSession, d: str) -> DataFrame:
    graph = trade(spark, d)
    placed = graph.of_type("PLACED_BY")[0].table.select(F.col("src").alias("id"))
    found = graph.label("orders").join(placed, "id", "left_semi").where((F.col("o_totalprice") > 100000) & ~ends_with_any(F.col("o_orderpriority"), ["LOW"]))
    return found.select(F.col("id").alias("outid"), "o_totalprice")


@query("""with c as (select n_nationkey, avg(c_acctbal) as a from nation left join customer on c_nationkey = n_nationkey group by 1), s as (select n_nationkey, avg(s_acctbal) as a from nation left join supplier on s_nationkey = n_nationkey group by 1),
  g as (select 3 + (select (count(*) = count(a))::int from c) + (select (count(*) = count(a))::int from s) as n) select 'plain' as variant, count(*) as n_rows, 5 as n_columns from nation union all select 'class', count(*), 4 from nation union all select 'complete', count(*), (select n from g)::int from nation""")
def csv_load_variants(spark: SparkSession, d: str) -> DataFrame:
    """An indicator table written as CSV to the shared folder and read back with each of the loader's options."""
    path = f"{shared_folder(spark)}/nations-{uuid.uuid4().hex}"
    files.write_csv(indicator_table_nations(spark, d), path)
    variants = {"plain": {}, "class": {"drop_class": True}, "complete": {"drop_incomplete": True}}
    out = None
    for name, options in variants.items():
        one = files.load_indicators(spark, path, **options)
        row = one.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("variant"), "n_rows", F.lit(len(one.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def _csv_folder(spark: SparkSession, d: str) -> str:
    """Two tables of different columns as CSV files of one folder."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_acctbal").write.mode("append").option("header", True).csv(path)
    return path


@query("""select n_nationkey::bigint as n_nationkey, n_name, null::bigint as s_suppkey, null::double as s_acctbal from nation union all select s_nationkey, null, s_suppkey, s_acctbal from supplier""")
def csv_directory(spark: SparkSession, d: str) -> DataFrame:
    """A folder of CSV files with different columns read as one table."""
    found = files.read_csv_directory(spark, _csv_folder(spark, d))
    return found.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("""select 2 as n_columns, count(*) as n_rows from nation union all select 3, count(*) from supplier""")
def csv_directory_summary(spark: SparkSession, d: str) -> DataFrame:
    return files.summarize_csv_directory(spark, _csv_folder(spark, d)).groupBy("n_columns").agg(F.sum("n_rows").alias("n_rows"))


@query("""select user_id, event_type, count(*) as degree from events where user_id is not null group by 1, 2""")
def event_degrees(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming extension."""
    from graphlume.streaming.degrees import degrees_by_type

    return degrees_by_type(table(spark, d, "events"))


@query("""select outid, "CUST_IN" from (select n_nationkey::bigint as outid, (select count(*) from customer where c_nationkey = n_nationkey) as "CUST_IN" from nation)""")
def degree_only(spark: SparkSession, d: str) -> DataFrame:
    return collect.in_degrees(trade(spark, d), "nation").select(F.col("id").alias("outid"), "CUST_IN")
