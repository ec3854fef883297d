"""Queries: validation, metrics, kernels, search, insights, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlume.operators import collect, context, insights, kernels, metrics, search, validate
from graphlume.plans.base import MANY_TO_ONE, query, r, trade
from graphlume.session import cut, table

NUMBERS = ["Airport_latitude", "Airport_altitude", "City_population", "Country_infant_mortality", "Country_physicians", "ROUTE_TO__rel__avg_distance", "ROUTE_TO__neighbor__sum_runways"]
_CLEAN = "select outid, load_day, " + ", ".join(f'case when not isnan("{c}") then "{c}" end as "{c}"' for c in NUMBERS) + " from (select distinct on (outid, load_day) * from node_indicators order by outid, load_day)"


def loads(spark: SparkSession, d: str) -> DataFrame:
    """The nodes' loads, each once: an indicator table with ``outid`` first."""
    return table(spark, d, "node_indicators").dropDuplicates(["outid", "load_day"]).select("outid", *NUMBERS)


def _long(select: str) -> str:
    return " union all ".join(select.format(c=c, i=i) for i, c in enumerate(NUMBERS))


@query(f"with t as ({_CLEAN}) " + _long("""select '{c}' as "column", count(*) as n, count("{c}") as n_present, count(distinct "{c}") as n_distinct, round(1 - count("{c}") / count(*), 9) as null_ratio,
  round(count(distinct "{c}") / count("{c}"), 9) as distinct_ratio from t"""))
def profile_null_distinct(spark: SparkSession, d: str) -> DataFrame:
    return validate.profile(loads(spark, d), NUMBERS).withColumns({"null_ratio": r("null_ratio", 9), "distinct_ratio": r("distinct_ratio", 9)})


_PROFILE = f"with t as ({_CLEAN}), p as (" + _long("""select '{c}' as "column", {i} as i, 1 - count("{c}") / count(*) as nr, count(distinct "{c}") / count("{c}") as dr from t""") + ")"


@query(_PROFILE + """ select "column", case when nr > 0.05 or dr < 0.02 or dr > 0.9 then 'dropped' else 'kept' end as action, case when nr > 0.05 then 'null_ratio' when dr < 0.02 then 'distinct_low' when dr > 0.9 then 'distinct_high' end as reason,
  round(nr, 9) as null_ratio, round(dr, 9) as distinct_ratio, 'double' as dtype_before from p""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.process(loads(spark, d), 0.05, 0.02, 0.9)[1].withColumns({"null_ratio": r("null_ratio", 9), "distinct_ratio": r("distinct_ratio", 9)})


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
_PEARSON = f"with t as ({_CLEAN}), p as (" + " union all ".join(f"""select '{a}' as a, '{b}' as b, corr("{a}", "{b}") as x from t""" for a, b in _PAIRS) + ")"


@query(_PEARSON + " select a, b, round(x, 6) as r from p")
def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    return validate.pearson_pairs(loads(spark, d), NUMBERS).withColumn("r", r("r"))


_SMALL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""with c as (select corr(l_quantity, l_extendedprice) x from lineitem) select 'l_extendedprice' as "column", 'dropped' as action, 'correlated with l_quantity' as reason, null::double as null_ratio, null::double as distinct_ratio,
  'double' as dtype_before from c where abs(x) > 0.2""")
def correlated_drop(spark: SparkSession, d: str) -> DataFrame:
    return validate.drop_correlated(table(spark, d, "lineitem").select("l_orderkey", *_SMALL), 0.2)[1]


@query("""select * from (values ('Country_physicians', 'dropped', 'unwanted', null::double, null::double, 'double'), ('ROUTE_TO__neighbor__sum_runways', 'dropped', 'unwanted', null, null, 'double'))
  v("column", action, reason, null_ratio, distinct_ratio, dtype_before)""")
def suffix_drop_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.drop_suffixes(loads(spark, d), ["physicians", "_runways", "outid"])[1]


_WHOLE = " and ".join(f'"{c}" is not null' for c in NUMBERS)


def _nan_as_null(spark: SparkSession, d: str) -> DataFrame:
    return loads(spark, d).select("outid", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in NUMBERS))


@query(f"with t as ({_CLEAN}) select outid, {', '.join(f'"{c}"' for c in NUMBERS)} from t where outid is not null and {_WHOLE}")
def drop_null_rows(spark: SparkSession, d: str) -> DataFrame:
    return validate.drop_null_rows(_nan_as_null(spark, d))


@query(f"with t as ({_CLEAN}) select count(*) as n_before, count(*) filter (where outid is not null and {_WHOLE}) as n_after from t")
def null_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return validate.null_row_counts(_nan_as_null(spark, d))


@query("""with k as (select p_retailprice, rank() over (order by p_retailprice) as k, count(*) over (partition by p_retailprice) as c, count(*) over () as n, p_partkey from part)
  select p_partkey, p_retailprice, round((k + (c - 1) / 2 - 1) / (n - 1), 9) as scaled from k""")
def percentile_scale(spark: SparkSession, d: str) -> DataFrame:
    return validate.percentile_scale(table(spark, d, "part"), "p_partkey", "p_retailprice").withColumn("scaled", r("scaled", 9))


@query("""select p_partkey, round((p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ()), 9) as p_size,
  round((p_retailprice - min(p_retailprice) over ()) / (max(p_retailprice) over () - min(p_retailprice) over ()), 9) as p_retailprice, 0::double as one from part""")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    found = validate.minmax_scale(table(spark, d, "part").withColumn("one", F.lit(1)), "p_partkey", ["p_size", "p_retailprice", "one"])
    return found.select("p_partkey", r("p_size", 9).alias("p_size"), r("p_retailprice", 9).alias("p_retailprice"), "one")


def _average_rank(c: str) -> str:
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 as {c}"


@query(f"with k as (select {', '.join(map(_average_rank, _SMALL))} from lineitem), p as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as x from k" for i, a in enumerate(_SMALL) for b in _SMALL[i + 1 :]) + ") select a, b, round(x, 6) as r from p")
def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    return validate.spearman_pairs(table(spark, d, "lineitem"), _SMALL).withColumn("r", r("r"))


# metrics

_FEATURES = NUMBERS
_LONG = f"with t as ({_CLEAN}), l as (" + " union all ".join(f"""select '{c}' as feature, "{c}" as x from t where "{c}" is not null""" for c in _FEATURES) + ")"
_BC = """, m as (select feature, avg(x) as m, count(*) as n from l group by 1), z as (select l.feature, n, avg((x - m) ** 2) as m2, avg((x - m) ** 3) as m3, avg((x - m) ** 4) as m4 from l join m using (feature) group by 1, 2),
  bc as (select feature, n, case when n < 5 then null when m2 = 0 then 0 else (m3 * m3 / (m2 ** 3) + 1) / (m4 / (m2 * m2)) end as bc from z)"""
_CV = """, g as (select feature, x - lag(x) over (partition by feature order by x) as gap from l), cv as (select feature, stddev_pop(gap) / avg(gap) as cv from g where gap is not null group by 1)"""


@query(_LONG + _BC + " select feature, n, round(bc, 6) as bc from bc")
def bimodality(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bimodality(metrics.unpivoted(loads(spark, d), _FEATURES)).withColumn("bc", r("bc"))


@query(_LONG + _CV + " select feature, round(cv, 5) as cv from cv")
def gap_cv(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gap_cv(metrics.unpivoted(loads(spark, d), _FEATURES)).withColumn("cv", r("cv", 5))


@query(_LONG + _BC + _CV + """ select feature, n, round(bc, 6) as bc, round(cv, 5) as cv, case when n < 5 then 'unused' when cv <= 0.05 then 'comparison' when bc > 0.55 then 'clustering' else 'unused' end as category
  from bc join cv using (feature)""")
def feature_categories(spark: SparkSession, d: str) -> DataFrame:
    return metrics.feature_categories(metrics.unpivoted(loads(spark, d), _FEATURES)).withColumns({"bc": r("bc"), "cv": r("cv", 5)})


@query(_LONG + _BC + _CV + """, k as (select feature, n, bc, cv, row_number() over (order by cv, feature) as a, row_number() over (order by bc desc, feature) as b from bc join cv using (feature))
  select feature, n, round(bc, 6) as bc, round(cv, 5) as cv, case when n < 5 then 'unused' when a <= 1 then 'comparison' when b <= 1 then 'clustering' when cv <= 0.05 then 'comparison' else 'unused' end as category from k""")
def feature_categories_ranked(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ranked_categories(metrics.unpivoted(loads(spark, d), _FEATURES), 1, 1).withColumns({"bc": r("bc"), "cv": r("cv", 5)})


_KNN = """with p as (select p_partkey as id, p_size::double as f0, p_retailprice as f1 from part), d as (select a.id as a, b.id as b, row_number() over (partition by a.id order by (a.f0 - b.f0) ** 2 + (a.f1 - b.f1) ** 2, b.id) as k from p a join p b on a.id <> b.id),
  e as (select a, b from d where k <= 5 union select b, a from d where k <= 5), deg as (select a as id, count(*) as g from e group by 1), l as (select id, 'p_size' as feature, f0 as x from p union all select id, 'p_retailprice', f1 from p),
  m as (select feature, sum(x * g) / sum(g) as m from l join deg using (id) group by 1), w as (select feature, sum((x - m) ** 2 * g) as w from l join deg using (id) join m using (feature) group by 1),
  q as (select u.feature, sum((u.x - v.x) ** 2) / 2 as q from e join l u on u.id = e.a join l v on v.id = e.b and v.feature = u.feature group by 1)"""


@query(_KNN + " select feature, round(q / w, 6) as score from q join w using (feature)")
def laplacian_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.laplacian_scores(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"]).withColumn("score", r("score"))


_STANDARD = _KNN.replace("select p_partkey as id, p_size::double as f0, p_retailprice as f1 from part", "select p_partkey as id, (p_size - avg(p_size) over ()) / stddev_pop(p_size) over () as f0, (p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over () as f1 from part")
_RAW = ", raw as (select 'p_size' as feature, p_size::double as x from part union all select 'p_retailprice', p_retailprice from part)"


@query(_STANDARD + _RAW + (_BC + _CV).replace("from l ", "from raw ").replace("from l)", "from raw)").replace(" l.feature", " raw.feature").replace("from l join m", "from raw join m").replace(", m as (", ", mm as (").replace("join m using", "join mm using").replace("as m, count(*) as n from raw", "as m, count(*) as n from raw") + """, sd as (select feature, stddev_pop(x) / avg(x) as v from raw group by 1)
  select feature, round(v, 6) as cv_values, round(cv, 5) as cv_gaps, round(bc, 6) as bc, round(q / w, 6) as laplacian from bc join cv using (feature) join sd using (feature) join q using (feature) join w using (feature)""")
def metric_table(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.metric_table(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return found.withColumns({"cv_values": r("cv_values"), "cv_gaps": r("cv_gaps", 5), "bc": r("bc"), "laplacian": r("laplacian")})


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """The indicator table of the customers with orders, scaled to 0..1: it grows with the data."""
    found = validate.drop_null_rows(collect.indicators(trade(spark, d), "customer", MANY_TO_ONE, ["PLACED_BY"]))
    return cut(validate.minmax_scale(found, "outid", found.columns[1:]))


@query()
def knee_split(spark: SparkSession, d: str) -> DataFrame:
    small = _customers(spark, d)
    columns = small.columns[1:]
    return metrics.knee_split(metrics.laplacian_scores(small, "outid", columns), metrics.gap_cv(metrics.unpivoted(small, columns)))


@query()
def dip_statistic(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dip_statistics(metrics.unpivoted(table(spark, d, "part"), ["p_size", "p_retailprice"]))


@query()
def column_kmeans(spark: SparkSession, d: str) -> DataFrame:
    small = _customers(spark, d)
    return metrics.column_groups(metrics.gap_cv(metrics.unpivoted(small, small.columns[1:])), "cv", 2)


# kernels: parts labelled by size class; clustering on the price, comparison on the size


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_size") % 4).alias("label"))


_PAIR_SUMS = """with p as (select p_partkey as id, p_size as y, p_retailprice as x, p_size % 4 as c from part), s as (select a.c, sum(abs(a.y - b.y)) as l1, sum((a.x - b.x) ** 2) as l2 from p a join p b on a.c = b.c and a.id < b.id{} group by 1)"""


@query(_PAIR_SUMS.format("") + " select round(0.5 * sum(l1) - 0.5 * sum(l2), 0) as objective from s")
def objective_pairs(spark: SparkSession, d: str) -> DataFrame:
    return kernels.objective(_parts(spark, d), ["p_retailprice"], ["p_size"]).withColumn("objective", r("objective", 0))


@query(_PAIR_SUMS.format("") + " select round(sum(l1), 3) as compared_sum, round(sum(l2), 0) as clustered_sum from s")
def bi_objective(spark: SparkSession, d: str) -> DataFrame:
    return kernels.objective_parts(_parts(spark, d), ["p_retailprice"], ["p_size"]).withColumns({"compared_sum": r("compared_sum", 3), "clustered_sum": r("clustered_sum", 0)})


@query(_PAIR_SUMS.format(" and a.c < 3") + " select round(0.5 * sum(l1) - 0.5 * sum(l2), 0) as objective from s")
def objective_skip_last(spark: SparkSession, d: str) -> DataFrame:
    return kernels.objective(_parts(spark, d), ["p_retailprice"], ["p_size"], skip_last=True).withColumn("objective", r("objective", 0))


_START = "c0 as (select row_number() over (order by p_partkey) - 1 as j, p_size::double as s, p_retailprice as t from part qualify row_number() over (order by p_partkey) <= 3)"
_ASSIGN = "select p_partkey, p_size, p_retailprice, arg_min(j, ((p_size - s) ** 2 + (p_retailprice - t) ** 2, j))::int as label from part, {} group by 1, 2, 3"


@query("select p_partkey as id, p_size::double as p_size, p_retailprice from part order by p_partkey limit 3")
def start_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = kernels.start_rows(table(spark, d, "part"), "p_partkey", ["p_partkey", "p_size", "p_retailprice"], 3)
    return spark.createDataFrame([(int(i), s, p) for i, s, p in rows], "id long, p_size double, p_retailprice double")


@query(f"with {_START}, a as ({_ASSIGN.format('c0')}) select p_partkey, label from a")
def kmeans_assign_step(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    centres = kernels.start_rows(part, "p_partkey", ["p_size", "p_retailprice"], 3)
    return kernels.assign(part, ["p_size", "p_retailprice"], centres).select("p_partkey", F.col("label").cast("int").alias("label"))


@query(f"with {_START}, a as ({_ASSIGN.format('c0')}), c1 as (select label as j, avg(p_size) as s, avg(p_retailprice) as t from a group by 1), b as ({_ASSIGN.format('c1')}) select p_partkey, label from b")
def kmeans_two_steps(spark: SparkSession, d: str) -> DataFrame:
    part, columns = table(spark, d, "part"), ["p_size", "p_retailprice"]
    first = kernels.assign(part, columns, kernels.start_rows(part, "p_partkey", columns, 3))
    centres = [[x["p_size"], x["p_retailprice"]] for x in kernels.means(first, columns).orderBy("label").collect()]
    return kernels.assign(part, columns, centres).select("p_partkey", F.col("label").cast("int").alias("label"))


_U = "1 / ((greatest((x - {0}) ** 2, 1e-12) / greatest((x - 1000) ** 2, 1e-12)) ** (1 / 1.5) + (greatest((x - {0}) ** 2, 1e-12) / greatest((x - 1500) ** 2, 1e-12)) ** (1 / 1.5))"
_V = "1 / ((greatest(abs(y - {0}), 1e-12) / greatest(abs(y - 10), 1e-12)) ** (1 / 1.5) + (greatest(abs(y - {0}), 1e-12) / greatest(abs(y - 40), 1e-12)) ** (1 / 1.5))"


@query(f"with p as (select p_partkey, p_retailprice as x, p_size::double as y from part) select p_partkey, round({_U.format(1000)}, 6) as u0, round({_U.format(1500)}, 6) as u1, round({_V.format(10)}, 6) as v0, round({_V.format(40)}, 6) as v1 from p")
def fcm_step(spark: SparkSession, d: str) -> DataFrame:
    found = kernels.fcm_step(_parts(spark, d), ["p_retailprice"], ["p_size"], [[1000.0], [1500.0]], [[10.0], [40.0]])
    return found.select("p_partkey", *(r(c).alias(c) for c in ("u0", "u1", "v0", "v1")))


@query("select p_partkey, round((p_retailprice / 1000 - 1.2) ** 2 - abs(p_size / 50 - 0.5), 6) as distance from part")
def medoid_distance_step(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("x"), (F.col("p_size") / 50).alias("y"))
    return part.select("p_partkey", r(kernels.medoid_distance(["x"], ["y"], [1.2], [0.5])).alias("distance"))


@query("""with p as (select s_suppkey as id, s_acctbal as x, s_nationkey % 3 as c from supplier), m as (select a.id, a.c, b.c as o, sum(abs(a.x - b.x)) as s, count(*) as n from p a, p b group by 1, 2, 3),
  e as (select id, max(case when c = o and n > 1 then s / (n - 1) end) as a, min(case when c <> o then s / n end) as b from m group by 1) select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from e""")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "supplier").withColumn("label", F.col("s_nationkey") % 3)
    return kernels.silhouette(labelled, "s_suppkey", ["s_acctbal"]).withColumn("silhouette", r("silhouette"))


@query("select p_size % 4 as label, count(*) as members, (count(*) * (count(*) - 1) // 2)::bigint as pairs from part group by 1")
def co_membership(spark: SparkSession, d: str) -> DataFrame:
    return search.co_membership(_parts(spark, d), "p_partkey")


def _searched(spark: SparkSession, d: str, method: str, kernel: str = "kmeans") -> DataFrame:
    small = _customers(spark, d)
    columns = small.columns[1:]
    problem = search.Problem(small, "outid", columns, 2, kernel)
    solution, score = search.search(problem, method)
    return spark.createDataFrame([(method, list(solution), float(score))], "method string, solution array<int>, score double")


@query()
def search_random(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, "rd")


@query()
def search_smart(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, "lp")


@query()
def search_local(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, "ls")


@query()
def search_smart_local(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, "sls")


@query()
def search_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, "exp")


@query()
def cluster_medoids(spark: SparkSession, d: str) -> DataFrame:
    small = _customers(spark, d)
    return kernels.cluster(small, "outid", small.columns[1:3], small.columns[3:], 3, "fcm2")


@query()
def cluster_dual_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    small = _customers(spark, d)
    return kernels.cluster(small, "outid", small.columns[1:3], small.columns[3:], 3, "fcm")


# insights: parts by size class


@query("select 'p_size' as feature, min(p_size)::double as lo, max(p_size)::double as hi from part union all select 'p_retailprice', min(p_retailprice), max(p_retailprice) from part union all select 'one', 0, 2")
def feature_ranges(spark: SparkSession, d: str) -> DataFrame:
    return insights.feature_ranges(table(spark, d, "part").withColumn("one", F.lit(1.0)), ["p_size", "p_retailprice", "one"])


@query("select 'p_size' as feature, quantile_cont(p_size, 0.05) as lo, quantile_cont(p_size, 0.95) as hi from part union all select 'p_retailprice', round(quantile_cont(p_retailprice, 0.05), 6), round(quantile_cont(p_retailprice, 0.95), 6) from part")
def feature_ranges_percentile(spark: SparkSession, d: str) -> DataFrame:
    return insights.feature_ranges(table(spark, d, "part"), ["p_size", "p_retailprice"], 5, 95).withColumns({"lo": r("lo"), "hi": r("hi")})


@query("""with l as (select c_nationkey as label, 'c_acctbal' as feature, c_acctbal as value from customer union all select c_nationkey, 'c_custkey', c_custkey from customer), s as (select label, feature, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, count(*) as n from l group by 1, 2)
  select label, feature, round(mean, 5) as mean, round(std, 5) as std, n, row_number() over (partition by label order by std, n desc, feature)::int as rank from s qualify row_number() over (partition by label order by std, n desc, feature) <= 1""")
def cluster_low_std(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "customer").withColumn("label", F.col("c_nationkey"))
    return insights.tightest(labelled, ["c_acctbal", "c_custkey"], 1).withColumns({"mean": r("mean", 5), "std": r("std", 5)})


_TOP = """with p as (select p_partkey as id, p_size as y, p_retailprice as x, p_size % 4 as label from part), d as (select a.label, a.id as a, b.id as b, abs(a.y - b.y) + abs(a.x - b.x) as s from p a join p b on a.label = b.label and a.id < b.id),
  k as (select label, row_number() over (partition by label order by round(s, 9) desc, a, b)::int as rank, a, b, round(s, 6) as score from d qualify row_number() over (partition by label order by round(s, 9) desc, a, b) <= 3)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    return insights.top_pairs(parts, "p_partkey", ["p_size", "p_retailprice"], 3)


@query(_TOP + " select * from k")
def topk_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("score", r("score"))


@query(_TOP + """, f as (select k.label, rank, a, b, 'p_size' as feature, u.y::double as va, v.y::double as vb from k join p u on u.id = a join p v on v.id = b union all select k.label, rank, a, b, 'p_retailprice', u.x, v.x from k join p u on u.id = a join p v on v.id = b),
  o as (select *, abs(va - vb) as diff, row_number() over (partition by label, rank order by abs(va - vb) desc, feature) as place from f)
  select o.label, o.rank, o.a, o.b, o.feature, o.va, o.vb, round(o.diff, 6) as diff, o.place::int as place, round(w.diff, 6) as hidden from o join o w on w.label = o.label and w.rank = o.rank and w.place = 2 where o.place = 1""")
def topk_pairs_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    found = insights.side_by_side(_pairs(spark, d), table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], 1)
    return found.withColumns({"diff": r("diff"), "hidden": r("hidden")})


@query(_TOP + """ select k.*, concat('p_name=', u.p_name, ', p_size=', u.p_size) as info_a, concat('p_name=', v.p_name, ', p_size=', v.p_size) as info_b from k join part u on u.p_partkey = a join part v on v.p_partkey = b""")
def topk_pairs_with_info(spark: SparkSession, d: str) -> DataFrame:
    return insights.with_info(_pairs(spark, d).withColumn("score", r("score")), table(spark, d, "part"), "p_partkey", ["p_name", "p_size"])


@query("select p_partkey, round(least(1, greatest(0, (p_retailprice - 1000) / 500)), 9) as scaled from part")
def radar_scaled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", r(insights.radar(F.col("p_retailprice"), F.lit(1000.0), F.lit(1500.0)), 9).alias("scaled"))


@query(_TOP + """, t as (select p_size % 4 as label, count(*) as n from part group by 1) select 'ranges' as name, 2 as n_rows, round((select min(p_size) + max(p_size) + min(p_retailprice) + max(p_retailprice) from part), 3) as total
  union all select 'tightest', count(*), round(sum(n), 3) from t union all select 'pairs', count(*), round(sum(score), 3) from k union all select 'side_by_side', 2 * count(*), round(sum(score), 3) from k""")
def insights_all(spark: SparkSession, d: str) -> DataFrame:
    """All insight tables of the parts, each by its rows and the sum of its numbers: range ends, rows that features rest on, scores, and differences by feature."""
    found = insights.extract(_parts(spark, d), table(spark, d, "part"), "p_partkey", ["p_retailprice"], ["p_size", "p_retailprice"], top=2)
    numbers = {"ranges": F.col("lo") + F.col("hi"), "tightest": F.col("n"), "pairs": F.col("score"), "side_by_side": F.col("diff")}
    parts = [found[name].agg(F.count("*").cast("int").alias("n_rows"), r(F.sum(x).cast("double"), 3).alias("total")).select(F.lit(name).alias("name"), "n_rows", "total") for name, x in numbers.items()]
    return reduce(DataFrame.unionByName, parts)


@query("""with o as (select * from orders where o_orderkey = 1), l as (select distinct * from lineitem where l_orderkey = 1), c as (select * from customer where c_custkey in (select o_custkey from o)), n as (select * from nation where n_nationkey in (select c_nationkey from c)),
  g as (select * from region where r_regionkey in (select n_regionkey from n)), p as (select * from part where p_partkey in (select l_partkey from l)), s as (select * from supplier where s_suppkey in (select l_suppkey from l)), x as (
  select 'node' as type, '' as source, 'orders' as label, unnest(['o_totalprice', 'o_orderstatus', 'o_orderpriority', 'o_orderdate']) as property, unnest([o_totalprice::varchar, o_orderstatus, o_orderpriority, o_orderdate::varchar]) as value from o union all
  select 'node', 'PLACED_BY', 'customer', unnest(['c_name', 'c_acctbal', 'c_mktsegment']), unnest([c_name, c_acctbal::varchar, c_mktsegment]) from c union all
  select 'node', 'PLACED_BY/customer/CUST_IN', 'nation', 'n_name', n_name from n union all select 'node', 'PLACED_BY/customer/CUST_IN/nation/IN_REGION', 'region', 'r_name', r_name from g union all
  select 'node', 'CONTAINS', 'part', unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']), unnest([p_name, p_brand, p_type, p_size::varchar, p_retailprice::varchar]) from p union all
  select 'node', 'SUPPLIED_BY', 'supplier', unnest(['s_name', 's_acctbal']), unnest([s_name, s_acctbal::varchar]) from s union all
  select 'edge', t, t, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']), unnest([l_quantity::varchar, l_extendedprice::varchar, l_discount::varchar, l_tax::varchar]) from (select distinct l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, 'CONTAINS' as t from l union all
  select distinct l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, 'SUPPLIED_BY' from l)) select type, source, label, property, value from x where value is not null""")
def node_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of one order, with the value of each property."""
    found = context.node_context(trade(spark, d), "orders", 1, ["PLACED_BY", "CUST_IN", "IN_REGION"])
    return found.withColumn("source", F.array_join("source", "/"))


@query("select c_custkey as id from customer order by md5('7:' || c_custkey), c_custkey limit 1")
def pick_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return context.pick_node(trade(spark, d), "customer", seed=7)
