"""Queries: scans, structure, collection of indicators, schema distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlume.operators import collect, hops, structure
from graphlume.operators.graph import Edges, PropertyGraph
from graphlume.plans.base import MANY_TO_MANY, MANY_TO_ONE, query, r, trade
from graphlume.session import table

_SCHEMA = """(values ('nation','IN_REGION','region'), ('customer','CUST_IN','nation'), ('supplier','SUPP_IN','nation'),
  ('orders','PLACED_BY','customer'), ('orders','CONTAINS','part'), ('orders','SUPPLIED_BY','supplier')) e(a, t, b)"""


@query("select c_custkey as id, c_name, c_acctbal, c_mktsegment from customer")
def label_scan(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).label("customer")


@query("""select 'region' as label, r_regionkey::bigint as id from region union all select 'nation', n_nationkey from nation union all select 'customer', c_custkey from customer
  union all select 'supplier', s_suppkey from supplier union all select 'part', p_partkey from part union all select 'orders', o_orderkey from orders""")
def all_nodes(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).all_nodes()


@query("""select 'CUST_IN' as type, c_custkey as id, 'nation' as other_label, c_nationkey::bigint as other from customer
  union all select 'PLACED_BY', o_custkey, 'orders', o_orderkey from orders""")
def edge_undirected(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).touching("customer")


@query("select c_custkey as id, c_acctbal from customer where c_custkey in (1, 7, 42, 99999999)")
def id_lookup(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).lookup("customer", [1, 7, 42, 99999999]).select("id", "c_acctbal")


@query("""select * from (values ('node','customer','c_acctbal','double'), ('node','orders','o_totalprice','double'), ('node','part','p_retailprice','double'), ('node','part','p_size','int'),
  ('node','supplier','s_acctbal','double'), ('rel','CONTAINS','l_discount','double'), ('rel','CONTAINS','l_extendedprice','double'), ('rel','CONTAINS','l_quantity','double'), ('rel','CONTAINS','l_tax','double'),
  ('rel','SUPPLIED_BY','l_discount','double'), ('rel','SUPPLIED_BY','l_extendedprice','double'), ('rel','SUPPLIED_BY','l_quantity','double'), ('rel','SUPPLIED_BY','l_tax','double')) v(kind, element, property, type)""")
def numeric_catalog(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).catalog()


@query(f"""select distinct a as start, t as type, b as "end" from {_SCHEMA}""")
def schema_edges_fallback(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).schema_edges_from_data()


@query("""select * from (values ('node','customer','c_acctbal'), ('node','orders','o_totalprice'), ('node','part','p_size'), ('node','supplier','s_acctbal'), ('rel','CONTAINS','l_discount'),
  ('rel','CONTAINS','l_quantity'), ('rel','CONTAINS','l_tax'), ('rel','SUPPLIED_BY','l_discount'), ('rel','SUPPLIED_BY','l_quantity'), ('rel','SUPPLIED_BY','l_tax')) v(kind, element, property)""")
def index_candidates(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).index_candidates(["retailprice", "extendedprice"])


@query("""select o_orderkey as id, o_totalprice as orders_o_totalprice, c_acctbal as customer_c_acctbal from orders left join customer on o_custkey = c_custkey""")
def m2o_closure_orders(spark: SparkSession, d: str) -> DataFrame:
    return collect.closure(trade(spark, d), "orders", MANY_TO_ONE)


@query("""with one as (select distinct on (l_orderkey) * from lineitem order by l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax)
  select o_orderkey as id, l_quantity as "CONTAINS_l_quantity", l_extendedprice as "CONTAINS_l_extendedprice", l_discount as "CONTAINS_l_discount", l_tax as "CONTAINS_l_tax"
  from orders left join one on o_orderkey = l_orderkey""")
def path_edge_properties(spark: SparkSession, d: str) -> DataFrame:
    return collect.closure(trade(spark, d), "orders", ["CONTAINS"], nodes=False, relations=True)


@query("""select o_orderkey as id, round(avg(p_size), 6) as "CONTAINS__neighbor__avg_p_size", round(avg(p_retailprice), 6) as "CONTAINS__neighbor__avg_p_retailprice"
  from orders left join lineitem on o_orderkey = l_orderkey left join part on l_partkey = p_partkey group by 1""")
def m2m_neighbor_avg(spark: SparkSession, d: str) -> DataFrame:
    found = collect.aggregate_many(trade(spark, d), "orders", ["CONTAINS"], relations=False)
    return found.select("id", *(r(c).alias(c) for c in found.columns[1:]))


RULES = {"P_Size ": "max", "p_retailprice": " SUM", "s_acctbal": "min", "l_quantity": "count", "l_tax": "median"}


@query("""with a as (select l_orderkey k, max(p_size)::double m, round(sum(p_retailprice), 4) s, count(l_quantity) q from lineitem left join part on l_partkey = p_partkey group by 1),
  b as (select l_orderkey k, min(s_acctbal) m, count(l_quantity) q from lineitem left join supplier on l_suppkey = s_suppkey group by 1)
  select o_orderkey as id, a.m as "CONTAINS__neighbor__max_p_size", a.s as "CONTAINS__neighbor__sum_p_retailprice", a.q as "CONTAINS__rel__count_l_quantity",
    b.m as "SUPPLIED_BY__neighbor__min_s_acctbal", b.q as "SUPPLIED_BY__rel__count_l_quantity" from orders left join a on a.k = o_orderkey left join b on b.k = o_orderkey""")
def m2m_neighbor_rules(spark: SparkSession, d: str) -> DataFrame:
    found = collect.aggregate_many(trade(spark, d), "orders", MANY_TO_MANY, RULES, keep=["p_size", "p_retailprice", "s_acctbal", "l_quantity"])
    return found.withColumn("CONTAINS__neighbor__sum_p_retailprice", r("CONTAINS__neighbor__sum_p_retailprice", 4))


@query("""select p_partkey as id, round(avg(l_quantity), 6) as "CONTAINS__rel__avg_l_quantity", round(avg(l_extendedprice), 4) as "CONTAINS__rel__avg_l_extendedprice", round(avg(l_discount), 6) as "CONTAINS__rel__avg_l_discount",
  round(avg(l_tax), 6) as "CONTAINS__rel__avg_l_tax" from part left join lineitem on l_partkey = p_partkey group by 1""")
def m2m_rel_agg(spark: SparkSession, d: str) -> DataFrame:
    found = collect.aggregate_many(trade(spark, d), "part", [], neighbours=False)
    return found.select("id", *(r(c, 4 if c.endswith("extendedprice") else 6).alias(c) for c in found.columns[1:]))


@query("""with c as (select c_nationkey k, count(*) n from customer group by 1), s as (select s_nationkey k, count(*) n from supplier group by 1)
  select n_nationkey::bigint as id, coalesce(c.n, 0) as "CUST_IN", coalesce(s.n, 0) as "SUPP_IN" from nation left join c on c.k = n_nationkey left join s on s.k = n_nationkey""")
def in_degree_pivot(spark: SparkSession, d: str) -> DataFrame:
    return collect.in_degrees(trade(spark, d), "nation")


@query("""select c_custkey as id, count(o_orderkey) as "PLACED_BY" from customer left join orders on c_custkey = o_custkey group by 1""")
def in_degree_customers(spark: SparkSession, d: str) -> DataFrame:
    return collect.in_degrees(trade(spark, d), "customer")


_ORDERS = """with m2o as (select o_orderkey id, o_totalprice, c_acctbal from orders left join customer on o_custkey = c_custkey),
  m2m as (select l_orderkey id, avg(p_size) ps, avg(p_retailprice) pr, avg(l_quantity) q, avg(l_extendedprice) e, avg(l_discount) d, avg(l_tax) t from lineitem left join part on l_partkey = p_partkey group by 1)
  select coalesce(a.id, b.id) as outid, o_totalprice as orders_o_totalprice, c_acctbal as customer_c_acctbal, round(ps, 6) as "CONTAINS__neighbor__avg_p_size", round(pr, 6) as "CONTAINS__neighbor__avg_p_retailprice",
    round(q, 6) as "CONTAINS__rel__avg_l_quantity", round(e, 4) as "CONTAINS__rel__avg_l_extendedprice", round(d, 6) as "CONTAINS__rel__avg_l_discount", round(t, 6) as "CONTAINS__rel__avg_l_tax"
  from m2o a left join m2m b on a.id = b.id"""


@query(_ORDERS)
def indicator_table_orders(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: all indicators of all orders."""
    found = collect.indicators(trade(spark, d), "orders", MANY_TO_ONE, ["CONTAINS"])
    return found.select(*(r(c, 4 if c.endswith("extendedprice") else 6).alias(c) if "__" in c else F.col(c) for c in found.columns))


def placed(spark: SparkSession, d: str) -> PropertyGraph:
    """Orders, customers and nations, with properties on the many-to-one edges between them."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    by = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), "o_totalprice")
    lives = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), (F.col("c_custkey") * 2).cast("double").alias("since"))
    return PropertyGraph({"orders": orders, "customer": customers, "nation": nations}, [Edges("PLACED_BY", "orders", "customer", by), Edges("LIVES_IN", "customer", "nation", lives)])


@query("""select o_orderkey as outid, o_totalprice as "PLACED_BY_o_totalprice", c_acctbal as customer_c_acctbal, c_custkey * 2.0 as "LIVES_IN_since", c_acctbal as "PLACED_BY__neighbor__avg_c_acctbal", o_totalprice as "PLACED_BY__rel__avg_o_totalprice"
  from orders left join customer on o_custkey = c_custkey""")
def indicator_table_edges(spark: SparkSession, d: str) -> DataFrame:
    """Indicators with those of the many-to-one edges: one row per node."""
    return collect.indicators(placed(spark, d), "orders", ["PLACED_BY", "LIVES_IN"], ["PLACED_BY"])


@query("""with c as (select c_nationkey k, count(*) n from customer group by 1), s as (select s_nationkey k, count(*) n from supplier group by 1),
  ca as (select c_nationkey k, round(avg(c_acctbal), 6) a from customer group by 1), sa as (select s_nationkey k, round(avg(s_acctbal), 6) a from supplier group by 1)
  select n_nationkey::bigint as outid, ca.a as "CUST_IN__neighbor__avg_c_acctbal", sa.a as "SUPP_IN__neighbor__avg_s_acctbal", coalesce(c.n, 0) as "CUST_IN", coalesce(s.n, 0) as "SUPP_IN"
  from nation left join c on c.k = n_nationkey left join s on s.k = n_nationkey left join ca on ca.k = n_nationkey left join sa on sa.k = n_nationkey""")
def indicator_table_nations(spark: SparkSession, d: str) -> DataFrame:
    found = collect.indicators(trade(spark, d), "nation", MANY_TO_ONE, ["CUST_IN", "SUPP_IN"])
    return found.select("outid", r("CUST_IN__neighbor__avg_c_acctbal").alias("CUST_IN__neighbor__avg_c_acctbal"), r("SUPP_IN__neighbor__avg_s_acctbal").alias("SUPP_IN__neighbor__avg_s_acctbal"), "CUST_IN", "SUPP_IN")


@query("""select coalesce(a.c_custkey, b.o_custkey) as outid, coalesce(a.c_acctbal, b.top) as balance, a.c_nationkey as nation, b.n from
  (select * from customer where c_acctbal > 0) a full outer join (select o_custkey, max(o_totalprice) as top, count(*) as n from orders group by 1) b on a.c_custkey = b.o_custkey""")
def outer_join_coalesce(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    right = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("balance"), F.count("*").alias("n"))
    return collect.outer_join(left, right, "c_custkey", "o_custkey", "outid")


def _side(t: str, e: str, key: str, node: str, node_key: str) -> str:
    return f"(select count(*) p, min(coalesce(n, 0)) lo, max(coalesce(n, 0)) hi from {node} left join (select {key} k, count(*) n from {e} group by 1) x on x.k = {node_key})"


def _cardinality(t: str, a: str, b: str, e: str, src: str, dst: str, ak: str, bk: str) -> str:
    return f"""select '{t}' as type, '{a}' as start_labels, '{b}' as end_labels, o.p as out_population, o.lo as min_out, o.hi as max_out, i.p as in_population, i.lo as min_in, i.hi as max_in,
      case when o.lo >= 1 and o.hi <= 1 and i.lo >= 1 and i.hi <= 1 then 'one-to-one' when i.hi <= 1 then 'one-to-many' when o.hi <= 1 then 'many-to-one' else 'many-to-many' end as cardinality
      from {_side(t, e, src, a, ak)} o, {_side(t, e, dst, b, bk)} i"""


@query(" union all ".join([
    _cardinality("IN_REGION", "nation", "region", "nation", "n_nationkey", "n_regionkey", "n_nationkey", "r_regionkey"),
    _cardinality("CUST_IN", "customer", "nation", "customer", "c_custkey", "c_nationkey", "c_custkey", "n_nationkey"),
    _cardinality("SUPP_IN", "supplier", "nation", "supplier", "s_suppkey", "s_nationkey", "s_suppkey", "n_nationkey"),
    _cardinality("PLACED_BY", "orders", "customer", "orders", "o_orderkey", "o_custkey", "o_orderkey", "c_custkey"),
    _cardinality("CONTAINS", "orders", "part", "lineitem", "l_orderkey", "l_partkey", "o_orderkey", "p_partkey"),
    _cardinality("SUPPLIED_BY", "orders", "supplier", "lineitem", "l_orderkey", "l_suppkey", "o_orderkey", "s_suppkey"),
]))
def cardinality_classes(spark: SparkSession, d: str) -> DataFrame:
    found = structure.cardinalities(trade(spark, d))
    return found.select(*(F.col(c).cast("long").alias(c) if c.startswith(("min", "max", "out", "in_")) else F.col(c) for c in found.columns))


@query("""select 'CONTAINS' as type where (select max(n) from (select count(*) n from lineitem group by l_orderkey)) > 1 union all
  select 'SUPPLIED_BY' where (select max(n) from (select count(*) n from lineitem group by l_orderkey)) > 1 union all
  select 'PLACED_BY' where (select max(n) from (select count(*) n from orders group by o_orderkey)) > 1""")
def m2m_types_loose(spark: SparkSession, d: str) -> DataFrame:
    return structure.loose_many_types(trade(spark, d), "orders")


@query("""select 'CONTAINS' as type where (select max(n) from (select count(*) n from lineitem group by l_orderkey)) > 1 and (select max(n) from (select count(*) n from lineitem group by l_partkey)) > 1 union all
  select 'SUPPLIED_BY' where (select max(n) from (select count(*) n from lineitem group by l_orderkey)) > 1 and (select max(n) from (select count(*) n from lineitem group by l_suppkey)) > 1""")
def m2m_types_strict(spark: SparkSession, d: str) -> DataFrame:
    return structure.strict_many_types(trade(spark, d), "orders")


def world(spark: SparkSession, d: str) -> PropertyGraph:
    """Countries and the nodes' loads in them: a graph with missing properties."""
    loads = table(spark, d, "node_indicators").dropDuplicates(["outid", "load_day"])
    countries = table(spark, d, "countries").select("id", "latitude", "infant_mortality", "sub_region_code", "physicians")
    inside = loads.where("country_id is not null").select(F.col("outid").alias("src"), F.col("country_id").alias("dst"), "ROUTE_TO__rel__avg_distance")
    nodes = loads.select(F.col("outid").alias("id"), "Airport_latitude", "Airport_altitude", "City_population", "ROUTE_TO")
    return PropertyGraph({"Country": countries, "Airport": nodes}, [Edges("IN_COUNTRY", "Airport", "Country", inside)])


_PRESENT = "count(case when not isnan({0}) then {0} end)"
_DENSITY = """with a as (select distinct on (outid, load_day) * from node_indicators order by outid, load_day), all_ as (
  {}) select kind, element, property, n, n_present, round(n_present / n, 9) as ratio from all_""".format(" union all ".join(
    [f"select 'node' as kind, 'Country' as element, '{p}' as property, count(*) as n, {_PRESENT.format(p) if p != 'sub_region_code' else f'count({p})'} as n_present from countries" for p in ("latitude", "infant_mortality", "sub_region_code", "physicians")]
    + [f"""select 'node', 'Airport', '{p}', count(*), {_PRESENT.format('"' + p + '"') if p != 'ROUTE_TO' else 'count("ROUTE_TO")'} from a""" for p in ("Airport_latitude", "Airport_altitude", "City_population", "ROUTE_TO")]
    + [f"""select 'rel', 'IN_COUNTRY', 'ROUTE_TO__rel__avg_distance', count(*), {_PRESENT.format('"ROUTE_TO__rel__avg_distance"')} from a where country_id is not null"""]
))


@query(_DENSITY + " where n_present / n >= 0.9")
def density_min(spark: SparkSession, d: str) -> DataFrame:
    return structure.dense(world(spark, d), 0.9).withColumn("ratio", r("ratio", 9))


@query(_DENSITY + " where n_present / n < 0.9")
def density_below(spark: SparkSession, d: str) -> DataFrame:
    return structure.sparse(world(spark, d), 0.9).withColumn("ratio", r("ratio", 9))


@query("""select 'Country' as label, round(avg((latitude is not null and not isnan(latitude))::int + (infant_mortality is not null and not isnan(infant_mortality))::int + (sub_region_code is not null)::int
  + (physicians is not null and not isnan(physicians))::int), 9) as mean_properties from countries""")
def avg_props_per_node(spark: SparkSession, d: str) -> DataFrame:
    return structure.mean_properties(world(spark, d), "Country").withColumn("mean_properties", r("mean_properties", 9))


@query("select * from (values ('node', 5::bigint), ('rel', 4::bigint), ('any', 9::bigint)) v(kind, n)")
def numeric_property_count(spark: SparkSession, d: str) -> DataFrame:
    return structure.count_properties(trade(spark, d))


@query("""select * from (values ('l_discount', ''), ('l_extendedprice', ''), ('l_quantity', ''), ('l_tax', ''), ('p_retailprice', ''), ('p_size', ''), ('s_acctbal', '')) v(attribute, aggregation_function)""")
def agg_template(spark: SparkSession, d: str) -> DataFrame:
    return structure.aggregation_template(trade(spark, d), "orders", MANY_TO_MANY)


def _triples(spark: SparkSession, d: str) -> list[tuple[str, str, str]]:
    return sorted({(e.start, e.type, e.end) for e in trade(spark, d).edges})


def _hops_sql(start: str, directed: bool) -> str:
    both = "" if directed else " union select b, a from e"
    return f"""with recursive e as (select * from {_SCHEMA}), n as (select a, b from e{both}), w(l, h) as (select '{start}', 0 union select n.b, h + 1 from w join n on n.a = w.l where h < 8),
      near as (select l, min(h) as h from w group by 1), ls as (select a as l from e union select b from e union select '{start}')
      select 'label' as kind, ls.l as name, near.h as hops from ls left join near on near.l = ls.l union all
      select 'relationship', t, 1 + min(near.h) from e left join near on near.l in (e.a, e.b) group by t"""


@query(_hops_sql("customer", False))
def schema_hops(spark: SparkSession, d: str) -> DataFrame:
    return hops.hops_table(spark, hops.schema_hops(_triples(spark, d), "customer"))


@query(_hops_sql("customer", True))
def schema_hops_directed(spark: SparkSession, d: str) -> DataFrame:
    return hops.hops_table(spark, hops.schema_hops(_triples(spark, d), "customer", directed=True))


@query(f"""with recursive e as (select * from {_SCHEMA}), n as (select 'L:' || a as x, 'R:' || t as y from e union select 'R:' || t, 'L:' || a from e union select 'L:' || b, 'R:' || t from e union select 'R:' || t, 'L:' || b from e),
  w(x, h) as (select 'L:supplier', 0 union select n.y, h + 1 from w join n on n.x = w.x where h < 14), near as (select x, min(h) as h from w group by 1)
  select case when x like 'L:%' then 'label' else 'relationship' end as kind, x[3:] as name, case when x like 'L:%' then h // 2 else (h + 1) // 2 end as hops from near""")
def schema_distance_bipartite(spark: SparkSession, d: str) -> DataFrame:
    return hops.hops_table(spark, hops.schema_distances(_triples(spark, d), "supplier"))


@query(f"""with t as ({_ORDERS}) select outid, orders_o_totalprice, round(customer_c_acctbal / 2, 6) as customer_c_acctbal, round("CONTAINS__neighbor__avg_p_size" / 2, 8) as "CONTAINS__neighbor__avg_p_size",
  round("CONTAINS__neighbor__avg_p_retailprice" / 2, 8) as "CONTAINS__neighbor__avg_p_retailprice", round("CONTAINS__rel__avg_l_quantity" / 2, 8) as "CONTAINS__rel__avg_l_quantity",
  round("CONTAINS__rel__avg_l_extendedprice" / 2, 8) as "CONTAINS__rel__avg_l_extendedprice", round("CONTAINS__rel__avg_l_discount" / 2, 8) as "CONTAINS__rel__avg_l_discount", round("CONTAINS__rel__avg_l_tax" / 2, 8) as "CONTAINS__rel__avg_l_tax" from t""")
def hop_weighted_indicators(spark: SparkSession, d: str) -> DataFrame:
    found = hops.weighted(indicator_table_orders(spark, d), hops.schema_hops(_triples(spark, d), "orders"))
    return found.select("outid", "orders_o_totalprice", r("customer_c_acctbal").alias("customer_c_acctbal"), *(r(c, 8).alias(c) for c in found.columns if "__" in c))
