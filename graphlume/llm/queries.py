"""Queries of this folder's operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlume.llm import clusters, digests, leakage, mixing, splitting, tokens
from graphlume.operators.ordered import salted_join
from graphlume.operators.packed import split_packed
from graphlume.session import cut, table

SIDES = ("clustering", "comparison", "unused")
NODE_KEYS, NODE_SCHEMA = ["country_id", "load_day"], "country_id long, load_day timestamp"
RUN_KEYS, RUN_SCHEMA = ["data", "heuristic", "k"], "data string, heuristic string, k int"


def _node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "node_indicators").select("outid", *NODE_KEYS, "Country_physicians").dropDuplicates(["outid", "load_day"])


def _run_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "solver_logs").select("log_id", *RUN_KEYS, "cpu_time").dropDuplicates(["log_id"])


def _plain(certified: DataFrame, schema: str, src: str, columns: list[str]) -> DataFrame:
    keys = F.from_json("grp", schema)
    named = [keys[c].alias(c) if f"{c} " in f"{schema} " else F.lit(None).cast(kind).alias(c) for c, kind in (("country_id", "long"), ("load_day", "timestamp"), ("period", "string"), ("data", "string"), ("heuristic", "string"), ("k", "int")) if c in columns]
    return certified.select(F.lit(src).alias("src"), *named, "n", "percentile", "value", "bound", "rank_error")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of Country_physicians by country and load day, and of cpu_time by data, heuristic and k."""
    columns, out = ["country_id", "load_day", "data", "heuristic", "k"], []
    for src, values, row, keys, schema, value in (
        ("node_indicators", _node_values(spark, sf_dir), "outid", NODE_KEYS, NODE_SCHEMA, "Country_physicians"),
        ("solver_logs", _run_values(spark, sf_dir), "log_id", RUN_KEYS, RUN_SCHEMA, "cpu_time"),
    ):
        values = cut(values.select(row, *keys, value))  # read by both passes
        made = digests.certified(digests.estimates(digests.digest(values, keys, value)), values, keys, value)
        out.append(_plain(made, schema, src, columns))
    return out[0].unionByName(out[1])


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each percentile, how many values it rests on and whether its counted rank error is within the digest's bound, and that within 2 %."""
    found = p1_percentiles(spark, sf_dir)
    few = F.col("n") < 200  # a centroid of such a group holds a single value, which is more than its share of the bound
    within = (F.col("rank_error") <= F.col("bound") + 1e-12) & (few | (F.col("bound") <= 0.02))
    return found.select("src", "country_id", "load_day", "data", "heuristic", "k", F.round("percentile", 2).alias("percentile"), "n", within.alias("within"))


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of single loads combined: percentiles of Country_physicians by country and month."""
    values = cut(_node_values(spark, sf_dir).select("outid", *NODE_KEYS, "Country_physicians"))
    loads = cut(digests.digest(values, NODE_KEYS, "Country_physicians"))
    month = F.date_format("load_day", "yyyy-MM")
    months = digests.regrouped(loads, NODE_SCHEMA, {"country_id": F.col("country_id"), "period": month})
    of_month = values.select("outid", "country_id", month.alias("period"), "Country_physicians")
    return _plain(digests.certified(digests.estimates(months), of_month, ["country_id", "period"], "Country_physicians"), "country_id long, period string", "node_indicators", ["country_id", "period"])


def _clustered(spark: SparkSession, sf_dir: str, away: bool) -> DataFrame:
    runs = table(spark, sf_dir, "run_results").select("result_id", "partition", "Country_physicians").where("Country_physicians is not null and not isnan(Country_physicians)")
    entries = split_packed(runs, "result_id", "partition", SIDES).where("val != ''")
    sets = entries.groupBy("row_key").agg(F.collect_set(F.concat_ws("\x1f", "side", "val")).alias("entries"))
    numbers = runs.dropDuplicates(["result_id"]).select(F.col("result_id").alias("row_key"), F.col("Country_physicians").alias("number"))
    return clusters.similarity_clusters(sets.join(numbers.hint("merge"), "row_key").select(F.col("row_key").alias("record_id"), "entries", "number"), away=away)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of every cluster of at least two runs alike in partition and physicians."""
    found = cut(_clustered(spark, sf_dir, away=False))
    several = found.groupBy("first_id").agg(F.count("*").alias("n")).where("n > 1").select("first_id")
    return salted_join(found, several, ["first_id"], "record_id", merge=True).select("first_id", F.col("record_id").alias("result_id"))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and its most typical runs."""
    return clusters.described(cut(_clustered(spark, sf_dir, away=True)))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(mixing.plain_name(F.col("source")))).alias("sources"), "text")
    return mixing.mix(tokens.count_tokens(documents, "text"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, each with the number of times it is used."""
    return _mixed(spark, sf_dir)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens that each source should have and has."""
    return mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for messages: copies of one message (by its Message-ID) in several sources are one document of all these sources, so that the flow has something to route."""
    targets = table(spark, sf_dir, "mix_targets")
    documents = table(spark, sf_dir, "documents").select("doc_id", mixing.plain_name(F.col("source")).alias("source"), "text")
    message = F.nullif(F.regexp_extract("text", r"(?im)^message-id:\s*(\S+)", 1), F.lit(""))
    counted = tokens.count_tokens(documents.withColumn("message", F.coalesce(message, F.col("doc_id").cast("string"))), "text")
    # a message is no longer than its first copy; its sources are at most those of the targets' table and some names more
    one = counted.groupBy("message").agg(F.min("doc_id").alias("doc_id"), F.collect_set("source").alias("sources"), F.min_by("n_tokens", "doc_id").alias("n_tokens"))
    return mixing.shares(mixing.mix(one.drop("message"), targets), targets)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of an evaluation item, with the item."""
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document over 2,000 tokens."""
    return splitting.split_items(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that had to be cut."""
    return splitting.split_items(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=False).where("piece = 1").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_bounds, p1_periods, p5_found, p5_clusters, p6_found, p7_mix, p7_shares, p7_shared, p8_found, p8_pieces)}
