"""An extension beyond batch parity: degrees kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, directory: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def degrees_by_type(events: DataFrame) -> DataFrame:
    """``user_id, event_type, degree``: the batch in-degree as an aggregate that a stream can keep; each event is an edge to its user."""
    return events.where("user_id is not null").groupBy("user_id", "event_type").agg(F.count("*").alias("degree"))


def hourly_degrees(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``window, event_type, degree, mean_value`` by hour; events later than ``late`` behind the newest are left out of closed hours."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("degree"), F.avg("value").alias("mean_value"))
