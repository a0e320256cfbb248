"""Streams over the events table, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.plans import read
from storegrain.sources.tables import shared_path as shared
from storegrain.streaming import jobs as S


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")


def admission_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two events of a user in a day."""
    e = read(spark, sf_dir, "events").filter("user_id is not null").select(F.col("user_id").alias("key"), "ts", "event_id")
    return S.admissions_batch(e, 2, 86_400.0)


def snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type as snapshots of a page; its hash is whether the value is above 20."""
    e = event_stream(spark, sf_dir).filter("user_id is not null")
    s = e.select(F.col("user_id").cast("string").alias("store_id"), F.col("event_type").alias("url"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 20).cast("string").alias("content_hash"), F.lit("d").alias("dom_hash"))
    # the processor's state needs this store; the setting holds for the query's start only
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = S.run_to_end(spark, S.snapshot_changes(s), shared(spark, "snapshots"), shared(spark, "checkpoint"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return out.groupBy("url", "change").agg(F.count(F.lit(1)).alias("n"))


def alert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as violations: product = user, rule = type."""
    e = event_stream(spark, sf_dir).filter("user_id is not null").select(F.col("user_id").alias("product_id"), F.col("event_type").alias("rule"))
    return S.run_to_end(spark, S.alert_once(e), shared(spark, "alerts"), shared(spark, "checkpoint"))


SNAPSHOT_SQL = """
with d as (select user_id, event_type, ts, event_id, value > 20 as h from events where user_id is not null),
u as (select * from (select *, lag(h) over w as before, row_number() over w as k from d window w as (partition by user_id, event_type order by ts)))
select event_type as url, case when k = 1 then 'new' else 'changed' end as change, count(*) as n from u where k = 1 or h is distinct from before group by 1, 2
"""
QUERIES = {f.__name__: f for f in (admission_limit, snapshot_stream, alert_once)}
SQL = {"snapshot_stream": SNAPSHOT_SQL, "alert_once": "select distinct user_id as product_id, event_type as rule from events where user_id is not null"}
