"""Measurement views over the star-schema tables.

``px`` reads events as 25 x 100 images with two channels, ``labels_ref`` and
``labels_pred`` are two label grids over them, ``obs`` is lineitem as object
values with study metadata, ``det`` is events as detections in hourly frames,
``objects`` is part as an object table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 100, 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 2500").alias("image_id"),
        F.expr("(event_id % 2500) div 100").alias("y"),
        F.expr("event_id % 100").alias("x"),
        F.col("value").alias("v"),
        F.col("user_id").cast("double").alias("v2"),
    )


def labels_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).withColumn("label", F.expr("case when v > 5 then (y div 5) * 20 + x div 5 + 1 else 0 end"))


def labels_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).withColumn("label", F.expr("case when v2 % 7 = 0 then 0 else (y div 5) * 21 + (x + 1) div 5 + 1 end"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("review"), F.col("o_orderpriority").alias("condition"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'HOUSEHOLD')").alias("replicate"), F.col("c_nationkey").alias("nation"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("image_id"), "value", "quantity", "review", "condition", "replicate", "nation")


def hour_frame(ts: str) -> Column:
    """Hours since 2024-01-01, whatever the session's time zone."""
    return ((F.unix_date(F.col(ts).cast("date")) - 19723) * 24 + F.hour(ts)).cast("bigint")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("seq"),
        hour_frame("ts").alias("frame"),
        F.col("event_id").alias("label"),
        F.col("value").alias("x"),
        F.col("user_id").cast("double").alias("y"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 7).alias("result_id"),
        F.col("p_partkey").alias("label"),
        F.col("p_retailprice").alias("measure"),
        F.expr("case when p_size % 11 = 0 then null else cast(p_size as double) end").alias("size"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
    )


#: The same views in DuckDB's SQL, as common table expressions.
SQL = {
    "px": "px as (select event_id // 2500 as image_id, (event_id % 2500) // 100 as y, event_id % 100 as x, value as v, cast(user_id as double) as v2 from events)",
    "labels_ref": "labels_ref as (select *, case when v > 5 then (y // 5) * 20 + x // 5 + 1 else 0 end as label from px)",
    "labels_pred": "labels_pred as (select *, case when v2 % 7 = 0 then 0 else (y // 5) * 21 + (x + 1) // 5 + 1 end as label from px)",
    "obs": "obs as (select o_orderkey as image_id, l_extendedprice as value, l_quantity as quantity, o_orderstatus as review, o_orderpriority as condition, nullif(c_mktsegment, 'HOUSEHOLD') as replicate, c_nationkey as nation from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)",
    "det": "det as (select event_type as seq, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as frame, event_id as label, value as x, cast(user_id as double) as y from events)",
    "objects": "objects as (select p_partkey % 7 as result_id, p_partkey as label, p_retailprice as measure, case when p_size % 11 = 0 then null else cast(p_size as double) end as size, p_brand as brand, p_type as kind from part)",
}


def sql(*views: str, then: str) -> str:
    """A query over views; those they rest on come first."""
    needed = []
    for v in views:
        for x in (["px", v] if v.startswith("labels") else [v]):
            if x not in needed:
                needed.append(x)
    return "with " + ", ".join(SQL[v] for v in needed) + " " + then
