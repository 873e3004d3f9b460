"""The customer timeline: customers and their orders as one table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.timeline import indexed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static event for each customer, a dated one for each order."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.lit(None).cast("timestamp_ntz").alias("time"),
        F.concat(F.lit("SEGMENT//"), "c_mktsegment").alias("code"),
        F.col("c_acctbal").alias("numeric_value"),
        F.lit(None).cast("string").alias("priority"),
        F.lit(None).cast("bigint").alias("src_id"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("time"),
        F.concat(F.lit("ORDER//"), "o_orderstatus").alias("code"),
        F.col("o_totalprice").alias("numeric_value"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias("src_id"),
    )
    return customers.unionByName(orders)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(raw_events(spark, sf_dir), F.col("time").asc_nulls_first(), F.col("src_id").asc_nulls_first())
