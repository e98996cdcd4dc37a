"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder; timestamps are tz-less, so sessions in UTC agree with SQL."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits of events: (event_id, account_id, n_confirmations), one row per line item group."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("account_id"))
        .agg(F.count("*").alias("n_confirmations"))
    )
