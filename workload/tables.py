"""The given tables, read with their schemas so that no file is opened just to learn its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedweave.session import pin_session

SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, spread over the cores when its file is too small to be split: parsing JSON is work for all of them."""
    df = pin_session(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 8) else df
