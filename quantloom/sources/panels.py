"""Price panels (instrument, ts, price) made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.tables import read_table


def day_of(column: str):
    return F.col(column).cast("date").cast("timestamp_ntz")


def orders_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean order total of each priority."""
    return read_table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("instrument"), day_of("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("price"))


def market_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean order total over all priorities, as the one instrument 'all'."""
    return read_table(spark, folder, "orders").groupBy(F.lit("all").alias("instrument"), day_of("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("price"))


def items_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean unit price of each return flag."""
    rows = read_table(spark, folder, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("instrument"), day_of("l_shipdate").alias("ts")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def event_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Raw ticks (instrument, ts, price, seq): one for each event, seq being the order of arrival."""
    return read_table(spark, folder, "events").select(F.col("event_type").alias("instrument"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))
