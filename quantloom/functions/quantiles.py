"""Exact quantiles of each key by distributed selection: histograms narrow the place of each order statistic.

``percentile`` holds the values of a whole key in one task. Here a first pass counts the rows of a key in BINS parts
between its least and its greatest value. Only the parts that hold a wanted place go on, each with the least and greatest
value seen in it; they are counted in parts again, and what is left is grouped by value, few rows in which the place is
read off a running count. Counts are combined before every shuffle, so no task receives a key's rows, and values that
repeat are one row. The interpolation is that of percentile, operation by operation: results are equal to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def order_statistics(rows: DataFrame, by: list[str], x: str | Column, shares: tuple[float, ...]) -> DataFrame:
    """(by, share_no, position, low, high): the values at the floor and the ceiling of share * (n - 1), counted from 0.

    NULLs of x take no part; a key without values has no rows. Keys are not NULL, values are finite.
    """
    x = F.col(x) if isinstance(x, str) else x
    # four steps read the values: dealt out once, they are computed once
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.select(*by, x.cast("double").alias("_x")).filter("_x is not null").repartition(parts)
    facts = values.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    position = F.array(*[F.lit(float(s)) * (F.col("_n") - 1) for s in shares])
    wanted = facts.select(*by, F.posexplode(position).alias("share_no", "position"))
    ends = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))).alias("rank"))
    ranks = ends.select(*by, "rank").distinct()
    near = values.join(facts.select(*by, "_lo", "_hi"), by).withColumn("_part", _part())
    first = _reached(near, ranks.withColumn("_below", F.lit(0).cast("long")), by)
    near = near.drop("_lo", "_hi").join(first, [*by, "_part"]).drop("_part")  # one row for each rank whose part it is in
    near = near.withColumn("_part", _part())
    second = _reached(near.drop("_below"), first.select(*by, "rank", "_below"), by, True)
    inside = near.select(*by, "rank", "_part", "_x").join(second.select(*by, "rank", "_part", "_below"), [*by, "rank", "_part"]).groupBy(*by, "rank", "_below", "_x").agg(F.count("*").alias("_c"))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*by, "rank").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).filter("_upto > rank").groupBy(*by, "rank").agg(F.min("_x").alias("value"))
    return ends.join(found, [*by, "rank"]).groupBy(*by, "share_no", "position").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def _part() -> Column:
    """The part of [_lo, _hi] that _x lies in; it rises with _x."""
    return F.coalesce(F.least(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * BINS), F.lit(BINS - 1)), F.lit(0))


def _reached(values: DataFrame, ranks: DataFrame, by: list[str], own: bool = False) -> DataFrame:
    """(by, rank, _part, _lo, _hi, _below): the part that holds each rank, its extreme values, and what lies below it.

    values has _part; with ``own`` it has a rank, too, and a rank looks only at its own values.
    """
    keys = [*by, "rank"] if own else by
    counted = values.groupBy(*keys, "_part").agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    counted = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
    met = counted.join(ranks, keys).withColumn("_upto", F.col("_upto") + F.col("_below"))
    met = met.filter((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_c") <= F.col("rank")))
    return met.select(*by, "rank", "_part", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_below"))


def exact_quantiles(rows: DataFrame, by: list[str], x: str | Column, shares: tuple[float, ...], name: str) -> DataFrame:
    """(by, name): the array of quantiles in the order of shares, each as percentile() gives it."""
    between = (F.ceil("position") - F.col("position")) * F.col("low") + (F.col("position") - F.floor("position")) * F.col("high")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between)
    found = order_statistics(rows, by, x, shares).select(*by, "share_no", value.alias("_v"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("share_no", "_v"))), lambda s: s["_v"]).alias(name))


def with_quantiles(panel: DataFrame, x: str | Column, shares: tuple[float, ...], name: str) -> DataFrame:
    """panel with the array of its instrument's quantiles of x; NULL for an instrument without values."""
    return panel.join(exact_quantiles(panel, ["instrument"], x, shares, name), "instrument", "left")
