"""Linear recursions y = a * y_before + b with 0 <= a <= 1, as column expressions over time buckets.

A series is cut into time buckets, and a bucket is what one task holds. Inside a bucket rows fall into segments, each as
long as the weights a multiply to more than about e^-CUT, so that running products neither vanish nor overflow:

    y = p * (y_in + sum(b / p)),   p the running product of a in the segment.

What enters a segment is folded from the three segments before it, as anything older weighs less than e^-CUT. A bucket
as a whole is one affine map; the maps of all buckets, one row each, go through the same recursion, and each bucket then
meets what enters it. Rows with a = 1 and b = 0 leave y as it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket in seconds where the caller names none.
BUCKET_S = 30 * 86_400
#: Segments hold a product of about e^-CUT; a weight below LEAST counts as LEAST, which no double tells from 0 here.
CUT, LEAST = 200.0, 1e-80


def bucketed(panel: DataFrame, bucket_s: int) -> DataFrame:
    return panel.withColumn("_bucket", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / bucket_s))


def _recur(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """rows (_a, _b) with _y, the recursion from 0 at the start of the partition, and _left, the weight of that start."""
    part = Window.partitionBy(*within).orderBy(order)
    so_far = part.rowsBetween(Window.unboundedPreceding, 0)
    segment = Window.partitionBy(*within, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_a", F.greatest(F.col("_a"), F.lit(LEAST))).withColumn("_l", F.sum(-F.log("_a")).over(so_far)).withColumn("_seg", F.floor(F.col("_l") / CUT))
    rows = rows.withColumn("_p", F.product("_a").over(segment))
    rows = rows.withColumn("_e", F.col("_p") * F.sum(F.col("_b") / F.col("_p")).over(segment))
    first = F.coalesce(F.col("_seg") != F.lag("_seg").over(part), F.lit(True))
    rows = rows.withColumn("_new", first).withColumn("_s0", F.struct(F.col("_p").alias("a"), F.col("_e").alias("b")))
    nothing = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    for k in range(1, 4):  # _sk: the map of the whole segment k before this row's
        rows = rows.withColumn("_prior", F.coalesce(F.lag(f"_s{k - 1}").over(part), nothing))
        rows = rows.withColumn(f"_s{k}", F.last(F.when(F.col("_new"), F.col("_prior")), ignorenulls=True).over(so_far))
    a, b = (lambda k, c=c: F.col(f"_s{k}.{c}") for c in "ab")
    entering = b(1) + a(1) * (b(2) + a(2) * b(3))
    out = rows.withColumn("_y", F.col("_p") * entering + F.col("_e")).withColumn("_left", F.exp(-F.col("_l")))
    return out.drop("_l", "_seg", "_p", "_e", "_new", "_prior", "_s0", "_s1", "_s2", "_s3")


def scan(panel: DataFrame, a: Column, b: Column, name: str, bucket_s: int = BUCKET_S) -> DataFrame:
    """panel with the recursion as column ``name``; panel may have _bucket from bucketed() with the same width already.

    Series start from 0, so the first value of a series has a = 0. Rows of one series have different times.
    """
    rows = panel if "_bucket" in panel.columns else bucketed(panel, bucket_s)
    inside = _recur(rows.withColumn("_a", a).withColumn("_b", b), ["instrument", "_bucket"], "ts")
    maps = inside.groupBy("instrument", "_bucket").agg(F.min("_left").alias("_a"), F.max_by("_y", "ts").alias("_b"))
    ends = _recur(maps, ["instrument"], "_bucket")
    entering = ends.select("instrument", "_bucket", F.coalesce(F.lag("_y").over(Window.partitionBy("instrument").orderBy("_bucket")), F.lit(0.0)).alias("_in"))
    met = inside.join(entering, ["instrument", "_bucket"])
    return met.withColumn(name, F.col("_left") * F.col("_in") + F.col("_y")).drop("_a", "_b", "_y", "_left", "_in", "_bucket")


def placed(panel: DataFrame, x: str, bucket_s: int = BUCKET_S) -> DataFrame:
    """panel with _bucket, _at (number of the row in its series from 1), _seen (values of x up to the row), _held (_at of the
    last value of x before the row) and _was (ts of the row before), without a window over a whole series."""
    part = Window.partitionBy("instrument", "_bucket").orderBy("ts")
    rows = bucketed(panel, bucket_s).withColumn("_own", F.row_number().over(part)).withColumn("_k", F.count(x).over(part.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_lag", F.lag("ts").over(part))
    value = F.when(F.col(x).isNotNull(), F.col("_own"))
    rows = rows.withColumn("_mine", F.max(value).over(part.rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy("instrument").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    facts = rows.groupBy("instrument", "_bucket").agg(F.count("*").alias("_n"), F.count(x).alias("_c"), F.max("ts").alias("_t"), F.max(value).alias("_h"))
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    facts = facts.withColumn("_n0", zero("_n")).select("instrument", "_bucket", "_n0", zero("_c").alias("_c0"), F.max("_t").over(before).alias("_t0"), F.max(F.col("_n0") + F.col("_h")).over(before).alias("_h0"))
    met = rows.join(facts, ["instrument", "_bucket"])
    out = met.withColumns({"_at": F.col("_n0") + F.col("_own"), "_seen": F.col("_c0") + F.col("_k"), "_held": F.coalesce(F.col("_n0") + F.col("_mine"), F.col("_h0")), "_was": F.coalesce("_lag", "_t0")})
    return out.drop("_own", "_k", "_lag", "_mine", "_n0", "_c0", "_t0", "_h0")


def half_life_weight(elapsed: Column, half_life: float) -> Column:
    """The weight that halves in every half_life."""
    return F.exp(elapsed * (-math.log(2) / half_life))
