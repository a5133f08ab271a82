"""Windows over series that are too long for one task: chunks of rows with overlap, and running totals in two steps.

A window puts a whole series into one task. Here rows are first numbered without such a window: counts by time bucket are
added up over the small table of buckets, and rows are numbered inside their bucket. Chunks of equal row counts, each
with the rows before it that its windows look back on, then stand for series of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "\u0001"


def numbered(panel: DataFrame, bucket_s: int = 86_400, total: str | None = None) -> DataFrame:
    """panel with _rn, the number of the row in its series from 0; one task holds one time bucket of a series at most.

    With ``total``, also _rows, the rows of the series, and _total, the sum of that column over it.
    """
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / bucket_s)
    rows = panel.withColumn("_bucket", bucket)
    earlier = Window.partitionBy("instrument").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("instrument", "_bucket").agg(F.count("*").alias("_n"), *([F.sum(total).alias("_t")] if total else []))
    whole = Window.partitionBy("instrument")  # of bucket counts, not of rows
    more = [F.sum("_n").over(whole).alias("_rows"), F.sum("_t").over(whole).alias("_total")] if total else []
    offsets = counts.select("instrument", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *more)
    own = F.row_number().over(Window.partitionBy("instrument", "_bucket").orderBy("ts")) - 1
    return rows.withColumn("_own", own).join(offsets, ["instrument", "_bucket"]).withColumn("_rn", F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def in_chunks(panel: DataFrame, build: Callable[[DataFrame], DataFrame], rows_before: int, chunk_rows: int = 1_000_000, bucket_s: int = 86_400) -> DataFrame:
    """build(panel), computed chunk by chunk; build looks back on at most ``rows_before`` rows and keeps instrument and ts.

    Only the rows that open a chunk are copied, rows_before in chunk_rows, so the overlap stays small.
    """
    if rows_before > chunk_rows:
        raise ValueError("a chunk is shorter than what its windows look back on")
    rows = numbered(panel, bucket_s)
    at, place = F.floor(F.col("_rn") / chunk_rows), F.col("_rn") % chunk_rows
    both = F.array_compact(F.array(at, F.when(place >= chunk_rows - rows_before, at + 1)))
    dealt = rows.withColumn("_home", at).withColumn("_chunk", F.explode(both))
    keyed = dealt.withColumn("instrument", F.concat_ws(MARK, "instrument", F.col("_chunk").cast("string")))
    starts = keyed.filter("_home = _chunk").groupBy("instrument").agg(F.min("ts").alias("_start"))
    out = build(keyed.drop("_rn", "_home", "_chunk")).join(starts, "instrument").filter("ts >= _start").drop("_start")
    return out.withColumn("instrument", F.split("instrument", MARK)[0])


def dealt(rows: DataFrame, rows_before: Column | int, chunk_rows: Column | int, rows_after: int = 0) -> DataFrame:
    """numbered() rows with _chunk and own: runs of chunk_rows rows, each with its neighbours (not own): the rows_before rows
    ahead of it and the rows_after rows behind it.

    All may depend on the series through _rows; a chunk has no fewer rows than what it looks back or forward on.
    """
    size = chunk_rows if isinstance(chunk_rows, Column) else F.lit(chunk_rows)
    at, place = F.floor(F.col("_rn") / size), F.col("_rn") % size
    home = lambda chunk, own: F.struct(chunk.alias("_chunk"), F.lit(own).alias("own"))
    homes = [home(at, True), F.when((place >= size - rows_before) & (F.col("_rn") < F.col("_rows") - size + place), home(at + 1, False))]
    if rows_after:
        homes.append(F.when((place < rows_after) & (at > 0), home(at - 1, False)))
    return rows.withColumn("_home", F.explode(F.array_compact(F.array(*homes)))).select("*", "_home.*").drop("_home")


def running_sum(panel: DataFrame, x: str, name: str, bucket_s: int = 86_400) -> DataFrame:
    """panel with the sum of x over all rows of the series up to the current one, bucket totals added first."""
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / bucket_s)
    rows = panel.withColumn("_bucket", bucket)
    earlier = Window.partitionBy("instrument").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("instrument", "_bucket").agg(F.sum(x).alias("_t"))
    offsets = totals.select("instrument", "_bucket", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_before"))
    own = F.sum(x).over(Window.partitionBy("instrument", "_bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(offsets, ["instrument", "_bucket"]).withColumn(name, F.col("_before") + F.coalesce("_own", F.lit(0.0))).drop("_bucket", "_own", "_before")
