"""Append-only store of run records as Parquet folders, one for each kind of record."""

from __future__ import annotations

import functools
import json
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("states", "backtests", "datasets", "runs")
MOST = 200
SCHEMA = T.StructType([T.StructField("record_id", T.StringType(), False), T.StructField("created_at", T.TimestampType(), False), T.StructField("request", T.StringType()), T.StructField("result", T.StringType())])


def clamp(limit: int) -> int:
    """A page size from 1 to 200."""
    return max(1, min(int(limit), MOST))


def plain(value):
    """A value as JSON knows it: numpy scalars as Python's, tuples, sets and arrays as lists, odd keys as text, and anything
    else that JSON lacks as text."""
    if isinstance(value, dict):
        keyed = ((plain(k), plain(v)) for k, v in value.items())
        return {k if isinstance(k, (str, int, float, bool, type(None))) else str(k): v for k, v in keyed}
    if isinstance(value, (list, tuple, set, frozenset, np.ndarray)):
        return [plain(v) for v in value]
    if isinstance(value, np.generic):
        return value.item()
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def as_json(value) -> str:
    return json.dumps(plain(value))


class RunStore:
    """Records of one root folder. Writes append files, reads prune columns and push the filter on the id down."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, kind: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        return f"{self.root}/{kind}"

    def create(self) -> None:
        """Empty folders with the schema, where there are none yet."""
        for kind in KINDS:
            self.spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(self._path(kind))

    def save(self, kind: str, record_id: str, request: dict, result: dict, created_at: datetime | None = None) -> None:
        row = (record_id, created_at or datetime.now(UTC), as_json(request), as_json(result))
        self.spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(self._path(kind))

    def save_frame(self, kind: str, records: DataFrame) -> None:
        records.select(*SCHEMA.fieldNames()).write.mode("append").parquet(self._path(kind))

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self._path(kind))

    def history(self, kind: str, limit: int = 50) -> DataFrame:
        """The newest records, at most 200."""
        return self.read(kind).orderBy(F.desc("created_at"), "record_id").limit(clamp(limit))

    def overview(self) -> DataFrame:
        """(kind, n_records, newest) of every kind of record, those without records too."""
        held = [self.read(k).agg(F.lit(k).alias("kind"), F.count("*").alias("n_records"), F.max("created_at").alias("newest")) for k in KINDS]
        return functools.reduce(DataFrame.unionByName, held)

    def latest(self, kind: str = "states") -> DataFrame:
        return self.history(kind, 1)

    def get(self, kind: str, record_id: str) -> DataFrame:
        return self.read(kind).filter(F.col("record_id") == record_id)


def rows_to_panel(spark: SparkSession, rows: list[dict], instrument: str = "all") -> DataFrame:
    """Rows {timestamp_utc, price} as raw ticks (instrument, timestamp_utc, price, seq)."""
    data = [(instrument, str(r["timestamp_utc"]), float(r["price"]), k) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, "instrument string, timestamp_utc string, price double, seq long")


def _checked(raw: DataFrame) -> DataFrame:
    """raw with the counts of array_quality() and problem."""
    later = F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0)))
    sooner = F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0)))
    steps = F.zip_with(later, sooner, lambda b, a: (b <= a).cast("int"))
    number = lambda v: v.cast("double")
    missing = lambda c: F.size(F.filter(c, lambda v: v.isNull() | F.isnan(number(v))))
    endless = lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(number(v)) | (F.abs(number(v)) == float("inf")))
    counted = raw.withColumn("_t", F.transform("timestamps", lambda t: t.cast("timestamp_ntz"))).withColumns(
        {
            "timestamp_count": F.size("_t"),
            "duplicate_timestamps": F.size("_t") - F.size(F.array_distinct("_t")),
            "non_monotonic_timestamps": F.aggregate(steps, F.lit(0), lambda s, v: s + v),
            "nan_prices": missing("prices"),
            "nan_signals": missing("signals"),
        }
    )
    problem = (
        F.when(F.col("timestamp_count") == 0, "no timestamps")
        .when((F.size("timestamps") != F.size("prices")) | (F.size("timestamps") != F.size("signals")), "arrays differ in length")
        .when(F.col("duplicate_timestamps") > 0, "duplicate timestamps")
        .when(F.col("non_monotonic_timestamps") > 0, "timestamps do not rise")
        .when(endless("prices"), "prices are not finite")
        .when(endless("signals"), "signals are not finite")
    )
    return counted.withColumn("problem", problem)


def array_quality(raw: DataFrame, instrument: str = "instrument") -> DataFrame:
    """(instrument, timestamp_count, duplicate_timestamps, non_monotonic_timestamps, nan_prices, nan_signals, problem) of rows of
    arrays; problem names the first reason for which arrays_to_panel() rejects a row, NULL if it takes it."""
    return _checked(raw).select(F.col(instrument).alias("instrument"), "timestamp_count", "duplicate_timestamps", "non_monotonic_timestamps", "nan_prices", "nan_signals", "problem")


def arrays_to_panel(raw: DataFrame, instrument: str = "instrument") -> DataFrame:
    """Rows (instrument, timestamps, prices, signals) of arrays as (instrument, ts, price, position, seq); a row in which
    array_quality() finds a problem raises it."""
    zipped = F.when(F.col("problem").isNull(), F.arrays_zip("timestamps", "prices", "signals")).otherwise(F.raise_error(F.col("problem")))
    out = _checked(raw).select(F.col(instrument).alias("instrument"), F.posexplode(zipped).alias("seq", "z"))
    return out.select("instrument", F.col("z.timestamps").cast("timestamp_ntz").alias("ts"), F.col("z.prices").cast("double").alias("price"), F.col("z.signals").cast("double").alias("position"), "seq")


def save_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)


def load_report(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def safe_number(column: str):
    """NULL, NaN and infinite values as 0."""
    x = F.col(column)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
