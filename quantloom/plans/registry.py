"""Named queries over the Parquet tables, with the SQL that DuckDB runs beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WHOLE_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType)


def comparable(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, whole numbers as long, times as text: the form in which results are compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, WHOLE_NUMBERS):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, its twin."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, folder: comparable(f(spark, folder))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add
