"""Iterations over series that no task can hold: rounds of messages between buckets of rows and their series.

Buckets of rows are packed once, one row each, and stay in executors' memory or on their disks. A round maps over them,
each bucket answering what its series told it, and groups the small answers by series, which draws from them what to tell
next. The messages are a written table every few rounds.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.linear import bucketed
from quantloom.functions.written import Rounds

#: Rounds of messages between two written tables.
CHAIN = 8


def pack(panel: DataFrame, columns: list[str], calibrate: str | None, bucket_s: int) -> DataFrame:
    """(instrument, _bucket, n, x, at, fit): the complete rows of each bucket in time order, as bytes."""
    wanted = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    fit = F.coalesce(F.col(calibrate).cast("boolean"), F.lit(False)) if calibrate else F.lit(True)
    rows = bucketed(panel.select("instrument", "ts", *wanted, fit.alias("_fit")), bucket_s).dropna(subset=[f"_x{i}" for i in range(len(columns))])
    kind = panel.schema["instrument"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        x = np.ascontiguousarray(pdf[[f"_x{i}" for i in range(len(columns))]].to_numpy(dtype=float))
        at = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        return pdf.iloc[:1][["instrument", "_bucket"]].assign(n=len(x), x=[x.tobytes()], at=[at.tobytes()], fit=[pdf["_fit"].to_numpy(dtype=bool).tobytes()])

    packed = rows.groupBy("instrument", "_bucket").applyInPandas(run, f"instrument {kind}, _bucket long, n long, x binary, at binary, fit binary")
    return packed.repartition("instrument", "_bucket").persist(StorageLevel.MEMORY_AND_DISK)


class Messages:
    """Rounds of messages: buckets answer what their series told them, and a series draws from its buckets' answers.

    A message is (what the series knows, what this bucket alone is told).
    """

    def __init__(self, chunks: DataFrame, told: DataFrame, d: int):
        self.chunks, self.told, self.d = chunks, told, d
        self.kind = chunks.schema["instrument"].dataType.simpleString()
        self.tables, self.since = Rounds(chunks.sparkSession), 0

    def met(self, columns: list[str]) -> DataFrame:
        return self.chunks.select("instrument", "_bucket", *columns).join(self.told.select("instrument", "_bucket", "note"), ["instrument", "_bucket"])

    def round(self, answer: Callable, draw: Callable, last: bool = False) -> None:
        """answer(known, own, x) of each bucket; draw(known, answers in order) gives the next known and each bucket's own.

        Series that have ended stay as they are. The last round is for all series, over all rows and not those of the fit.
        """
        d, note = self.d, f"instrument {self.kind}, _bucket long, note binary"
        schema = note + ", done boolean"

        def by_bucket(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for x, fit, told in zip(pdf["x"], pdf["fit"], pdf["note"], strict=True):
                    known, own = pickle.loads(told)
                    rows = np.frombuffer(x).reshape(-1, d)
                    rows = rows if last else rows[np.frombuffer(fit, dtype=bool)]
                    out.append(pickle.dumps((known, answer(known, own, rows) if last or not known.get("done") else None)))
                yield pdf[["instrument", "_bucket"]].assign(note=out)

        def by_series(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_bucket")
            answers = [pickle.loads(n) for n in pdf["note"]]
            known = answers[0][0]
            if known.get("done") and not last:
                return pdf.assign(note=[pickle.dumps((known, None))] * len(pdf), done=True)
            known, own = draw(known, [a for _, a in answers])
            return pdf.assign(note=[pickle.dumps((known, o)) for o in own], done=bool(known.get("done")))

        answers = self.met(["x", "fit"]).mapInPandas(by_bucket, note)
        self.told = answers.groupBy("instrument").applyInPandas(by_series, schema)
        self.since += 1
        if self.since >= CHAIN:
            self.write()

    def write(self) -> None:
        self.told, self.since = self.tables.write(self.told), 0

    def all_done(self) -> bool:
        return self.told.filter("not done").isEmpty()
