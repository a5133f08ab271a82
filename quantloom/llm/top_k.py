"""Exact top-k search by inner product with no-random-access aggregation over sorted lists.

Vectors are turned into whole numbers, floor(1024 * x). Each shard of about ``shard`` rows keeps, for each dimension, the
list of its rows in order of the component, each entry with the row's norm. A query reads a list from the top where its
own component is positive and from the bottom where it is negative, and adds what it reads of a row to the row's partial
score. All lists are read in rounds: a round goes on in each list until what one unread entry can still change in a score
is at most a width common to all lists, and the width shrinks from round to round; so lists that the query hardly weighs
are read last or not at all.

After each round every row has a lower and an upper bound of its score: the partial score plus, for the unread
components, the sums of the ends and of the reading places of their lists, or, if that is closer, plus or minus the
product of the norms of the unread parts of query and row. Rows whose upper bound is below the k-th lower bound are
outsiders; reading stops when the rows left are few, and their final scores are resolved. Fully read lists give the
scores themselves, so reading always stops.

Queries are a stated part of the rows and travel in blocks to each shard; each shard emits k rows a query, and the
queries' lists of all shards are merged. A task holds one shard and one block of queries.

Defined cases: vectors that are NULL or empty or hold NULL or non-finite components, and rows with a NULL vec_id, take
no part; rows that share a vec_id are rows of their own: each is a candidate, and each a query that leaves out only
itself; vectors of different dimension do not meet; ties go to the smaller vec_id; a component of which 1024 times is no
finite double takes no part; a score beyond long, which its column cannot hold, is the nearest long; fewer rows than k
give all; an empty table gives no rows; other columns are not looked at; a vec_id that is not a whole number is an error
of the cast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.base import Scratch, read_table
from quantloom.llm.vectors import matrices

SCALE = 1024.0
SHARD, BLOCK = 4096, 1024
#: First width as a part of the widest list's, the part of it left after each round, and the share of rows at which a
#: query stops reading.
FIRST, SHRINK = 0.12, 0.6
FEW = 0.02
#: Above this size of a component sums of doubles are no bounds any more, and whole lists are read.
_EXACT = 2.0**53
PACKED = "dim int, shard int, ids binary, numbers binary"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, dim, numbers) of the rows that take part: row is unique once written, numbers are doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (rows, x) in matrices(batch.column(1)).items():
                with np.errstate(over="ignore"):
                    x = np.floor(SCALE * x)
                held = np.isfinite(x).all(axis=1)
                rows, x = rows[held], x[held]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d, dtype=np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "dim", "numbers"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null")
    return rows.mapInArrow(run, "vec_id long, dim int, numbers binary").withColumn("row", F.monotonically_increasing_id())


def pack(rows: DataFrame, most: int) -> DataFrame:
    """Rows (dim, shard, vec_id, row, numbers) packed into one row for each run of at most ``most`` rows of a shard.

    ids holds the vec_id and the row number of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, numbers = None, [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.array(ids, dtype=np.int64).tobytes()]), pa.array([b"".join(numbers)])], ["dim", "shard", "ids", "numbers"])

        for batch in batches:
            for d, s, i, r, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, s) != now or len(ids) >= most:
                    if ids:
                        yield done()
                    now, ids, numbers = (d, s), [], []
                ids.append((i, r))
                numbers.append(x)
        if ids:
            yield done()

    return rows.select("dim", "shard", "vec_id", "row", "numbers").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "vec_id", "row").mapInArrow(run, PACKED)


class SortedLists:
    """The sorted lists of one shard (ids ascending), read by one query at a time; rows tells rows of one id apart."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.x, self.rows = ids, x, ids if rows is None else rows
        columns = np.ascontiguousarray(x.T)
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.lists = np.take_along_axis(columns, self.order, axis=1)
        self.top = max(float(np.abs(x).max()), 1.0)
        self.norms = (x * x).sum(axis=1) if self.top <= _EXACT else np.zeros(len(x))

    def read(self, query_row: int, q: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """The rows that may be among the query's k best ones when its reading stops, and the entries read till then."""
        n, d = self.x.shape
        left = np.flatnonzero(self.rows != query_row)
        if max(self.top, float(np.abs(q).max())) > _EXACT:
            return left, n * d
        few = max(2 * k, FEW * n)
        ends = np.stack([q * self.lists[:, 0], q * self.lists[:, -1]])
        high, low = ends.max(axis=0), ends.min(axis=0)
        slack = 1e-13 * d * max(float(np.abs(q).max()), 1.0) * self.top
        met = np.zeros(d, dtype=np.int64)
        partial, seen, unread = np.zeros(n), np.zeros(n), np.ones((d, n))
        width = FIRST * float((high - low).max(initial=0.0))
        while len(left) > few and (met[q != 0] < n).any():
            width = width * SHRINK if width > 1.0 else -1.0  # contributions are whole numbers: below 1 all is read
            place = np.minimum(high, low + width)  # entries of a greater contribution are read
            for i in range(d):
                line, column = place[i] / q[i] if q[i] else 0.0, self.lists[i]
                if width < 0:  # the width is spent: lists are read to their ends
                    until = n
                elif q[i] > 0:
                    until = n - int(np.searchsorted(column, line, "right"))
                else:
                    until = int(np.searchsorted(column, line, "left")) if q[i] else 0
                span = slice(n - until, n - met[i]) if q[i] > 0 else slice(met[i], until)
                if until > met[i]:
                    rows, values = self.order[i, span], column[span]
                    partial[rows] += q[i] * values
                    seen[rows] += values * values
                    unread[i, rows] = 0.0
                    met[i] = until
            place = np.where(met < n, place, 0.0)
            above, below, of_query = (np.stack([place, low, q * q]) @ unread)[:, left]
            reach = np.sqrt(np.maximum(self.norms[left] - seen[left], 0.0) * of_query)
            upper, lower = (np.clip(partial[left] + b, -(2.0**63), 2.0**63) for b in (np.minimum(above, reach), np.maximum(below, -reach)))
            if len(left) > k:
                line = np.partition(lower, len(left) - k)[len(left) - k]
                left = left[upper >= line - slack]
        return left, int(met.sum())

    def search(self, query_rows: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query row, ids, scores, entries read) of the k best rows of the shard for each query, its own row apart."""
        for query, row in zip(query_rows.tolist(), q, strict=True):
            left, entries = self.read(query, row, k)
            score = self.resolve(left, row)
            best = np.lexsort((self.ids[left], ~score))[:k]  # ~s falls as s rises, without overflow
            yield query, self.ids[left[best]], score[best], entries

    def resolve(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores of rows: in doubles while all sums are whole there, else in Python's numbers."""
        if max(float(np.abs(q).max()), 1.0) * self.top * len(q) < 2.0**52:
            return (self.x[rows] @ q).astype(np.int64)
        own = [int(v) for v in q.tolist()]
        sums = (sum(a * int(b) for a, b in zip(own, x, strict=True)) for x in self.x[rows].tolist())
        return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in sums], dtype=np.int64)


def search(shards: DataFrame, queries: DataFrame, k: int, number: int) -> DataFrame:
    """(query_row, query_id, vec_id, score, entries): the k best rows of each shard for each query, and the entries read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                d, s, is_query, ids, numbers = (batch.column(c)[i].as_py() for c in range(5))
                ids, x = np.frombuffer(ids, dtype=np.int64).reshape(-1, 2), np.frombuffer(numbers).reshape(-1, d)
                if (d, s) != now:
                    now, lists = (d, s), []
                if not is_query:
                    lists.append(SortedLists(ids[:, 0], x, ids[:, 1]))
                    continue
                out, names = [o for held in lists for o in held.search(ids[:, 1], x, k)], dict(ids[:, ::-1].tolist())
                if out:
                    sizes = [len(o[1]) for o in out]
                    columns = [np.repeat([o[0] for o in out], sizes), np.repeat([names[o[0]] for o in out], sizes), np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out]), np.repeat([o[3] for o in out], sizes)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_row", "query_id", "vec_id", "score", "entries"])

    blocks = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("shard"), F.lit(True).alias("is_query"), "ids", "numbers")
    met = shards.select("dim", "shard", F.lit(False).alias("is_query"), "ids", "numbers").unionByName(blocks)
    return met.repartition(min(number, 10_000), "dim", "shard").sortWithinPartitions("dim", "shard", "is_query").mapInArrow(run, "query_row long, query_id long, vec_id long, score long, entries long")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score, entries): the k best rows for each row whose vec_id is divisible by ``every``.

    entries: list entries that the query read in the shard of this row; whole lists are rows of the shard times dimension.
    """
    rows = Scratch(vectors.sparkSession).write(whole_numbers(vectors))
    total = rows.count()
    number = max(1, -(-total // shard))
    deal = lambda df, n: df.withColumn("shard", F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int"))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-total // (every * BLOCK)))
    found = search(pack(deal(rows, number), 2 * shard), pack(deal(asked, blocks), BLOCK), k, number)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "entries")


def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(read_table(spark, folder, "embeddings")).drop("entries")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as n from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.n as double[]), cast(c.n as double[])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_top_k": op9_top_k}
ORACLES: dict[str, str] = {"op9_top_k": ORACLE}
