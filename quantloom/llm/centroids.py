"""Centroid clustering of whole-number vectors, the nearest centroid found through a vantage-point tree.

Components x become floor(1024 * x). Each round a vantage-point tree over the centroids is built on the driver and
broadcast: a node holds a vantage centroid, and the others are split by their distance to it into a near and a far half.
A task searches the tree for a whole batch of vectors at once, best first: every vector keeps a lower bound for each node
that waits, takes the one of least bound, and stops when no bound is at most its best distance. The bound is inclusive
and a little lowered, so that rounding prunes no centroid that is as near as the best, and leaf distances are exact
integers; of equally near centroids the smaller number wins.

A round sends, for each task and cluster, a count and exact sums; they are added up by Spark, in two steps, and k rows come
back. Vectors are a written table, read once a round.

Defined cases: vectors that are NULL, of another dimension, or hold NULL or non-finite components take no part; each row
that shares a vec_id is a vector of its own; a row with a NULL vec_id is clustered like any other and is never a start;
equal hashes start in order of the vectors; fewer vectors than k give as many centroids; components too large for 64-bit
distances are computed in Python's whole numbers, and a distance or a sum beyond long is the greatest long; an empty
table gives no rows; other columns are not looked at; a vec_id that is not a whole number is an error of the cast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.base import Scratch, read_table
from quantloom.llm.vectors import matrices

SCALE, DIM, K, ROUNDS, SALT = 1024.0, 64, 8, 10, "3:"
#: Components up to this size have squared distances and sums of a batch within 64 bits.
SMALL = 2**27
LEAF, SLACK, MOST_LONG, ROWS = 2, 1e-9, 2**63 - 1, 4096
#: Partial sums of a cluster are first added up in this many groups.
SLICES = 64


def whole_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, numbers, large): numbers as 64-bit integers, or in large, as decimal text, where one exceeds SMALL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (rows, x) in matrices(batch.column(1)).items():
                if d != dim:
                    continue
                with np.errstate(over="ignore"):
                    n = np.floor(SCALE * x)
                small = (np.abs(n) <= SMALL).all(axis=1)
                numbers = [r.tobytes() if s else None for r, s in zip(np.where(small[:, None], n, 0.0).astype(np.int64), small.tolist(), strict=True)]
                large = [None if s else ",".join(str(math.floor(int(SCALE) * whole(v))) for v in r) for r, s in zip(x.tolist(), small.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(numbers, pa.binary()), pa.array(large, pa.string())], ["vec_id", "numbers", "large"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, numbers binary, large string")


def whole(v: float):
    """A double as an exact number: itself while 1024 times it is a double, else an integer."""
    return v if abs(v) < 2.0**1000 else int(v)


def unpack(numbers: list[bytes | None], large: list[str | None], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the rows with 64-bit components, and of those with larger ones, as objects."""
    small = np.array([i for i, b in enumerate(numbers) if b is not None], dtype=np.int64)
    if len(small):
        yield small, np.frombuffer(b"".join(b for b in numbers if b is not None), dtype=np.int64).reshape(-1, dim)
    rest = np.array([i for i, b in enumerate(numbers) if b is None], dtype=np.int64)
    if len(rest):
        yield rest, np.array([[int(v) for v in large[i].split(",")] for i in rest.tolist()], dtype=object)


@dataclass
class Node:
    """A node of the tree: the centroids it decides on itself, and the halves with their nearest and farthest distance."""

    own: list[int]
    near: int = -1
    far: int = -1
    radius: float = 0.0
    reach: float = 0.0


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots of whole numbers as doubles, limited to 2^1000: limited distances differ by no more than whole ones."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([math.sqrt(v) if v < 2**1000 else float(min(math.isqrt(v), 2**1000)) for v in map(int, squares.tolist())])


class VantageTree:
    """A vantage-point tree over centroids given as tuples of Python integers."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        self.centroids = np.array(centroids, dtype=object)
        self.small = all(abs(v) <= SMALL for c in centroids for v in c)
        self.nodes: list[Node] = []
        self._build(list(range(len(centroids))))

    def _distances(self, x: np.ndarray, j: int) -> np.ndarray:
        """Exact squared distances of rows to centroid j."""
        if self.small and x.dtype != object:
            gap = x - self.centroids[j].astype(np.int64)
            return np.einsum("ij,ij->i", gap, gap)
        gap = x.astype(object) - self.centroids[j]
        return (gap * gap).sum(axis=1)

    def _build(self, members: list[int]) -> int:
        at = len(self.nodes)
        if len(members) <= LEAF:
            self.nodes.append(Node(members))
            return at
        vantage, rest = members[0], members[1:]
        gaps = roots(self._distances(self.centroids[rest], vantage)).tolist()
        order = sorted(range(len(rest)), key=lambda i: (gaps[i], rest[i]))
        half = len(rest) // 2
        near, far = [rest[i] for i in order[:half]], [rest[i] for i in order[half:]]
        node = Node([vantage], radius=max((gaps[i] for i in order[:half]), default=0.0), reach=min(gaps[i] for i in order[half:]))
        self.nodes.append(node)
        node.near = self._build(near) if near else -1
        node.far = self._build(far)
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest centroid (the smaller number of equals) and its squared distance."""
        n = len(x)
        plain = self.small and x.dtype != object
        best = np.full(n, MOST_LONG if plain else None, dtype=np.int64 if plain else object)
        number, line = np.full(n, -1, dtype=np.int64), np.full(n, np.inf)
        bounds = np.full((n, len(self.nodes)), np.inf)
        bounds[:, 0] = 0.0
        todo = np.arange(n)
        while len(todo):
            at = bounds[todo].argmin(axis=1)
            low = bounds[todo, at]
            live = (low < np.inf) & (low <= line[todo])  # inclusive: an equally near centroid of smaller number may wait there
            todo, at, low = todo[live], at[live], low[live]
            bounds[todo, at] = np.inf
            for k in np.unique(at).tolist():
                rows, floor, node = todo[at == k], low[at == k], self.nodes[k]
                for j in node.own:
                    d = self._distances(x[rows], j)
                    if plain:
                        better = (d < best[rows]) | (d == best[rows]) & (j < number[rows])
                    else:
                        better = np.array([number[r] < 0 or v < best[r] or (v == best[r] and j < number[r]) for r, v in zip(rows.tolist(), d.tolist(), strict=True)], dtype=bool)
                    hit = rows[better]
                    best[hit], number[hit] = d[better], j
                    reach = roots(d)
                    line[hit] = reach[better]
                if node.far >= 0:
                    slack = SLACK * (1.0 + reach + node.radius + node.reach)
                    bounds[rows, node.far] = np.maximum(floor, node.reach - reach - slack)
                    if node.near >= 0:
                        bounds[rows, node.near] = np.maximum(floor, reach - node.radius - slack)
        return number, best


def starts(vectors: DataFrame, k: int, salt: str, dim: int) -> list[tuple[int, ...]]:
    """The k vectors of smallest sha256 of salt and vec_id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.filter("vec_id is not null").withColumn("_key", key).orderBy("_key", "numbers", "large").limit(k).collect()
    return [tuple(int(v) for v in next(unpack([r["numbers"] and bytes(r["numbers"])], [r["large"]], dim))[1][0]) for r in rows]


def sums(vectors: DataFrame, tree, dim: int, k: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of each cluster that has vectors; at most k rows reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [0] * k, [[0] * dim for _ in range(k)]
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                for _, x in unpack(part.column(0).to_pylist(), part.column(1).to_pylist(), dim):
                    number, _ = tree.value.nearest(x)
                    for j in np.unique(number).tolist():
                        own = x[number == j]
                        counts[j] += len(own)
                        totals[j] = [a + int(b) for a, b in zip(totals[j], own.sum(axis=0).tolist(), strict=True)]
        held = [j for j in range(k) if counts[j]]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([counts[j] for j in held], pa.int64()), pa.array([",".join(map(str, totals[j])) for j in held], pa.string())], ["cluster", "n", "sums"])

    def add(pdf):
        totals = [0] * dim
        for text in pdf["sums"]:
            totals = [a + int(b) for a, b in zip(totals, text.split(","), strict=True)]
        return pdf.iloc[:1].assign(n=pdf["n"].sum(), sums=",".join(map(str, totals)))

    schema = "cluster int, n long, sums string"
    found = vectors.select("numbers", "large").mapInArrow(partial, schema)
    sliced = found.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES))).groupBy("cluster", "slice").applyInPandas(add, schema + ", slice int")
    rows = sliced.drop("slice").groupBy("cluster").applyInPandas(add, schema).collect()
    return {r["cluster"]: (r["n"], [int(v) for v in r["sums"].split(",")]) for r in rows}


def assigned(vectors: DataFrame, tree, dim: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                for places, x in unpack(part.column(1).to_pylist(), part.column(2).to_pylist(), dim):
                    number, gap = tree.value.nearest(x)
                    gap = pa.array([min(int(g), MOST_LONG) for g in gap.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places)), pa.array(number.astype(np.int32)), gap], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "numbers", "large").mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, salt: str = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = scratch.write(whole_vectors(vectors, dim))
    centroids = starts(rows, k, salt, dim)
    if not centroids:  # nothing to start from
        empty = "cast(null as bigint) as {}"
        return rows.limit(0).selectExpr("vec_id", "cast(null as int) as cluster", *[empty.format(c) for c in ("distance", "cluster_inertia", "inertia")], "cast(null as string) as centroid_sha256")
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        found = sums(rows, tree, dim, len(centroids))
        centroids = [tuple(v // found[j][0] for v in found[j][1]) if j in found else c for j, c in enumerate(centroids)]
        tree.unpersist()
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    out = scratch.write(assigned(rows, tree, dim))
    digests = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    by_cluster = out.groupBy("cluster").agg(total("distance").alias("cluster_inertia"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("_d"))
    whole_sum = F.least(F.sum("_d").over(Window.partitionBy()), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")  # over k rows
    facts = by_cluster.withColumn("inertia", whole_sum).drop("_d").join(digests, "cluster")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(read_table(spark, folder, "embeddings"))


def _oracle(k: int, rounds: int, dim: int, salt: str) -> str:
    """All rounds as one chain of tables; distances in whole numbers, floors by moving the rest below zero up."""
    near = "select vec_id, n, unnest(min_by({{j: j, d: d}}, (d, j))) from (select v.vec_id, v.row, v.n, c.j, list_sum(list_transform(list_zip(v.n, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{r} c) group by vec_id, row, n"
    text = f"""with v as materialized (select vec_id, row_number() over () as row, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as n from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select (row_number() over (order by sha256('{salt}' || vec_id::varchar), n) - 1)::int as j, n as c from v where vec_id is not null qualify j < {k})"""
    for r in range(rounds + 1):
        text += f",\na{r} as materialized ({near.format(r=r)})"
        if r < rounds:
            text += f""",
s{r} as (select j, i, sum(x)::hugeint as s, count(*)::hugeint as m from (select j, unnest(n) as x, unnest(range({dim})) as i from a{r}) group by all),
c{r + 1} as materialized (select c.j, coalesce(f.c, c.c) as c from c{r} c left join (select j, list(((s - ((s % m) + m) % m) // m)::bigint order by i) as c from s{r} group by 1) f using (j))"""
    return text + f"""
select a.vec_id, a.j::int as cluster, a.d as distance, (sum(a.d) over (partition by a.j))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.j = c.j"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_centroids": op13_centroids}
ORACLES: dict[str, str] = {"op13_centroids": _oracle(K, ROUNDS, DIM, SALT)}
