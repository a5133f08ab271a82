"""Near-duplicate vectors by tiled comparison in the order of principal components.

1. Vectors are scaled to length 1; equal vectors become one row that counts for all of them.
2. A rotation to principal components, fitted on at most ``SAMPLE`` rows, keeps all cosines; so the sample changes the
   speed and never the result. Rows are ordered by the first component and cut into tiles of about ``tile`` rows.
3. Two linked unit vectors are less than sqrt(2 - 2 * threshold) apart, so tiles whose ranges of the first component are
   farther apart than that are not compared. For the others, the product over the first 16 components plus the product of
   the norms of what is left (Cauchy-Schwarz) bounds the cosine of every pair in one matrix product; pairs whose bound
   stays below the threshold are done. The rest add further components, with the bound renewed, and survivors are
   decided by the full cosine in double precision.
4. Each pair of tiles emits the number of links of each row and the links of a spanning forest, never the pairs.

Every task holds two tiles, whatever the input. Vectors of different dimension link with nothing of another dimension.

Defined cases: vectors that are NULL, empty or zero, or hold NULL or non-finite components, link with nothing: n_links 0
and a component of their own; rows that share a vec_id are one node, and their links count for each row; a NULL vec_id
links with nothing, has a NULL component and is kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.base import Scratch, mix64, read_table
from quantloom.llm.components import Forest, components
from quantloom.llm.vectors import matrices

SAMPLE = 4096
LEAD = 16
TILE = 16_384
SLACK = 1e-4

UNITS = "vec_id long, dim int, f1 long, f2 long, unit binary"


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, f1, f2, unit) of the rows that can link: a fingerprint of the vector, and its unit vector as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (rows, x) in matrices(batch.column(1)).items():
                scale = np.abs(x).max(axis=1)
                rows, x, scale = rows[scale > 0], x[scale > 0], scale[scale > 0]
                x = x / scale[:, None]
                x = (x / np.sqrt((x * x).sum(axis=1))[:, None]) + 0.0
                turn = mix64(np.arange(1, d + 1, dtype=np.uint64)) | np.uint64(1)
                bits = mix64(np.ascontiguousarray(x).view(np.uint64) + turn)
                prints = [pa.array((mix64(bits ^ np.uint64(k)) * turn).sum(axis=1, dtype=np.uint64).view(np.int64)) for k in (0, 0x5BD1E995)]
                units = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d, dtype=np.int32)), *prints, units], ["vec_id", "dim", "f1", "f2", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id is not null").mapInArrow(run, UNITS)


def fit_rotation(nodes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: a rotation to principal components, and the sampled first components in order."""
    rows = nodes.orderBy(F.xxhash64("f1"), "f1").limit(SAMPLE).select("dim", "unit").collect()
    out = {}
    for d in sorted({r["dim"] for r in rows}):
        x = np.stack([np.frombuffer(r["unit"]) for r in rows if r["dim"] == d])
        turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        out[d] = turn, np.sort(x @ turn[:, 0])
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of rotated unit vectors whose cosine reaches the threshold; i < j if x and y are the same."""
    lead = min(LEAD, x.shape[1])
    left, right = (np.hstack([m[:, :lead], np.sqrt(np.maximum((m[:, lead:] ** 2).sum(axis=1), 0))[:, None]]).astype(np.float32) for m in (x, y))
    for begin in range(0, len(x), 512):
        bound = left[begin : begin + 512] @ right.T
        i, j = np.nonzero(bound >= threshold - SLACK)
        i += begin
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 17):
            a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            sums, done = np.zeros(len(a)), 0
            for stop in [*range(2 * lead, x.shape[1], lead), x.shape[1]]:
                sums = sums + np.einsum("ij,ij->i", x[a, done:stop], y[b, done:stop])
                rest = np.sqrt(np.maximum((x[a, stop:] ** 2).sum(axis=1) * (y[b, stop:] ** 2).sum(axis=1), 0))
                on = sums + rest >= threshold - SLACK
                a, b, sums, done = a[on], b[on], sums[on], stop
            yield a, b


def plan_tiles(tiles: list[tuple[int, float, float, int]], reach: float) -> tuple[list[tuple[int, int, int, int]], int]:
    """(name, place, first, last) of each tile (dim, low, high, name): the tiles from first to last may hold links with it;
    and the number of pairs. Tiles are taken in order of (dim, low); within a dimension the greatest high so far never falls.
    """
    order = sorted(tiles)
    dims, low, high = (np.array([t[k] for t in order]) for k in range(3))
    spans, pairs = [], 0
    for d in np.unique(dims):
        begin, end = np.searchsorted(dims, d, "left"), np.searchsorted(dims, d, "right")
        tops = np.maximum.accumulate(high[begin:end])
        first = begin + np.searchsorted(tops, low[begin:end] - reach, "left")
        last = begin + np.searchsorted(low[begin:end], tops + reach, "right") - 1
        places = np.arange(begin, end)
        spans += list(zip((order[k][3] for k in places), places.tolist(), first.tolist(), last.tolist(), strict=True))
        pairs += int((last - places + 1).sum())
    return spans, pairs


def compare_tiles(tiles: DataFrame, pairs: int, threshold: float, rotation: dict) -> DataFrame:
    """Rows (u, v, weight): v NULL: weight more links of node u; weight NULL: u and v are linked, a forest edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, _, ids, weights, dim, units = (batch.column(c)[i].as_py() for c in range(7))
                own = np.frombuffer(units).reshape(-1, dim)
                tile = np.frombuffer(ids, dtype=np.int64), np.frombuffer(weights, dtype=np.int64), own @ rotation[dim][0] if dim in rotation else own, own
                if (a, b) != now:
                    now, first = (a, b), tile
                    if a != b:
                        continue
                (ids_x, w_x, x, own_x), (ids_y, w_y, y, own_y) = first, tile
                counts_x, counts_y, forest, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), Forest(), []
                for p, q in close_pairs(x, y, threshold, a == b):
                    exact = np.einsum("ij,ij->i", own_x[p], own_y[q]) >= threshold
                    p, q = p[exact], q[exact]
                    apart = ids_x[p] != ids_y[q]
                    np.add.at(counts_x, p[apart], w_y[q[apart]])
                    np.add.at(counts_y, q[apart], w_x[p[apart]])
                    edges += [(u, v) for u, v in zip(ids_x[p].tolist(), ids_y[q].tolist(), strict=True) if forest.join(u, v)]
                u = np.concatenate([ids_x, ids_y])
                n = np.concatenate([counts_x, counts_y])
                u, n = u[n > 0], n[n > 0]
                blank = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u), blank, pa.array(n)], ["u", "v", "weight"])
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64()), pa.nulls(len(edges), pa.int64())], ["u", "v", "weight"])

    return tiles.repartition(pairs, "a", "b").sortWithinPartitions("a", "b", "k").mapInArrow(run, "u long, v long, weight long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession)
    base = scratch.write(unit_rows(vectors).dropDuplicates(["vec_id", "f1", "f2"]))
    keys = ["dim", "f1", "f2"]
    nodes = scratch.write(base.groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("unit").alias("unit")))
    rotation = fit_rotation(nodes)
    total = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    cuts = {d: np.unique(np.quantile(lead, np.linspace(0, 1, max(1, -(-total[d] // tile)) + 1)[1:-1])) for d, (_, lead) in rotation.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                own = np.stack([np.frombuffer(v.as_py()) for v in part.column(3)])
                lead = own @ rotation[d][0][:, 0] if d in rotation else own[:, 0]
                slot = np.searchsorted(cuts.get(d, np.empty(0)), lead)
                columns = [part.column(0), part.column(1), part.column(2), pa.array(slot.astype(np.int32)), pa.array(lead), part.column(3)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "weight", "dim", "slot", "lead", "unit"])

    placed = nodes.select("node", "weight", "dim", "unit").mapInArrow(place, "node long, weight long, dim int, slot int, lead double, unit binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each run of at most ``tile`` rows of a slot; rows come sorted by (dim, slot)."""
        now, held = None, []

        def done() -> pa.RecordBatch:
            ids, weights, leads, units = zip(*held, strict=True)
            blobs = np.array(ids, dtype=np.int64).tobytes(), np.array(weights, dtype=np.int64).tobytes(), b"".join(units)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([min(leads)]), pa.array([max(leads)]), *(pa.array([x], pa.binary()) for x in blobs)], ["dim", "low", "high", "ids", "weights", "units"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for node, weight, dim, slot, lead, unit in zip(*columns, strict=True):
                if (dim, slot) != now or len(held) >= tile:
                    if held:
                        yield done()
                    now, held = (dim, slot), []
                held.append((node, weight, lead, unit))
        if held:
            yield done()

    packed = placed.repartition("dim", "slot").sortWithinPartitions("dim", "slot").mapInArrow(pack, "dim int, low double, high double, ids binary, weights binary, units binary")
    stored = scratch.write(packed.withColumn("name", F.xxhash64("dim", "ids")))
    tiles = [(r["dim"], r["low"], r["high"], r["name"]) for r in stored.select("dim", "low", "high", "name").collect()]  # 32 bytes a tile
    spans, pairs = plan_tiles(tiles, float(np.sqrt(2 - 2 * threshold)) + SLACK)
    numbered = stored.join(vectors.sparkSession.createDataFrame(spans or [(0, 0, 0, 0)], "name long, k int, first int, last int"), "name")
    other = numbered.withColumn("other", F.explode(F.sequence("first", "last")))
    asked = other.select(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b"), "k", "ids", "weights", "dim", "units")
    found = scratch.write(compare_tiles(asked, max(1, min(pairs, 10_000)), threshold, rotation))
    own = base.join(nodes.select("node", *keys), keys).select(F.col("vec_id").alias("u"), F.col("node").alias("v"))
    labels = scratch.write(components(found.filter("weight is null").select("u", "v").unionByName(own.filter("u <> v")), scratch))
    more = found.filter("v is null").groupBy("u").agg(F.sum("weight").alias("links"))
    by_node = nodes.join(more, F.col("node") == F.col("u"), "left").select("node", *keys, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    by_row = base.join(by_node, keys).groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    out = vectors.select(F.col("vec_id").cast("long")).alias("r").join(by_row.alias("l"), F.col("r.vec_id") == F.col("l.vec_id"), "left").join(labels, F.col("r.vec_id") == F.col("node"), "left")
    component = F.coalesce("component", F.col("r.vec_id"))
    return out.select(F.col("r.vec_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("r.vec_id") == component, F.lit(True)).alias("kept"))


def op8_vector_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "embeddings"))


ORACLE = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from v where list_inner_product(e, e) > 0),
pairs as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach as (select a as x, b as y from pairs union select r.x, p.b from reach r join pairs p on r.y = p.a),
least as (select x, min(y) as y from reach group by 1),
linked as (select a, count(*) as n from pairs group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(least.y, vec_id)) as component_id, vec_id <= coalesce(least.y, vec_id) as kept
from embeddings left join least on vec_id = x left join linked on vec_id = a
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_vector_dup": op8_vector_dup}
ORACLES: dict[str, str] = {"op8_vector_dup": ORACLE}
