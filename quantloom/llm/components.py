"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.base import Scratch

#: A key is a hub if it has more than one in HUBS of the rows, and more than LEAST_HUB: a few times HUBS keys can be.
HUBS, LEAST_HUB = 20_000, 1_000


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], line: int) -> DataFrame:
    """rows joined with facts, which has one row a key and the number n of its rows, returned without n.

    The rows of keys above ``line`` are answered where they stand, from a broadcast, so no task gets all rows of a key. The
    caller sets the line to a share of all rows, which bounds the number of such keys.
    """
    large = F.broadcast(facts.filter(F.col("n") > line).drop("n"))
    return rows.join(large, keys).unionByName(rows.join(large.select(*keys), keys, "left_anti").join(facts.filter(F.col("n") <= line).drop("n"), keys))


def hub_line(rows: int) -> int:
    """The number of rows from which a key is a hub."""
    return max(LEAST_HUB, rows // HUBS)


def _stars(directed: DataFrame, line: int, hubs: bool) -> DataFrame:
    """directed: (u, v) with v a neighbour of u. Adds m, the least id in u's neighbourhood, u included."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return meet(directed, least, ["u"], line) if hubs else directed.join(least.drop("n"), "u")


def _shape(edges: DataFrame) -> tuple[int, int]:
    """(nodes that keep the edges (u, v), v < u, from being stars; most edges of a node): in stars no node has two hubs, and
    no hub has one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    of = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    found = of.agg(F.sum(((F.col("up") > 1) | (F.col("up") > 0) & (F.col("n") > F.col("up"))).cast("long")).alias("loose"), F.max("n").alias("most")).first()
    return found["loose"] or 0, found["most"] or 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of edges (u, v); component is the least node that can be reached.

    Large-star moves each larger neighbour of a node to the least node near it, small-star the smaller ones; the edges
    shrink to one star a component in about log(n) rounds. Minima are combined before the shuffle, and the joins give
    one row an edge, those of hubs, once there are any, without a shuffle. Every round is a written table.
    """
    now = scratch.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    line = None
    while True:
        loose, most = _shape(now)
        if not loose:
            break
        line = line or hub_line(now.count())
        hubs = 2 * most > line
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, line, hubs).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        stars = _stars(scratch.write(large) if hubs else large, line, hubs)
        small = stars.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(stars.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = scratch.write(small.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Union-find over ids; the least id of a set is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
