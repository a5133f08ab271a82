"""Near-duplicate documents by SetSketch registers, register bands, joint likelihood and exact verification.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes) and a sketch of 192 registers. A register
   keeps the least exponential value met under its own hash, truncated to steps that are spaced exponentially with
   base 1.001; the register of a union is the maximum of the registers, so sketches merge, and two sets agree in a
   register with about the probability of their Jaccard similarity.
2. Documents with equal sets are one node, named by the least doc_id; sets are equal if their sizes and the SHA-256 of all
   their members in order are.
3. The registers are cut into 32 bands of 6. Nodes with an equal band are mates, and only mates are compared; a pair at the
   threshold of 0.85 is missed by all bands with probability 3e-7.
4. First each mate is compared with the hub of its bucket, the least node there, in tasks that take a hub and a hash part
   of its mates. Then come the buckets whose other mates are not all connected by that: every pair of them is compared
   once, in the first band that it shares, but for pairs that are connected already. A bucket above ``block`` nodes is
   cut into blocks, and each pair of blocks is a task of its own, so memory is bounded by two blocks whatever the bucket,
   and no pair is emitted: only spanning links are.
5. A comparison begins with the registers: the joint likelihood of their counts of greater, less and equal ones, given
   both set sizes, estimates the similarity. Pairs estimated more than 0.15, about six standard errors, below the
   threshold are passed over, and the others are verified on full sets.
6. Components of the verified links give component_id.

Defined cases: NULL or blank texts have n_shingles 0 and are their own component; a NULL doc_id links with nothing, has
a NULL component_id and is kept; rows that share a doc_id are one document, linked to each other; repeated rows are
returned as often as they come; an empty table gives no rows; columns beyond doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.base import Scratch, chunks, hash_grams, hash_words, mix64, read_table
from quantloom.llm.components import Forest, components, hub_line, meet

SHINGLE = 5
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Base of the register steps, rate of the exponential values, highest step.
BASE, RATE, TOP = 1.001, 20.0, 65_535
MARGIN = 0.15
#: Shingles of a block at most, but for one longer document, and hash parts of the mates of a hub.
BLOCK_SHINGLES, PARTS = 2_000_000, 64
_SEEDS = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TURN, STIR = _SEEDS[:REGISTERS] | np.uint64(1), _SEEDS[REGISTERS:]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = hash_words(texts)
    grams, owner = hash_grams(words, counts, SHINGLE)
    out = np.split(grams, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
    ends = np.cumsum(counts)
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        n = int(counts[i])
        out[i] = hash_grams(words[ends[i] - n : ends[i]], counts[i : i + 1], n)[0]
    return [np.unique(x) for x in out]


def sketch(members: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes; those of an empty set are 0."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(members), 2048):
        least = np.minimum(least, ((members[i : i + 2048, None] ^ STIR) * TURN).min(axis=0))
    if not len(members):
        return np.zeros(REGISTERS, dtype="<u2")
    x = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def estimate(greater: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and set sizes, for a base near 1."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    equal = REGISTERS - greater - less
    a, b = u * u * (equal + less), v * v * (equal + greater)
    return (a + b - np.sqrt((a - b) ** 2 + 4 * greater * less * u * u * v * v)) / (2 * REGISTERS * u * v)


def is_similar(few: np.ndarray, many: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, on all their members."""
    if len(few) > len(many):
        few, many = many, few
    both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return 100 * both >= percent * (len(few) + len(many) - both)


def promising(sizes: np.ndarray, sketches: np.ndarray, size: float, own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets that may reach the similarity with the set of ``own``, most alike first."""
    near = np.flatnonzero(100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))
    greater, less = (sketches[near] > own).sum(axis=1), (sketches[near] < own).sum(axis=1)
    guess = estimate(greater.astype(np.float64), less.astype(np.float64), sizes[near], size)
    order = np.argsort(-guess, kind="stable")
    return near[order[guess[order] >= percent / 100 - MARGIN]]


def links(ids: list[int], groups: list[int], sets: list[np.ndarray], sketches: np.ndarray, split: int, band: int, percent: int) -> Iterator[tuple[int, int]]:
    """Spanning links among mates of a band, or, if 0 < split < n, those of the pairs across the split; each is verified.

    Nodes of a group are connected already, and further links inside it are passed over: they change no component.
    Pairs that share an earlier band are left to that one.
    """
    forest = Forest()
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    bands = sketches.reshape(len(ids), BANDS, ROWS)
    for i in range(max(split, 1), len(ids)):
        stop = min(i, split) if split else i
        for j in promising(sizes[:stop], sketches[:stop], sizes[i], sketches[i], percent).tolist():
            if forest.root(groups[i]) == forest.root(groups[j]) or (bands[i, :band] == bands[j, :band]).all(axis=1).any():
                continue
            if is_similar(sets[i], sets[j], percent):
                forest.join(groups[i], groups[j])
                yield ids[i], ids[j]


def with_sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, print, sketch): the size, the SHA-256 and the registers of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch, "text"):
                sets = shingle_sets(texts)
                columns = [
                    batch.column(0).slice(begin, len(texts)).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary()),
                    pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print", "sketch"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, print binary, sketch binary")


def bucket_mates(nodes: DataFrame) -> DataFrame:
    """(band, key, node, n_shingles, hub) of the nodes that share a band with another; hub is the least node of the bucket."""
    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring(F.col("sketch"), b * width + 1, F.lit(width))).alias("key")))
    keyed = nodes.select("node", F.col("n_shingles").cast("int").alias("n_shingles"), F.inline(bands))
    hubs = keyed.groupBy("band", "key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("n")).filter("hub <> last").drop("last")
    return meet(keyed, hubs, ["band", "key"], hub_line(BANDS * nodes.count()))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, sketch, members): the sets of the nodes of wanted (node, print, sketch), read again from the texts of that doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows give their set once
        for batch in batches:
            for begin, texts in chunks(batch, "text"):
                found = [s.tobytes() for s in shingle_sets(texts)]
                columns = [batch.column(k).slice(begin, len(texts)) for k in (0, 1, 2)]
                stay = []
                for members, own in zip(found, columns[2].to_pylist(), strict=True):
                    stay.append(own not in seen and hashlib.sha256(members).digest() == own)
                    if stay[-1]:
                        seen.add(own)
                yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(found, pa.binary())], ["node", "sketch", "members"]).filter(pa.array(stay, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
    return texts.join(wanted.hint("shuffle_hash"), "node").select("node", "sketch", "print", "text").mapInArrow(run, "node long, sketch binary, members binary")


def hub_links(mates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the verified links between mates and the hubs of their buckets."""
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part")
    pairs = mates.filter("node <> hub").select("node", "hub").distinct().select("node", "hub", part)
    of_mates = pairs.join(sets, "node").select("hub", "part", F.lit(True).alias("mate"), "node", "sketch", "members")
    of_hubs = pairs.select(F.col("hub").alias("node"), "part").distinct().join(sets, "node").select(F.col("node").alias("hub"), "part", F.lit(False).alias("mate"), "node", "sketch", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, []
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                *key, mate, node, drawn, members = (batch.column(k)[i].as_py() for k in range(6))
                members, drawn = np.frombuffer(members, dtype=np.uint64), np.frombuffer(drawn, dtype="<u2")
                if key != now:
                    now, hub = key, []
                if not mate:  # one, or more if the doc_id stands on unlike texts; before the mates
                    hub.append((members, drawn))
                    continue
                for own, registers in hub:
                    if len(promising(np.array([float(len(own))]), registers[None], float(len(members)), drawn, percent)) and is_similar(own, members, percent):
                        found.append((node, key[0]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return of_mates.unionByName(of_hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "mate").mapInArrow(run, "u long, v long")


def bucket_links(mates: DataFrame, sets: DataFrame, percent: int, block: int, line: int) -> DataFrame:
    """(u, v): spanning links among the mates (band, key, node, hub, component, n_shingles) that hubs leave unconnected."""
    rest = mates.filter("node <> hub").select("band", "key", "node", "component", "n_shingles")
    sizes = rest.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("mass"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int")
    placed = meet(rest, sizes.select("band", "key", "n", parts.alias("parts")), ["band", "key"], line).select("band", "key", "node", "component", "parts").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    held = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "band", "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), (F.col("part") > F.col("other")).alias("late"), "node", "component"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, split = None, [], 0

        def done() -> pa.RecordBatch:
            found = []
            if key[2] == key[3] or 0 < split < len(rows):
                ids, groups, members, drawn = zip(*rows, strict=True)
                found = list(links(ids, groups, members, np.stack(drawn), split if key[2] != key[3] else 0, key[0], percent))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for i in range(batch.num_rows):
                *now, late, node, component, drawn, members = (batch.column(k)[i].as_py() for k in range(9))
                if now != key:
                    if len(rows) > 1:
                        yield done()
                    key, rows, split = now, [], 0
                rows.append((node, component, np.frombuffer(members, dtype=np.uint64), np.frombuffer(drawn, dtype="<u2")))
                split += not late
        if len(rows) > 1:
            yield done()

    keys = ("band", "key", "a", "b")
    met = held.join(sets, "node").select(*keys, "late", "node", "component", "sketch", "members")
    return met.repartition(*keys).sortWithinPartitions(*keys, "late", "node").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = 2048) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs; similarity of at least percent / 100 links."""
    scratch = Scratch(docs.sparkSession)
    base = scratch.write(with_sketches(docs))
    keys = ["n_shingles", "print"]
    full = base.filter("doc_id is not null and n_shingles > 0")
    nodes = scratch.write(full.groupBy(*keys).agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")))
    # only the nodes of a doc_id that stands on unlike texts need a link; copies find their component by their set's print
    held = full.select("doc_id", *keys).join(nodes.select("node", *keys), keys).select("doc_id", "node")
    several = held.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("doc_id")
    own = held.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    mates = scratch.write(bucket_mates(nodes))
    sets = scratch.write(full_sets(docs, nodes.join(mates.select("node").distinct(), "node").select("node", "print", "sketch")))
    first = scratch.write(components(hub_links(mates, sets, percent).unionByName(own), scratch))
    grouped = mates.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = bucket_links(grouped, sets, percent, block, hub_line(mates.count()))
    for end in ("u", "v"):  # what hubs have joined is one node
        more = more.join(first.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).select("u", "v")
    second = scratch.write(components(more, scratch)).select(F.col("node").alias("component"), F.col("component").alias("last"))
    named = nodes.select("node", *keys).join(first, "node", "left").withColumn("component", F.coalesce("component", "node")).join(second, "component", "left").select(*keys, F.coalesce("last", "component").alias("component"))
    out = base.select("doc_id", *keys).join(named, keys, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"))


ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '') as w from documents),
g as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
h as (select doc_id, hash(g)::ubigint as g, g as s from g),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both from h a join h b on a.g = b.g and a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
pairs as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * p.both >= 85 * (x.n + y.n - p.both)),
reach as (select a as x, b as y from pairs union select r.x, p.b from reach r join pairs p on r.y = p.a),
least as (select x, min(y) as y from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(least.y, d.doc_id)) as component_id, d.doc_id <= coalesce(least.y, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join least on d.doc_id = x
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_near_dup": op4_near_dup}
ORACLES: dict[str, str] = {"op4_near_dup": ORACLE}
