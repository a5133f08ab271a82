"""Prefix trie of conversations with vertical bitmaps.

Conversations are rebuilt first: the first h turns of conversation c - c % 5, then c's own turns after its first h, where
h is crc32 of c's decimal text modulo 9. Every distinct sequence of first turns is then a node of a trie whose members are
the rebuilt conversations that begin with it.

A shard is a range of SHARD conversation ids, so a task holds the turns (a digest and a length each, no text) of at most
SHARD conversations, however common a turn or a whole conversation is. In a shard each (position, turn) has a bitset of
conversations; going depth first, the bitset of a node met with the postings of the next position gives the children,
their popcounts, and, as what is left, the conversations that end there. The nodes of all shards are then added up by
the digest of their path: a node is one row a shard at most, so that no path is a hot key.

Sums over subtrees need no walk through the tree: what a node adds is credited in the shard of its smallest member, which
holds all prefixes of that member and with them all nodes above. There the nodes are numbered in depth-first order, a
subtree is a run of numbers, and running sums give each shard's share; the shares of a node are added up.

Ids of conversations that end at a node reach one task in order, as a stream that is hashed and not held: SHA-256 of a
list has no parallel form, and its rows are one text a shard.

Defined cases: a NULL role or text is empty; turns are ordered by turn, NULL first, then role and text; repeated rows are
turns of their own; rows with a NULL conv_id belong to no conversation; the base of a negative c is that of Spark's %, so
c - c % 5 moves towards 0; without rows there is no trie, not even a root; other columns are not looked at; a conv_id
that is not a whole number is an error of the cast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.base import Scratch, read_table

#: Ids of a shard; a multiple of GROUP, so that a conversation and its base are in one shard.
SHARD, GROUP, HEADS = 640, 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
PARTS = "shard long, pre long, last long, node binary, parent binary, depth long, conv_id long, n_convs long, n_bytes long, inner boolean, ends string"


def head(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % GROUP


def turns(conversations: DataFrame, shard: int) -> DataFrame:
    """(shard, conv_id, base, head, turn_key, n_bytes), in order within shard and conversation; no partition cuts a shard.

    turn_key: 128 bits of the SHA-256 of role and text, the length of the role before them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text")).filter("conv_id is not null")
    rows = rows.withColumn("shard", F.expr(f"(conv_id - conv_id % {GROUP}) div {shard}")).repartition("shard").sortWithinPartitions("shard", "conv_id", F.col("_turn").asc_nulls_first(), "_role", "_text")
    whole = F.concat(F.octet_length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text"))
    key = F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)
    return rows.select("shard", "conv_id", base_of(F.col("conv_id")).alias("base"), head(F.col("conv_id")).alias("head"), key.alias("turn_key"), F.octet_length("_text").cast("long").alias("n_bytes"))


def rebuilt(own: dict[int, list], bases: dict[int, tuple[int, int]]) -> dict[int, list]:
    """The rebuilt turns of each conversation of a shard, from its own turns and its (base, head)."""
    return {c: own.get(base, [])[:h] + own[c][h:] for c, (base, h) in bases.items()}


class Bitmaps:
    """The vertical bitmaps of one shard: conversations by ascending id, one bit each."""

    def __init__(self, sequences: dict[int, list]):
        self.ids = sorted(sequences)
        self.paths = [sequences[c] for c in self.ids]
        self.postings: dict[tuple, int] = {}
        width = (len(self.ids) + 7) // 8
        marks: dict[tuple, list[int]] = {}
        for i, path in enumerate(self.paths):
            for at, turn in enumerate(path):
                marks.setdefault((at, turn[0]), []).append(i)
        for posting, members in marks.items():
            if len(members) == 1:
                self.postings[posting] = 1 << members[0]
            else:
                bits = np.zeros(8 * width, dtype=np.uint8)
                bits[members] = 1
                self.postings[posting] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def members(self, bits: int) -> list[int]:
        """The ids of a bitset, ascending."""
        found = []
        while bits:
            low = bits & -bits
            found.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return found

    def children(self, bits: int, depth: int) -> tuple[list[tuple[int, int]], int]:
        """(first member, bitset) of each child of a node, and the bitset of the members that end at it."""
        out, ends = [], 0
        while bits:
            low = bits & -bits
            first = low.bit_length() - 1
            if len(self.paths[first]) == depth:
                ends |= low
                bits ^= low
            else:
                child = bits & self.postings[depth, self.paths[first][depth][0]]
                out.append((first, child))
                bits ^= child
        return out, ends

    def nodes(self) -> list[list]:
        """[pre, last, node, parent, depth, conv_id, n_convs, n_bytes, inner, ends] in depth-first order.

        pre and last: the node's number and the greatest one in its subtree.
        """
        out: list[list] = []
        waiting = [(0, (1 << len(self.ids)) - 1, 0, ROOT, None)]
        open_nodes: list[list] = []
        while waiting:
            first, bits, depth, node, parent = waiting.pop()
            while open_nodes and open_nodes[-1][4] >= depth:
                open_nodes.pop()[1] = len(out) - 1
            found, ends = self.children(bits, depth)
            n_bytes = self.paths[first][depth - 1][1] if depth else 0
            row = [len(out), 0, node, parent, depth, self.ids[first], bits.bit_count(), n_bytes, bool(found), ",".join(map(str, self.members(ends))) if ends else None]
            out.append(row)
            open_nodes.append(row)
            for member, child in found:
                waiting.append((member, child, depth + 1, hashlib.blake2b(node + self.paths[member][depth][0], digest_size=16).digest(), node))
        for row in open_nodes:
            row[1] = len(out) - 1
        return out


def shard_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of each shard (PARTS)."""

    def emit(shard: int, own: dict, bases: dict) -> pa.RecordBatch:
        found = Bitmaps(rebuilt(own, bases)).nodes()
        columns = [pa.array([shard] * len(found), pa.int64()), *(pa.array(c) for c in zip(*found, strict=True))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in PARTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, bases = None, {}, {}
        for batch in batches:
            for s, c, base, h, key, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if s != now and own:
                    yield emit(now, own, bases)
                    own, bases = {}, {}
                now = s
                own.setdefault(c, []).append((key, n))
                bases[c] = (base, h)
        if own:
            yield emit(now, own, bases)

    return rows.mapInArrow(run, PARTS)


def subtree_shares(rows: DataFrame) -> DataFrame:
    """(node, n_children, n_leaves, saved_tokens, parent_conv_id): each shard's share of the sums over a node's subtree.

    rows: (shard, pre, last, depth, node, top, leaf, saved, mine) of all nodes of each shard; top is the smallest member,
    mine tells the nodes credited here, and leaf and saved are 0 for all others. parent_conv_id is given with the credited
    row only.
    """
    schema = "node binary, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"

    def emit(held: list[tuple]) -> pa.RecordBatch:
        _, _, last, depth, node, top, leaf, saved, mine = (list(c) for c in zip(*held, strict=True))
        n = len(held)
        parents, above = np.full(n, -1), []
        for i, d in enumerate(depth):
            del above[d:]
            parents[i] = above[-1] if d else -1
            above.append(i)
        last, mine = np.array(last), np.array(mine)
        sums = [np.concatenate(([0], np.cumsum(np.array(x, dtype=np.int64)))) for x in (leaf, saved)]
        leaves, spared = (s[last + 1] - s[:n] for s in sums)
        children = np.bincount(parents[mine & (parents >= 0)], minlength=n)
        tops = [top[p] if p >= 0 and m else None for p, m in zip(parents.tolist(), mine.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), *(pa.array(x.astype(np.int64)) for x in (children, leaves, spared)), pa.array(tops, pa.int64())], [f.split()[0] for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    wanted = rows.select("shard", "pre", "last", "depth", "node", "top", "leaf", "saved", "mine")
    return wanted.repartition("shard").sortWithinPartitions("shard", "pre").mapInArrow(run, schema)


def end_digests(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end; ids are read in order of their shards, never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if digest:
                        done.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["node", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    ends = parts.filter("ends is not null").repartition("node").sortWithinPartitions("node", "conv_id")
    return ends.select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node) of every node.

    ``shard`` is the number of ids of a shard, a multiple of 5; results do not depend on it.
    """
    if shard % GROUP:
        raise ValueError("a shard holds whole groups of conversations")
    parts = Scratch(conversations.sparkSession).write(shard_nodes(turns(conversations, shard)))
    whole = parts.groupBy("node").agg(F.min("conv_id").alias("top"), F.min("depth").alias("at"), F.sum("n_convs").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("inner").alias("inner"))
    met = parts.select("shard", "pre", "last", "depth", "node", "conv_id").join(whole, "node")
    mine = F.col("conv_id") == F.col("top")
    saved = F.when(mine & (F.col("depth") > 0), (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(F.lit(0))
    shares = subtree_shares(met.select("*", (mine & ~F.col("inner")).cast("long").alias("leaf"), saved.alias("saved"), mine.alias("mine")))
    sums = shares.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.max("parent_conv_id").alias("parent_conv_id"))
    out = whole.select("node", F.col("top").alias("conv_id"), F.col("at").alias("depth"), "n_convs").join(sums, "node").join(end_digests(parts), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "node")


def op11_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie(read_table(spark, folder, "conversations")).drop("node")


#: crc32 bit by bit, then each node as the list of its turns; sums over subtrees by meeting each node with its prefixes.
ORACLE = """
with ids as (select distinct conv_id from conversations where conv_id is not null),
crc as (select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) as crc from ids),
own as (select conv_id, list(coalesce(role, '') || chr(1) || coalesce(text, '') order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as t from conversations where conv_id is not null group by 1),
re as (select c.conv_id, coalesce(b.t, []::varchar[])[1:(c.crc % 9)::int] || o.t[(c.crc % 9)::int + 1:] as t from crc c join own o using (conv_id) left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
steps as (select conv_id, t, unnest(range(len(t) + 1)) as depth from re),
prefixes as (select conv_id, depth, t[1:depth] as path, len(t) = depth as done from steps),
node as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(case when done then conv_id::varchar end, ',' order by conv_id), '') as ends from prefixes group by 1, 2),
kids as (select path[1:depth - 1] as path, depth - 1 as depth, count(*) as n from node where depth > 0 group by 1, 2),
value as (select n.*, coalesce(k.n, 0) as n_children, (k.n is null)::int as leaf, case when n.depth > 0 then (n.n_convs - 1) * strlen(substr(n.path[n.depth], strpos(n.path[n.depth], chr(1)) + 1)) else 0 end as saved from node n left join kids k on n.depth = k.depth and n.path = k.path),
ups as (select path, depth, leaf, saved, unnest(range(depth + 1)) as up from value),
sums as (select path[1:up] as path, up as depth, sum(leaf) as n_leaves, sum(saved) as saved_tokens from ups group by 1, 2)
select v.conv_id, v.depth::bigint as depth, p.conv_id as parent_conv_id, v.n_convs::bigint as n_convs, v.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(v.ends) as ends_sha256
from value v join sums s on s.depth = v.depth and s.path = v.path left join node p on v.depth > 0 and p.depth = v.depth - 1 and p.path = v.path[1:v.depth - 1]
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_trie": op11_trie}
ORACLES: dict[str, str] = {"op11_trie": ORACLE}
