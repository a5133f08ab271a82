"""Byte-level BPE encoding and decoding with numpy, by the ranks of a public vocabulary file.

A text is cut by the vocabulary's pattern, and each match is encoded by itself. The distinct matches of a batch that
the worker has not met before are laid out in numpy matrices, one for each bucket of byte lengths, padded at the end.
In each round every row merges its leftmost pair of minimum rank; pair ranks come from an open-addressing hash table,
and rows without a mergeable pair leave the matrix (compaction). Matches over ``LONG`` bytes go through a heap
instead, so that one very long match costs n log n.

Decoding concatenates the bytes of the ids by one gather over the vocabulary's bytes.

Defined cases: NULL and empty texts have no ids, and decode to no bytes; bytes that are not UTF-8 are first replaced by
U+FFFD; special tokens' strings are ordinary text. The vocabulary is read on the driver, where its path is known, and
sent to the workers once: its size is fixed by the file (under 2 MB), whatever the input.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.base import chunks, read_table

PAD = 1 << 20
NONE = 1 << 30
LONG = 192
CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Hash table from a pair of ids to the id of their concatenation, probed for whole arrays at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 21 | right)
                    ids.append(rank)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ids = np.full(1 << bits, NONE, dtype=np.int64)
        left = np.array(keys, dtype=np.int64)
        value = np.array(ids, dtype=np.int64)
        slot = self._slot(left)
        self.probes = 0
        while len(left):  # each round puts one of the keys that meet in a free slot there; the rest step on
            free = self.keys[slot] < 0
            first = np.zeros(len(left), dtype=bool)
            where = np.flatnonzero(free)
            first[where[np.unique(slot[where], return_index=True)[1]]] = True
            self.keys[slot[first]], self.ids[slot[first]] = left[first], value[first]
            left, value, slot = left[~first], value[~first], (slot[~first] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the concatenations, NONE where there is none."""
        keys = (left << 21) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ids[slot], NONE)
        live = np.flatnonzero((found != keys) & (found >= 0))
        flat_keys, flat_out, slots = keys.ravel(), out.ravel(), slot.ravel()
        live = np.flatnonzero(((found != keys) & (found >= 0)).ravel())
        at = slots[live]
        while len(live):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == flat_keys[live]
            flat_out[live[hit]] = self.ids[at[hit]]
            on = ~hit & (found >= 0)
            live, at = live[on], at[on]
        return flat_out.reshape(keys.shape)


class Codec:
    """Encoder and decoder for one vocabulary; picklable, with a bounded cache of encoded matches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.byte_ids = np.array([ranks.get(bytes([b]), NONE) for b in range(256)], dtype=np.int64)
        self.pairs = PairTable(ranks)
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.blob = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.length = np.array([len(t) for t in by_id], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def __reduce__(self):
        return Codec, (self.ranks, self.pattern)

    def encode_matrix(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, ids) of the rows of a padded matrix, as their merging ends."""
        rows = np.arange(len(ids))
        while len(rows):
            if ids.shape[1] < 2:
                yield rows, ids
                return
            rank = self.pairs(ids[:, :-1], ids[:, 1:])
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            ended = best == NONE
            if ended.any():
                yield rows[ended], ids[ended]
                rows, ids, at, best = rows[~ended], ids[~ended], at[~ended], best[~ended]
                if not len(rows):
                    return
            line = np.arange(len(rows))
            ids[line, at] = best
            keep = np.ones(ids.shape, dtype=bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)

    def encode_long(self, piece: bytes) -> list[int]:
        """Ids of one long match by a heap of candidate pairs and linked neighbours."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(ids):
                pair = ids[i], ids[j]
                if (rank := known.get(pair)) is None:
                    rank = known[pair] = int(self.pairs(np.array([pair[0]]), np.array([pair[1]]))[0])
                if rank != NONE:
                    heapq.heappush(heap, (rank, i, *pair))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else len(ids)
            if j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Little-endian ids of distinct matches."""
        out: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if raw in self.ranks:
                out[piece] = self.ranks[raw].to_bytes(4, "little")
            elif len(raw) > LONG:
                out[piece] = np.array(self.encode_long(raw), dtype="<u4").tobytes()
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, entries in buckets.items():
            width = 1 << bits
            step = max(1, (1 << 18) // width)
            for i in range(0, len(entries), step):
                part = entries[i : i + step]
                length = np.fromiter((len(raw) for _, raw in part), dtype=np.int64, count=len(part))
                inside = np.arange(width) < length[:, None]
                ids = np.full((len(part), width), PAD, dtype=np.int64)
                ids[inside] = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in part), dtype=np.uint8)]
                for rows, done in self.encode_matrix(ids):
                    real = done != PAD
                    flat, ends = done[real].astype("<u4").tobytes(), (4 * real.sum(axis=1).cumsum()).tolist()
                    begin = 0
                    for row, end in zip(rows.tolist(), ends, strict=True):
                        out[part[row][0]] = flat[begin:end]
                        begin = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        found = [self.find(t) for t in texts]
        new = set().union(*found).difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = set().union(*found)
        self.cache.update(self.encode_pieces(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in found]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of an array of ids."""
        length = self.length[ids]
        skip = np.cumsum(length) - length
        return self.blob[np.arange(int(length.sum())) + np.repeat(self.start[ids] - skip, length)].tobytes()


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian binary), or with digests instead of the ids, of each row's text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Codec(read_ranks(vocabulary), pattern))
    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            keys = batch.column(0)
            for begin, raw in chunks(batch, "text"):
                ids = codec.encode([t.decode("utf-8", "replace") for t in raw])
                columns = [keys.slice(begin, len(raw)), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digests:
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                    back = (codec.decode(np.frombuffer(x, dtype="<u4").astype(np.int64)) for x in ids)
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in back]))
                else:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", *[x.split()[0] for x in kind.split(", ")]]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, {kind}")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text) from encode()'s (doc_id, ids); bytes that are not UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(read_ranks(vocabulary), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = (np.frombuffer(x.as_py() or b"", dtype="<u4").astype(np.int64) for x in batch.column(1))
            texts = [shared.value.decode(x).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, folder, "documents")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe}
