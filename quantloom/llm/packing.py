"""Packing of tokenised documents into sequences along a space-filling curve.

A document's ids are hashed into BUCKETS signed counts, damped by a logarithm and brought to unit length; a fixed random
projection takes that vector to AXES dimensions. With mean and deviation over all documents each coordinate becomes a
whole number of BITS bits, and the three together a place on a Hilbert curve, on which documents with like words lie
close. Documents are range-sorted by place, and the curve is then one stream of ids, cut every ``length`` ids: a sequence
holds neighbours of the curve, and no sequence but the last is short. What is left at the end is cut into powers of two,
which need no padding, so nothing is padded at all.

The vocabulary's rule never joins what white space parts. The runs between white space of some megabytes of texts are
lower-cased and cut into the rule's words in arrays where they are plain: ASCII and the letters of Latin-1, without an
apostrophe. Any other run stays whole. These pieces are told apart in arrays, by their first 16 bytes where that is all, so
each distinct piece is looked up once; a word that a worker has not met is encoded by the library's model, and a whole run
is first split into words, or left to the library. All are kept, up to a number of bytes, for all tasks of the worker.
Documents' ids are a written table (two bytes an id while the vocabulary allows), and only key, size and row number are
sorted; the place of each document then meets its ids by row number.

Defined cases: a NULL text is empty, and a document without words is the end id alone; special tokens' strings in a text
are ordinary text; documents without words lie at the origin of the projection; equal places are ordered by doc_id, NULL
first, and by what the ids are, so rows that repeat lie side by side; every row is packed, those that share a doc_id or
have none too, each with starts of its own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.base import GAP, LANE, Scratch, chunks, mix64, read_table

LENGTH, END = 4096, 2
BUCKETS, AXES, BITS, SPAN = 256, 3, 16, 4.0
#: Bytes of cached words, runs and ids of a worker, and the longest of them that is kept.
CACHE_BYTES, LONGEST = 192 << 20, 256
#: Words of a lower-cased run, as the vocabulary's own rule finds them. Below LATIN_END lower case and composition are
#: matters of single characters, the same in Python and in the library.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LATIN_END = "\u0250"
#: Bytes of texts that are split together.
TEXT_BYTES = 8 << 20


GAP_BYTE, LETTER, DIGIT, MARK, ODD, WHOLE = range(6)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """What each byte is to the vocabulary's rule, and its lower case. ODD: what the arrays leave to a whole run.

    The two bytes of a letter of Latin-1 are letters here; where they are anything else is told by their neighbours.
    """
    kind, low = np.full(256, ODD, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    kind[0x21:0x7F], kind[0x80:0xC0], kind[LATIN_LEAD] = MARK, LETTER, LETTER
    kind[ord("0") : ord("9") + 1], kind[ord("'")], kind[GAP] = DIGIT, ODD, GAP_BYTE
    for first in (ord("A"), ord("a")):
        kind[first : first + 26] = LETTER
    low[ord("A") : ord("Z") + 1] += 0x20
    return kind, low


#: First byte of U+00C0 to U+00FF in UTF-8, the second bytes of the two among them that are no letters, and of their last capital.
LATIN_LEAD, LATIN_SIGNS, LATIN_CAPITAL = 0xC3, (0x97, 0xB7), 0x9E
_KIND, _LOW = _kinds()


def library(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def id_type(path: str, end: int) -> str:
    """The kind of number that ids are kept as."""
    return "<u2" if max(library(path).get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4"


class Encoder(dict):
    """Ids of texts as the tokenizers library gives them; words and whole runs come again from this cache."""

    def __init__(self, path: str, end: int, kind: str):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.library, self.kind, self.held = library(path), kind, 0
        self.model, level = self.library.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x80, ord(LATIN_END)))}  # the model's signs for their bytes
        self.end = np.array([end], dtype=kind).tobytes()

    def __missing__(self, run: str) -> bytes:
        return self._keep(run, np.array(self.library.encode(run, add_special_tokens=False).ids, dtype=self.kind).tobytes())

    def _keep(self, run: str, ids: bytes) -> bytes:
        if len(run) <= LONGEST:
            self[run] = ids
            self.held += 200 + 2 * len(run) + len(ids)
        return ids

    def _learn_words(self, words: list[str]) -> None:
        """Keeps the ids of new words in lower case below LATIN_END, which the library's normaliser leaves as they are."""
        cut, letters = self.model.tokenize, self.letters
        ids, ends = [], [0]
        for word in words:
            ids += [t.id for t in cut(word if word.isascii() else word.translate(letters))]
            ends.append(len(ids))
        flat, width = np.array(ids, dtype=self.kind).tobytes(), np.dtype(self.kind).itemsize
        for word, first, end in zip(words, ends, ends[1:], strict=False):
            self[word] = flat[first * width : end * width]
        self.held += 200 * len(words) + 2 * sum(map(len, words)) + len(flat)

    def _learn(self, runs: list[str], whole: list[bool]) -> None:
        """Keeps the ids of new pieces: words, and whole runs, which are split into words where that is safe."""
        words = {r for r, w in zip(runs, whole, strict=True) if not w and len(r) <= LONGEST}
        latin = [r for r, w in zip(runs, whole, strict=True) if w and len(r) <= LONGEST and r.isprintable() and (r.isascii() or max(r) < LATIN_END)]
        split = [WORD.findall(r.lower()) for r in latin]
        known = (w for w in itertools.chain.from_iterable(split) if w not in self and max(w) < LATIN_END)  # lower case may pass LATIN_END
        self._learn_words(list(words.union(known)))
        for run, parts in zip(latin, split, strict=True):
            if run not in self:
                self._keep(run, b"".join(map(self.__getitem__, parts)))

    def _distinct(self, runs: list[str], whole: list[bool]) -> list[bytes]:
        held = list(map(self.get, runs))
        if None in held:
            new = [i for i, x in enumerate(held) if x is None]
            self._learn([runs[i] for i in new], [whole[i] for i in new])
            for i in new:
                held[i] = self[runs[i]]
        return held

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian numbers of the encoder's kind."""
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        joined, start, stop, whole, owner = pieces_of(texts)
        first, of = distinct_runs(joined, start, stop)
        found = self._distinct([joined[a:b].decode() for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)], whole[first].tolist())
        width = np.dtype(self.kind).itemsize
        values, sizes = np.frombuffer(b"".join(found), dtype=self.kind), np.array([len(x) // width for x in found], dtype=np.int64)
        begin, size = (np.cumsum(sizes) - sizes)[of], sizes[of]
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = values[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = (ends[np.searchsorted(owner, np.arange(len(texts) + 1))] * width).tolist()
        return [flat[a:b] + self.end for a, b in zip(cuts, cuts[1:], strict=False)]


def pieces_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined, and of each piece where it begins, ends, whether it is a whole run, and whose it is.

    Plain runs between ASCII white space are in lower case and cut into the rule's words; others are as they were.
    """
    source = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(source, dtype=np.uint8)
    kind, low = _KIND[raw], _LOW[raw]
    high = np.flatnonzero(raw >= 0x80)
    here, before, after = raw[high], raw[high - 1], raw[high + 1]
    lead, second = here == LATIN_LEAD, (before == LATIN_LEAD) & (here < 0xC0)
    fine = np.where(lead, (after >= 0x80) & (after < 0xC0) & (after != LATIN_SIGNS[0]) & (after != LATIN_SIGNS[1]), second)
    low[high[second & (here <= LATIN_CAPITAL)]] += 0x20
    kind[high[~fine]] = ODD
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        edge = np.flatnonzero(np.diff(np.concatenate(([True], kind == GAP_BYTE)).view(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        run = np.unique(np.searchsorted(begin, odd, "right") - 1)
        size = end[run] - begin[run]
        at = np.repeat(begin[run] - np.cumsum(size) + size, size) + np.arange(size.sum())
        kind[at], low[at] = WHOLE, raw[at]
    text, alone = kind != GAP_BYTE, kind == DIGIT
    turn = np.concatenate(([True], kind[1:] != kind[:-1], [True]))
    start, stop = np.flatnonzero(text & (turn[:-1] | alone)), np.flatnonzero(text & (turn[1:] | alone)) + 1
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return low.tobytes(), start, stop, kind[start] == WHOLE, np.searchsorted(ends, start, "right")


def distinct_runs(joined: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a run of each kind, the kind of each run): runs of at most 16 bytes by these bytes, longer ones each by itself.

    Kinds are sorted by a hash and compared byte for byte with the first of their kind; one that differs is its own.
    """
    raw = np.frombuffer(joined + bytes(16), dtype=np.uint8)
    view = np.ndarray(shape=(len(joined) + 9,), dtype="<u8", buffer=raw.data, strides=(1,))
    size = stop - start
    low, high = view[start] & LANE[np.minimum(size, 8)], view[start + 8] & LANE[np.clip(size - 8, 0, 8)]
    h = mix64((low + size.astype(np.uint64)) ^ mix64(high + np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(h)
    turn = np.concatenate(([True], np.diff(h[order]) != 0))[: len(h)]
    first, of = order[turn], np.empty(len(h), dtype=np.int64)
    of[order] = np.cumsum(turn) - 1
    like = first[of]
    own = np.flatnonzero((low != low[like]) | (high != high[like]) | (size != size[like]) | (size > 16))
    of[own] = len(first) + np.arange(len(own))
    return np.concatenate((first, own)), of


@functools.lru_cache(maxsize=1)
def encoder(path: str, end: int, kind: str) -> Encoder:
    """The encoder of this worker, which its tasks share."""
    return Encoder(path, end, kind)


def _signs() -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the sign of each id below 2^16; others take those of their low bits."""
    h = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)


_BUCKET, _SIGN = _signs()
_PROJECTION = np.random.default_rng(12).normal(size=(BUCKETS, AXES))


def project(ids: np.ndarray) -> np.ndarray:
    """The hashed vector of a document's ids, projected."""
    low = ids & 0xFFFF
    counts = np.bincount(_BUCKET[low], weights=_SIGN[low], minlength=BUCKETS)
    damped = np.sign(counts) * np.log1p(np.abs(counts))
    size = np.sqrt(damped @ damped)
    return damped @ _PROJECTION / size if size else np.zeros(AXES)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of whole-number points (n, d), each coordinate below 2^bits, d * bits at most 63.

    The coordinates' bits are turned, from the highest level down, as the curve turns in each quadrant, then Gray-decoded
    and interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(d):
            set_here = (x[i] & q) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_here, q - 1, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def tokenised(docs: DataFrame, path: str, end: int, kind: str) -> DataFrame:
    """(doc_id, uid, n, axes, crc, ids) of every row; uid is unique once the frame is written.

    ids: all ids with the end id, as numbers of the given kind; crc tells documents of one place apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, end, kind)
        for batch in batches:
            for begin, part in chunks(batch, "text", TEXT_BYTES):
                found = known.ids(part)
                numbers = [np.frombuffer(x, dtype=kind) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(part)),
                        pa.array([len(x) for x in numbers], pa.int64()),
                        pa.array([project(x[:-1]).tolist() for x in numbers], pa.list_(pa.float64())),
                        pa.array([zlib.crc32(x) for x in found], pa.int64()),
                        pa.array(found, pa.binary()),
                    ],
                    ["doc_id", "n", "axes", "crc", "ids"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    name = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {name}, n long, axes array<double>, crc long, ids binary").withColumn("uid", F.monotonically_increasing_id())


def places(rows: DataFrame) -> DataFrame:
    """(doc_id, uid, n, crc, place): each row's place on the curve; coordinates are scaled over all rows."""
    stats = [f(F.col("axes")[i]).alias(f"{name}{i}") for i in range(AXES) for name, f in (("mean", F.avg), ("spread", F.stddev_pop))]
    scale = rows.agg(*stats).first()
    top, half = (1 << BITS) - 1, 1 << (BITS - 1)
    cell = lambda i: F.least(F.greatest(F.floor(half + half / SPAN * (F.col("axes")[i] - F.lit(scale[f"mean{i}"] or 0.0)) / F.lit(scale[f"spread{i}"] or 1.0)), F.lit(0)), F.lit(top))
    cells = rows.select("doc_id", "uid", "n", "crc", *[cell(i).cast("long").alias(f"c{i}") for i in range(AXES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(4 + i).to_numpy(zero_copy_only=False) for i in range(AXES)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hilbert(points, BITS))], ["doc_id", "uid", "n", "crc", "place"])

    return cells.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, uid long, n long, crc long, place long")


def stream(sized: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(uid, first) and the number of all ids: first is the place of the row's first id in the stream along the curve.

    Rows are range-sorted; each range runs its own sum, and the totals of the ranges, one number each, are added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            ends = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - sizes), pa.array(sizes), pa.array(np.full(len(sizes), part, dtype=np.int32))], ["uid", "own", "n", "part"])
            before = int(ends[-1]) if len(ends) else before

    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["place", F.col("doc_id").asc_nulls_first(), "crc", "uid"]
    sorted_rows = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("uid", "n")
    own = scratch.write(sorted_rows.mapInArrow(run, "uid long, own long, n long, part int"))
    totals = {r["part"]: r["total"] for r in own.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    firsts, total = [], 0
    for part in sorted(totals):
        firsts.append((part, total))
        total += totals[part]
    before = sized.sparkSession.createDataFrame(firsts, "part int, _before long")
    return own.join(F.broadcast(before), "part").select("uid", (F.col("own") + F.col("_before")).alias("first")), total


def edges(total: int, length: int) -> tuple[int, list[int]]:
    """(full sequences, places at which the sequences after them begin, and the end of the last): powers of two."""
    full, rest = divmod(total, length)
    out = [full * length]
    for level in range(rest.bit_length() - 1, -1, -1):
        if rest >> level & 1:
            out.append(out[-1] + (1 << level))
    return full, out


def pieces(rows: DataFrame, total: int, length: int, kind: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of rows (doc_id, first, ids)."""
    full, tail = edges(total, length)
    name = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a document."""
        at, end = first, first + n
        while at < end:
            if at < tail[0]:
                seq, begin = divmod(at, length)[0], at - at % length
                stop = begin + length
            else:
                k = int(np.searchsorted(tail, at, "right")) - 1
                seq, begin, stop = full + k, tail[k], tail[k + 1]
            upto = min(end, stop)
            yield at - first, upto - at, seq, at - begin
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[i].as_py(), dtype=kind).astype("<u4")
                for start, size, seq, offset in cut(batch.column(1)[i].as_py(), len(ids)):
                    at.append(i)
                    out.append((start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), seq, offset))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names)

    return rows.select("doc_id", "first", "ids").mapInArrow(run, f"doc_id {name}, " + ", ".join(f"{c} long" for c in names[1:]))


def pack(docs: DataFrame, path: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """One row for each piece of each document: what ids of it lie in which sequence, and where."""
    scratch = Scratch(docs.sparkSession)
    kind = id_type(path, end)
    rows = scratch.write(tokenised(docs, path, end, kind))
    firsts, total = stream(places(rows), scratch)
    return pieces(rows.select("uid", "doc_id", "ids").join(firsts, "uid"), total, length, kind)


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_packing": op12_packing}
