"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training rows (crc32(doc_id) mod 5 is not 1) give counts of words and of word pairs, each text framed by a begin mark
and an end token. A count c is stored as its level 1 + floor(log_1.5 c): a gram is put in the filter once for each level
up to its own, and a lookup probes the levels in turn until one is absent. The probability of a word after another is
    (c(pair) + K * p(word)) / (c(first) + K),   p(word) = (c(word) + 0.5) / (N + 0.5 (V + 1)),
with counts read from the filter. The base score uses exact counts.

The filter is cut into segments by hash, each built by one task and sized to its grams, 8 bits an entry. If all
segments together stay under ``most_bytes`` they are broadcast; beyond that, the lookups are shuffled to the segments
and give the same levels. Exact counts are never broadcast as a whole: words that make up at least 1/65536 of all tokens,
65536 at most, are sent to the workers, and the others are looked up by sending each document's words to the segments.
Map tasks merge equal grams before any shuffle, so a word that is everywhere is a handful of rows.

Defined cases: NULL and empty texts have one token, the end; without training rows N and V are 0, nothing is known, and
both scores are finite; a NULL doc_id counts as the empty text in the fold rule; repeated rows are each scored, and each
counts in training; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.base import Scratch, chunks, fold, hash_words, mix64, read_table

STEP = 1.5
PROBES, BITS = 4, 8
SMOOTH = 4.0
HEAVY = 65_536
#: A gram is hot if its count is at least the bytes of text over HOT, so at most HOT words and HOT pairs are.
HOT = 1 << 18
MOST_BYTES = 100_000_000
#: Text bytes for each segment of the filter.
SEGMENT_TEXT = 24_000_000
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_M = np.uint64(0x9E3779B97F4A7C15)
#: A row's key is the MD5 of its doc_id and text; rows that have it in common are alike and get the same answers.
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
#: Mean of the counts of each level, taken as the middle of its range of whole numbers.
LEVELS = np.array([0.0, *((np.ceil(STEP**k) + max(np.ceil(STEP**k), np.ceil(STEP ** (k + 1)) - 1)) / 2 for k in range(120))])


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log of the count) for counts of at least 1."""
    return 1 + np.floor(np.log(counts.astype(np.float64)) / np.log(STEP) + 1e-9).astype(np.int64)


def frame(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, each framed by BEGIN and END; the number of tokens of each text, END included; BEGIN's places."""
    words, counts = hash_words(texts)
    begins = np.concatenate(([0], np.cumsum(counts + 2)))[:-1]
    out = np.empty(len(words) + 2 * len(texts), dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[begins] = inner[begins + counts + 1] = False
    out[inner] = words
    out[begins], out[begins + counts + 1] = BEGIN, END
    return out, counts + 1, begins


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(mix64(first * _M + np.uint64(1)) ^ (second * _M))


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    return ((grams >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)


def _spots(grams: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> np.ndarray:
    """The bit numbers of (gram, level) entries, one column for each probe."""
    a = mix64(grams ^ (np.uint64(0x9E3779B97F4A7C15) * np.asarray(level).astype(np.uint64)))
    b = mix64(a) | np.uint64(1)
    k = np.arange(PROBES, dtype=np.uint64)
    return ((a[:, None] + k * b[:, None]) % np.asarray(bits).astype(np.uint64).reshape(-1, 1)).astype(np.int64)


def build_filter(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A bit array, as bytes, that holds every gram at each level up to its own."""
    bits = max(64, -(-int(levels.sum()) * BITS // 8) * 8)
    out = np.zeros(bits, dtype=bool)
    level = 1
    while len(grams):
        out[_spots(grams, level, bits).ravel()] = True
        grams, levels = grams[levels > level], levels[levels > level]
        level += 1
    return np.packbits(out, bitorder="little")


def probe(grams: np.ndarray, filters: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Levels of grams by probing; 0: absent. filters: all segments' bytes on end; offsets and sizes: those of each gram's segment."""
    out = np.zeros(len(grams), dtype=np.int64)
    live = np.flatnonzero(sizes > 0) if len(filters) else np.empty(0, dtype=np.int64)
    level = 1
    while len(live):
        spot = _spots(grams[live], level, sizes[live] * 8)
        hit = ((filters[offsets[live][:, None] + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1).all(axis=1)
        live = live[hit]
        out[live] = level
        level += 1
        if level >= len(LEVELS):
            break
    return out


def probe_one(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Levels of the grams of one segment."""
    return probe(grams, table, np.zeros(len(grams), dtype=np.int64), np.full(len(grams), len(table), dtype=np.int64))


def probe_all(grams: np.ndarray, filters: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Levels of grams of any segment; offsets and sizes in bytes by segment."""
    own = segment_of(grams, len(sizes))
    return probe(grams, filters, offsets[own], sizes[own])


def token_scores(pair: np.ndarray, first: np.ndarray, word: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 probabilities from the levels of the pair, its first token and its second."""
    p = (LEVELS[word] + 0.5) / (n + 0.5 * (v + 1))
    of = LEVELS[first]
    return np.log10((np.minimum(LEVELS[pair], of) + SMOOTH * p) / (of + SMOOTH))


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    return h[edge], np.add.reduceat(c, edge) if len(edge) else c


GRAMS = "segment int, kind int, hashes binary, counts binary"


def count_grams(docs: DataFrame, segments: int) -> DataFrame:
    """Rows (segment, kind, hashes, counts): merged counts of words (kind 0) and pairs (kind 1) of parts of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, (h, c) in held.items():
                grams, counts = _merged(h, c)
                own = segment_of(grams, segments)
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(segments + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    part = np.sort(order[cuts[s] : cuts[s + 1]])
                    blobs = grams[part].tobytes(), counts[part].astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["segment", "kind", "hashes", "counts"])
                h.clear()
                c.clear()

        for batch in batches:
            for _, texts in chunks(batch, "text"):
                tokens, _, begins = frame(texts)
                pairs = np.delete(pair_hash(tokens[:-1], tokens[1:]), begins[1:] - 1)
                for kind, grams in ((0, tokens), (1, pairs)):
                    found, n = np.unique(grams, return_counts=True)
                    held[kind][0].append(found)
                    held[kind][1].append(n)
                    size += len(found)
                if size > 6_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, GRAMS)


TABLE = "segment int, n long, v long, filter binary, words binary, word_counts binary, hot binary, hot_levels binary"


def build_segments(grams: DataFrame, segments: int, line: float) -> DataFrame:
    """One row for each segment: its tokens n, distinct words v, filter, exact word counts in order of hash, and the grams
    counted at least ``line`` times with the levels that the filter gives for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done() -> pa.RecordBatch:
            words, counts = _merged(*held.pop(0, ([], [])))
            pairs, pair_counts = _merged(*held.pop(1, ([], [])))
            both, both_counts = np.concatenate([words, pairs]), np.concatenate([counts, pair_counts])
            table = build_filter(both, level_of(both_counts))
            hot = np.sort(both[both_counts >= line])
            hot_levels = probe_one(hot, table)
            real = words != BEGIN
            words, counts = words[real], counts[real]
            values = [now, int(counts.sum()), len(words), table.tobytes(), words.tobytes(), counts.astype("<i8").tobytes(), hot.tobytes(), hot_levels.astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], [c.split()[0] for c in TABLE.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                segment, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if segment != now:
                    if now is not None:
                        yield done()
                    now = segment
                h, c = held.setdefault(kind, ([], []))
                h.append(np.frombuffer(batch.column(2)[i].as_py(), dtype="<u8"))
                c.append(np.frombuffer(batch.column(3)[i].as_py(), dtype="<u4").astype(np.int64))
        if now is not None:
            yield done()

    return grams.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(run, TABLE)


def heavy_words(table: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words that make up at least one token in HEAVY: HEAVY of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, c = np.frombuffer(batch.column(0)[i].as_py(), dtype="<i8"), np.frombuffer(batch.column(1)[i].as_py(), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(h[c * HEAVY >= n]), pa.array(c[c * HEAVY >= n])], ["h", "c"])

    rows = table.select("words", "word_counts").mapInArrow(run, "h long, c long").toPandas()
    rows = rows.assign(u=rows["h"].to_numpy(dtype=np.int64).view(np.uint64)).sort_values("u")
    return rows["u"].to_numpy(dtype=np.uint64), rows["c"].to_numpy(dtype=np.int64)


def _look_up(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Counts of the asked hashes in a table sorted by hash; -1: absent."""
    if not len(keys):
        return np.full(len(asked), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, counts[at], -1)


def key_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=KEY)


def light_sums(keyed: DataFrame, table: DataFrame, heavy, segments: int) -> DataFrame:
    """(key, part, known): sums of log10(c + 0.5) and of known tokens over each row's words that are not heavy.

    Of alike rows of a chunk one is looked up, and all chunks give the same sums for them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = heavy.value
        for batch in batches:
            row_keys = key_array(batch.column(0))
            for begin, texts in chunks(batch, "text"):
                tokens, n, _ = frame(texts)
                owner = np.repeat(np.arange(len(texts)), n + 1)
                first = np.zeros(len(texts), dtype=bool)
                first[np.unique(row_keys[begin : begin + len(texts)], return_index=True)[1]] = True
                light = (tokens != BEGIN) & first[owner]
                light[light] = _look_up(keys, counts, tokens[light]) < 0
                grams, owner = tokens[light], owner[light]
                own = segment_of(grams, segments)
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(segments + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    part = order[cuts[s] : cuts[s + 1]]
                    rows, index = np.unique(owner[part], return_inverse=True)
                    blobs = grams[part].tobytes(), index.astype("<u4").tobytes(), row_keys[begin + rows].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array(row_keys["a"][begin : begin + 1].view(np.int64)), *(pa.array([x], pa.binary()) for x in blobs)], ["segment", "chunk", "hashes", "counts", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, counts = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = batch.column(0)[i].as_py()
                if segment != now:
                    now, words, counts = segment, np.empty(0, np.uint64), np.empty(0, np.int64)
                hashes = np.frombuffer(batch.column(2)[i].as_py(), dtype="<u8")
                if batch.column(4)[i].as_py() is None:
                    words, counts = hashes, np.frombuffer(batch.column(3)[i].as_py(), dtype="<i8")
                    continue
                index = np.frombuffer(batch.column(3)[i].as_py(), dtype="<u4").astype(np.int64)
                keys = batch.column(4)[i].as_py()
                c = _look_up(words, counts, hashes)
                part = np.bincount(index, weights=np.log10(np.maximum(c, 0) + 0.5), minlength=len(keys) // KEY.itemsize).astype("<f8")
                known = np.bincount(index[c > 0], minlength=len(keys) // KEY.itemsize).astype("<i8")
                blobs = keys, part.tobytes(), known.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), *(pa.array([x], pa.binary()) for x in blobs)], ["chunk", "keys", "parts", "known"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The answers of all segments for one chunk of rows come together; one row for each key goes on."""
        now, held = None, []

        def done() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([np.frombuffer(h[0], dtype=KEY) for h in held]), return_inverse=True)
            part = np.bincount(at, weights=np.concatenate([np.frombuffer(h[1], dtype="<f8") for h in held]))
            known = np.bincount(at, weights=np.concatenate([np.frombuffer(h[2], dtype="<i8") for h in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(part), pa.array(known)], ["key", "part", "known"])

        for batch in batches:
            for i in range(batch.num_rows):
                chunk, *blobs = (batch.column(k)[i].as_py() for k in range(4))
                if chunk != now:
                    if held:
                        yield done()
                    now, held = chunk, []
                held.append(blobs)
        if held:
            yield done()

    asked = keyed.select("key", "text").mapInArrow(send, "segment int, chunk long, hashes binary, counts binary, keys binary")
    known = table.select("segment", F.lit(0).cast("long").alias("chunk"), F.col("words").alias("hashes"), F.col("word_counts").alias("counts"), F.lit(None).cast("binary").alias("keys"))
    met = known.unionByName(asked).repartition(segments, "segment").sortWithinPartitions("segment", F.col("keys").isNotNull())
    answers = met.mapInArrow(answer, "chunk long, keys binary, parts binary, known binary").repartition("chunk").sortWithinPartitions("chunk")
    return answers.mapInArrow(gather, "key binary, part double, known long").groupBy("key").agg(F.max("part").alias("part"), F.max("known").alias("known"))


def _rows(batch: pa.RecordBatch, begin: int, texts: list[bytes], heavy, filters, n: int, v: int):
    """Columns n_tokens, heavy part, heavy known and, if filters are given, the score of some texts."""
    tokens, lengths, begins = frame(texts)
    inner = np.ones(len(tokens), dtype=bool)
    inner[begins] = False
    owner = np.repeat(np.arange(len(texts)), lengths)
    words = tokens[inner]
    c = _look_up(*heavy, words)
    found = c >= 0
    part = np.bincount(owner[found], weights=np.log10(c[found] + 0.5), minlength=len(texts)).astype(np.float64)
    known = np.bincount(owner[found], minlength=len(texts)).astype(np.int64)
    out = [pa.array(lengths), pa.array(part), pa.array(known)]
    if filters is not None:
        each, at = np.unique(tokens, return_inverse=True)
        level = probe_all(each, *filters)[at]
        pairs, of = np.unique(pair_hash(tokens[:-1], tokens[1:])[inner[1:]], return_inverse=True)
        pair = probe_all(pairs, *filters)[of]
        logs = token_scores(pair, level[:-1][inner[1:]], level[1:][inner[1:]], n, v)
        out.append(pa.array(np.bincount(owner, weights=logs, minlength=len(texts))))
    return out


def shuffled_scores(keyed: DataFrame, table: DataFrame, segments: int, n: int, v: int) -> DataFrame:
    """(key, score) by sending the grams of each chunk of rows, each once, to the segments that can answer for them.

    The grams that are hot, at most 2 * HOT of them, are answered where they stand, so that no segment gets a third of
    the tokens. The rows of a chunk, their texts packed, come along, and meet the levels of their grams at the end.
    """
    rows = table.select("hot", "hot_levels").collect()
    hot = np.concatenate([np.frombuffer(r["hot"], dtype="<u8") for r in rows] or [np.empty(0, np.uint64)])
    hot_levels = np.concatenate([np.frombuffer(r["hot_levels"], dtype="<i8") for r in rows] or [np.empty(0, np.int64)])
    order = np.argsort(hot)
    known = keyed.sparkSession.sparkContext.broadcast((hot[order], hot_levels[order]))

    def grams_of(texts: list[bytes]):
        """Tokens, their numbers by text, inner tokens, the place of each token and pair among the grams, and the grams;
        their levels, -1 if to be asked for; and for each segment asked the places of its grams."""
        tokens, lengths, begins = frame(texts)
        inner = np.ones(len(tokens), dtype=bool)
        inner[begins] = False
        grams, at = np.unique(np.concatenate([tokens, pair_hash(tokens[:-1], tokens[1:])[inner[1:]]]), return_inverse=True)
        level = _look_up(*known.value, grams)
        asked = np.flatnonzero(level < 0)
        own = segment_of(grams[asked], segments)
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(segments + 1))
        places = {s: asked[order[cuts[s] : cuts[s + 1]]] for s in np.flatnonzero(np.diff(cuts)).tolist()}
        return len(tokens), lengths, inner, at, grams, level, places

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_keys = key_array(batch.column(0))
            for begin, texts in chunks(batch, "text"):
                keys = row_keys[begin : begin + len(texts)].tobytes()
                chunk = int.from_bytes(hashlib.blake2b(keys, digest_size=8).digest(), "little", signed=True)  # equal chunks get equal answers
                *_, grams, _, places = grams_of(texts)
                sizes = np.array([len(t) for t in texts], dtype="<i8").tobytes()
                out = [(s, grams[part].tobytes(), None, None, None) for s, part in places.items()]
                for s, *blobs in [*out, (chunk % segments, None, keys, sizes, zlib.compress(b"".join(texts), 1))]:
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs), pa.nulls(1, pa.binary())], ["segment", "chunk", "grams", "keys", "sizes", "texts", "filter"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Levels in the order of the grams asked for; rows go on as they are."""
        now, table_of = None, np.empty(0, np.uint8)
        for batch in batches:
            for i in range(batch.num_rows):
                s, bits, grams = (batch.column(k)[i].as_py() for k in (0, 6, 2))  # segments come in order, each with its filter first
                if s != now:
                    now, table_of = s, np.empty(0, np.uint8)
                if bits is not None:
                    table_of = np.frombuffer(bits, dtype=np.uint8)
                    continue
                levels = None
                if grams is not None:
                    levels = probe_one(np.frombuffer(grams, dtype="<u8"), table_of).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in (1, 0)), pa.array([levels], pa.binary()), *(batch.column(k).slice(i, 1) for k in (3, 4, 5))], ["chunk", "segment", "levels", "keys", "sizes", "texts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The levels that all segments gave for one chunk of rows come together with its texts."""
        now, held, own = None, {}, None

        def done() -> pa.RecordBatch:
            keys, sizes = np.frombuffer(own[0], dtype=KEY), np.frombuffer(own[1], dtype="<i8")
            joined, ends = zlib.decompress(own[2]), np.cumsum(sizes)
            count, lengths, inner, at, _, level, places = grams_of([joined[e - z : e] for e, z in zip(ends.tolist(), sizes.tolist(), strict=True)])
            for s, part in places.items():
                level[part] = np.frombuffer(held[s], dtype=np.uint8)
            word, pair = level[at[:count]], level[at[count:]]
            logs = token_scores(pair, word[:-1][inner[1:]], word[1:][inner[1:]], n, v)
            owner = np.repeat(np.arange(len(keys)), lengths)
            return pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(np.bincount(owner, weights=logs, minlength=len(keys)))], ["key", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                chunk, s, levels, *blobs = (batch.column(k)[i].as_py() for k in range(6))
                if chunk != now:
                    if own:
                        yield done()
                    now, held, own = chunk, {}, None
                if levels is None:
                    own = blobs
                else:
                    held[s] = levels
        if own:
            yield done()

    blobs = "keys binary, sizes binary, texts binary"
    asked = keyed.select("key", "text").mapInArrow(send, f"segment int, chunk long, grams binary, {blobs}, filter binary")
    none = [F.lit(None).cast("binary").alias(c) for c in ("grams", "keys", "sizes", "texts")]
    met = table.select("segment", F.lit(0).cast("long").alias("chunk"), *none, "filter").unionByName(asked).repartition(segments, "segment").sortWithinPartitions("segment", F.col("filter").isNull())
    answers = met.mapInArrow(answer, f"chunk long, segment int, levels binary, {blobs}").repartition("chunk").sortWithinPartitions("chunk")
    return answers.mapInArrow(gather, "key binary, score double").groupBy("key").agg(F.max("score").alias("score"))


def score(docs: DataFrame, most_bytes: int = MOST_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    keyed = docs.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary"))).alias("key"), F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(8, -(-int(size) // SEGMENT_TEXT))
    table = scratch.write(build_segments(count_grams(keyed.filter("not held_out"), segments), segments, max(2.0, size / hot)))
    facts = table.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum(F.octet_length("filter")).alias("b")).first()
    n, v, held = int(facts["n"] or 0), int(facts["v"] or 0), int(facts["b"] or 0)
    heavy = spark.sparkContext.broadcast(heavy_words(table, n) if n else (np.empty(0, np.uint64), np.empty(0, np.int64)))
    small = held <= most_bytes
    shared = None
    if small:
        sizes = np.zeros(segments, dtype=np.int64)
        for r in table.select("segment", F.octet_length("filter").alias("b")).collect():
            sizes[r["segment"]] = r["b"]
        offsets, joined = np.cumsum(sizes) - sizes, np.empty(held, dtype=np.uint8)
        for r in table.select("segment", "filter").toLocalIterator():  # one segment at a time passes through the driver
            at = offsets[r["segment"]]
            joined[at : at + len(r["filter"])] = np.frombuffer(r["filter"], dtype=np.uint8)
        shared = spark.sparkContext.broadcast((joined, offsets, sizes))
        del joined
    light = light_sums(keyed, table, heavy, segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch, "text"):
                columns = _rows(batch, begin, texts, heavy.value, shared.value if shared else None, n, v)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(begin, len(texts)) for k in range(3)), *columns], names)

    names = ["doc_id", "held_out", "key", "n_tokens", "part", "known", *["score"] * small]
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = keyed.mapInArrow(run, f"doc_id {kind}, held_out boolean, key binary, n_tokens long, part double, known long" + ", score double" * small)
    if not small:
        own = own.join(shuffled_scores(keyed, table, segments, n, v), "key", "left")
    joined = own.alias("o").join(light.alias("l"), "key", "left")
    part = F.col("o.part") + F.coalesce("l.part", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("o.known") + F.coalesce("l.known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (part - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        "score",
    )


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return score(read_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_lm_score": op3_lm_score}
