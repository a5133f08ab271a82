"""Shared pieces: table reader, fold rule, scratch tables, and vectorised word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java form of the word rule shared by several operators: runs of anything but space, tab and the four other ASCII white-space bytes.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table through Spark's reader only, so that any store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; NULL ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


class Scratch:
    """Tables written to the folder that all executors share, dropped once nobody needs them.

    A written table cuts the lineage: after it, a lost executor costs only the tasks it was running.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self.root = f"{shared or tempfile.mkdtemp()}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._quiet_drop, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _quiet_drop(self, path: str) -> None:
        try:
            self._delete(path)
        except Exception:  # the session has ended; the shared folder is then cleaned by its owner
            pass


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of pieces of a batch holding a few MB at most, or one longer text; NULL counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    begin, size, out = 0, 0, []
    for i, value in enumerate(col):
        text = value.as_py() or b""
        if out and size + len(text) > most_bytes:
            yield begin, out
            begin, size, out = i, 0, []
        out.append(text)
        size += len(text)
    if out:
        yield begin, out


def map_texts(docs: DataFrame, compute: Callable[[list[bytes]], list[pa.Array]], fields: list[tuple[str, T.DataType]], whole: bool) -> DataFrame:
    """(_keep, _text, fields): what compute finds in each row's text, beside the row itself.

    Without ``whole``, _keep holds doc_id only and _text is NULL. Rows travel inside a struct, so their column names never
    meet those of the fields.
    """
    names = [c for c in docs.columns if c != "text"] if whole else ["doc_id"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_keep"), F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            asked = pa.RecordBatch.from_arrays([texts.cast(pa.binary())], ["text"])
            for begin, part in chunks(asked, "text"):
                back = texts.slice(begin, len(part)) if whole else pa.nulls(len(part), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(part)), back, *compute(part)], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def whole_rows(mapped: DataFrame, columns: list[str]) -> list[Column]:
    """The columns of the rows inside a frame of map_texts(whole=True)."""
    return [F.col("_text").alias("text") if c == "text" else F.col(f"_keep.`{c}`").alias(c) for c in columns]


GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-xor-multiply)."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def hash_words(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the number of words of each text.

    ASCII letters are lower-cased; words are maximal runs of bytes other than ASCII white space. Words are read eight
    bytes at a time across all words of the call, so the cost is a few array operations whatever their number.
    """
    texts = list(texts)
    joined = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(joined + bytes(8), dtype=np.uint8)
    gap = GAP[raw[: len(joined)]]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    view = np.ndarray(shape=(len(joined) + 1,), dtype="<u8", buffer=raw.data, strides=(1,))
    length = stop - start
    h = length.astype(np.uint64) * _M1
    lane, live = 0, np.arange(len(start))
    while len(live):
        left = length[live] - 8 * lane
        part = view[start[live] + 8 * lane] & LANE[np.minimum(left, 8)]
        h[live] = mix64((h[live] ^ part) * _M1 + _M3)
        live = live[left > 8]
        lane += 1
    return h, counts


def hash_grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences inside each text, and the index of the text of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        h = mix64((h ^ words[k : m + k]) * _M1 + np.uint64(k))
    same = owner[:m] == owner[n - 1 :]
    return h[same], owner[:m][same]
