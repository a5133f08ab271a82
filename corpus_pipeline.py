"""A training-data pipeline of five stages over the documents table, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bpe, mixing, near_dup, quality, toxicity
from quantloom.llm.base import Scratch, read_table


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    NULL texts are judged as empty ones; repeated rows are each judged; an empty table gives none.
    """
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts.

    NULL texts are judged as empty ones; repeated rows are each judged; an empty table gives none.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least doc_id, of each group of near-duplicates at Jaccard 0.8.

    Rows with a NULL doc_id stay; NULL and blank texts are near nothing and stay; of rows that share a doc_id the one of
    least text stays, then of least lang, source and n_chars; an empty table gives none.
    """
    found = near_dup.near_duplicates(docs, percent=80)
    kept = found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"))
    stay = docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("_kept"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = stay.filter("_rows > 1").groupBy("doc_id").agg(F.min_by(whole, F.struct(*[c for c in ("text", "lang", "source", "n_chars") if c in docs.columns])).alias("row")).select("row.*")
    return stay.filter("_rows = 1").select(*docs.columns).unionByName(one).unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in the order of the curriculum.

    NULL and blank texts have no words and are never taken; a NULL source is a source; an empty table gives no rows.
    """
    return mixing.curriculum(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every document taken.

    NULL texts are encoded as empty ones; repeated rows are each encoded; an empty table gives no rows.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("quality", drop_bad),
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

#: Both classifiers learn their weights from the data, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are a written table."""
    scratch, docs = Scratch(spark), read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
