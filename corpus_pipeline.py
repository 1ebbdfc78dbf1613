"""The corpus pipeline: documents to token ids, in stages that each call one training-data operator.

Each stage is a function of (session, docs, folder of the tables) and returns a frame; run() writes
each one's rows as Parquet in the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.bpe import bpe_decode, bpe_digests, bpe_encode, read_ranks
from glyphmill.llm.common import table, written
from glyphmill.llm.decontaminate import drop_leaks
from glyphmill.llm.exact_dedup import drop_copies
from glyphmill.llm.language_id import keep_identified, train
from glyphmill.llm.ngram_join import keep_one
from glyphmill.llm.queries import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: letterless ones go, and those that three languages or more are near to."""
    return keep_identified(docs, train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of equal texts."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    path, pattern = tokenizer_file()
    ranks = read_ranks(spark, path)
    return bpe_digests(bpe_decode(bpe_encode(docs, ranks, pattern), ranks))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]

#: SQL cannot express the learned stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left.

    Null, empty and letterless texts go at the first stage. Rows that repeat an id and text share their
    fate at every stage, those that share an id only are judged by text but for the join, where they are
    one document. Extra columns pass through to the last stage, whatever their names. Texts are read
    whole; empty tables give an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
