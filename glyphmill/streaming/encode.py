"""Encoding of streams. Every operator here is a stateless map, so a streaming frame takes the batch
operators as they are, needs no watermark, and keeps any trigger and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.kernel import Config
from ..operators.encode import encode_with_ids
from ..sources.vocab import Vocab


def encode_stream(stream: DataFrame, vocab: Vocab, text_col: str = "text", config: Config = Config(), max_length: int = 512) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming frame")
    return encode_with_ids(stream, vocab, text_col, config, max_length=max_length)


def encode_folder(spark: SparkSession, source: str, schema, target: str, checkpoint: str, vocab: Vocab, text_col: str = "text", config: Config = Config(), max_length: int = 512):
    """Encode the Parquet files that appear in a folder to another, exactly once; returns the query,
    which ends when what is there is done."""
    stream = spark.readStream.schema(schema).parquet(source)
    return encode_stream(stream, vocab, text_col, config, max_length).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
