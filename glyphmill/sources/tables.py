"""Corpus tables, and pads of arrays that callers store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input for each core under which rows are dealt out again, and those that a task then has at most.
SPREAD_BYTES, TASK_BYTES = 32 << 20, 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt to all cores where the input is so small that its files may not reach them
    (a Parquet file of one row group is one task); larger inputs and streams are left as they are. The size
    is that of the files, as Spark's estimate for some of their columns knows nothing of long texts."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.repartition(max(2 * cores, -(-size // TASK_BYTES))) if size < SPREAD_BYTES * cores else df


def until_nul(text: Column) -> Column:
    """Text as far as its first NUL."""
    return F.substring_index(text, "\0", 1)


def zero_padded(ids: Column, length: int) -> Column:
    """An array cut or filled with zeros to a fixed length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)
