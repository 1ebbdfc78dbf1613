"""What the operators share: reading tables, the shared folder, byte-bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

__all__ = ["SPACES", "Scratch", "code_points", "discard", "named", "plain_text", "slices", "table", "tasks", "written"]

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions for work that takes time out of proportion to its bytes: by bytes, adaptive execution
    would merge it into a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables made by written() that no later plan reads."""
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch(list):
    """Paths of the tables that an operator writes on its way; clear_from() removes those that its result
    does not read."""

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        table_, path = written(df, tag)
        self.append(path)
        return table_

    def clear_from(self, spark: SparkSession) -> None:
        discard(spark, *self)
        self.clear()


def named(column: str):
    """A column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def plain_text(text):
    """A text column in which null counts as empty."""
    return F.coalesce(named(text) if isinstance(text, str) else text, F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts hold about ``most`` bytes, of at most ``rows`` rows; one longer
    text is a piece of its own."""
    lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        n = 0 if n != n else int(n)
        if i > start and (held + n > most or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
