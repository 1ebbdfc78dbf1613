"""Narrow passes over Arrow batches in parts of bounded size, and the flat rows that they make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernel import Config, RunTable, Tokenizer
from ..session import ship
from ..sources.tables import spread
from ..sources.vocab import Vocab

#: Bytes of text, or elements of arrays, that a pass works on at once; a longer row is alone.
PART = 2_000_000
#: Distinct runs from which counts leave a task.
_COUNTED = 200_000
_BUILT: dict = {}


def tokenizer(key, made) -> Tokenizer:
    """The worker's tokeniser of a key, made once a worker: (tokens, config) come from made()."""
    if key not in _BUILT:
        _BUILT.clear()
        tokens, config = made()
        _BUILT[key] = Tokenizer(Vocab(tokens), config)
    return _BUILT[key]


def table_of(tk: Tokenizer, pieces: bool) -> RunTable:
    """The table of runs that a tokeniser keeps."""
    if getattr(tk, "table", None) is None or tk.table.pieces != pieces:
        tk.table = RunTable(tk, pieces)
    return tk.table


def parts(batches: Iterator[pa.RecordBatch], at: int, most: int = PART, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose column ``at`` holds about ``most`` bytes or elements, one row at least."""
    for batch in batches:
        column = batch.column(at)
        size = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < batch.num_rows:
            done = int(ends[k - 1]) if k else 0
            to = min(max(k + 1, int(np.searchsorted(ends, done + most, "right"))), k + rows)
            yield batch.slice(k, to - k)
            k = min(to, batch.num_rows)


def flat_rows(df: DataFrame, keys: list[str], text_col: str, made, outs: dict[str, str], pieces: bool) -> DataFrame:
    """One row per item of a text, a basic token or with ``pieces`` a piece: the keys and ``outs``, names
    with what of Flat they hold. ``made`` is (key, function) for tokenizer()."""
    ship(df.sparkSession)
    plain = spread(df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text_col).alias("text")))
    kinds = [T.StringType() if x == "strings" else T.IntegerType() for x in outs.values()]
    schema = T.StructType([*plain.schema.fields[:-1], *(T.StructField(f"o{i}", kind, False) for i, kind in enumerate(kinds))])
    names, wanted, n_keys = schema.names, list(outs.values()), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(tokenizer(*made), pieces)
        for part in parts(batches, n_keys):
            flat = table.flat(part.column(n_keys))
            row = pa.array(np.repeat(np.arange(part.num_rows), flat.per))
            own = (flat.strings if x == "strings" else pa.array(getattr(flat, x).astype(np.int32)) for x in wanted)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(n_keys)), *own], names=names)

    return plain.mapInArrow(run, schema).toDF(*keys, *outs)


def token_rows(df: DataFrame, keys: list[str], text_col: str = "text", config: Config = Config()) -> DataFrame:
    """basic_token_rows() with offsets, by one Arrow pass: the keys, pos, start, end, token. Its cost is
    linear in the text, and a fraction of that of column expressions."""
    return flat_rows(df, keys, text_col, (config, lambda: ((), config)), {"pos": "pos", "start": "start", "end": "end", "token": "strings"}, False)


def token_counts(df: DataFrame, text_col: str = "text", config: Config = Config()) -> DataFrame:
    """(token, n), a token once: runs are counted within tasks as they stand and folded once each."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(tokenizer(config, lambda: ((), config)), False)
        held: list[pa.StructArray] = []

        def merged(counts: list[pa.StructArray]) -> pa.StructArray:
            values, n = pa.concat_arrays(counts).flatten()
            coded = values.dictionary_encode()
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, coded.indices.to_numpy(), n.to_numpy())
            return pa.StructArray.from_arrays([coded.dictionary, pa.array(total)], names=["values", "counts"])

        def told() -> pa.RecordBatch:
            values, n = merged(held).flatten()
            held.clear()
            return pa.RecordBatch.from_arrays([table.tokens(values), n], names=["token", "n"])

        for part in parts(batches, 0):
            held.append(table.cut(part.column(0)).strings.value_counts())
            if sum(map(len, held)) > 2 * _COUNTED:
                held[:] = [merged(held)]
                if len(held[0]) > _COUNTED:
                    yield told()
        if held:
            yield told()

    return spread(df.select(text_col)).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
