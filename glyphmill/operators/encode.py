"""Encodings of a text column: one narrow pass over Arrow batches with the vocabulary broadcast."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernel import Config, Tokenizer, check_length
from ..session import is_local, ship, written
from ..sources.tables import spread, zero_padded
from ..sources.vocab import MAX_BROADCAST_TOKENS, Vocab
from .passes import flat_rows, parts, table_of, tokenizer

_INTS = T.ArrayType(T.IntegerType(), False)
ENCODING = ("input_ids", "token_type_ids", "attention_mask", "offsets")


def _tokenizer(shared) -> Tokenizer:
    """The worker's tokeniser of a broadcast vocabulary, made once a worker."""
    return tokenizer(shared.id, lambda: shared.value)


_OPEN: list = []


def close() -> None:
    """Release the vocabularies that encoders have broadcast: from executors at once, from the driver with
    the frames that use them. Frames made before read them again if they are run."""
    while _OPEN:
        _OPEN.pop().unpersist()


class _Shared:
    """A broadcast and its id, which the worker's cache is keyed by."""

    def __init__(self, df: DataFrame, vocab: Vocab, config: Config):
        if len(vocab) > MAX_BROADCAST_TOKENS:
            raise ValueError(f"a vocabulary of more than {MAX_BROADCAST_TOKENS} tokens is not broadcast: use wordpiece_rows(), which joins it")
        self.broadcast = ship(df.sparkSession).sparkContext.broadcast((vocab.tokens, config))
        self.id = hash((vocab.tokens, config))
        _OPEN.append(self.broadcast)

    @property
    def value(self):
        return self.broadcast.value


def _mapped(df: DataFrame, text_col: str, vocab: Vocab, config: Config, outs: dict[str, T.DataType], of: Callable) -> DataFrame:
    """df with columns ``outs``, of(tokenizer, column) giving their values for a part of the rows; null
    text gives nulls."""
    shared = _Shared(df, vocab, config)
    kept = spread(df.drop(*outs))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(k, t) for k, t in outs.items())])
    at = kept.columns.index(text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for t in outs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = _tokenizer(shared)
        for part in parts(batches, at):
            column = part.column(at)
            none = column.is_null() if column.null_count else None
            more = []
            for (sizes, values), kind in zip(of(tk, column), kinds, strict=True):
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                values = values if isinstance(values, pa.Array) else pa.array(values, pa.int32())
                more.append(pa.ListArray.from_arrays(offsets, values, type=kind, mask=none))
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=schema.names)

    return kept.mapInArrow(run, schema)


def _framed(per: np.ndarray, values: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of ``per`` elements, end to end, with an element before and one behind each."""
    ends = np.cumsum(per)
    return per + 2, np.insert(values, np.stack((ends - per, ends), 1).ravel(), np.tile(np.array([first, last], values.dtype), len(per)))


def _padded(per: np.ndarray, values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of ``per`` elements, end to end, cut or filled with zeros to length; nothing beyond is copied."""
    kept = np.minimum(per, length)
    row = np.repeat(np.arange(len(per)), kept)
    place = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
    out = np.zeros((len(per), length), np.int32)
    out[row, place] = values[(np.cumsum(per) - per)[row] + place]
    return np.full(len(per), length), out.ravel()


def _arrays(tk: Tokenizer, column: pa.Array, of: Callable, n: int) -> list:
    """What of(text) gives text by text, as sizes and values of n arrays."""
    rows = [((),) * n if t is None else of(t) for t in column.to_pylist()]
    sizes = [np.fromiter((len(r[i]) for r in rows), np.int64, len(rows)) for i in range(n)]
    return [(sizes[i], np.fromiter((x for r in rows for x in r[i]), np.int32, int(sizes[i].sum()))) for i in range(n)]


def _whole(tk: Tokenizer, column: pa.Array, add_cls_sep: bool, places: bool = True):
    """The items of whole texts, and sizes and values of their ids."""
    table = table_of(tk, True)
    flat = table.flat(column, places)
    ids = flat.per, table.ids(flat)
    return flat, (_framed(*ids, tk.vocab.cls_id, tk.vocab.sep_id) if add_cls_sep else ids)


def _pairs(flat) -> tuple[np.ndarray, np.ndarray]:
    return 2 * flat.per, np.stack((flat.start, flat.end), 1).ravel()


def wordpiece_tokenize(df: DataFrame, vocab: Vocab, text_col: str = "text", config: Config = Config()) -> DataFrame:
    """df with pieces (array<string>) and offsets (flat array<int>)."""

    def of(tk: Tokenizer, column: pa.Array):
        flat, _ = _whole(tk, column, False)
        return (flat.per, flat.strings), _pairs(flat)

    return _mapped(df, text_col, vocab, config, {"pieces": T.ArrayType(T.StringType(), False), "offsets": _INTS}, of)


def piece_rows(df: DataFrame, keys: list[str], vocab: Vocab, outs: dict[str, str], text_col: str = "text", config: Config = Config()) -> DataFrame:
    """One row per piece: the keys and ``outs``, names with what they hold: pos (of the basic token),
    piece_idx (in it), i (in the text), start, end, strings (the piece)."""
    shared = _Shared(df, vocab, config)
    return flat_rows(df, keys, text_col, (shared.id, lambda: shared.value), outs, True)


def encode(df: DataFrame, vocab: Vocab, text_col: str = "text", config: Config = Config(), add_cls_sep: bool = True, truncation: bool = True, max_length: int = 512) -> DataFrame:
    """df with input_ids, cut to max_length but not padded."""
    check_length(max_length, add_cls_sep)

    def of(tk: Tokenizer, column: pa.Array):
        if truncation:
            return _arrays(tk, column, lambda t: (tk.encode(t, add_cls_sep, truncation, max_length),), 1)
        return (_whole(tk, column, add_cls_sep, False)[1],)

    return _mapped(df, text_col, vocab, config, {"input_ids": _INTS}, of)


def encode_fixed(df: DataFrame, vocab: Vocab, max_length: int, text_col: str = "text", config: Config = Config()) -> DataFrame:
    """df with input_ids of exactly max_length: cut, or filled with zeros."""
    return encode(df, vocab, text_col, config, max_length=max_length).withColumn("input_ids", zero_padded(F.col("input_ids"), max_length))


def encode_with_ids(
    df: DataFrame, vocab: Vocab, text_col: str = "text", config: Config = Config(), add_cls_sep: bool = True, padding: bool = True, truncation: bool = True, max_length: int = 512
) -> DataFrame:
    """df with input_ids, token_type_ids, attention_mask and offsets. Padding is with zeros to
    max_length, and cuts what truncation left longer; offsets are never padded."""
    check_length(max_length, add_cls_sep)

    def of(tk: Tokenizer, column: pa.Array):
        if truncation:
            return _arrays(tk, column, lambda t: tk.encode_with_ids(t, add_cls_sep, padding, truncation, max_length), len(ENCODING))
        flat, (per, ids) = _whole(tk, column, add_cls_sep)
        if padding:
            (_, mask), (per, ids) = _padded(per, np.broadcast_to(np.int32(1), len(ids)), max_length), _padded(per, ids, max_length)
        else:
            mask = np.ones(len(ids), np.int32)
        return (per, ids), (per, np.zeros(len(ids), np.int32)), (per, mask), _pairs(flat)

    return _mapped(df, text_col, vocab, config, dict.fromkeys(ENCODING, _INTS), of)


def _filled(column: str, fill: Column, length: Column) -> Column:
    return F.concat(F.col(column), F.array_repeat(fill, F.greatest(F.lit(0), length - F.size(column))))


def encode_batch(
    df: DataFrame, vocab: Vocab, batch_cols: list[str], text_col: str = "text", config: Config = Config(), add_cls_sep: bool = True,
    padding: bool = True, padding_to_max_length: bool = False, truncation: bool = True, max_length: int = 512, shifted_arguments: bool = False,
) -> DataFrame:
    """Encodings of batches (rows that agree in batch_cols; none: the whole frame), padded with the pad
    token's id to the longest of the batch or to max_length.

    The longest is an aggregation joined back, a row a batch, so that a batch of any size is never in one
    task; rows are encoded once and written to the shared folder for both, where the session has one.
    ``shifted_arguments`` reproduces an implementation that passes on truncation as padding, any
    max_length but 0 as truncation, and 512 as max_length.
    """
    if shifted_arguments:
        rows = encode_with_ids(df, vocab, text_col, config, add_cls_sep, truncation, bool(max_length), 512)
    else:
        rows = encode_with_ids(df, vocab, text_col, config, add_cls_sep, False, truncation, max_length)
    if not padding:
        return rows
    names = rows.columns
    if padding_to_max_length:
        longest = F.lit(max_length)
        if shifted_arguments:
            rows = rows.withColumns({c: F.slice(c, 1, max_length) for c in ENCODING[:3]})
        plain = rows.toDF(*(f"c{i}" for i in range(len(names))))
    else:
        rows = _once(rows)
        plain = rows.toDF(*(f"c{i}" for i in range(len(names))))  # no column can clash with those added
        own = [f"c{names.index(c)}" for c in batch_cols]
        size = F.max(F.size(f"c{names.index('input_ids')}")).alias("longest")
        if own:
            sizes = plain.groupBy(*(F.col(c).alias(f"b{i}") for i, c in enumerate(own))).agg(size)
            same = [F.col(c).eqNullSafe(F.col(f"b{i}")) for i, c in enumerate(own)]
            plain = plain.join(sizes, functools.reduce(Column.__and__, same), "left")
            longest = F.col("longest")
        else:
            longest = F.lit(plain.agg(size).first()[0] or 0)
    fill = {"input_ids": F.lit(vocab.pad_id), "token_type_ids": F.lit(0), "attention_mask": F.lit(0)}
    return plain.select(*((_filled(f"c{i}", fill[c], longest) if c in fill else F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(names))).toDF(*names)


def _once(rows: DataFrame) -> DataFrame:
    """rows written in the shared folder, as they are used twice; where the session names no folder, they
    are made twice."""
    spark = rows.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return written(rows, "encoded")[0] if named or is_local(spark) else rows


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ids_of(tk: Tokenizer, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of arrays of tokens; each distinct token is looked up once."""
    coded = column.flatten().dictionary_encode()
    ids = np.array([*tk.token_ids(coded.dictionary.to_pylist()), tk.vocab.unk_id], np.int32)
    return _sizes(column), ids[coded.indices.fill_null(len(ids) - 1).to_numpy(zero_copy_only=False)]


def tokens_of(tk: Tokenizer, column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes and tokens of arrays of ids."""
    ids = column.flatten()
    for i in ids.unique().to_pylist():
        tk.vocab.token_of(i)
    if getattr(tk, "strings", None) is None:
        tk.strings = pa.array(tk.vocab.tokens, pa.string())
    return _sizes(column), tk.strings.take(ids)


def convert_tokens_to_ids(df: DataFrame, vocab: Vocab, tokens_col: str = "pieces", add_cls_sep: bool = False, out: str = "ids") -> DataFrame:
    """df with the ids of an array of tokens; unknown ones have the unknown token's id."""

    def of(tk: Tokenizer, column: pa.Array):
        return (_framed(*ids_of(tk, column), tk.vocab.cls_id, tk.vocab.sep_id) if add_cls_sep else ids_of(tk, column),)

    return _mapped(df, tokens_col, vocab, Config(), {out: _INTS}, of)


def convert_ids_to_tokens(df: DataFrame, vocab: Vocab, ids_col: str = "ids", out: str = "tokens") -> DataFrame:
    """df with the tokens of an array of ids; an id that no token has is an error."""
    return _mapped(df, ids_col, vocab, Config(), {out: T.ArrayType(T.StringType(), False)}, lambda tk, column: (tokens_of(tk, column),))
