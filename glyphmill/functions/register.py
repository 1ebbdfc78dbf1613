"""SQL functions: tokenise and encode from spark.sql()."""

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.encode import _Shared, _tokenizer
from ..sources.vocab import Vocab
from .kernel import Config


def register(spark: SparkSession, vocab: Vocab, config: Config = Config(), prefix: str = "") -> None:
    """wordpiece(text), wordpiece_offsets(text), encode_ids(text, max_length) and token_count(text)."""
    shared = _Shared(spark.range(0), vocab, config)

    @F.pandas_udf("array<string>")
    def wordpiece(text: pd.Series) -> pd.Series:
        tk = _tokenizer(shared)
        return text.map(lambda t: None if t is None else tk.wordpiece(t)[0])

    @F.pandas_udf("array<int>")
    def wordpiece_offsets(text: pd.Series) -> pd.Series:
        tk = _tokenizer(shared)
        return text.map(lambda t: None if t is None else tk.wordpiece(t)[1])

    @F.pandas_udf("array<int>")
    def encode_ids(text: pd.Series, max_length: pd.Series) -> pd.Series:
        tk = _tokenizer(shared)
        return pd.Series([None if t is None else tk.encode(t, max_length=int(n)) for t, n in zip(text, max_length, strict=True)], dtype=object)

    @F.pandas_udf("int")
    def token_count(text: pd.Series) -> pd.Series:
        tk = _tokenizer(shared)
        return pd.Series([None if t is None else len(tk.wordpiece(t)[0]) for t in text], dtype="Int32")

    for f in (wordpiece, wordpiece_offsets, encode_ids, token_count):
        spark.udf.register(prefix + f.__name__, f)
