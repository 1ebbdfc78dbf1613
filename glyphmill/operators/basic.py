"""Basic tokenisation of a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basic_tokens, token_strings
from ..functions.kernel import Config
from ..sources.tables import spread, until_nul


def basic_tokenize(df: DataFrame, text_col: str = "text", config: Config = Config(), out: str = "tokens") -> DataFrame:
    """df with ``out``: array<struct<start, end, token>>. A null text gives null."""
    text = until_nul(F.col(text_col)) if config.stop_at_nul else F.col(text_col)
    return df.withColumn(out, basic_tokens(text, config.lower, config.specials, "codepoint" if config.codepoint_level else "byte"))


def basic_token_rows(df: DataFrame, keys: list[str], text_col: str = "text", config: Config = Config(), offsets: bool = True) -> DataFrame:
    """One row per token: the keys, pos, start, end, token; without offsets the keys, pos, token. Narrow:
    nothing is shuffled but inputs too small for all cores."""
    rows = spread(df.select(*keys, text_col))
    if not offsets:
        text = until_nul(F.col(text_col)) if config.stop_at_nul else F.col(text_col)
        return rows.select(*keys, F.posexplode(token_strings(text, config.lower, config.specials)).alias("pos", "token"))
    tokens = basic_tokenize(rows, text_col, config, _unused(rows, "tokens"))
    return tokens.select(*keys, F.posexplode(tokens.columns[-1]).alias("pos", "t")).select(*keys, "pos", "t.start", "t.end", "t.token")


def _unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name
