"""Greedy longest-match WordPiece.

``joined_rows`` is a plan of joins: each distinct word is split once, then joined back to its
occurrences; words that have no pieces need no row, so the words are counted in one pass and the
occurrences in another. ``operators.encode`` fuses everything in one narrow pass over Arrow batches, which
moves no text; ``wordpiece_rows`` takes that while the vocabulary is of broadcast size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernel import MAX_WORD_BYTES, Config
from ..sources.vocab import MAX_BROADCAST_TOKENS, UNK, Vocab
from .basic import basic_token_rows
from .encode import piece_rows
from .vocabulary import relation


def _split(words: DataFrame, vocab: Vocab) -> DataFrame:
    """(w, pieces) of the distinct words w that pieces make up whole, a word of the vocabulary being its
    own piece: of each place in a word the longest piece is kept, and the walk takes those it comes to."""
    longest = max(map(len, vocab.tokens), default=0)
    n = F.length("w")
    # a word beyond the limit can only be in the vocabulary whole
    starts = F.when(F.octet_length("w") <= MAX_WORD_BYTES, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(1)))
    sizes = F.when(F.octet_length("w") <= MAX_WORD_BYTES, F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), n - F.col("i") + 1))).otherwise(F.array(n))
    cuts = (
        words.where("w <> ''")
        .withColumn("i", F.explode(starts))
        .withColumn("m", F.explode(sizes))
        .withColumn("piece", F.concat(F.when(F.col("i") > 1, "##").otherwise(""), F.expr("substring(w, i, m)")))
    )
    best = cuts.join(relation(words, vocab).select(F.col("token").alias("piece")), "piece").groupBy("w", "i").agg(F.max("m").alias("m"))
    at = best.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("best"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.length("w")),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok")),
        lambda a, i: F.when(
            a["ok"] & (i == a["at"]),
            F.struct(
                (i + F.coalesce(F.element_at("best", i), F.lit(0))).alias("at"),
                F.concat(a["out"], F.array(F.concat(F.when(i > 1, "##").otherwise(""), F.substring(F.col("w"), i, F.coalesce(F.element_at("best", i), F.lit(0)))))).alias("out"),
                F.element_at("best", i).isNotNull().alias("ok"),
            ),
        ).otherwise(a),
        lambda a: F.when(a["ok"], a["out"]),
    )
    return at.select("w", walked.alias("pieces")).where("pieces is not null")


def _pieces(word: Column, found: Column, config: Config) -> Column:
    """The pieces of a word, found being those of _split(): the word itself where special, the unknown
    token where there are none."""
    special = word.isin(*config.specials) if config.specials else F.lit(False)
    return F.when(special, F.array(word)).when(word == "", F.array().cast("array<string>")).otherwise(F.coalesce(found, F.array(F.lit(UNK))))


def split_words(words: DataFrame, vocab: Vocab, config: Config = Config(), word_col: str = "token") -> DataFrame:
    """Distinct words with ``pieces``: the word itself where special or in the vocabulary, the unknown
    token where too long or not to be made of pieces, else its pieces."""
    named = words.select(F.col(word_col).alias("w"))
    found = _split(named, vocab).select("w", F.col("pieces").alias("p"))
    return named.join(found, "w", "left").select(F.col("w").alias(word_col), _pieces(F.col("w"), F.col("p"), config).alias("pieces"))


def wordpiece_rows(df: DataFrame, keys: list[str], vocab: Vocab, text_col: str = "text", config: Config = Config()) -> DataFrame:
    """One row per piece: the keys, pos (of the basic token), piece_idx, piece."""
    if len(vocab) > MAX_BROADCAST_TOKENS:
        return joined_rows(df, keys, vocab, text_col, config)
    return piece_rows(df, keys, vocab, {"pos": "pos", "piece_idx": "piece_idx", "piece": "strings"}, text_col, config)


def joined_rows(df: DataFrame, keys: list[str], vocab: Vocab, text_col: str = "text", config: Config = Config()) -> DataFrame:
    """wordpiece_rows() for a vocabulary of any size."""
    inner = [f"k{i}" for i in range(len(keys))]  # no key can clash
    rows = df.select(*(F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)), F.col(text_col).alias("text"))
    tokens = basic_token_rows(rows, inner, "text", config, offsets=False).withColumnRenamed("token", "w")
    found = _split(tokens.select("w").distinct(), vocab)
    pieces = tokens.join(found, "w", "left").select(*inner, "pos", F.posexplode(_pieces(F.col("w"), F.col("pieces"), config)).alias("piece_idx", "piece"))
    return pieces.toDF(*keys, "pos", "piece_idx", "piece")
