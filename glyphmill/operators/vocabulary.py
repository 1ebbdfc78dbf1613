"""Vocabulary operators over DataFrames: equi-joins with the (id, token) relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernel import Config
from ..sources.tables import spread
from ..sources.vocab import MAX_BROADCAST_TOKENS, SPECIAL_TOKENS, Vocab
from .passes import token_counts


def relation(df: DataFrame, vocab: Vocab) -> DataFrame:
    """(id, token), marked for broadcast while the vocabulary is of broadcast size."""
    frame = vocab.frame(df.sparkSession)
    return F.broadcast(frame) if len(vocab) <= MAX_BROADCAST_TOKENS else frame


def _looked_up(df: DataFrame, vocab: Vocab, key: str, by: str, get: str) -> tuple[DataFrame, Column]:
    """df joined with the relation on one of its columns, and the other column of the relation. All columns
    are renamed, so that none of df can clash: _back() gives them their names again."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    v = relation(df, vocab).select(F.col(by).alias("v_by"), F.col(get).alias("v_get"))
    return plain.join(v, F.col(f"c{df.columns.index(key)}") == F.col("v_by"), "left"), F.col("v_get")


def _back(df: DataFrame, joined: DataFrame, out: str, value: Column) -> DataFrame:
    kept = [(i, c) for i, c in enumerate(df.columns) if c != out]
    return joined.select(*(F.col(f"c{i}") for i, _ in kept), value.alias("value")).toDF(*(c for _, c in kept), out)


def get_ids(df: DataFrame, vocab: Vocab, token_col: str = "token", out: str = "id") -> DataFrame:
    """df with the id of each token; a token that is not in the vocabulary has the unknown token's."""
    joined, found = _looked_up(df, vocab, token_col, "token", "id")
    return _back(df, joined, out, F.coalesce(found, F.lit(vocab.unk_id)))


def contains(df: DataFrame, vocab: Vocab, token_col: str = "token", out: str = "known") -> DataFrame:
    joined, found = _looked_up(df, vocab, token_col, "token", "id")
    return _back(df, joined, out, found.isNotNull())


def get_tokens(df: DataFrame, vocab: Vocab, id_col: str = "id", out: str = "token") -> DataFrame:
    """df with the token of each id; null for an id that no token has."""
    joined, found = _looked_up(df, vocab, id_col, "id", "token")
    return _back(df, joined, out, found)


def prefix_rows(df: DataFrame, keys: list[str], vocab: Vocab, text_col: str = "text") -> DataFrame:
    """Every token of the vocabulary at every place of a text, overlaps and all: the keys, pos (code
    points), token, id. Substrings of the lengths that tokens have are joined with the relation."""
    inner = [f"k{i}" for i in range(len(keys))]
    lengths = sorted({len(t) for t in vocab.tokens}) or [1]
    text = F.col("text")
    rows = spread(df.select(*(F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)), F.col(text_col).alias("text")).where(F.length("text") > 0))
    places = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length(text) - 1))).withColumn("rest", F.expr(f"substring(text, pos + 1, {lengths[-1]})")).drop("text")
    pieces = places.withColumn("m", F.explode(F.array(*map(F.lit, lengths)))).where(F.col("m") <= F.length("rest")).withColumn("token", F.expr("substring(rest, 1, m)"))
    found = pieces.drop("rest", "m").join(relation(df, vocab), "token")
    return found.select(*inner, "pos", "token", "id").toDF(*keys, "pos", "token", "id")


def longest_prefix(df: DataFrame, vocab: Vocab, text_col: str = "text", out: str = "prefix") -> DataFrame:
    """df with the longest token of the vocabulary that a text begins with, empty where none. Narrow but
    for the join: a text has one candidate a length of tokens."""
    lengths = sorted({len(t) for t in vocab.tokens}, reverse=True) or [1]
    texts = df.select(F.col(text_col).alias("text")).where(F.length("text") > 0).distinct()
    heads = texts.withColumn("token", F.explode(F.transform(F.array(*map(F.lit, lengths)), lambda m: F.when(m <= F.length("text"), F.substring(F.col("text"), F.lit(1), m))))).where("token is not null")
    best = heads.join(relation(df, vocab), "token").groupBy("text").agg(F.max_by("token", F.length("token")).alias("best"))
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    joined = plain.join(best, F.col(f"c{df.columns.index(text_col)}") == F.col("text"), "left")
    return _back(df, joined, out, F.when(F.col(f"c{df.columns.index(text_col)}").isNotNull(), F.coalesce("best", F.lit(""))))


def vocab_from_corpus(df: DataFrame, text_col: str = "text", words: int = 5000, suffixes: int = 1000, config: Config = Config()) -> Vocab:
    """Special tokens; every character of the corpus' words, then each as a continuation; the most
    frequent words of two or more characters; the most frequent three-character ends as continuations.
    Ties go by token. Tasks count their own words, one aggregation adds up; only the chosen tokens reach the driver."""
    counts = token_counts(df, text_col, config).where(F.length("token") > 0)
    counts = counts.where(~F.col("token").isin(*SPECIAL_TOKENS)).persist()
    chars = [r[0] for r in counts.select(F.explode(F.split("token", "")).alias("c")).distinct().orderBy("c").collect()]
    top = [r[0] for r in counts.where(F.length("token") > 1).orderBy(F.desc("n"), "token").limit(words).collect()]
    ends = counts.where(F.length("token") > 3).groupBy(F.substring("token", -3, 3).alias("e")).agg(F.sum("n").alias("n"))
    tails = [r[0] for r in ends.orderBy(F.desc("n"), "e").limit(suffixes).collect()]
    counts.unpersist()
    return Vocab((*SPECIAL_TOKENS, *chars, *(f"##{c}" for c in chars), *top, *(f"##{e}" for e in tails)))
