"""Vocabularies: files of one token a line, immutable in-memory tables, and their DataFrame form."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The five tokens every tokeniser knows.
PAD, CLS, SEP, UNK, MASK = "[PAD]", "[CLS]", "[SEP]", "[UNK]", "[MASK]"
SPECIAL_TOKENS = (PAD, CLS, SEP, UNK, MASK)
#: Tokens up to which a vocabulary is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_TOKENS = 2_000_000


@dataclass(frozen=True)
class Vocab:
    """Distinct non-empty tokens; a token's id is its place. Extending makes a new vocabulary, and the
    ids of the special tokens follow from it (absent: -1)."""

    tokens: tuple[str, ...] = ()
    ids: dict[str, int] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        distinct = tuple(dict.fromkeys(t for t in self.tokens if t))
        object.__setattr__(self, "tokens", distinct)
        object.__setattr__(self, "ids", {t: i for i, t in enumerate(distinct)})

    @classmethod
    def from_text(cls, text: str, strip_cr: bool = False) -> Vocab:
        """Lines end at line feeds only; blank lines and repeats do not count, so ids may run below line
        numbers; a carriage return belongs to its token unless stripped."""
        lines = text.split("\n")
        return cls(tuple(x.rstrip("\r") if strip_cr else x for x in lines))

    @classmethod
    def load(cls, spark: SparkSession, path: str, strip_cr: bool = False) -> Vocab:
        """A vocabulary file from any store Spark reads. The order of lines is their meaning, so a file is
        read as one text, on one task, and comes to the driver; vocabularies have some ten thousands of
        lines. The files of a folder follow each other by name."""
        rows = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("name")).collect()
        return cls.from_text("\n".join(r["value"] for r in sorted(rows, key=lambda r: r["name"])), strip_cr)

    def dump(self, spark: SparkSession, path: str) -> None:
        """The tokens as a folder of one text file, a line each."""
        spark.createDataFrame([("\n".join(self.tokens),)], "value string").coalesce(1).write.text(path)

    def insert(self, tokens: str | Iterable[str]) -> Vocab:
        return Vocab((*self.tokens, *([tokens] if isinstance(tokens, str) else tokens)))

    def __len__(self) -> int:
        return len(self.tokens)

    def id_of(self, token: str) -> int:
        """The token's id, else the unknown token's."""
        return self.ids.get(token, self.unk_id)

    def token_of(self, i: int) -> str:
        if not 0 <= i < len(self.tokens):
            raise IndexError(f"no token has id {i}")
        return self.tokens[i]

    def count(self, token: str) -> bool:
        return token in self.ids

    def special_id(self, token: str) -> int:
        return self.ids.get(token, -1)

    pad_id = property(lambda self: self.special_id(PAD))
    cls_id = property(lambda self: self.special_id(CLS))
    sep_id = property(lambda self: self.special_id(SEP))
    unk_id = property(lambda self: self.special_id(UNK))
    mask_id = property(lambda self: self.special_id(MASK))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(id, token)."""
        return spark.createDataFrame(list(enumerate(self.tokens)), "id int not null, token string not null")

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.parquet(path)

    @classmethod
    def restore(cls, spark: SparkSession, path: str) -> Vocab:
        return cls(tuple(r.token for r in spark.read.parquet(path).orderBy("id").collect()))
