"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed character n-grams
(one to three letters, word ends included) predicts its sign; decoding adds, over the bits, the
logistic loss of the prediction against the codeword's bit, weighted by what the bit's classifier is
worth on its training rows, and takes the codeword of least loss. The score is the softmax of the
negative losses. Where two codewords are about as near, as in texts of two languages or of a letter or
two, the prediction is flagged ambiguous.

The classifiers are fitted on a bounded sample (TRAIN_ROWS in all, an equal part of each language,
chosen by hash of the id) of the rows that training may see; n-grams are counted over whole texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import code_points, slices

#: Hashed n-gram buckets.
BUCKETS = 4096
#: Rows of the training sample, about.
TRAIN_ROWS = 1000
#: Letters of the windows that training adds to the whole texts, so that short texts are learned too.
WINDOWS = (32, 80)
#: Codewords for up to so many languages are exhaustive; beyond, the best of random codes.
EXHAUSTIVE = 6
#: Scores under this are ambiguous: of two languages, the second is then at least 0.8 times as likely.
AMBIGUOUS = 0.55
#: Scores under this are rejected by the filter: three languages or more are then about as near. Documents
#: between two languages, often of one word, are flagged but kept.
REJECTED = 1 / 3
UNKNOWN = "und"
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    worth: np.ndarray  # of each bit


_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text: letters, and one blank before, between and after words."""
    points = code_points((text or "").lower())
    letter = _is_letter()[points]
    if not letter.any():
        return points[:0]
    before = np.concatenate(([False], letter[:-1]))
    kept = np.where(letter, points, np.uint32(32))[letter | before]
    return np.concatenate((np.array([32], dtype="<u4"), kept, np.array([32], dtype="<u4") if kept[-1] != 32 else kept[:0]))


def counts_of(points: np.ndarray) -> np.ndarray:
    """Hashed counts of the one- to three-grams of letters_of()."""
    total = np.zeros(BUCKETS, dtype=np.float32)
    if not len(points):
        return total
    gram = points.astype(np.uint32)
    for n, k in enumerate(_MULTIPLIERS):
        if n:
            gram = gram[:-1] * np.uint32(0x01000193) + points[n:]
        if not len(gram):
            break
        total += np.bincount((gram * k) >> np.uint32(20), minlength=BUCKETS)
    return total


def unit(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as square roots of shares."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n x bits codewords: all distinct splits for few languages, random ones far apart for more."""
    if n <= EXHAUSTIVE:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1)]
        return np.array([s for s in splits if n == 1 or min(s) < 0], dtype=np.float64).T
    rng, bits = np.random.default_rng(seed), math.ceil(15 * math.log2(n))
    best, far = None, -1
    for _ in range(60):
        code = rng.choice((-1.0, 1.0), size=(n, bits))
        product = code @ code.T
        np.fill_diagonal(product, -bits)
        if (d := (bits - product.max()) / 2) > far and np.abs(code.sum(axis=0)).max() < n:
            best, far = code, d
    return best


def fit(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], steps: int = 120, rate: float = 4.0, decay: float = 1e-5) -> Model:
    """Logistic classifiers of all bits at once, by gradient descent with momentum on balanced rows."""
    codes = codewords(len(languages))
    target = codes[y]
    share = np.bincount(y, minlength=len(languages))
    w_row = (1.0 / share[y])[:, None]
    w_row = w_row / w_row.sum()
    mean = x.mean(axis=0)
    z = ((x - mean) * 8).astype(np.float32)
    w, b = np.zeros((x.shape[1], codes.shape[1]), dtype=np.float32), np.zeros(codes.shape[1], dtype=np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        slope = (-target * w_row / (1 + np.exp(target * (z @ w + b)))).astype(np.float32)
        vw = 0.9 * vw - rate * 0.1 * (z.T @ slope + decay * w)
        vb = 0.9 * vb - rate * 0.1 * slope.sum(axis=0)
        w, b = w + vw, b + vb
    error = ((np.sign(z @ w + b) != target) * w_row).sum(axis=0)
    worth = np.clip(0.5 * np.log((1 - error + 1e-3) / (error + 1e-3)), 0.05, None)
    return Model(languages, codes, 8 * w, b - 8 * (mean @ w), worth / worth.mean())


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword and its score, for rows of bit margins."""
    loss = (np.logaddexp(0, -margins[:, None, :] * model.codes[None]) * model.worth).mean(axis=2)
    odds = np.exp((loss.min(axis=1, keepdims=True) - loss) * 2)
    return loss.argmin(axis=1), 1 / odds.sum(axis=1)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    counts = np.stack([counts_of(letters_of(t)) for t in texts])
    known = counts.any(axis=1)
    if model.languages:
        best, score = decode(model, unit(counts) @ model.weights + model.bias)
        score = np.where(known, score, 0.0)
    else:
        best, score, known = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
    return [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], np.clip(score, 0.0, 1.0)


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse n-gram counts of whole texts and of windows of them."""
    for batch in batches:
        langs, found, counts = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            points = letters_of(text)
            cuts = [points] + [points[(s := (len(points) - n) * (k + 1) // (len(WINDOWS) + 1)) : s + n] for k, n in enumerate(WINDOWS) if len(points) > n]
            for cut in cuts if len(points) else []:
                c = counts_of(cut)
                at = np.flatnonzero(c)
                langs.append(lang), found.append(at.astype("<i4").tobytes()), counts.append(c[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["lang", "at", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model of the languages in the labelled rows that are not held out. Without such rows the
    model knows no language and predicts ``und``."""
    ship(docs.sparkSession)
    known = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((0, 0)), np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    each = max(16, rows // len(languages))
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, each / n))) for k, n in sizes.items()))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(F.col("text").isNotNull() & (drawn < share[F.col("lang")])).select("lang", "text")
    found = sorted(sample.mapInArrow(_sampled, "lang string, at binary, n binary").collect())
    if not found:
        return Model((), np.zeros((0, 0)), np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    languages = tuple(sorted({r["lang"] for r in found}))
    counts = np.zeros((len(found), BUCKETS), dtype=np.float32)
    for i, r in enumerate(found):
        counts[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<f4")
    return fit(unit(counts), np.array([languages.index(r["lang"]) for r in found]), languages)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, ambiguous.

    Null, empty and letterless texts are ``und`` with score 0. Texts of any length are read whole.
    Ties between codewords go to the language first in order, and are ambiguous. Repeated rows repeat their
    result; other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000, 256):
                langs, score = predict(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS)],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = REJECTED) -> DataFrame:
    """docs without the rows that have no language: letterless ones (null, empty and blank texts among
    them) and those of a score under ``least``. Rows are filtered where they are, whole, with all their columns; nothing is
    shuffled. Repeated rows share their fate; an empty table stays empty."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 2_000_000, 256):
                langs, score = predict(shared.value, part.column(text_col).to_pylist())
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
