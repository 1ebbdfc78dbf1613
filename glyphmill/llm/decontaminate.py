"""Benchmark decontamination by q-gram lemma filtering over diagonal bands.

A benchmark item of m characters leaks where a document holds it within e = EDITS * m edits, upper and
lower case and runs of white space aside. By the q-gram lemma such a place shares at least
m - q + 1 - e q of the item's q-grams, on diagonals (text position less item position) at most e apart.
So: look up every q-gram of every document in the items' q-grams, count the hits of an item in
overlapping bands of diagonals, each wide enough to hold any such drift, keep bands that reach the
bound, and align the item with the band's stretch of text by a banded edit distance. Items too short
for an edit are looked up by hash at the starts of words, and leak where they stand as whole words.

A q-gram that very many items have is left out of those that can do without it, and their bound is lower by
as many: by the lemma nothing is lost, as the alignment decides, and a common phrase costs little.

Items are read in blocks of bounded size, each broadcast, and a pass over the documents looks in several
blocks; documents never move.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from .common import code_points, named, slices

#: Characters of a q-gram.
Q = 10
#: Edits an item may differ by, as a share of its characters.
EDITS = 0.08
#: Characters of items in a block; a block's index is broadcast and takes about 32 bytes a character.
BLOCK_CHARS = 1_000_000
#: Items in a block on average; twice as many would not fit the 15 bits of a key.
BLOCK_ITEMS = 1 << 14
#: Blocks that one pass over the documents looks in.
PASS_BLOCKS = 8
#: Places in a block's items from which a q-gram is common, and the share of the bound that an item must
#: keep without its common q-grams to do without them.
COMMON, LEFT = 256, 0.5
#: Code points of scripts written without blanks, whose words end anywhere.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_R = 0x9E3779B97F4A7C15
_R1, _R2, _R4 = (np.uint64(pow(_R, k, 1 << 64)) for k in (1, 2, 4))
_BITS = 22
#: Half bands are counted from here, so that those of matches cut by a text's start are positive.
_ORIGIN = 1 << 24
#: Rows of a slice, as they have 16 bits of a key.
_ROWS = 1 << 16


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of the Q-grams of code points, by doubling: of lengths 1, 2, 4, 8, then 8 + 2."""
    h1 = points.astype(np.uint64) + np.uint64(1)
    if len(h1) < Q:
        return h1[:0]
    h2 = h1[:-1] * _R1 + h1[1:]
    h4 = h2[:-2] * _R2 + h2[2:]
    h8 = h4[:-4] * _R4 + h4[4:]
    h10 = h8[:-2] * _R2 + h2[8:]
    return h10 ^ (h10 >> np.uint64(29))


@functools.cache
def _in_words() -> np.ndarray:
    """Of each code point whether it continues a word."""
    table = np.fromiter((c.isalnum() or unicodedata.category(c)[0] == "M" for c in map(chr, range(0x110000))), dtype=bool, count=0x110000)
    for a, b in _UNSPACED:
        table[a : b + 1] = False
    return table


def _prefix_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums that give the hash of any stretch, and the inverse powers that move it to the start."""
    power, inverse = (np.concatenate((np.ones(1, np.uint64), np.full(len(points), r, dtype=np.uint64))).cumprod(dtype=np.uint64) for r in (np.uint64(_R), np.uint64(pow(_R, -1, 1 << 64))))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64))), inverse


@dataclass(frozen=True)
class Index:
    """The q-grams of a block of items, and the items without edits by their text and by length."""

    item_ids: list
    items: list[str]
    times: list[int]
    edits: np.ndarray
    need: np.ndarray
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each gram's postings
    item: np.ndarray  # postings
    at: np.ndarray
    seen: np.ndarray  # bit table of the grams' leading bits
    short: dict[str, list[int]]
    short_hashes: dict[int, np.ndarray]


def _leading(grams: np.ndarray) -> np.ndarray:
    return ((grams * _R1) >> np.uint64(64 - _BITS)).astype(np.int64)


def build_index(rows: list[tuple[object, str | None, int]], min_chars: int = 0) -> Index:
    ids, texts, times = [], [], []
    for item_id, text, n in rows:
        if len(t := normalised(text)) >= max(min_chars, 1):
            ids.append(item_id), texts.append(t), times.append(n)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    edits = np.maximum(np.minimum((lengths * EDITS).astype(np.int64), (lengths - Q) // Q), 0)
    all_grams = [gram_hashes(code_points(t if e else "")) for t, e in zip(texts, edits, strict=True)]
    short: dict[str, list[int]] = {}
    hashes: dict[int, list[int]] = {}
    for k in np.flatnonzero(edits == 0).tolist():
        short.setdefault(texts[k], []).append(k)
    for t in short:
        hashes.setdefault(len(t), []).append(int(_prefix_hashes(code_points(t))[0][-1]))
    short_hashes = {n: np.unique(np.array(h, dtype=np.uint64)) for n, h in hashes.items()}
    flat = np.concatenate(all_grams) if texts else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(texts)), [len(g) for g in all_grams])
    at = np.concatenate([np.arange(len(g)) for g in all_grams]) if texts else np.zeros(0, np.int64)
    need = lengths - Q + 1 - edits * Q
    _, which, places = np.unique(flat, return_inverse=True, return_counts=True)
    common = places[which] > COMMON
    fewer = np.bincount(item[common], minlength=len(texts))
    spared = (need - fewer >= LEFT * need) & (need - fewer >= 1)
    kept = ~(common & spared[item])
    flat, item, at = flat[kept], item[kept], at[kept]
    need = np.where(spared, need - fewer, need)
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << _BITS, dtype=bool)
    seen[_leading(grams)] = True
    return Index(ids, texts, times, edits, need, grams, np.append(first, len(flat)), item[order], at[order], seen, short, short_hashes)


def banded_alignment(item: str, region: str, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of item in region with at most so many edits, on diagonals
    from low to high: ends are free in the region, the matrix has a column for each diagonal and a row
    for each character of the item. Ties go to the first end."""
    a, b = code_points(item), code_points(region)
    m, n, width = len(a), len(b), high - low + 1
    far = m + n + 1
    diag = np.arange(low, high + 1)
    # the region between sentinels, so that each row is one slice of it
    padded = np.full(n + 2 * (m + width) + abs(low) + abs(high), 0xFFFFFFFF, dtype=np.uint32)
    shift = m + width + abs(low)
    padded[shift : shift + n] = b
    cost = np.where((diag >= 0) & (diag <= n), 0, far)
    start, ramp = diag.copy(), np.arange(width)
    above, came = np.full(width, far), np.zeros(width, dtype=np.int64)
    for i in range(1, m + 1):
        at = shift + i + low - 1
        diagonal = cost + (padded[at : at + width] != a[i - 1])
        above[:-1], came[:-1] = cost[1:], start[1:]
        skipped = above + 1  # an item character without a partner
        origin = np.where(skipped < diagonal, came, start)
        level = np.minimum(diagonal, skipped) - ramp
        best = np.minimum.accumulate(level)  # region characters without a partner
        start = origin[np.maximum.accumulate(np.where(level == best, ramp, 0))]
        cost = best + ramp
        if i + low < 0 or i + high > n:
            cost[(i + diag < 0) | (i + diag > n)] = far
        if i % 16 == 0 and cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), int(m + diag[k])) if cost[k] <= most else None


def leaks_in(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) of the best match of each leaked item in each text; positions are
    characters of the normalised text."""
    norm = [normalised(t) for t in texts]
    offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in norm])))
    points = code_points("\0".join(norm))
    return sorted(_by_bands(norm, offset, points, index) + _by_words(norm, offset, points, index))


def _by_words(norm: list[str], offset: np.ndarray, points: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """leaks_in() of the items without edits: the first place where they stand as whole words."""
    if not index.short:
        return []
    inside = _in_words()[points]
    edge = np.concatenate(([True], ~(inside[1:] & inside[:-1]), [True]))
    edge = edge if len(points) else edge[:1]
    total, inverse = _prefix_hashes(points)
    starts = np.flatnonzero(edge)
    first: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n, hashes in index.short_hashes.items():
        at = starts[starts + n <= len(points)]
        at = at[edge[at + n]]
        own = (total[at + n] - total[at]) * inverse[at]
        at = at[hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own]
        for p, r in zip(at.tolist(), (np.searchsorted(offset, at, side="right") - 1).tolist(), strict=True):
            begin = p - int(offset[r])
            for i in index.short.get(norm[r][begin : begin + n], ()):
                first.setdefault((r, i), (0, begin, begin + n))
    return [(r, i, *v) for (r, i), v in first.items()]


def _by_bands(norm: list[str], offset: np.ndarray, points: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """leaks_in() of the items that may have edits."""
    if not len(index.grams):
        return []
    hashes = gram_hashes(points)
    where = np.flatnonzero(index.seen[_leading(hashes)])
    found = np.searchsorted(index.grams, hashes[where])
    real = index.grams[np.minimum(found, len(index.grams) - 1)] == hashes[where]
    where, found = where[real], found[real]
    if not len(where):
        return []
    n = index.first[found + 1] - index.first[found]
    posting = np.repeat(index.first[found] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    item, row = index.item[posting].astype(np.int64), np.searchsorted(offset, where, side="right") - 1
    diag = np.repeat(where - offset[row], n) - index.at[posting]
    width = 2 * index.edits + 1
    # item, row and half band in one number; a band is a half band and the next one
    keys, count = np.unique((item << 48) | (np.repeat(row, n) << 32) | (np.floor_divide(diag, width[item]) + _ORIGIN), return_counts=True)
    after = np.minimum(np.searchsorted(keys, keys + 1), len(keys) - 1)
    total = count + np.where(keys[after] == keys + 1, count[after], 0)
    good = keys[total >= index.need[keys >> 48]]
    out = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else ():
        i, r = int(run[0] >> 48), int(run[0] >> 32) & 0xFFFF
        e, w = int(index.edits[i]), int(width[i])
        first, last = ((int(k) & 0xFFFFFFFF) - _ORIGIN for k in (run[0], run[-1]))
        if match := _verified(index.items[i], norm[r], first * w - e, (last + 2) * w + e, e):
            out.append((r, i, *match))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, i, *match in out:
        best[r, i] = min(best.get((r, i), tuple(match)), tuple(match))
    return [(r, i, *v) for (r, i), v in best.items()]


def _verified(item: str, text: str, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """The match of item on diagonals low to high of text within so many edits."""
    start, end = max(low, 0), min(len(text), high + len(item))
    if end - start < len(item) - edits:
        return None
    region = text[start:end]
    if (at := region.find(item)) >= 0:
        return 0, start + at, start + at + len(item)
    found = banded_alignment(item, region, low - start, high - start, edits)
    return found and (found[0], start + found[1], start + found[2])


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None, int]]]:
    """The distinct items (id, text, rows that have it) in blocks of about BLOCK_CHARS characters and
    BLOCK_ITEMS items at most, one at a time on the driver."""
    items = benchmark.select(named(id_col).alias("id"), named(text_col).alias("text")).where(F.length("text") > 0).groupBy("id", "text").agg(F.count(F.lit(1)).alias("times"))
    chars, rows = items.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    n = int(max(-(-(chars or 0) // BLOCK_CHARS), -(-rows // BLOCK_ITEMS)))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        yield [(r["id"], r["text"], r["times"]) for r in items.where(block == k).sort("id", "text").collect()]


def _passes(benchmark: DataFrame, id_col: str, text_col: str, min_chars: int) -> Iterator[tuple[list, bool]]:
    """The broadcast indexes of each pass over the documents, and whether any of their items repeats."""
    found = filter(None, blocks(benchmark, id_col, text_col))
    share = ship(benchmark.sparkSession).sparkContext.broadcast
    while some := list(itertools.islice(found, PASS_BLOCKS)):
        yield [share(build_index(block, min_chars)) for block in some], any(x[2] > 1 for block in some for x in block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_chars: int = 0) -> DataFrame:
    """One row per document and item that leaks into it: doc_id, item_id (of the benchmark's type), edits,
    similarity, start, end (characters of the lower-cased text with single blanks), of the item's best
    match there.

    Null and empty texts leak nothing; texts of any length are read whole. Items too short for an edit
    (under 20 characters) leak where they stand unchanged as whole words; those under min_chars characters
    are not searched. Items that repeat are each reported, repeated documents too. Ties between matches go
    to the earlier. A null document or item id is reported as null. Other columns are ignored, whatever
    their names. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    id_type = benchmark.schema[item_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("item_id", id_type), T.StructField("edits", T.LongType()), T.StructField("similarity", T.DoubleType()),
         T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema] + [pa.int64()]
    result = None
    for indexes, repeats in _passes(benchmark, item_col, item_text, min_chars):

        def run(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1_000_000, _ROWS):
                    ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                    for shared in indexes:
                        index = shared.value
                        out = [(ids[r], index.item_ids[i], e, 1 - e / len(index.items[i]), a, b, index.times[i]) for r, i, e, a, b in leaks_in(texts, index)]
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], [*schema.names, "times"])

        one = rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("times", T.LongType())]))
        if repeats:  # rows of an item that repeats
            one = one.withColumn("time", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
        one = one.select(*schema.names)
        result = one if result is None else result.unionByName(one)
    return result if result is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_chars: int = 0) -> DataFrame:
    """docs without the documents that any item of min_chars characters leaks into, as find_leaks() finds
    them. Rows are filtered where they are, with all their columns: those with null or empty texts stay,
    repeated rows share their fate, an empty benchmark drops none."""
    for indexes, _ in _passes(benchmark, item_col, item_text, min_chars):

        def run(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col, 1_000_000, _ROWS):
                    texts = part.column(text_col).to_pylist()
                    leaked = {x[0] for shared in indexes for x in leaks_in(texts, shared.value)}
                    yield part.filter(pa.array([i not in leaked for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
