"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text up to ``chunk`` characters is one chunk. A longer one is cut into chunks that overlap; all
chunks, of whatever document, are pre-tokenised in parallel, each from its own start. Pre-token
boundaries are a left-to-right scan without look-behind, so once two scans share a boundary they agree
from there on: neighbours are stitched at the first boundary that both have inside their overlap and
after which the earlier chunk still sees text. Only the pieces between two stitches are encoded and
kept, each by the rank merges. A text whose neighbours share no boundary in an overlap (a pre-token
longer than the overlap) is encoded again as one chunk. Decoding concatenates the tokens' bytes.

Chunks carry their encoded ids, not their text, to the stitch, and the stitch streams over sorted
partitions, so no group is ever held in memory beyond one document's ids.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import named, plain_text, slices, tasks, written

#: Characters of a chunk, and of the overlap that follows it.
CHUNK, OVERLAP = 32_768, 2_048
#: More characters than a text can have.
WHOLE = 1 << 30
#: Characters behind a boundary that the pattern may look at to set it; cut chunks trust none nearer
#: their end. A pattern that looks further, as one with a repeat behind a look-ahead or with alternatives
#: that need what follows a run (``\\s*[\\r\\n]+``), is not to be cut by chunks: see bpe_encode().
LOOKAHEAD = 16
#: Patterns that may be cut: the given one looks ahead by a character (``\\s+(?!\\S)``), and a piece that
#: reaches the end of a cut chunk is never trusted.
_FAR = re.compile(r"\\s[*+]\[|\\s[*+]\\[rn]|\(\?[=!][^)]*[*+{]")
#: Cached pieces a Python worker keeps, and the longest of them.
CACHE_PIECES, CACHE_CHARS = 60_000, 24
#: Bytes from which a piece is merged with a heap.
LONG_PIECE = 96


def read_ranks(spark: SparkSession, path: str) -> list[tuple[bytes, int]]:
    """(token, rank) of a rank file, lines of base64 token and rank; read on the driver, as vocabulary
    files are of fixed size and need not exist on executors."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]
    else:
        with open(path, encoding="ascii") as f:
            lines = f.read().splitlines()
    return [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in lines if x)]


def _fast_merge(ranks: dict[bytes, int]):
    """The merge of one piece in native code where that library is installed, None elsewhere. It is
    given pieces only, so its own pattern, of which it keeps many copies, is the smallest there is."""
    try:
        import tiktoken
    except ImportError:
        return None
    core = getattr(tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)
    return getattr(core, "encode_single_piece", None)


class Encoder:
    """Encodes single texts by a rank table and a pre-token pattern."""

    def __init__(self, ranks: Iterable[tuple[bytes, int]], pattern: str):
        self.ranks = dict(ranks)
        self.pieces = regex.compile(pattern)
        self.bytes_of = {i: token for token, i in self.ranks.items()}
        self.cache: dict[str, list[int]] = {}
        self.merge = None  # made when first needed, as decoding never is

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank, leftmost first, merges until none can."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) >= LONG_PIECE:
            return self._merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, none = self.ranks.get, 1 << 60
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap and a linked list: n log n in the length of the piece."""
        n, get = len(piece), self.ranks.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if (j := after[i]) < n and (r := get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def piece_ids(self, piece: str) -> list[int]:
        if self.merge is None:
            self.merge = _fast_merge(self.ranks) or self.merged
        ids = self.merge(piece.encode())
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cached, fresh, add = self.cache.get, self.piece_ids, out.extend
        for p in self.pieces.findall(text):
            add(cached(p) or fresh(p))
        return out

    def encode_marked(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, and after each piece its end in characters and the ids so far."""
        out: list[int] = []
        ends, counts = [], []
        for m in self.pieces.finditer(text):
            out.extend(self.cache.get(p := m[0]) or self.piece_ids(p))
            ends.append(m.end())
            counts.append(len(out))
        return out, ends, counts

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_BUILT: dict[str, Encoder] = {}


def _shared(spark: SparkSession, ranks: list[tuple[bytes, int]], pattern: str):
    """A broadcast rank table and pattern, under a name of its own: a worker outlives broadcasts, and
    another object may come to have the identity that one had."""
    return ship(spark).sparkContext.broadcast((uuid.uuid4().hex, ranks, pattern))


def _encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast rank table; made once a worker."""
    name, ranks, pattern = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Encoder(ranks, pattern)
    return _BUILT[name]


def _whole(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.array(enc.encode(t), dtype="<u4") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return run


def _chunks(shared, chunk: int):
    """Per chunk: its ids, and the piece ends (document positions, with the ids up to them) inside the
    overlaps at its head and tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for k, last, text in zip(*(part.column(c).to_pylist() for c in ("k", "is_last", "text")), strict=True):
                    ids, ends, counts = enc.encode_marked(text)
                    # Where the text goes on, the last piece may be cut short and those at the end misjudged.
                    while not last and ends and ends[-1] > len(text) - LOOKAHEAD:
                        ends.pop(), counts.pop()
                    marks = np.array([[e + k * chunk, c] for e, c in zip([0, *ends], [0, *counts], strict=True)], dtype="<i8")
                    overlap = len(text) - chunk
                    head = marks[marks[:, 0] <= k * chunk + OVERLAP] if k else marks[:1]
                    tail = marks[marks[:, 0] >= (k + 1) * chunk] if overlap > 0 and not last else marks[:0]
                    rows.append((np.array(ids, dtype="<u4").tobytes(), head.tobytes(), tail.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("k"), part.column("is_last"), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))],
                    ["doc_id", "k", "is_last", "ids", "head", "tail"],
                )

    return run


def stitch(chunks: Iterable[tuple[int, bool, bytes, bytes, bytes]]) -> bytes | None:
    """Ids of a document from its chunks in order, None where neighbours share no boundary."""
    out: list[bytes] = []
    tail: dict[int, int] | None = None
    start, held = 0, b""
    for k, _, ids, head, own_tail in chunks:
        if k:
            if tail is None:
                return None
            shared = next(((c, tail[e]) for e, c in np.frombuffer(head, "<i8").reshape(-1, 2).tolist() if e in tail), None)
            if shared is None or shared[1] < start:
                return None
            out.append(held[4 * start : 4 * shared[1]])
            start = shared[0]
        held = ids
        tail = dict(np.frombuffer(own_tail, "<i8").reshape(-1, 2).tolist())
    out.append(held[4 * start :])
    return b"".join(out)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stitches partitions sorted by document and chunk; ids is null where the overlap was too short."""
    doc, held = None, []

    def out():
        ids = stitch(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([doc], pa.int64()), pa.array([None if ids is None else len(ids) // 4], pa.int64()), pa.array([ids], pa.binary())],
            ["doc_id", "n_tokens", "ids"],
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "is_last", "ids", "head", "tail")), strict=True):
            if held and row[0] != doc:
                yield out()
                held = []
            doc = row[0]
            held.append(row[1:])
    if held:
        yield out()


def bpe_encode(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (unsigned 32-bit, little-endian).

    Null text counts as empty and has no ids. Special tokens have no meaning: their strings are
    ordinary text. Rows that repeat an id stay apart; long texts that share an id, or have none, are
    encoded as one chunk each, and so are all texts where the pattern looks ahead further than chunks
    can see. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    if _FAR.search(pattern):
        chunk = WHOLE
    if chunk <= OVERLAP:
        raise ValueError(f"chunk must be more than {OVERLAP}")
    spark = docs.sparkSession
    shared = _shared(spark, ranks, pattern)
    encoded = "doc_id long, n_tokens long, ids binary"
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    long_rows = rows.where(F.length("text") > chunk + OVERLAP)
    result = rows.where(F.length("text") <= chunk + OVERLAP).mapInArrow(_whole(shared), encoded)
    ids = long_rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    alike = ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    if not alike.isEmpty():
        result = result.unionByName(long_rows.join(alike, same, "left_semi").mapInArrow(_whole(shared), encoded))
        long_rows = long_rows.join(alike, same, "left_anti")
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - OVERLAP) / chunk).cast("int") - 1)
    cut = long_rows.select("doc_id", "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k")).select(
        "doc_id", "k", (F.col("k") == F.col("last")).alias("is_last"), F.expr(f"substring(text, k * {chunk} + 1, {chunk + OVERLAP})").alias("text")
    )
    marked = cut.repartition(tasks(spark), "doc_id", "k").mapInArrow(_chunks(shared, chunk), "doc_id long, k int, is_last boolean, ids binary, head binary, tail binary")
    stitched, _ = written(marked.repartition("doc_id").sortWithinPartitions("doc_id", "k").mapInArrow(_stitched, encoded), "bpe")
    unsynced = stitched.where("ids is null").select(F.col("doc_id").alias("_id"))
    if not unsynced.isEmpty():
        result = result.unionByName(long_rows.join(unsynced, same, "left_semi").mapInArrow(_whole(shared), encoded))
    return result.unionByName(stitched.where("ids is not null"))


def bpe_decode(encoded: DataFrame, ranks: list[tuple[bytes, int]], ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the bytes of its ids, null for null ids. A column of the input
    named decoded is replaced; an id without a token is an error. Repeated rows repeat their result; an
    empty table gives an empty result."""
    shared = _shared(encoded.sparkSession, ranks, ".")
    encoded = encoded.drop("decoded") if ids_col != "decoded" else encoded.withColumnRenamed("decoded", "ids")
    ids_col = ids_col if ids_col != "decoded" else "ids"
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for batch in batches:
            for part in slices(batch, ids_col):
                out = [None if x is None else enc.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def bpe_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded, null where those are; a row for each row."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
