"""Jaccard self-join of documents on word n-grams, by prefix trees.

A document's set is ordered globally, so documents are paths of a prefix tree. Two sets x and y link
when |x & y| / |x | y| is at least t, which needs max(|x|, |y|) * t shared elements; so a document can
drop the first |x| - ceil(t |x|) elements of its path, but no more, and must meet every partner among
the elements before that bound plus one. What is built on this:

1. Order by hash. Each document shows the first quarter of its path. A partner must share, within it,
   about a tenth of the document's elements; a document of which fewer shown elements occur in any
   other document has no partner and leaves. Documents that merely quote a passage leave here, however
   common the passage, and no pair is ever written.
2. Equal sets become one class. A family of near copies would give a pair for every two of them, so
   where more than FAMILY classes have the same first element under one of SEEDS orders, they are measured
   against the one of them whose elements are the most common, mostly the text that the others vary; this
   ties families together with a link each. It only saves work: step 4 finds the same components without.
3. Links within a component change nothing. So step 1 repeats with elements that occur in two
   components; families leave as a whole, and what stays is little.
4. What stays is joined in full: elements ordered by spread, then rarity; paths cut at the bound; for
   each element the paths from there on form a tree, which is searched with every member, partial
   overlaps being shared by all that continue a path, and subtrees dropped where the lengths that
   remain cannot reach the overlap. Partners differ little in size, so an element has a forest for each
   class of sizes, which holds the sets of that class and, to be found only, those of the next. Large
   forests are cut into pairs of blocks.

Every link between documents of different components is measured on the whole sets, so the components
are those of the full join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, discard, named, plain_text, slices, tasks, written
from .components import components

#: Words of a shingle, and the similarity in per cent.
WORDS, PERCENT = 4, 85
#: Share of a path that a document shows in steps 1 and 3.
SHOWN = 0.25
#: Orders that step 2 tries (none: step 4 finds all links), and classes that it leaves to step 4 as a family.
SEEDS, FAMILY = 4, 1
#: Paths of a block of a tree in step 4.
BLOCK = 1024
#: Documents up to which a list of ids is broadcast instead of shuffled (8 MB).
BROADCAST_IDS = 1_000_000

_RADIX = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.full(n, np.uint64(r), dtype=np.uint64))).cumprod(dtype=np.uint64) for r in (_RADIX, pow(_RADIX, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of bytes that hold texts one after another; cuts are the texts'
    starts, where words end too."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begin[inner] = word[inner]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    stop[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)))
    return mixed((total[e] - total[s]) * inverse[s]), s


def _pieces(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_word_hashes() of any length, in pieces that end at white space or between texts."""
    if len(data) <= _PIECE:
        return _word_hashes(data, cuts)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            found = np.flatnonzero(_SPACE[data[end : end + _PIECE]])
            end = end + int(found[0]) if len(found) else min(len(data), end + _PIECE)
        h, s = _word_hashes(data[at:end], cuts[(cuts >= at) & (cuts < end)] - at)
        hashes.append(h), starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text, as signed 64-bit integers."""
    raw = [(x or "").encode("utf-8", "surrogatepass").translate(_LOWER) for x in texts.to_pylist()]
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    h, s = _pieces(np.frombuffer(b"".join(raw), dtype=np.uint8), cuts[:-1])
    bounds = np.searchsorted(s, cuts)
    k = np.uint64(0xD6E8FEB86659FD93)
    rolled = h
    for i in range(1, words):
        rolled = rolled[:-1] * k + h[i:] if len(rolled) else rolled
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1].view(np.int64))
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for w in h[a:b]:
                short = short * k + w
            out.append(mixed(short).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def shown_length(n: int, percent: int = PERCENT) -> int:
    """Elements of its path that a document of n shows: the bound's, and a margin to count over."""
    return min(n, n - least_overlap(n, percent) + margin(n, percent)) if n else 0


def margin(n: int, percent: int = PERCENT) -> int:
    """Elements that a partner of no smaller a cut must share within what is shown."""
    return max(1, int((SHOWN - (100 - percent) / 100) * n))


def needed(n: int, percent: int = PERCENT) -> int:
    """Shared elements without which a document has no partner. Of two partners, the one whose shown
    path ends first in the order has margin() of its size within both; the other's size is at most that
    over the similarity."""
    return margin(least_overlap(n, percent), percent)


def _rows(part: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _shown(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _PIECE, 4096):
                sets = shingle_sets(part.column("text"), words)
                yield _rows(part, ["n", "need", "path"], [
                    pa.array([len(x) for x in sets], pa.int32()), pa.array([needed(len(x), percent) for x in sets], pa.int32()),
                    _lists([x[: shown_length(len(x), percent)] for x in sets]),
                ])

    return run


def _whole(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _PIECE, 4096):
                sets = shingle_sets(part.column("text"), words)
                unsigned = [x.view(np.uint64) for x in sets]
                sums = [[int(mixed(x + np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for x in unsigned] for c in (0x1234567, 0x89ABCDEF)]
                least = [[int(mixed(x ^ np.uint64(0x5851F42D4C957F2D * (c + 1) & (2**64 - 1))).min().astype(np.int64)) if len(x) else 0 for c in range(SEEDS)] for x in unsigned]
                yield _rows(part, ["n", "d1", "d2", "least", "path"], [
                    pa.array([len(x) for x in sets], pa.int32()), *(pa.array(x, pa.int64()) for x in sums),
                    pa.array(least, pa.list_(pa.int64())), _lists(sets),
                ])

    return run


def _spread_out(rows: DataFrame, group: str) -> DataFrame:
    """(doc_id, weight) of the rows (doc_id, need, path, group) whose path has ``need`` elements that
    occur in two groups; weight is the mean logarithm of its elements' counts."""
    each = rows.select("doc_id", "need", group, F.size("path").alias("_size"), F.explode("path").alias("e"))
    both = each.groupBy("e").agg(F.min(group).alias("_a"), F.max(group).alias("_b"), F.count(F.lit(1)).alias("_df")).where("_a < _b").select("e", "_df")
    found = each.join(both, "e").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c"), F.max("need").alias("_need"), (F.sum(F.log2("_df")) / F.max("_size")).alias("weight"))
    return found.where("_c >= _need").select("doc_id", F.round("weight", 4).alias("weight"))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose doc_id is in ids, which is a written table; broadcast while it is small."""
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity. Sizes are compared before sets move."""
    size_x, size_y = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("nx")), sets.select(F.col("doc_id").alias("b"), F.col("n").alias("ny"))
    fit = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    near = pairs.join(size_x, "a").join(size_y, "b").where(fit).select("a", "b")
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("path").alias("px")), sets.select(F.col("doc_id").alias("b"), F.col("path").alias("py"))
    both = F.size(F.array_intersect("px", "py"))
    measured = near.join(y, "b").join(x, "a").select("a", "b", both.alias("both"), (F.size("px") + F.size("py")).alias("all"))
    return measured.where(F.col("both") * 100 >= (F.col("all") - F.col("both")) * percent).select("a", "b")


class _Tree:
    """A prefix tree of paths of sets of one size. A node knows the longest remainder below it, and the
    component of its members where they have one in common. A child that holds one path only is that
    path's position in docs; it becomes a node when a second path arrives."""

    __slots__ = ("children", "ends", "left", "comp")

    def __init__(self, comp: int):
        self.children: dict[int, _Tree | int] = {}
        self.ends: list[int] = []
        self.left, self.comp = 0, comp

    def add(self, docs: list, k: int, depth: int = 0) -> None:
        _, comp, _, left, path = docs[k]
        node = self
        while True:
            node.left = max(node.left, left - depth)
            if node.comp != comp:
                node.comp = None
            if depth == len(path):
                node.ends.append(k)
                return
            child = node.children.get(path[depth])
            if child is None:
                node.children[path[depth]] = k
                return
            depth += 1
            if isinstance(child, int):
                held, child = child, _Tree(docs[child][1])
                child.add(docs, held, depth)
                node.children[path[depth - 1]] = child
            node = child


def tree_pairs(docs: list[tuple[int, int, int, int, list[int]]], percent: int = PERCENT, blocks: tuple | None = None, upper: list[bool] | None = None) -> set[tuple[int, int]]:
    """Candidate pairs (positions in docs) of different components among paths that begin at one shared
    element. docs: (id, component, size, elements after the shared one in the whole set, path after it).

    With blocks, (block of each document, i, j), only pairs between block i and block j; with upper, no
    pairs of two documents that are marked in it, which are larger than all others.
    """
    block, i, j = blocks or ([0] * len(docs), 0, 0)
    sides: dict[int, dict[int, _Tree]] = {i: {}, j: {}}  # the trees of each block by size
    for k, (_, comp, size, _, _) in enumerate(docs):
        if block[k] in sides:
            sides[block[k]].setdefault(size, _Tree(comp)).add(docs, k)
    found = set()
    for k, (_, comp, size, left, path) in enumerate(docs):
        if block[k] not in sides or (upper and upper[k]):
            continue
        place = {e: at for at, e in enumerate(path)}
        for other_size, tree in sides[j if block[k] == i else i].items():
            need = -(-percent * (size + other_size) // (100 + percent))
            # the smaller set looks for the larger, as the bounds below hold for no other; of equal
            # ones either does, and of two blocks that of block j
            if need > size or other_size < size or (other_size == size and block[k] != j):
                continue
            stack = [(tree, 0, 1, -1)]
            while stack:
                node, depth, overlap, seen = stack.pop()
                if isinstance(node, int):  # one path: its elements from depth on
                    d = docs[node]
                    if d[1] == comp or node == k:
                        continue
                    for e in d[4][depth:]:
                        if (at := place.get(e)) is not None:
                            overlap, seen = overlap + 1, at
                    if overlap + min(left - seen - 1, d[3] - len(d[4])) >= need:
                        found.add((min(node, k), max(node, k)))
                    continue
                rest = left - seen - 1
                if node.comp == comp or overlap + min(rest, node.left) < need:
                    continue
                for other in node.ends:
                    d = docs[other]
                    if d[1] != comp and overlap + min(rest, d[3] - len(d[4])) >= need:
                        found.add((min(other, k), max(other, k)))
                for e, child in node.children.items():
                    at = place.get(e)
                    stack.append((child, depth + 1, overlap, seen) if at is None else (child, depth + 1, overlap + 1, at))
    return found


def _tree_task(percent: int):
    """Searches the forests of partitions sorted by forest and block, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, salts, upper = None, [], [], []

        def search() -> list[tuple[int, int]]:
            if key is None or len(rows) < 2 or all(upper):
                return []
            i, j, n_blocks = key[2:]
            blocks = ([x % n_blocks for x in salts], i, j) if n_blocks > 1 else None
            return [(min(rows[a][0], rows[b][0]), max(rows[a][0], rows[b][0])) for a, b in tree_pairs(rows, percent, blocks, upper)]

        def told(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            pairs = []
            columns = ("doc_id", "comp", "n", "at", "tail", "salt", "upper", *_FOREST)
            for doc, comp, n, at, tail, salt, up, *own in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if own != key:
                    pairs += search()
                    key, rows, salts, upper = own, [], [], []
                rows.append((doc, comp, n, n - at - 1, tail))
                salts.append(salt), upper.append(up)
            yield told(pairs)
        yield told(search())

    return run


#: What names a forest and two blocks of it.
_FOREST = ("e", "g", "i", "j", "blocks")


def tree_join(rows: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """Candidate pairs (a, b) of rows (doc_id, comp, n, path), path being the whole set."""
    scratch = Scratch() if scratch is None else scratch
    spark = rows.sparkSession
    each = rows.select("doc_id", F.explode("path").alias("e"), "comp")
    spread = each.groupBy("e").agg(F.count(F.lit(1)).alias("df"), (F.min("comp") < F.max("comp")).alias("mixed"))
    ordered = each.select("doc_id", "e").join(spread, "e").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("mixed", "df", "e"))).alias("o"))
    bound = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    # partners are of one class or neighbours: a class is a little wider than the ratio of two partners
    size_class = F.floor(F.log("n") / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n")
    paths = scratch.written(rows.select("doc_id", "comp", "n").join(ordered, "doc_id").select("doc_id", "comp", "n", size_class.alias("c"), F.slice("o", F.lit(1), bound).alias("o")), "paths")
    # a task unfolds a path into all its tails, which is more than its bytes tell
    at = paths.repartition(tasks(spark), "doc_id").select("doc_id", "comp", "n", "c", F.posexplode("o").alias("at", "x"), F.transform("o", lambda s: s["e"]).alias("es")).where("x.mixed")
    roles = at.select(
        "doc_id", "comp", "n", "at", F.col("x.e").alias("e"), F.slice("es", F.col("at") + 2, F.size("es")).alias("tail"),
        F.explode(F.array(F.struct(F.col("c").alias("g"), F.lit(False).alias("upper")), F.struct((F.col("c") - 1).alias("g"), F.lit(True).alias("upper")))).alias("role"),
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("int").alias("salt"),
    )
    tails = roles.select("*", "role.g", "role.upper").drop("role")
    # forests of one document, or of one component, have nothing to find
    sizes = tails.groupBy("e", "g").agg(F.count(F.lit(1)).alias("size"), (~F.min("upper")).alias("searched"), (F.min("comp") < F.max("comp")).alias("apart")).where("searched and apart")
    sizes = scratch.written(sizes.select("e", "g", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "forests")
    own = F.col("salt") % F.col("blocks")
    dealt = tails.join(sizes, ["e", "g"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least(own, "other"), "j": F.greatest(own, "other")}).drop("other")
    # trees take time, not bytes, so their tasks are not to be merged by bytes
    forests = dealt.repartition(tasks(spark), *_FOREST).sortWithinPartitions(*_FOREST)
    return forests.mapInArrow(_tree_task(percent), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    component_id is the smallest id reachable by links, the row's own included. Null, empty and blank
    texts have an empty set and link with nothing; with fewer than ``words`` words the whole sequence
    is one shingle. A row without an id links with nothing and has no component. Rows that share an id
    are one node: repeated rows share a component, and so does all that texts of one id link with.
    Texts are read whole; other columns are ignored. An empty table gives an empty result.
    """
    spark, scratch = ship(docs.sparkSession), Scratch()
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    shown, _ = written(texts.mapInArrow(_shown(words, percent), "doc_id long, n int, need int, path array<bigint>"), "shown")
    some = shown.where("n > 0 and doc_id is not null")
    alive = scratch.written(_spread_out(some, "doc_id"), "alive")
    sets = scratch.written(_only(texts.where("doc_id is not null"), alive).mapInArrow(_whole(words), "doc_id long, n int, d1 long, d2 long, least array<bigint>, path array<bigint>").where("n > 0"), "sets")
    # classes of equal sets
    rep = scratch.written(sets.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    members = scratch.written(sets.select("doc_id", "n", "d1", "d2").join(rep, ["n", "d1", "d2"]).select("doc_id", "n", "rep").distinct(), "members")
    own = members.where("doc_id = rep").select("doc_id", "n")
    reps = scratch.written(sets.join(own, ["doc_id", "n"], "left_semi").dropDuplicates(["doc_id", "n", "d1", "d2"]), "reps")
    node = reps.select("doc_id", "n", "path")
    # families around the member whose elements are the most common: the text that the others vary
    keys = reps.join(alive, "doc_id").select("doc_id", "weight", F.posexplode("least").alias("seed", "v"))
    first = F.max(F.struct("weight", (-F.col("doc_id")).alias("id")))
    lead = scratch.written(keys.groupBy("seed", "v").agg(first.alias("top"), F.count(F.lit(1)).alias("c")).where(F.col("c") > FAMILY).select("seed", "v", (-F.col("top.id")).alias("a")), "leads")
    stars = keys.join(lead, ["seed", "v"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    links = scratch.written(linked(stars, node, percent), "links")
    labels = components(links)
    state, path = written(
        shown.join(reps.select("doc_id", "n"), ["doc_id", "n"], "left_semi").join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "need", "path", F.coalesce("label", "doc_id").alias("comp")), "state"
    )
    before = state.count()
    while before:
        kept, new_path = written(state.join(_spread_out(state, "comp"), "doc_id", "left_semi"), "state")
        discard(spark, path)
        state, path = kept, new_path
        now = state.count()
        if now > 0.8 * before:
            break
        before = now
    edges = links.unionByName(members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    if before:
        full = node.join(state.select("doc_id", "n", "comp"), ["doc_id", "n"]).select("doc_id", "n", F.ceil(F.col("n") * percent / 100).cast("int").alias("need"), "path", "comp")
        full = scratch.written(full, "rest")
        last = scratch.written(full.join(_spread_out(full, "comp"), "doc_id", "left_semi"), "last")
        pairs = scratch.written(tree_join(last, percent, scratch), "pairs")
        more = scratch.written(linked(pairs, last, percent), "links")
        edges = edges.unionByName(more)
    final = components(edges)
    scratch.append(path)
    scratch.clear_from(spark)
    return shown.select("doc_id", "n").join(final, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those linked, directly or not, with a document of smaller id; all columns stay,
    whatever their names. Rows without an id or a text stay, and so do repeats of a row that stays."""
    gone = jaccard_components(docs, id_col, text_col).where("component_id < doc_id").select("doc_id").distinct()
    plain = [f"c{i}" for i in range(len(docs.columns))]  # no column can clash with doc_id
    id_ = F.col(plain[docs.columns.index(id_col)]).cast("long")
    return docs.toDF(*plain).join(gone, id_ == F.col("doc_id"), "left_anti").toDF(*docs.columns)
