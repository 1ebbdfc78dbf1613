"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are the leaves of a radix tree over their characters. A round reads one digit (the next
``width`` characters) of every document still in a group of two or more and splits the group by it;
equal digits are found by an aggregation over the characters themselves, so no digest decides
equality. A document leaves when its group is a singleton; a group is done when its digit ends early
(all of its members have ended). Digits are bounded: they grow from 64 characters to 65,536 and stay so.

What moves is one digit of a row at a time, with the row's name. Texts stay for the first digit; of the
documents that share it with another, the rest is written once as a column a digit, and each round reads
its column. Rows are named by id and a hash of the text, which only keeps rows apart that share an id.

Skew: groups are counted with map-side combination, one row per group and task, so a group holding a
third of the corpus shuffles a few rows. Groups are written before the rows are split by them: both sides
of that equi-join are then plain shuffles, of which adaptive execution divides a hot partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, named, plain_text, written

#: Characters in the successive digits; the last width repeats.
WIDTHS = (64, 256, 1024, 4096, 16_384, 65_536)
#: Rows up to which the list of those still in a group is broadcast (16 bytes a row).
BROADCAST_ROWS = 500_000
_NO_ID = 2**63 - 1


def normalised(text) -> Column:
    """Each run of white space becomes one blank; null counts as empty."""
    return F.regexp_replace(plain_text(text), SPACES, " ")


def _first_digit(text: str) -> Column:
    """The first digit, from a bounded prefix where that holds enough characters (a prefix of the
    text normalises to a prefix of the normalised text), from the whole text otherwise."""
    width = WIDTHS[0]
    head = normalised(F.substring(plain_text(text), 1, 8 * width))
    return F.when(F.length(head) >= width, F.substring(head, 1, width)).otherwise(
        F.substring(normalised(text), 1, width)
    )


def _named_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, tag, text)."""
    text = named(text_col)
    return docs.select(F.coalesce(named(id_col).cast("long"), F.lit(_NO_ID)).alias("uid"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _small(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast where it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _split(rows: DataFrame, keys: list[str], width: int, scratch: Scratch) -> DataFrame:
    """The rows (uid, tag, digit, keys) of groups of two or more, each once: uid, tag, the group's new
    name gid and gtag, its size n, and whether it is open, as its members may go on.

    A node of the tree is named by its smallest id and its smallest tag, as an id can repeat with
    another text.
    """
    groups = scratch.written(
        rows.groupBy(*keys).agg(F.min("uid").alias("new_gid"), F.min("tag").alias("new_gtag"), F.count(F.lit(1)).alias("n")).where("n > 1"), "radix-groups"
    )
    found = rows.select("uid", "tag", *keys).join(groups, keys)
    whole = F.length("digit") == width
    return written(found.select("uid", "tag", F.col("new_gid").alias("gid"), F.col("new_gtag").alias("gtag"), "n", whole.alias("open")).distinct(), "radix")[0]


def _digits(rest: Column) -> dict[str, Column]:
    """Columns d1, d2, ... of the digits after the first, null behind the one that ends early, and more:
    those of the last width beyond, as an array."""
    out, at = {}, 0
    for k, width in enumerate(WIDTHS[1:-1], 1):
        out[f"d{k}"] = F.when(F.length(rest) >= at, F.substring(rest, at + 1, width))
        at += width
    last = WIDTHS[-1]
    piece = lambda i: F.substring(rest, i * last + (at + 1), F.lit(last))
    out["more"] = F.when(F.length(rest) >= at, F.transform(F.sequence(F.lit(0), F.floor((F.length(rest) - at) / last).cast("int")), piece))
    return out


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, tag, keep, group_size) of every document that has an equal one, each once: keep is the
    smallest id of its group; a missing id is the largest there is."""
    base, scratch = _named_rows(docs, id_col, text_col), Scratch()
    step = _split(base.select("uid", "tag", _first_digit("text").alias("digit")), ["digit"], WIDTHS[0], scratch)
    done = [step.where("not open")]
    live = _small(step.where("open").select("uid", "tag", "gid", "gtag"))
    if not live.isEmpty():
        rest = base.join(live.select("uid", "tag"), ["uid", "tag"], "left_semi").withColumn("rest", F.substring(normalised("text"), WIDTHS[0] + 1, _NO_ID >> 32))
        digits = _digits(F.col("rest"))
        table = scratch.written(rest.select("uid", "tag", *(c.alias(k) for k, c in digits.items())), "radix-digits")
        k = 0
        while not live.isEmpty():
            k += 1
            width = WIDTHS[min(k, len(WIDTHS) - 1)]
            digit = F.col(f"d{k}") if f"d{k}" in digits else F.get("more", F.lit(k + 1 - len(WIDTHS)))
            rows = table.select("uid", "tag", digit.alias("digit")).join(live, ["uid", "tag"])
            step = _split(rows, ["gid", "gtag", "digit"], width, scratch)
            done.append(step.where("not open"))
            live = _small(step.where("open").select("uid", "tag", "gid", "gtag"))
    scratch.clear_from(docs.sparkSession)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select("uid", "tag", F.col("gid").alias("keep"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space normalisation. Of equal texts the smallest id
    stays. Null text is the empty text, so all null and empty texts are one group. A null id ranks
    after all others: it stays only in a group without ids, and keep_id is then null. Rows that
    repeat an id and text count in group_size and share one verdict; an id that repeats with another
    text is judged text by text. Texts of any length are compared to their end. Other columns of the
    input are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = _named_rows(docs, id_col, text_col).select("uid", "tag", F.sha2(normalised("text"), 256).alias("text_sha256"))
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    grouped = F.col("group_size").isNotNull()
    return rows.join(radix_groups(docs, id_col, text_col), ["uid", "tag"], "left").select(
        real("uid").alias("doc_id"),
        F.when(grouped, real("keep")).otherwise(real("uid")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.col("keep") == F.col("uid")).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that exact_dedup() drops, on the same rules for nulls, repeats and ties;
    all columns stay, whatever their names."""
    gone = radix_groups(docs, id_col, text_col).where("keep <> uid").select("uid", "tag")
    plain = [f"c{i}" for i in range(len(docs.columns))]  # no column can clash with uid and tag
    own = dict(zip(docs.columns, plain, strict=True))
    rows = docs.toDF(*plain)
    uid, tag = F.coalesce(F.col(own[id_col]).cast("long"), F.lit(_NO_ID)), F.xxhash64(F.col(own[text_col]))
    return rows.join(gone, (uid == F.col("uid")) & (tag == F.col("tag")), "left_anti").toDF(*docs.columns)
