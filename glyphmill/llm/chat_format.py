"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar of a formatted conversation (a blank separates markers from text):

    conversation := turn*
    turn         := open text close
    open / close := "[INST] " / " [/INST]"           for role user
                    "<s> " / " </s>"                 for role assistant
                    "[ROLE:" hex(role) "] " / " [/ROLE]"   for any other role

A text conflicts when it, or a backslash before it, can be read as one of these markers. The rendered
turn is parsed again; where the parser does not give back the turn, a backslash goes before each
control string of its text and the check repeats, first turn by turn, then over the whole
conversation. Control strings hold no backslash, none overlaps another, and a marker in the rendered
text is always preceded by a blank or starts a turn, so one escape is enough; ``exact`` says that the
parse of the final string equals the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the grammar, as one pattern.
CONTROL = r"\[INST\]|\[/INST\]|<s>|</s>|\[ROLE:[0-9A-F]*\]|\[/ROLE\]"
_OPEN = r"\[INST\] |<s> |\[ROLE:[0-9A-F]*\] "
_CLOSE = r" \[/INST\]| </s>| \[/ROLE\]"
#: One turn: opening marker, shortest text, closing marker.
TURN = rf"(?s)({_OPEN})(.*?)({_CLOSE})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"({CONTROL})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def render(role: Column, body: Column) -> Column:
    """One turn as a string; body is escaped already."""
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s> "), body, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("[ROLE:"), F.hex(role), F.lit("] "), body, F.lit(" [/ROLE]")))
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string."""
    opens = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(
        opens,
        bodies,
        lambda o, b: F.struct(
            F.when(o == "[INST] ", F.lit("user"))
            .when(o == "<s> ", F.lit("assistant"))
            .otherwise(F.decode(F.unhex(F.substring(o, 7, 1 << 30).substr(F.lit(1), F.length(o) - 8)), "UTF-8"))
            .alias("role"),
            unescaped(b).alias("text"),
        ),
    )


def _joined(turns: Column, body) -> Column:
    return F.array_join(F.transform(turns, lambda t: render(t["role"], body(t))), "")


def _source(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (as parsed back), escape_level, exact.

    Rows are ordered by turn; ties by role, then text, and repeated rows stay, each a turn. A null
    turn comes first, null role and text count as empty, rows whose conversation id is null form one
    conversation. escape_level: 0 no text needed an escape, 1 some texts did, 2 all were escaped.
    An empty table gives an empty result; other columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    alone = F.array(F.struct(role.alias("role"), text.alias("text")))
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
            (~parse(render(role, text)).eqNullSafe(alone)).alias("conflict"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("source"))
    first = grouped.withColumn(
        "formatted",
        _joined(F.col("source"), lambda t: F.when(t["conflict"], escaped(t["text"])).otherwise(t["text"])),
    ).withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns").eqNullSafe(_source(F.col("source")))
    second = first.withColumn("_same", same).withColumn(
        "formatted",
        F.when(F.col("_same"), F.col("formatted")).otherwise(
            _joined(F.col("source"), lambda t: escaped(t["text"]))
        ),
    )
    return second.withColumn(
        "turns", F.when(F.col("_same"), F.col("turns")).otherwise(parse(F.col("formatted")))
    ).select(
        "conv_id",
        "formatted",
        "turns",
        F.when(~F.col("_same"), 2).when(F.exists("source", lambda t: t["conflict"]), 1).otherwise(0).alias("escape_level"),
        F.col("turns").eqNullSafe(_source(F.col("source"))).alias("exact"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, from the turns read back: a row for each row, with
    zero counts and the digest of the empty text where a conversation has no assistant. Roles and texts
    are never null here, as formatting made them empty; an empty table gives an empty result."""
    said = F.array_join(
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), ""
    )
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escape_level",
        "exact",
    )
