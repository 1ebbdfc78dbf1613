"""Column expressions of the basic tokeniser: segmentation, folding, offsets."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode_tables as u

_ASCII_PUNCT = r"!-/:-@\[-`{-~"
_ASCII_IGNORED = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F"
_PLAIN_PUNCT = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Code points from which ranges are asked for apart; Latin letters are before.
_FAR = 0x250
#: Elements of a block of running_starts().
_BLOCK = 16


def _beyond_ascii(ranges) -> str:
    """Non-ASCII ranges for a bracket, wide ones first and behind one test that fails for ASCII, so that
    common characters are decided by a few comparisons."""
    return rf"[\x{{80}}-\x{{10FFFF}}&&[{u.regex_ranges(sorted(ranges, key=lambda r: r[0] - r[1]))}]]"


@cache
def classes(lower: bool) -> dict[str, str]:
    """The insides of Java bracket expressions: K CJK, P punctuation, S space, I ignorable, W word."""
    c = u.non_ascii_classes()
    folded = [(k, k) for k in u.FOLDS_TO_PUNCTUATION] if lower else []
    taken = sorted([*c["K"], *c["P"], *c["S"], *c["I"], *folded])
    gaps, at = [], 0x80
    for first, last in taken:
        if first > at:
            gaps.append((at, first - 1))
        at = max(at, last + 1)
    return {
        "K": _beyond_ascii(c["K"]),
        "P": _ASCII_PUNCT + _beyond_ascii([*c["P"], *folded]),
        "S": r" \t\n\r" + _beyond_ascii(c["S"]),
        "I": _ASCII_IGNORED + _beyond_ascii(c["I"]),
        "W": r"0-9A-Za-z\x{C0}-\x{24F}" + _beyond_ascii(gaps),
    }


def quoted(text: str) -> str:
    """A literal inside a Java regex."""
    return re.sub(r"([^0-9A-Za-z])", lambda m: f"\\x{{{ord(m[1]):X}}}", text)


def specials_pattern(specials: tuple[str, ...]) -> str:
    return "|".join(quoted(s) for s in sorted(specials, key=lambda s: (-len(s), s)))


def partition_pattern(lower: bool, specials: tuple[str, ...]) -> str:
    """One pattern whose matches partition any text: special tokens, CJK characters, punctuation, words
    (with ignorables inside), runs of separators. Repeats are possessive, so long runs need no stack."""
    c = classes(lower)
    sp = specials_pattern(specials)
    # only a special token that begins like a word or separator can begin inside one
    inside = any(s[0] not in _PLAIN_PUNCT for s in specials)
    w, i, rest = ((f"(?:(?!{sp})[{x}])" if inside else f"[{x}]") for x in (c["W"], c["I"], c["S"] + c["I"]))
    return (f"(?:{sp})|" if sp else "") + f"{w}++(?:{i}++{w}++)*+|[{c['P']}]|[{c['K']}]|{rest}++"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _scan(xs: Column, start: Column) -> Column:
    first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(xs, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def running_starts(lengths: Column) -> Column:
    """Sum of the lengths before each element; lengths is a column or a lambda's variable. Sums run
    within blocks and over blocks, so the cost is linear in the array but for a small factor."""
    n_blocks = F.ceil(F.size(lengths) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), n_blocks), lambda b: F.slice(lengths, (b - 1) * _BLOCK + 1, F.lit(_BLOCK)))

    def several(parts: Column) -> Column:
        sums = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        return F.flatten(F.zip_with(parts, _scan(sums, F.lit(0)), _scan))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).when(F.size(lengths) <= _BLOCK, _scan(lengths, F.lit(0))).otherwise(let(blocks, several))


def _tables(lower: bool) -> tuple[str, str, dict[str, str]]:
    """Source and target of translate() and the one-to-many folds."""
    ignored = [chr(i) for i in range(0x80) if (i < 0x20 and chr(i) not in "\t\n\r") or i == 0x7F]
    table = u.fold_table() if lower else {}
    one = {a: b for a, b in table.items() if len(b) == 1}
    gone = [a for a, b in table.items() if not b] + ignored
    return "".join(one) + "".join(gone), "".join(one.values()), {a: b for a, b in table.items() if len(b) > 1}


def has_wide_folds(text: Column) -> Column:
    """Whether a text holds a character that folds to several."""
    many = _tables(True)[2]
    return text.rlike(f"[{u.regex_ranges((ord(c), ord(c)) for c in sorted(many))}\\x{{AC00}}-\\x{{D7A3}}]")


def fold(word: Column, lower: bool, wide: bool = True) -> Column:
    """A word run as token text: ignorables removed and, in lower mode, each character lower-cased,
    decomposed and stripped of nonspacing marks. Without ``wide``, for texts that has_wide_folds() says
    no of, a character is replaced at most."""
    source, target, many = _tables(lower)
    plain = word.rlike(r"^[0-9A-Za-z]*$")
    bare = F.regexp_replace(word, f"[^{classes(lower)['W']}]", "")
    if not (lower and wide):
        return F.when(plain, F.lower(word) if lower else word).otherwise(F.translate(bare, source, target))
    pairs = F.create_map(*(F.lit(x) for pair in sorted(many.items()) for x in pair))

    def one(c: Column) -> Column:
        k = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
        lead = lambda base, v: F.decode(F.unhex(F.lpad(F.hex(v + base), 4, "0")), "UTF-16BE")
        jamo = F.concat(lead(0x1100, F.floor(k / 588)), lead(0x1161, F.floor(k % 588 / 28)), F.when(k % 28 > 0, lead(0x11A7, k % 28)).otherwise(F.lit("")))
        return F.when(c.rlike(r"[\x{AC00}-\x{D7A3}]"), jamo).otherwise(F.coalesce(F.element_at(pairs, c), F.translate(c, source, target)))

    return F.when(plain, F.lower(word)).otherwise(F.array_join(F.transform(F.split(bare, ""), one), ""))


@cache
def _odd_pattern(lower: bool) -> str:
    """Matches the characters that no plain text has: those that tokens drop or, in lower mode, fold to any
    other number of characters. Java asks all ranges of a bracket in turn, so that common letters are to
    fail after a few: ranges beyond them stand behind one test of their own."""
    odd = {cp for first, last in ((0x0, 0x8), (0xB, 0xC), (0xE, 0x1F), (0x7F, 0x7F)) for cp in range(first, last + 1)}
    ranges = [(cp, cp) for cp in odd] + u.non_ascii_classes()["I"]
    if lower:
        ranges += [(0xAC00, 0xD7A3), *((ord(a), ord(a)) for a, b in u.fold_table().items() if len(b) != 1 and ord(a) >= 0x80)]
    merged: list[list[int]] = []
    for first, last in sorted(ranges):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    near, far = [r for r in merged if r[0] < _FAR], [r for r in merged if r[0] >= _FAR]
    return rf"[{u.regex_ranges(near)}]|[\x{{{_FAR:X}}}-\x{{10FFFF}}&&[{u.regex_ranges(far)}]]"


def is_plain(text: Column, lower: bool, specials: tuple[str, ...]) -> Column:
    """Whether a text holds no special token and plain characters only: its tokens are then those of the
    folded text, at the same places."""
    plain = ~text.rlike(_odd_pattern(lower))
    for s in specials:
        plain = plain & ~text.contains(s)
    return plain


def _plain_text(text: Column, lower: bool) -> Column:
    if not lower:
        return text
    source, target, _ = _tables(True)
    one = source[: len(target)]
    return F.when(text.rlike("^[ -~\\s]*+$"), F.lower(text)).otherwise(F.translate(text, one + "".join(map(chr, u.FOLDS_TO_PUNCTUATION)), target + "".join(u.FOLDS_TO_PUNCTUATION.values())))


def _plain_pattern(lower: bool) -> str:
    c = classes(lower)
    return f"[{c['W']}]++|[{c['P']}]|[{c['K']}]"


def token_strings(text: Column, lower: bool = True, specials: tuple[str, ...] = ()) -> Column:
    """array<string>: the tokens of basic_tokens() without their places; one regex for plain texts."""
    slow = F.transform(_general_tokens(text, lower, specials, "codepoint"), lambda x: x["token"])
    return F.when(is_plain(text, lower, specials), F.regexp_extract_all(_plain_text(text, lower), F.lit(_plain_pattern(lower)), F.lit(0))).when(text.isNotNull(), slow)


def basic_tokens(text: Column, lower: bool = True, specials: tuple[str, ...] = (), offset_unit: str = "codepoint") -> Column:
    """array<struct<start, end, token>> of a text: no shuffle, no window, no Python.

    Plain texts, nearly all, are folded as a whole; tokens and the stretches between them then come from
    two regexes, and only lengths are added up. Others are partitioned and folded run by run.
    """
    pattern = F.lit(_plain_pattern(lower))
    size = F.octet_length if offset_unit == "byte" else F.length
    folded = _plain_text(text, lower)
    measured = text if offset_unit == "byte" else folded  # a fold keeps characters, not bytes

    def starts_of(runs: Column, gaps: Column) -> Column:
        before = let(F.zip_with(gaps, runs, lambda g, r: size(g) + size(r)), running_starts)
        return F.zip_with(before, gaps, lambda s, g: s + size(g))

    def placed(tokens: Column) -> Column:
        gaps_of = lambda runs: F.slice(F.split(measured, _plain_pattern(lower), -1), 1, F.size(runs))
        if offset_unit != "byte":
            starts = let(gaps_of(tokens), lambda gaps: starts_of(tokens, gaps))
            return F.zip_with(starts, tokens, lambda s, t: F.struct(s.alias("start"), (s + size(t)).alias("end"), t.alias("token")))

        def told(runs: Column) -> Column:
            starts = let(gaps_of(runs), lambda gaps: starts_of(runs, gaps))
            return let(starts, lambda s: F.arrays_zip(s, F.zip_with(s, runs, lambda a, r: a + size(r)), tokens).cast("array<struct<start:int,end:int,token:string>>"))

        return let(F.regexp_extract_all(measured, pattern, F.lit(0)), told)

    plain = let(F.regexp_extract_all(folded, pattern, F.lit(0)), placed)
    return F.when(is_plain(text, lower, specials), plain).when(text.isNotNull(), _general_tokens(text, lower, specials, offset_unit))


def _general_tokens(text: Column, lower: bool, specials: tuple[str, ...], offset_unit: str) -> Column:
    c = classes(lower)
    runs = F.regexp_extract_all(text, F.lit(partition_pattern(lower, specials)), F.lit(0))
    size = F.octet_length if offset_unit == "byte" else F.length
    word = rf"^[{c['W']}]"
    separator = rf"^[{c['S']}{c['I']}]"

    def is_special(token: Column) -> Column:
        return token.isin(*specials) if specials else F.lit(False)

    def placed(rs: Column) -> Column:
        starts = let(F.transform(rs, lambda r: size(r)), running_starts)
        return F.zip_with(rs, starts, lambda r, s: F.struct(s.alias("start"), (s + size(r)).alias("end"), r.alias("token")))

    kept = F.filter(let(runs, placed), lambda x: x["token"].rlike("^[!-~]") | is_special(x["token"]) | ~x["token"].rlike(separator))

    def told(wide: bool) -> Column:
        return F.transform(
            kept,
            lambda x: F.struct(
                x["start"].alias("start"),
                x["end"].alias("end"),
                F.when(is_special(x["token"]), x["token"])
                .when(x["token"].rlike(word), fold(x["token"], lower, wide))
                .otherwise(_folded_punct(x["token"]) if lower else x["token"])
                .alias("token"),
            ),
        )

    return F.when(has_wide_folds(text), told(True)).otherwise(told(False)) if lower else told(False)


def _folded_punct(token: Column) -> Column:
    return F.translate(token, "".join(map(chr, u.FOLDS_TO_PUNCTUATION)), "".join(u.FOLDS_TO_PUNCTUATION.values()))
