"""Character classes and case/accent folding pinned to Unicode 14.

The tables come from the running interpreter's Unicode database by rule, with code points that
Unicode 15.0 and 15.1 added counted as unassigned, so that plans do not depend on what a JVM's or a
database engine's own tables say.
"""

from __future__ import annotations

import unicodedata
from functools import cache

# Ranges that Unicode 15.0 and 15.1 assigned.
ADDED_AFTER_14 = (
    (0x0CF3, 0x0CF3), (0x0ECE, 0x0ECE), (0x2FFC, 0x2FFF), (0x31EF, 0x31EF), (0x10EFD, 0x10EFF), (0x1123F, 0x11241), (0x11B00, 0x11B09),
    (0x11F00, 0x11F59), (0x1342F, 0x1342F), (0x13439, 0x13455), (0x1B132, 0x1B132), (0x1B155, 0x1B155), (0x1D2C0, 0x1D2D3), (0x1DF25, 0x1DF2A),
    (0x1E030, 0x1E08F), (0x1E4D0, 0x1E4F9), (0x1F6DC, 0x1F6DC), (0x1F774, 0x1F776), (0x1F77B, 0x1F77F), (0x1F7D9, 0x1F7D9), (0x1FA75, 0x1FA77),
    (0x1FA87, 0x1FA88), (0x1FAAD, 0x1FAAF), (0x1FABB, 0x1FABD), (0x1FABF, 0x1FABF), (0x1FACE, 0x1FACF), (0x1FADA, 0x1FADB), (0x1FAE8, 0x1FAE8),
    (0x1FAF7, 0x1FAF8), (0x2B739, 0x2B739), (0x2EBF0, 0x2EE5D), (0x31350, 0x323AF),
)
# The ranges whose characters are words of their own.
CJK = (
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF),
    (0x2F800, 0x2FA1F),
)
# Characters that fold to one ASCII punctuation mark, which is then a token.
FOLDS_TO_PUNCTUATION = {0x1FEF: "`", 0x2260: "=", 0x226E: "<", 0x226F: ">"}
_HANGUL = range(0xAC00, 0xD7A4)


#: Beyond this, everything is unassigned or private, but for the marks of VARIATION.
_LAST = 0x31350
VARIATION = (0xE0100, 0xE01EF)


@cache
def _added() -> frozenset[int]:
    return frozenset(cp for a, b in ADDED_AFTER_14 for cp in range(a, b + 1))


def is_cjk(cp: int) -> bool:
    return cp >= 0x3400 and any(a <= cp <= b for a, b in CJK)


def category(cp: int) -> str:
    return "Cn" if cp in _added() else unicodedata.category(chr(cp))


@cache
def non_ascii_classes() -> dict[str, list[tuple[int, int]]]:
    """Ranges of non-ASCII characters by class: P punctuation, S spaces, I ignorable, K CJK. What is in
    none is a word character. CJK is tested first, so unassigned code points there are CJK."""
    out: dict[str, list[list[int]]] = {"P": [], "S": [], "I": [], "K": [list(r) for r in CJK]}
    for cp in range(0x80, _LAST):
        c = category(cp)
        kind = "P" if c[0] == "P" else "S" if c == "Zs" else "I" if c[0] == "C" or cp == 0xFFFD else None
        if kind and not is_cjk(cp):
            runs = out[kind]
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    out["I"] += [[_LAST, VARIATION[0] - 1], [VARIATION[1] + 1, 0x10FFFF]]
    return {k: [(a, b) for a, b in v] for k, v in out.items()}


def fold_char(c: str) -> str:
    """Simple lower case, canonical decomposition of the one character, nonspacing marks removed."""
    low = c.lower() if category(ord(c)) != "Cn" else c
    low = low[0] if len(low) > 1 else low
    return "".join(x for x in unicodedata.normalize("NFD", low) if category(ord(x)) != "Mn")


@cache
def fold_table() -> dict[str, str]:
    """What each word character that folding changes becomes; Hangul syllables are left to arithmetic."""
    out = {chr(cp): "" for cp in range(VARIATION[0], VARIATION[1] + 1)}
    for cp in range(_LAST):
        if cp in _HANGUL or 0xD800 <= cp < 0xE000 or is_cjk(cp) or (c := category(cp))[0] == "C" or (c[0] == "P" and cp > 0x7F):
            continue
        char = chr(cp)
        if (f := fold_char(char)) != char:
            out[char] = f
    return out


def fold_hangul(c: str) -> str:
    """The two or three jamo of a syllable."""
    k = ord(c) - 0xAC00
    out = chr(0x1100 + k // 588) + chr(0x1161 + k % 588 // 28)
    return out + chr(0x11A7 + k % 28) if k % 28 else out


def regex_ranges(ranges) -> str:
    """Ranges inside a bracket of a Java regex."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def python_ranges(ranges) -> str:
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
