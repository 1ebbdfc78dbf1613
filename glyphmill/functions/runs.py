"""The runs of many texts at once: kernel.partition() as array operations over their UTF-8."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import unicode_tables as u

#: Classes of characters; runs of the last three are tokens.
GAP, IGNORED, WORD, MARK, SPECIAL = range(5)


@cache
def classes(lower: bool) -> np.ndarray:
    """The class of each code point."""
    out, c = np.full(0x110000, WORD, np.uint8), u.non_ascii_classes()
    ascii_part = {GAP: rb"[ \t\n\r]", IGNORED: rb"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", MARK: rb"[!-/:-@\[-`{-~]"}
    for kind, pattern in ascii_part.items():
        out[[k for k in range(0x80) if re.fullmatch(pattern, bytes([k]))]] = kind
    for kind, ranges in ((GAP, c["S"]), (IGNORED, c["I"]), (MARK, c["P"]), (MARK, c["K"])):
        for a, b in ranges:
            out[a : b + 1] = kind
    if lower:
        out[[k for k in u.FOLDS_TO_PUNCTUATION if k >= 0x80]] = MARK
    return out


def _within(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places lies in one of the ranges, which do not overlap."""
    steps = np.zeros(n + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).view(bool)


class Cutter:
    """Cuts columns of texts into runs, for the arguments of a tokeniser's Config."""

    def __init__(self, lower: bool, specials: tuple[str, ...], stop_at_nul: bool):
        self.classes, self.stop_at_nul = classes(lower), stop_at_nul
        self.specials = [s.encode("utf-8", "surrogatepass") for s in sorted(specials, key=lambda s: (-len(s), s))]
        self.special = re.compile(b"|".join(map(re.escape, self.specials))).finditer

    def cut(self, column: pa.Array) -> Runs:
        """The column's runs that are tokens; null is empty."""
        return Runs(self, column)


class Runs:
    """``per`` text so many runs; the runs' ``strings``; where they start by start()."""

    def __init__(self, cutter: Cutter, column: pa.Array):
        if column.null_count:
            column = pc.fill_null(column, "")
        if column.type != pa.string():
            column = column.cast(pa.string())
        column.validate(full=True)  # what is not UTF-8 is an error
        _, places, data = column.buffers()
        offsets = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        self.bounds = bounds = offsets.astype(np.int64) - offsets[0]
        n = int(bounds[-1])
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
        kinds = cutter.classes[:0x100][data]
        self.more = None
        if n and data.max() >= 0x80:
            self.more = (data & 0xC0) == 0x80
            self._far(cutter.classes, data, kinds)
        ends = self._until_nul(data, kinds) if cutter.stop_at_nul else bounds[1:]
        new = kinds == MARK
        if n:
            new[1:] |= kinds[1:] != kinds[:-1]
            if self.more is not None:
                new &= ~self.more
            new[bounds[:-1][bounds[:-1] < n]] = True
            self._specials(cutter, data, kinds, new, ends)
        at = np.flatnonzero(new)
        if (kinds[at] == IGNORED).any():
            at = self._joined(at, kinds)
        token = kinds[at] >= WORD
        size = np.diff(at, append=n)[token]
        self.at = at[token]
        first = np.searchsorted(self.at, bounds)
        self.per = np.diff(first)
        sizes = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        self.strings = pa.StringArray.from_buffers(len(self.at), pa.py_buffer(sizes), pa.py_buffer(data[kinds >= WORD]))

    @staticmethod
    def _far(of: np.ndarray, data: np.ndarray, kinds: np.ndarray) -> None:
        """The classes of the bytes of characters beyond ASCII."""
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at]
        for n, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
            own = at[(lead >= low) & (lead < high)]
            if len(own):
                code = data[own].astype(np.int32) & (0x7F >> n)
                for k in range(1, n):
                    code = code << 6 | (data[own + k] & 0x3F)
                kind = of[code]
                for k in range(n):
                    kinds[own + k] = kind

    def _until_nul(self, data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where texts end; what follows their first NUL is made a gap."""
        ends = self.bounds[1:]
        if len(data) and not data.all():
            nul = np.append(np.flatnonzero(data == 0), len(data))
            ends = np.minimum(ends, nul[np.searchsorted(nul, self.bounds[:-1])])
            some = ends < self.bounds[1:]
            kinds[_within(ends[some], self.bounds[1:][some], len(data))] = GAP
        return ends

    def _specials(self, cutter: Cutter, data: np.ndarray, kinds: np.ndarray, new: np.ndarray, ends: np.ndarray) -> None:
        """Special tokens, leftmost-longest in each text, are runs whatever they consist of."""
        raw = data.tobytes()
        if not any(s in raw for s in cutter.specials):
            return
        spans = [m.span() for a, b in zip(self.bounds[:-1].tolist(), ends.tolist(), strict=True) if a < b for m in cutter.special(raw, a, b)]
        if spans:
            starts, stops = np.array(spans, np.int64).T
            inside = _within(starts, stops, len(data))
            kinds[inside], new[inside] = SPECIAL, False
            new[starts] = True
            new[stops[stops < len(data)]] = True

    def _joined(self, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Runs without those ignored characters' that stand between words of one text: these are of the word."""
        n = len(kinds)
        head = np.zeros(n + 1, bool)
        head[self.bounds[:-1]] = True
        kind = kinds[at]
        m = 1 + np.flatnonzero((kind[1:-1] == IGNORED) & (kind[:-2] == WORD) & (kind[2:] == WORD) & ~head[at[1:-1]] & ~head[at[2:]])
        if not len(m):
            return at
        kinds[_within(at[m], at[m + 1], n)] = WORD
        kept = np.ones(len(at), bool)
        kept[m] = kept[m + 1] = False
        return at[kept]

    def start(self, codepoint_level: bool) -> np.ndarray:
        """Of each run its place in its text, in code points or bytes."""
        at, bounds = self.at, self.bounds[:-1]
        if codepoint_level and self.more is not None:
            count = np.concatenate(([0], np.cumsum(~self.more)))
            at, bounds = count[at], count[bounds]
        return at - np.repeat(bounds, self.per)
