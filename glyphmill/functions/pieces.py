"""Folding and word pieces of many distinct runs at once, as array operations over their code points."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import unicode_tables as u
from .runs import IGNORED, MARK, WORD, classes

#: Bits of a code point in the key of an edge.
_BITS = 21


@cache
def folds(lower: bool) -> np.ndarray:
    """The code point that each folds to; -1 where that is not one, or the character is of no token."""
    kinds = classes(lower)
    out = np.arange(0x110000, dtype=np.int32)
    if lower:
        for c, to in u.fold_table().items():
            out[ord(c)] = ord(to) if len(to) == 1 else -1
        out[0xAC00:0xD7A4] = -1
        out[kinds == MARK] = np.flatnonzero(kinds == MARK)
        for k, to in u.FOLDS_TO_PUNCTUATION.items():
            out[k] = ord(to)
    out[kinds <= IGNORED] = -1
    return out


def utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)


def sums(x: np.ndarray) -> np.ndarray:
    """Of all that is before each, and of all."""
    return np.concatenate(([0], np.cumsum(x, dtype=np.int64)))


class Folded:
    """Runs and what they fold to: ``codes`` end to end, ``at`` where each begins and the last ends; those
    are ``odd`` that not every character of folds to one, and their codes mean nothing."""

    def __init__(self, runs: pa.Array, to: np.ndarray):
        flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs), "")[0].as_py()
        self.chars = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        self.at = sums(pc.utf8_length(runs).to_numpy())
        self.codes = to[self.chars]
        lost = sums(self.codes < 0)
        self.odd = lost[self.at[1:]] > lost[self.at[:-1]]

    def bytes(self) -> np.ndarray:
        """UTF-8 bytes before each character of what runs fold to."""
        return sums(utf8_sizes(self.codes))

    def strings(self) -> pa.Array:
        """What runs fold to; odd ones anything."""
        codes = np.maximum(self.codes, 0)
        data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(self.odd), pa.py_buffer(sums(utf8_sizes(codes))[self.at].astype(np.int32)), pa.py_buffer(data))


class Trie:
    """Tokens as edges from two roots, 0 for the heads of words and 1 for what follows "##"; an edge is its
    node's number << 21 | code point, and the edge at k of all, sorted, leads to node k + 2."""

    def __init__(self, tokens: tuple[str, ...], longest: int):
        heads = [(t, i, 0) for i, t in enumerate(tokens) if len(t) <= longest]
        found = [*heads, *((t[2:], i, 1) for t, i, _ in heads if t.startswith("##") and len(t) > 2)]
        chars = np.frombuffer("".join(t for t, _, _ in found).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter((len(t) for t, _, _ in found), np.int64, len(found))
        number = np.fromiter((i for _, i, _ in found), np.int32, len(found))
        node = np.fromiter((r for _, _, r in found), np.int64, len(found))
        del found
        at, keys, made, ends = sums(size)[:-1], [], 2, []
        for level in range(int(size.max(initial=0))):
            own = size > level
            at, size, number, node = at[own], size[own], number[own], node[own]
            edges, inverse = np.unique(node << _BITS | chars[at + level], return_inverse=True)
            node = made + inverse
            made += len(edges)
            keys.append(edges)
            last = size == level + 1
            ends.append((node[last], number[last]))
        self.keys = np.concatenate((*keys, [np.iinfo(np.int64).max]))
        self.token = np.full(made, -1, np.int32)
        for nodes, numbers in ends:
            self.token[nodes] = numbers

    def walk(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Greedy longest pieces of words, each from begin to end in codes: word, start, end, token of each
        piece by word, and whether a word comes to where no token leads on."""
        word = np.arange(len(begin))
        lost = np.zeros(len(begin), bool)
        start, at, stop = begin.copy(), begin.copy(), end
        node, best, token = np.zeros(len(begin), np.int64), np.full(len(begin), -1), np.zeros(len(begin), np.int32)
        out, codes = [], np.append(codes, 0).astype(np.int64)
        while len(word):
            edge = node << _BITS | codes[at]
            k = np.searchsorted(self.keys, edge)
            hit = (self.keys[k] == edge) & (at < stop)
            node = np.where(hit, k + 2, node)
            at = at + hit
            found = np.where(hit, self.token[node], -1)
            best, token = np.where(found >= 0, at, best), np.where(found >= 0, found, token)
            if hit.all():
                continue
            lost[word[~hit & (best < 0)]] = True
            done = ~hit & (best >= 0)
            out.append((word[done], start[done], best[done], token[done]))
            start, at, node = np.where(done, best, start), np.where(done, best, at), np.where(done, 1, node)
            on = (hit | done) & ~(done & (best == stop))
            best = np.where(done, -1, best)
            word, start, at, stop, node, best, token = (x[on] for x in (word, start, at, stop, node, best, token))
        if not out:
            return (*(np.zeros(0, np.int64) for _ in range(4)), lost)
        word, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(word, kind="stable")
        order = order[~lost[word[order]]]
        return (word[order], *(x[order] for x in rest), lost)
