"""The tokeniser for one string, used where Spark hands batches to Python (Arrow path, streams)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..sources.vocab import SPECIAL_TOKENS, UNK, Vocab
from . import unicode_tables as u
from .pieces import Folded, Trie, folds, sums, utf8_sizes
from .runs import WORD, Cutter, Runs, classes

#: Folded bytes of a word from which it is unknown unless the vocabulary has it whole.
MAX_WORD_BYTES = 100
#: Words a worker remembers.
_CACHE = 300_000
#: Runs that do not fold character by character and that a worker remembers.
TABLE_RUNS = 100_000


@dataclass(frozen=True)
class Config:
    """What a tokeniser is, apart from its vocabulary."""

    lower: bool = True
    codepoint_level: bool = True
    specials: tuple[str, ...] = SPECIAL_TOKENS
    stop_at_nul: bool = True

    def with_specials(self, tokens) -> Config:
        more = [tokens] if isinstance(tokens, str) else list(tokens)
        return Config(self.lower, self.codepoint_level, tuple(dict.fromkeys((*self.specials, *more))), self.stop_at_nul)


def _set(ascii_part: str, ranges, *, but: bool = False) -> str:
    """One character of a set, or none of it. Python asks the ranges beyond the first plane in turn, for
    every character, so they stand behind a test of their own."""
    near = u.python_ranges((a, min(b, 0xFFFF)) for a, b in ranges if a <= 0xFFFF)
    far = u.python_ranges((max(a, 0x10000), b) for a, b in ranges if b > 0xFFFF)
    beyond = "\U00010000-\U0010FFFF"
    if but:
        return f"(?:[^{ascii_part}{near}{beyond}]|(?=[{beyond}])[^{far}])" if far else f"[^{ascii_part}{near}]"
    return f"(?:[{ascii_part}{near}]|(?=[{beyond}])[{far}])" if far else f"[{ascii_part}{near}]"


def _alternatives(lower: bool, specials: tuple[str, ...]) -> tuple[str, str, str, str]:
    """Patterns of special tokens, words, punctuation or CJK, separators: they partition any text."""
    c = u.non_ascii_classes()
    marks = [*c["P"], *([(k, k) for k in u.FOLDS_TO_PUNCTUATION if k >= 0x80] if lower else []), *c["K"]]
    gaps = [*c["S"], *c["I"]]
    ascii_ignored = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F"
    sp = "|".join(re.escape(s) for s in sorted(specials, key=lambda s: (-len(s), s)))
    # only a special token that begins like a word or separator can begin inside one, and only with its first character
    firsts = {s[0] for s in specials if not re.match(r"[!-/:-@\[-`{-~]", s)}
    hold = f"(?!{sp})" if firsts else ""
    usual = "".join(x for x in "0123456789" + "".join(chr(k) for k in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250))) if x not in firsts)
    blank = "".join(x for x in " \t\n\r" if x not in firsts)
    w = _set(r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F", [*marks, *gaps], but=True)
    words = f"(?:[{usual}]++|{hold}{w})++" if usual else f"(?:{hold}{w})++"
    i, rest = (f"(?:{hold}{_set(x, r)})" for x, r in ((ascii_ignored, c["I"]), (rf" \t\n\r{ascii_ignored}", gaps)))
    mark = rf"[!-/:-@\[-`{{-~]|(?=[^\x00-\x7F]){_set('', marks)}"
    return sp or "(?!)", f"{words}(?:{i}++{words})*+", mark, (f"[{blank}]++|" if blank else "") + f"{rest}++"


def partition(lower: bool, specials: tuple[str, ...]) -> re.Pattern:
    """Groups: 1 special, 2 word, 3 punctuation or CJK; separators match without a group."""
    special, word, mark, rest = _alternatives(lower, specials)
    return re.compile(f"({special})|({word})|({mark})|{rest}")


def partition_whole(lower: bool, specials: tuple[str, ...]) -> re.Pattern:
    """partition() without groups: its matches, separators too, are the text."""
    return re.compile("|".join(_alternatives(lower, specials)))


class Tokenizer:
    """Basic tokens, word pieces and encodings of single strings."""

    def __init__(self, vocab: Vocab, config: Config = Config()):
        self.vocab, self.config = vocab, config
        self.match = partition(config.lower, config.specials).finditer
        self.fold = u.fold_table() if config.lower else {}
        self.ignored = re.compile(rf"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F{u.python_ranges(u.non_ascii_classes()['I'])}]")
        self.ids = vocab.ids
        self.whole = set(config.specials) | set(vocab.ids)
        #: Lengths of pieces at the head of a word and behind it, longest first.
        self.heads = sorted({len(t) for t in vocab.tokens}, reverse=True)
        self.tails = sorted({len(t) - 2 for t in vocab.tokens if t.startswith("##") and len(t) > 2}, reverse=True)
        folds = {k: self.fold.get(chr(k), chr(k)) for k in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250))}
        self.simple = {k: x for k, x in folds.items() if len(x) == 1}
        #: Words of which each character folds to one.
        self.is_simple = re.compile(f"[{''.join(map(chr, self.simple))}]++").fullmatch
        self.cache: dict[str, tuple] = {}

    def folded(self, char: str) -> str:
        if self.config.lower:
            return u.fold_hangul(char) if "가" <= char <= "힣" else self.fold.get(char, char)
        return char

    def fold_word(self, run: str) -> str:
        if run.isascii() and run.isalnum():
            return run.lower() if self.config.lower else run
        if self.is_simple(run):
            return run.translate(self.simple)
        return "".join(map(self.folded, self.ignored.sub("", run)))

    def text(self, text: str) -> str:
        return text.partition("\0")[0] if self.config.stop_at_nul else text

    def basic(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, token), in code points or bytes."""
        text = self.text(text)
        out = []
        for m in self.match(text):
            if kind := m.lastindex:
                out.append((m.start(), m.end(), self.run_token(m[0], kind)))
        return out if self.config.codepoint_level else self._in_bytes(text, out)

    def _in_bytes(self, text: str, spans):
        if text.isascii():
            return spans
        at = [0]
        for c in text[: max((b for _, b, _ in spans), default=0)]:
            at.append(at[-1] + len(c.encode("utf-8", "surrogatepass")))
        return [(at[a], at[b], t) for a, b, t in spans]

    def walk(self, word: str) -> list[tuple[int, int, str]] | None:
        """Greedy longest pieces of a folded word with their positions in it, None where they end."""
        at, n, out, ids = 0, len(word), [], self.ids
        lead, sizes = "", self.heads
        while at < n:
            for m in sizes:
                if (end := at + m) <= n and (piece := lead + word[at:end]) in ids:
                    break
            else:
                return None
            out.append((at, end, piece))
            at, lead, sizes = end, "##", self.tails
        return out

    def _origin(self, run: str) -> list[int]:
        """For each character of the folded run the place of its source in the run, then the run's
        length."""
        out: list[int] = []
        for i, c in enumerate(run):
            if not self.ignored.match(c):
                out += [i] * len(self.folded(c))
        return [*out, len(run)]

    def run_token(self, run: str, kind: int) -> str:
        """The token of one run of the text."""
        return run if kind == 1 else self.fold_word(run) if kind == 2 else u.FOLDS_TO_PUNCTUATION.get(ord(run), run) if self.config.lower else run

    def run_pieces(self, run: str, kind: int) -> tuple[tuple[str, int, int], ...]:
        """Pieces of one run of the text, with code-point positions in it."""
        token = self.run_token(run, kind)
        if not token:
            return ()
        if token in self.whole:
            return ((token, 0, len(run)),)
        pieces = self.walk(token) if len(token.encode("utf-8", "surrogatepass")) <= MAX_WORD_BYTES else None
        if pieces is None:
            return ((UNK, 0, len(run)),)
        if kind == 3 or self.is_simple(run):
            return tuple((p, a, b) for a, b, p in pieces)
        pm = self._origin(run)
        return tuple((p, pm[a], pm[a] + 1 if pm[a] == pm[b] else pm[b]) for a, b, p in pieces)

    def wordpiece(self, text: str, most: int | None = None) -> tuple[list[str], list[int]]:
        """Pieces and flat offsets; with most, of the words as far as so many pieces."""
        text = self.text(text)
        out: list[tuple[int, int, str]] = []
        cache = self.cache
        for m in self.match(text):
            if kind := m.lastindex:
                if (found := cache.get(run := m[0])) is None:
                    found = self.run_pieces(run, kind)
                    if len(run) <= 40:
                        if len(cache) >= _CACHE:
                            cache.clear()
                        cache[run] = found
                at = m.start()
                out += [(at + a, at + b, p) for p, a, b in found]
                if most is not None and len(out) >= most:
                    break
        if not self.config.codepoint_level:
            out = self._in_bytes(text, out)
        return [p for _, _, p in out], [x for a, b, _ in out for x in (a, b)]

    def token_ids(self, tokens, add_cls_sep: bool = False) -> list[int]:
        v, unk = self.vocab, self.vocab.unk_id
        ids = [v.ids.get(t, unk) for t in tokens]
        return [v.cls_id, *ids, v.sep_id] if add_cls_sep else ids

    def encode(self, text: str, add_cls_sep: bool = True, truncation: bool = True, max_length: int = 512) -> list[int]:
        check_length(max_length, add_cls_sep)
        # what lies beyond the cut is never seen, so it is not read
        ids = self.token_ids(self.wordpiece(text, max_length + 1 if truncation else None)[0], add_cls_sep)
        if truncation and len(ids) > max_length:
            ids = ids[:max_length]
            if add_cls_sep:
                ids[-1] = self.vocab.sep_id
        return ids

    def encode_with_ids(self, text: str, add_cls_sep: bool = True, padding: bool = True, truncation: bool = True, max_length: int = 512):
        """(input_ids, token_type_ids, attention_mask, offsets)."""
        check_length(max_length, add_cls_sep)
        tokens, offsets = self.wordpiece(text, max_length + 1 if truncation else None)
        ids = self.token_ids(tokens, add_cls_sep)
        if truncation and len(ids) > max_length:
            ids = ids[:max_length]
            offsets = offsets[: 2 * (max_length - 2 * add_cls_sep)]
            if add_cls_sep:
                ids[-1] = self.vocab.sep_id
        mask = [1] * len(ids)
        if padding:
            fill = [0] * max(0, max_length - len(ids))
            ids, mask = (ids + fill)[:max_length], (mask + fill)[:max_length]
        return ids, [0] * len(ids), mask, offsets


def check_length(max_length: int, add_cls_sep: bool) -> None:
    if max_length < (2 if add_cls_sep else 0):
        raise ValueError("max_length must be 2 or more with special tokens, and not negative")


class Flat:
    """What texts consist of, in arrays over all of them: ``per`` text so many items, and of each item
    ``token`` (its number among ``names``) and, with places, ``start``, ``end``, ``pos`` (place of its basic
    token in the text), ``piece_idx`` (place in the basic token) and ``i`` (place in the text)."""

    def __init__(self, table: RunTable, found: Runs, places: bool):
        coded = found.strings.dictionary_encode()
        count, (start, end, token), self.names = table.items(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        many = count[codes]
        items, last = sums(many), np.cumsum(found.per)
        self.per = items[last] - items[last - found.per]
        at = np.repeat(sums(count)[:-1][codes] - items[:-1], many) + np.arange(items[-1])
        self.token = token[at]
        if places:
            run = np.repeat(np.arange(len(codes)), many)
            off = found.start(table.tk.config.codepoint_level)[run]
            self.start, self.end = start[at] + off, end[at] + off
            self.piece_idx = np.arange(len(run)) - items[run]
            self.pos = run - np.repeat(last - found.per, self.per)

    @property
    def i(self) -> np.ndarray:
        last = np.cumsum(self.per)
        return np.arange(len(self.token)) - np.repeat(last - self.per, self.per)

    @property
    def strings(self) -> pa.Array:
        """The items' tokens."""
        return self.names.take(pa.array(self.token))


class RunTable:
    """A tokeniser for many texts at once. Array operations cut texts into runs (runs.Cutter), fold the
    distinct runs and walk them (pieces.Trie); those that do not fold character by character, special tokens
    and long words are looked at one by one, and remembered."""

    def __init__(self, tk: Tokenizer, pieces: bool):
        self.tk, self.pieces = tk, pieces
        self.cut = Cutter(tk.config.lower, tk.config.specials, tk.config.stop_at_nul).cut
        self.find = partition_whole(tk.config.lower, tk.config.specials).findall
        self.kind = partition(tk.config.lower, tk.config.specials).match
        self.folds = folds(tk.config.lower)
        self.specials = pa.array(tk.config.specials, pa.string())
        #: whether what a word folds to may be a special token
        self.alike = any((classes(tk.config.lower)[list(map(ord, s))] >= WORD).all() for s in tk.config.specials)
        self.odd: dict[str, tuple] = {}
        if pieces:
            more = [t for t in dict.fromkeys((UNK, *tk.config.specials)) if t not in tk.ids]
            self.numbers = {t: len(tk.vocab) + k for k, t in enumerate(more)}
            self.names = pa.array([*tk.vocab.tokens, *more], pa.string())
            self.own_ids = np.array([*range(len(tk.vocab)), *([tk.vocab.unk_id] * len(more))], np.int32)
            self.trie = Trie(tk.vocab.tokens, MAX_WORD_BYTES + 2)

    def folded(self, runs: pa.Array) -> Folded:
        """Distinct runs folded; special tokens, and what may fold to one, are odd."""
        found = Folded(runs, self.folds)
        if len(self.specials):
            for x in (runs, found.strings()) if self.alike else (runs,):
                found.odd |= pc.is_in(x, self.specials).to_numpy(zero_copy_only=False)
        return found

    def _each(self, runs: pa.Array, at: np.ndarray, of: Callable) -> list:
        """of(run, kind) of the runs at some places."""
        if len(self.odd) > TABLE_RUNS:
            self.odd.clear()
        out, odd = [], self.odd
        for run in runs.take(pa.array(at)).to_pylist():
            if (found := odd.get(run)) is None:
                found = of(run, self.kind(run).lastindex)
                if len(run) <= MAX_WORD_BYTES:
                    odd[run] = found
            out.append(found)
        return out

    def tokens(self, runs: pa.Array, found: Folded | None = None) -> pa.Array:
        """The tokens of distinct runs."""
        found = found or self.folded(runs)
        odd = np.flatnonzero(found.odd)
        strings = found.strings()
        if not len(odd):
            return strings
        place = np.arange(len(runs))
        place[odd] = len(runs) + np.arange(len(odd))
        return pa.concat_arrays([strings, pa.array(self._each(runs, odd, self.tk.run_token), pa.string())]).take(pa.array(place))

    def items(self, runs: pa.Array):
        """Of distinct runs: how many items each has; starts in the run, ends and tokens of them all; the
        names that tokens are the numbers of."""
        found = self.folded(runs)
        n = len(runs)
        if self.pieces:
            count, run, start, end, token = self._pieces(runs, found)
            names = self.names
        else:
            count, run, start, end, token, names = np.ones(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.diff(found.at), np.arange(n), self.tokens(runs, found)
        if not self.tk.config.codepoint_level:
            size, at = sums(utf8_sizes(found.chars)), found.at[:-1][run]
            start, end = size[at + start] - size[at], size[at + end] - size[at]
        return count, (start, end, token), names

    def _pieces(self, runs: pa.Array, found: Folded):
        size = found.bytes()[found.at]
        odd = found.odd | (np.diff(size) > MAX_WORD_BYTES)
        plain = np.flatnonzero(~odd)
        begin = found.at[plain]
        word, start, end, token, lost = self.trie.walk(found.codes, begin, found.at[plain + 1])
        unknown, one_by_one = plain[lost], np.flatnonzero(odd)
        number = lambda t: self.tk.ids[t] if t in self.tk.ids else self.numbers[t]
        of = lambda run, kind: tuple((a, b, number(t)) for t, a, b in self.tk.run_pieces(run, kind))
        each = self._each(runs, one_by_one, of)
        more = np.array([x for items in each for x in items], np.int64).reshape(-1, 3).T
        groups = (
            (plain[word], start - begin[word], end - begin[word], token),
            (unknown, np.zeros(len(unknown), np.int64), np.diff(found.at)[unknown], np.full(len(unknown), number(UNK))),
            (np.repeat(one_by_one, [len(x) for x in each]).astype(np.int64), *more),
        )
        run, start, end, token = (np.concatenate(x) for x in zip(*groups, strict=True))
        order = np.argsort(run, kind="stable")
        return np.bincount(run, minlength=len(runs)), run[order], start[order], end[order], token[order]

    def flat(self, texts: list[str | None] | pa.Array, places: bool = True) -> Flat:
        return Flat(self, self.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())), places)

    def ids(self, flat: Flat) -> np.ndarray:
        """The items' ids."""
        return self.own_ids[flat.token]
