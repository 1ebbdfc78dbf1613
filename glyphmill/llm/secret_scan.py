"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

Candidates are the runs of 16 or more characters of the alphabet that keys and tokens are written in;
one that lies within what the fixed patterns have found already is not asked about again, one that
only touches it is judged whole. The network reads a candidate with the text around it: one-hot
characters, a convolution, the maximum and mean over positions, a logistic output. It is trained on
labelled findings that a seeded rule writes (keys of many shapes against words, names, paths, numbers,
filler and the like; words are drawn from no language). A second part of them calibrates its output by
Platt scaling, and from a third each group of candidates (after a telling word, or bare) has the highest
threshold that still finds RECALL of its secrets. A candidate longer than the network's field is read in
overlapping fields, and its best one counts.

What the patterns find stays, whatever the network says of it.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import slices

#: The base patterns, their kinds in order, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: Words shortly before a candidate that put it in the group of told ones.
TELLING = re.compile(r"(?:key|auth|bearer|credential|private|secret|token|pwd|pass|access|signature)\w*\W{0,4}$", re.I)
#: Share of the labelled secrets that each group's threshold must find.
RECALL = 0.97
#: Labelled findings in all: three parts of five train, one calibrates, one sets the thresholds.
FINDINGS = 4000
LEFT, INSIDE, RIGHT = 20, 40, 4
FIELD = LEFT + INSIDE + RIGHT
_SYMBOLS = " \"'=:+/_-.,\n"
_CHANNELS = 26 + 3 + len(_SYMBOLS) + 1  # letters, upper, digit, inside, symbols, other
WIDTH, FILTERS = 4, 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _pseudo_word(rng: random.Random, least: int) -> str:
    """A word of no language: syllables of up to two consonants, one or two vowels, and maybe a last one."""
    consonants, vowels, out = "bcdfghjklmnpqrstvwxyz", "aeiou", ""
    while len(out) < least:
        out += "".join(rng.choices(consonants, k=rng.randint(0, 2))) + "".join(rng.choices(vowels, k=rng.choice((1, 1, 2)))) + (rng.choice(consonants) if rng.random() < 0.3 else "")
    return out.capitalize() if rng.random() < 0.2 else out


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) by rule: label 1 for secrets, 0 for what only looks like a candidate."""
    rng = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda a=2: _pseudo_word(rng, rng.randint(a, a + 5))
    secrets = (
        lambda: pick(lower + upper + digits, 20, 64),
        lambda: pick(lower + upper + digits + "+/", 24, 64) + rng.choice(["", "=", "=="]),
        lambda: rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "pk_test_", "npm_", "xoxb-"]) + pick(lower + upper + digits, 20, 40),
        lambda: "eyJ" + pick(lower + upper + digits, 20, 30) + "." + pick(lower + upper + digits + "_-", 20, 40),
        lambda: pick("0123456789abcdef", 16, 23) if rng.random() < 0.5 else pick("0123456789ABCDEF", 24, 40),
        lambda: pick(upper + digits, 20, 32),
        lambda: pick(lower + digits, 24, 40),
    )
    plain = (
        lambda: _pseudo_word(rng, 16),
        lambda: _pseudo_word(rng, 22).upper(),
        lambda: "-".join(word(3) for _ in range(rng.randint(3, 5))),
        lambda: ".".join(word(3) for _ in range(rng.randint(3, 5))),
        lambda: "/".join(["", *(word(3) for _ in range(rng.randint(3, 5)))]) + rng.choice(["", ".py", ".txt", ".html"]),
        lambda: "_".join(word(3) for _ in range(rng.randint(3, 5))).upper(),
        lambda: "".join(word(3).capitalize() for _ in range(rng.randint(3, 5))),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}.{rng.randint(10, 59)}",
        lambda: pick(digits, 16, 24),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)) + "." + pick(digits, 4, 8),
        lambda: rng.choice("=-._+" + lower + digits) * rng.randint(16, 60),
        lambda: (pick("=-._+/" + lower, 1, 3) * 60)[: rng.randint(16, 60)],
        lambda: f"www.{word(4)}.example.com/{word(3)}/{word(3)}",
        lambda: f"{word(5)}.{rng.randint(10, 99)}mail{rng.randint(1, 9)}.example.com",
        lambda: "-".join(pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: "".join(word(2) for _ in range(rng.randint(6, 20))),
    )
    out = []
    for i in range(n):
        label = i % 2
        body = rng.choice(secrets if label else plain)()
        body = body if len(body) >= 16 else body + "x" * (16 - len(body))
        before = " ".join(word() for _ in range(rng.randint(0, 5)))
        if rng.random() < (0.4 if label else 0.15):
            before += " " + rng.choice(["key", "auth", "bearer", "pwd", "credential", "private_key", "access", "signature"]) + rng.choice([" ", ": ", "=", ' = "'])
        else:
            before += rng.choice([" ", " ", " ", " (", ', "', "\n", ""]) if before else ""
        after = rng.choice([" ", ".", '"', ",", "\n", ""]) + word()
        out.append((before + body + after, len(before), len(before) + len(body), label))
    return out


_CODE: list[np.ndarray] = []


def _codes() -> np.ndarray:
    """Channel of each character up to 127; everything else is the last channel."""
    if not _CODE:
        code = np.full(129, _CHANNELS - 1, dtype=np.int64)
        for k in range(26):
            code[97 + k] = code[65 + k] = k
        code[48:58] = 27
        for k, c in enumerate(_SYMBOLS):
            code[ord(c)] = 29 + k
        _CODE.append(code)
    return _CODE[0]


def fields(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """The fields of a candidate: FIELD characters of text, and where the candidate is in them."""
    out = []
    for at in range(start, max(start + 1, end - INSIDE // 2), INSIDE // 2):
        stop = min(end, at + INSIDE)
        before = text[max(0, at - LEFT) : at].rjust(LEFT, "\0")
        out.append(((before + text[at : stop + RIGHT]).ljust(FIELD, "\0")[:FIELD], LEFT, LEFT + stop - at))
    return out


def one_hot(rows: list[tuple[str, int, int]]) -> np.ndarray:
    points = np.frombuffer("".join(r[0] for r in rows).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(rows), FIELD)
    x = np.zeros((len(rows), FIELD, _CHANNELS), dtype=np.float32)
    code = _codes()[np.minimum(points, 128)]
    np.put_along_axis(x, code[:, :, None], (points > 0)[:, :, None].astype(np.float32), axis=2)
    x[:, :, 26] = (points >= 65) & (points <= 90)
    inside = np.arange(FIELD)
    x[:, :, 28] = (inside >= np.array([r[1] for r in rows])[:, None]) & (inside < np.array([r[2] for r in rows])[:, None])
    return x


def _patches(x: np.ndarray) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)  # rows, positions, channels, width
    return view.reshape(len(x), FIELD - WIDTH + 1, -1)


@dataclass(frozen=True)
class Network:
    filters: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float] = (0.5, 0.5)  # bare, told

    def margin(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(_patches(x) @ self.filters + self.offset, 0)
        return np.concatenate((hidden.max(axis=1), hidden.mean(axis=1)), axis=1) @ self.out + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def train(findings: list[tuple[str, int, int, int]] | None = None, epochs: int = 8, seed: int = 3) -> Network:
    """Fit, calibrate and set the thresholds."""
    findings = findings or labelled_findings()
    rng = np.random.default_rng(seed)
    x = one_hot([fields(t, a, b)[0] for t, a, b, _ in findings])
    y = np.array([f[3] for f in findings], dtype=np.float32)
    told = np.array([bool(TELLING.search(t[max(0, a - 40) : a])) for t, a, _, _ in findings])
    part = np.arange(len(y)) // 2 % 5
    own, scaled, held = np.flatnonzero(part < 3), np.flatnonzero(part == 3), np.flatnonzero(part == 4)
    w = {
        "f": (rng.normal(size=(WIDTH * _CHANNELS, FILTERS)) * 0.15).astype(np.float32), "o": np.zeros(FILTERS, np.float32),
        "v": (rng.normal(size=2 * FILTERS) * 0.2).astype(np.float32), "b": np.zeros(1, np.float32),
    }
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // 32)):
            p = _patches(x[at])
            pre = p @ w["f"] + w["o"]
            hidden = np.maximum(pre, 0)
            top = hidden.argmax(axis=1)
            pooled = np.concatenate((hidden.max(axis=1), hidden.mean(axis=1)), axis=1)
            slope = (1 / (1 + np.exp(-(pooled @ w["v"] + w["b"][0]))) - y[at]) / len(at)
            back = slope[:, None] * w["v"][None]
            d = np.repeat(back[:, None, FILTERS:] / hidden.shape[1], hidden.shape[1], axis=1)
            rows, cols = np.arange(len(at))[:, None], np.arange(FILTERS)[None]
            d[rows, top, cols] += back[:, :FILTERS]
            d *= pre > 0
            grads = {"f": p.reshape(-1, p.shape[2]).T @ d.reshape(-1, FILTERS), "o": d.sum(axis=(0, 1)), "v": pooled.T @ slope, "b": slope.sum(keepdims=True)}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = w[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    net = Network(w["f"], w["o"], w["v"], float(w["b"][0]))
    m, a, c = net.margin(x[scaled]), 1.0, 0.0
    for _ in range(400):  # Platt scaling
        g = 1 / (1 + np.exp(-np.clip(a * m + c, -40, 40))) - y[scaled]
        a, c = a - 0.02 * float((g * m).mean()), c - 0.1 * float(g.mean())
    net = Network(net.filters, net.offset, net.out, net.bias, a, c)
    score = net.score(x[held])
    limits = []
    for group in (False, True):
        hits = np.sort(score[(told[held] == group) & (y[held] > 0)])
        limits.append(float(hits[int((1 - RECALL) * len(hits))]) if len(hits) else 0.5)
    return Network(net.filters, net.offset, net.out, net.bias, a, c, tuple(limits))


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that sorted spans cover together."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def scan(texts: list[str | None], net: Network) -> list[tuple[list, list]]:
    """(base spans, spans of the network) of each text, as (start, kind, end)."""
    found, rows, owner = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        found.append((base, []))
        covered = _merged(base)
        for m in CANDIDATE.finditer(text):
            at = bisect_right(covered, (m.start(), len(text) + 1)) - 1
            if at >= 0 and covered[at][1] >= m.end():
                continue
            told = bool(TELLING.search(text[max(0, m.start() - 40) : m.start()]))
            for f in fields(text, m.start(), m.end()):
                rows.append(f)
                owner.append((i, m.start(), m.end(), told))
    best: dict[tuple, float] = {}
    for at in range(0, len(rows), 512):
        for key, p in zip(owner[at : at + 512], net.score(one_hot(rows[at : at + 512])).tolist(), strict=True):
            best[key] = max(best.get(key, 0.0), p)
    for (i, start, end, told), p in best.items():
        if p >= net.thresholds[told]:
            found[i][1].append((start, 3, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans.

    spans has all spans as kind:start:end in code points, by start and then kind, comma-joined;
    base_sha256 is the digest of those of the fixed patterns. Null text counts as empty and has none.
    Spans of different kinds may overlap; two of one kind never do. Texts are read whole; repeated rows
    repeat their result, tied scores count alike; other columns are ignored, whatever their names. An empty table gives an empty
    result.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(net or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for base, more in scan(part.column("text").to_pylist(), shared.value):
                    counts = [sum(k == n for _, k, _ in base) for n in range(3)]
                    out.append((*counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.drop("text").schema
    for c in ("n_assign", "n_access", "n_hex", "n_model"):
        schema = schema.add(c, "long")
    return rows.mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))
