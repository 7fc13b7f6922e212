"""Problem 8: statistics of each text, and whether it is prose, a list, a table or junk."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.darts import mix
from vacantia.runtime import materialize, table

STATES = ("prose", "list", "table", "junk")
#: Weight of the seed tables against what the texts show: so many lines, and again for every SEED_TEXTS texts.
SEED_LINES = 400.0
SEED_TEXTS = 600
ROUNDS = 4
#: Characters looked at together.
SPAN = 1_000_000

_MARK = re.compile(r"^\s*(?:[-*•–—·▪◦‣+]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+\S")
_TABLE_TAG = re.compile(r"</?t[drh]\b", re.I)
_TAG = re.compile(r"<[^>]*>")
_ADDRESS = re.compile(r"://|www\.", re.I)
_URL = re.compile(r"\b(?:https?://|www\.)\S+", re.I)
_GAP = re.compile(r"\S( {2,}|\t)(?=\S)")
_STOPS = frozenset(".!?…:。！？")
_END = re.compile(r"[.!?…:。！？]['\"»”)\]\s]*$")
#: A word broken by a sign, by a capital that isn't a plain letter, or by the replacement character.
_BROKEN = re.compile(r"[^\W\d_][^\w\s'’\-–./&@:,()\"+#*?!;=]+[^\W\d_]|[a-zà-ÿ](?=[^\x00-\x7f])[ÂÃŸÅÐÞ]|\ufffd")
#: A line has a value of each of these; the number is how many values there are.
KINDS = {"cells": 4, "mark": 2, "words": 5, "end": 2, "signs": 4, "strange": 3, "again": 3, "common": 3}


def lines_of(text: str) -> list[str]:
    """The lines that hold more than blanks."""
    return [x for x in text.splitlines() if x.strip()]


#: Classes of characters, one bit each.
_ALNUM, _SPACE, _ALPHA, _DIGIT, _DECIMAL, _ASCII, _VOWEL, _CLOSER, _ENDS, _SIGN, _PLAIN, _LATE, _SMALL = (1 << i for i in range(13))


def _class(c: str) -> int:
    bits = c.isalnum() * _ALNUM | c.isspace() * _SPACE | c.isalpha() * _ALPHA | c.isdigit() * _DIGIT | c.isdecimal() * _DECIMAL | c.isascii() * _ASCII
    bits |= (c.lower() in "aeiouy") * _VOWEL | (c in "'\"»”)]" or c.isspace()) * _CLOSER | (c in ".!?…:。！？") * _ENDS | (c in "{}=<>|\\^~#$%&@*_") * _SIGN
    return bits | (c in "_'’-–./&@:,()\"+#*?!;=") * _PLAIN | (c in "ÂÃŸÅÐÞ") * _LATE | ("a" <= c <= "z" or "à" <= c <= "ÿ") * _SMALL


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and small letter of each code point of the basic plane."""
    small = [chr(i).lower() for i in range(0x10000)]
    return np.fromiter(map(_class, map(chr, range(0x10000))), np.uint16, 0x10000), np.fromiter((ord(x) if len(x) == 1 else i for i, x in enumerate(small)), np.uint32, 0x10000)


def _classified(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, classes, small letters) of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes, small = _tables()
    far = np.flatnonzero(points > 0xFFFF)
    near = points if not len(far) else np.where(points > 0xFFFF, 0, points)
    kinds, low = classes[near], small[near]
    if len(far):
        found, at = np.unique(points[far], return_inverse=True)
        kinds[far] = np.array([_class(chr(i)) for i in found], np.uint16)[at]
        low[far] = np.array([ord(chr(i).lower()) for i in found], np.uint32)[at]
    return points, kinds, low


def _hashed(small: np.ndarray, at: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; `at` are the places of all letters, `starts` and `size` the words among them."""
    place = np.arange(len(at)) - np.repeat(starts, size)
    return np.add.reduceat(mix((small[at] | (place.astype(np.uint64) << np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)), starts)


def _words(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of letters and digits, the first of each word among them, letters of each word)."""
    inside = (kinds & _ALNUM) > 0
    at = np.flatnonzero(inside)
    begins = np.ones(len(at), bool)
    begins[1:] = at[1:] != at[:-1] + 1
    starts = np.flatnonzero(begins)
    return at, starts, np.diff(np.append(starts, len(at)))


def word_hashes(words: Iterable[str]) -> np.ndarray:
    """The hashes of single words, sorted."""
    kept = [w for w in words if w.isalnum()]
    points, kinds, small = _classified(" ".join(kept))
    at, starts, size = _words(points, kinds)
    return np.unique(_hashed(small, at, starts, size)) if len(starts) else np.zeros(0, np.uint64)


def _among(hashes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which hashes are listed."""
    if not len(listed):
        return np.zeros(len(hashes), bool)
    return listed[np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)] == hashes


def _shapes(lines: Sequence[str], bare: Sequence[str], tagged: Sequence[int], counts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The notation of the row of cells each line is (0 for none), and how many cells it has."""
    form, cells = np.zeros(len(lines), np.int64), np.ones(len(lines), np.int64)
    signs = ("|", "\t", ";", ",")
    amounts = np.stack([counts[c] for c in signs])
    for i, x in enumerate(lines):
        if "\t" in x and len(x) != len(bare[i]):
            amounts[1, i] = x.count("\t")
    best, most = amounts.argmax(axis=0), amounts.max(axis=0)
    rows = (most >= 2) & (best < 3)
    form[rows], cells[rows] = best[rows] + 1, most[rows] + 1
    for i, x in enumerate(bare):
        if not rows[i] and ("  " in x or "\t" in x) and (gaps := len(_GAP.findall(x))) >= 2:
            form[i], cells[i] = 5, min(gaps + 1, 9)
    for i in np.flatnonzero((most >= 2) & (best == 3) & (form == 0)).tolist():
        if ", " not in lines[i]:
            form[i], cells[i] = 4, most[i] + 1
    none = (counts["{"] + counts["}"]) > 0
    form[none], cells[none] = 0, 1
    form[tagged], cells[tagged] = 6, 3
    return form, cells


def _beside(values: np.ndarray, text: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The value `step` lines further on, and whether that line is of the same text."""
    there = np.arange(len(values)) + step
    known = (there >= 0) & (there < len(values))
    there = np.where(known, there, 0)
    return values[there], known & (text[there] == text)


def _seen(texts: Sequence[Sequence[str]], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((line, kind) statistics in steps, characters of each line) of the lines of all texts; one pass over all their characters."""
    lines = [x for t in texts for x in t]
    if not lines:
        return np.zeros((0, len(KINDS)), np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    stripped = [x.strip() for x in lines]
    bare = list(stripped)
    tagged = [i for i, x in enumerate(lines) if "<" in x and _TABLE_TAG.search(x)]
    for i in tagged:
        bare[i] = _TAG.sub(" ", lines[i]).strip() or stripped[i]
    points, kinds, small = _classified("\n".join(bare) + "\n")
    length = np.fromiter(map(len, bare), np.int64, len(bare))
    of = np.repeat(np.arange(len(bare)), length + 1)

    def tally(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of[np.flatnonzero(mask)], minlength=len(bare))

    out = np.zeros((len(lines), len(KINDS)), np.int64)
    counts = {c: tally(points == ord(c)) for c in "|\t;,{}"}
    form, cells = _shapes(lines, bare, tagged, counts)
    near = same = np.zeros(len(lines), bool)
    for step in (-1, 1):
        (f, inside), (c, _) = _beside(form, text, step), _beside(cells, text, step)
        near = near | (inside & (f == form))
        same = same | (inside & (f == form) & (np.abs(c - cells) <= (form == 5)))
    out[:, 0] = np.where(form == 0, 0, np.where((form == 6) | same, 3, np.where(near, 2, 1)))
    out[:, 1] = [_MARK.match(x) is not None for x in lines]

    at, starts, size = _words(points, kinds)
    whose = of[at[starts]]
    n = np.bincount(whose, minlength=len(lines))
    out[:, 2] = np.searchsorted([0, 2, 7, 11], n)
    last = np.maximum.reduceat(np.where(kinds & _CLOSER, -1, np.arange(len(points))), np.cumsum(length + 1) - length - 1)
    out[:, 3] = (last >= 0) & ((kinds[last] & _ENDS) > 0)
    signs = tally((kinds & (_ALNUM | _SPACE)) == 0) / length
    code = tally(kinds & _SIGN) / length
    out[:, 4] = np.select([(signs > 0.28) | (code > 0.12) | ((counts["{"] > 0) & (counts["}"] > 0)), (signs > 0.14) | (code > 0.05), signs > 0.07], [3, 2, 1], 0)

    strange = np.ones(len(lines))
    hashes = np.zeros(0, np.uint64)
    if len(starts):
        any_of, all_of = np.bitwise_or.reduceat(kinds[at], starts), np.bitwise_and.reduceat(kinds[at], starts)
        alpha, digits = (all_of & _ALPHA) > 0, (all_of & _DIGIT) > 0
        mute = (size > 3) & alpha & ((all_of & _ASCII) > 0) & ((any_of & _VOWEL) == 0)
        odd = (size > 30) | mute | (((any_of & _DIGIT) > 0) & ~digits & (size > 3))
        loose = ~odd & ((digits & (size < 3)) | ((size == 1) & ~alpha))
        total = np.bincount(whose, weights=size, minlength=len(lines))
        strange = np.where(total > 0, np.bincount(whose, weights=np.where(odd, size, 0.5 * loose), minlength=len(lines)) / np.maximum(total, 1), 1.0)
        hashes = _hashed(small, at, starts, size)
    before = np.append(np.uint16(_SPACE), kinds[:-1])
    weird = (kinds & (_ALNUM | _SPACE | _PLAIN)) == 0
    letter = (before & (_ALNUM | _DECIMAL)) == _ALNUM
    broken = (weird & letter) | (((kinds & _LATE) > 0) & ((before & _SMALL) > 0)) | (points == 0xFFFD)
    for i in np.unique(of[np.flatnonzero(broken)]).tolist():
        tokens = bare[i].split()
        strange[i] = max(strange[i], 2 * sum(len(x) for x in tokens if _BROKEN.search(x)) / max(1, sum(map(len, tokens))))
    out[:, 5] = np.searchsorted([0.2, 0.5], strange)

    variety = np.ones(len(lines))
    first = np.cumsum(n) - n
    part = (np.arange(len(starts)) - first[whose]) // 40
    asked = np.flatnonzero((n[whose] >= 6) & (part * 40 < np.maximum(1, n[whose] - 20)))
    if len(asked):
        mine = whose[asked]
        names = mix(hashes[asked] ^ mix(mine.astype(np.uint64) << np.uint64(32) | part[asked].astype(np.uint64)))
        once = np.unique(names, return_index=True)[1]
        held = np.bincount(mine, minlength=len(lines))
        variety = np.where(held > 0, np.bincount(mine[once], minlength=len(lines)) / np.maximum(held, 1), 1.0)
    ids: dict[str, int] = {}
    name = np.fromiter((ids.setdefault(x, len(ids)) for x in stripped), np.int64, len(stripped))
    own = name.copy()
    own[tagged] = [ids.get(bare[i], -1) for i in tagged]
    alike = np.zeros(len(lines), np.int64)
    for step in range(-3, 4):
        there, inside = _beside(name, text, step)
        alike += inside & (there == own)
    out[:, 6] = np.select([(n >= 9) & (variety < 0.3) | (alike > 3), (alike > 1) | (n >= 6) & (variety < 0.45)], [2, 1], 0)
    share = np.bincount(whose[_among(hashes, common)], minlength=len(lines)) / np.maximum(n, 1) if len(starts) else np.zeros(len(lines))
    out[:, 7] = np.searchsorted([0.03, 0.12], share)
    return out, np.fromiter(map(len, stripped), np.int64, len(stripped))


def observe(lines: Sequence[str], common: Iterable[str]) -> np.ndarray:
    """(line, kind): the statistics of each line of one text in steps, as the model sees them."""
    return _seen([lines], word_hashes(common))[0]


#: Seed tables: P(value | state) of each kind, in the order of STATES (fixed starting values of the estimation).
SEEDS = {
    "cells": ((0.90, 0.06, 0.02, 0.02), (0.95, 0.02, 0.02, 0.01), (0.03, 0.05, 0.07, 0.85), (0.82, 0.09, 0.06, 0.03)),
    "mark": ((0.93, 0.07), (0.30, 0.70), (0.99, 0.01), (0.97, 0.03)),
    "words": ((0.005, 0.015, 0.04, 0.14, 0.80), (0.01, 0.37, 0.60, 0.018, 0.002), (0.01, 0.04, 0.65, 0.25, 0.05), (0.14, 0.12, 0.20, 0.14, 0.40)),
    "end": ((0.08, 0.92), (0.96, 0.04), (0.98, 0.02), (0.88, 0.12)),
    "signs": ((0.88, 0.10, 0.015, 0.005), (0.66, 0.20, 0.10, 0.04), (0.25, 0.15, 0.30, 0.30), (0.15, 0.04, 0.16, 0.65)),
    "strange": ((0.975, 0.02, 0.005), (0.93, 0.05, 0.02), (0.90, 0.08, 0.02), (0.25, 0.10, 0.65)),
    "again": ((0.9945, 0.0054, 0.0001), (0.987, 0.0128, 0.0002), (0.98, 0.0195, 0.0005), (0.60, 0.12, 0.28)),
    "common": ((0.02, 0.06, 0.92), (0.60, 0.02, 0.38), (0.80, 0.06, 0.14), (0.90, 0.06, 0.04)),
}
STAY = 0.88


class Lines:
    """Hidden Markov model over the lines of a text; a line's statistics are independent given its state."""

    def __init__(self) -> None:
        k = len(STATES)
        self.start = np.log(np.array([0.8, 0.07, 0.06, 0.07]))
        self.moves = np.log(np.full((k, k), (1 - STAY) / (k - 1)) + np.eye(k) * (STAY - (1 - STAY) / (k - 1)))
        self.tables = [np.log(np.array(SEEDS[name])) for name in KINDS]

    def emissions(self, seen: np.ndarray) -> np.ndarray:
        """(line, state) log-probabilities of what is seen."""
        return sum(t[:, seen[:, j]] for j, t in enumerate(self.tables)).T

    def posterior(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(state) of each line and the expected moves, by forward-backward."""
        e = self.emissions(seen)
        n, k = e.shape
        ahead, back = np.empty((n, k)), np.zeros((n, k))
        ahead[0] = self.start + e[0]
        for t in range(1, n):
            x = ahead[t - 1][:, None] + self.moves
            top = x.max(axis=0)
            ahead[t] = top + np.log(np.exp(x - top).sum(axis=0)) + e[t]
        total = np.logaddexp.reduce(ahead[-1])
        moved = np.zeros((k, k))
        for t in range(n - 2, -1, -1):
            x = self.moves + (e[t + 1] + back[t + 1])[None, :]
            top = x.max(axis=1)
            back[t] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            moved += np.exp(ahead[t][:, None] + x - total)
        return np.exp(ahead + back - total), moved

    def expected(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Expected lines of each state and value of each kind, then expected moves, in a row: `posterior` summed over texts."""
        texts = [t for t in texts if len(t)]
        return self.counted(_coded(np.concatenate(texts)), np.array([len(t) for t in texts])) if texts else self.counted(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def counted(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """`expected` of texts of n lines each, from the codes of all lines."""
        k = len(STATES)
        moved, at_code = np.zeros((k, k)), np.zeros((_CODES, k))
        if len(codes):
            e = self.emissions(_DECODED)
            b = np.exp(e - e.max(axis=1, keepdims=True))[codes]
            steps = _steps(n)
            moves = np.exp(self.moves)
            p, back, scale = np.empty_like(b), np.ones_like(b), np.empty((len(b), 1))
            for t, at in enumerate(steps):
                x = (p[at - 1] @ moves if t else np.exp(self.start)) * b[at]
                scale[at] = x.sum(axis=1, keepdims=True)
                p[at] = x / scale[at]
            for at in steps[:0:-1]:
                ahead = b[at] * back[at] / scale[at]
                back[at - 1] = ahead @ moves.T
                moved += moves * (p[at - 1].T @ ahead)
            p *= back
            at_code = np.stack([np.bincount(codes, weights=p[:, i], minlength=_CODES) for i in range(k)], axis=1)
        counts = [at_code[_DECODED[:, j] == v].sum(axis=0) for j, size in enumerate(KINDS.values()) for v in range(size)]
        return np.concatenate([np.concatenate(counts), moved.ravel()])

    def improve(self, counts: np.ndarray, texts: int) -> None:
        """Tables and moves from the expected counts of so many texts and the seeds."""
        k = len(STATES)
        weight = SEED_LINES * max(1.0, texts / SEED_TEXTS)
        at = 0
        for j, (name, size) in enumerate(KINDS.items()):
            t = np.array(SEEDS[name]) * weight + counts[at : at + k * size].reshape(size, k).T
            self.tables[j] = np.log(t / t.sum(axis=1, keepdims=True))
            at += k * size
        moves = np.exp(Lines().moves) * weight + counts[at:].reshape(k, k)
        self.moves = np.log(moves / moves.sum(axis=1, keepdims=True))

    def estimate(self, texts: Sequence[np.ndarray], rounds: int = ROUNDS) -> None:
        """Expectation maximisation from the seeds, which keep their weight at any number of texts."""
        for _ in range(rounds if texts else 0):
            self.improve(self.expected(texts), len(texts))

    def label(self, seen: np.ndarray) -> list[int]:
        """The likeliest states of all lines of a text together."""
        return self.labels(_coded(seen), np.array([len(seen)])).tolist()

    def labels(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The likeliest states of the lines of texts of n lines each (Viterbi), all texts a line at a time."""
        out = np.zeros(len(codes), np.int64)
        if not len(codes):
            return out
        e = self.emissions(_DECODED)[codes]
        best, came, steps = np.empty_like(e), np.zeros(e.shape, np.int8), _steps(n)
        for t, at in enumerate(steps):
            if not t:
                best[at] = self.start + e[at]
                continue
            x = best[at - 1][:, :, None] + self.moves
            came[at] = x.argmax(axis=1)
            best[at] = x.max(axis=1) + e[at]
        for t in range(len(steps) - 1, -1, -1):
            at = steps[t]
            going = len(steps[t + 1]) if t + 1 < len(steps) else 0
            out[at[going:]] = best[at[going:]].argmax(axis=1)
            out[at[:going]] = came[at[:going] + 1, out[at[:going] + 1]]
        return out


_CODES = int(np.prod(list(KINDS.values())))
#: What the code of a line stands for.
_DECODED = np.stack(np.unravel_index(np.arange(_CODES), tuple(KINDS.values())), axis=1)


def _coded(seen: np.ndarray) -> np.ndarray:
    """One number for all that is seen in each line."""
    return np.ravel_multi_index(tuple(seen.T), tuple(KINDS.values()))


def _steps(n: np.ndarray) -> list[np.ndarray]:
    """Places of the first lines of all texts, then of the second, and so on; the longest texts first, so that those with a line left come first."""
    starts = (np.cumsum(n) - n)[order := np.argsort(-n, kind="stable")]
    n = n[order]
    return [starts[: np.searchsorted(-n, -t, side="left")] + t for t in range(n[0] if len(n) else 0)]


def _counted_lines(text: str) -> list[str]:
    """The lines of a text that count: addresses don't count as text, unless there is nothing else."""
    return lines_of(text) if not _ADDRESS.search(text) else lines_of(_URL.sub("", text)) or lines_of(text)


def _spans(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SPAN characters, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SPAN:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _shares(codes: np.ndarray, size: np.ndarray, n: np.ndarray, model: Lines) -> np.ndarray:
    """(text, state): the share of each state in the characters of texts of n lines each; 0 for a text without any."""
    states = model.labels(codes, n)
    of = np.repeat(np.arange(len(n)), n) * len(STATES) + states
    total = np.bincount(of, weights=size, minlength=len(n) * len(STATES)).reshape(len(n), len(STATES))
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1)


def shares(text: str, model: Lines, common: Iterable[str]) -> list[float]:
    """The share of each state in a text's characters outside blank lines; all 0 for a text without any."""
    lines = _counted_lines(text)
    seen, size = _seen([lines], word_hashes(common))
    return _shares(_coded(seen), size, np.array([len(lines)]), model)[0].tolist()


def observed(df: DataFrame, key: str, text: str, common: Iterable[str]) -> DataFrame:
    """(key, codes, sizes): a number for what is seen in each line of the text that counts, and its characters; empty for texts without a line.

    Rows stay as they are, repeated or with a null key; texts are read whole; nothing is shuffled.
    """
    listed, field = word_hashes(common), df.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for low, high in _spans(texts):
                lines = [_counted_lines(t) if t else [] for t in texts[low:high]]
                seen, size = _seen(lines, listed)
                ends = pa.array(np.cumsum([0, *map(len, lines)]), pa.int32())
                codes = pa.ListArray.from_arrays(ends, pa.array(_coded(seen).astype(np.int16)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), codes, pa.ListArray.from_arrays(ends, pa.array(size, pa.int32()))], names=[key, "codes", "sizes"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, codes array<smallint>, sizes array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each list has) of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def counted(seen: DataFrame, model: Lines) -> np.ndarray:
    """`Lines.expected` of all texts; only the sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(model.counted(codes[: n.sum()], n[n > 0]) for b in batches for codes, n in [_lists(b.column(0))])
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    sums = seen.select("codes").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.round([r.v for r in sorted(sums, key=lambda r: r.i)], 6)


def fitted(seen: DataFrame) -> Lines:
    """The model, re-estimated on all texts that have a line, from what is seen in them."""
    model, texts = Lines(), seen.where("size(codes) > 0").count()
    for _ in range(ROUNDS if texts else 0):
        model.improve(counted(seen, model), texts)
    return model


def fit(df: DataFrame, text: str, common: Iterable[str]) -> Lines:
    """`fitted` on the texts of a table."""
    return fitted(materialize(observed(df.select(F.lit(0).alias("key"), F.col(text).alias("text")), "key", "text", common)))


def common_words(words: DataFrame) -> frozenset[str]:
    """The frequent words of all languages; the list is small by its nature, more than 100,000 are refused."""
    found = [r.word.lower() for r in words.where("word is not null").select("word").distinct().limit(100_001).collect()]
    if len(found) > 100_000:
        raise ValueError("more than 100,000 common words")
    return frozenset(found)


STATISTICS = ("words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words", *STATES)


def _worded(texts: Sequence[str | None], listed: np.ndarray) -> list[np.ndarray]:
    """Words, mean word length, symbol ratio, ended lines and common words of each text."""
    points, kinds, small = _classified("".join((t or "") + "\n" for t in texts))
    length = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), length)
    at, starts, size = _words(points, kinds)
    whose = of[at[starts]]
    words = np.bincount(whose, minlength=len(texts))
    solid = np.bincount(whose, weights=size, minlength=len(texts))
    signs = np.bincount(of[(kinds & (_ALNUM | _SPACE)) == 0], minlength=len(texts))
    known = np.bincount(whose[_among(_hashed(small, at, starts, size), listed)], minlength=len(texts)) if len(starts) else words
    lines = [lines_of(t or "") for t in texts]
    ended = np.array([sum(x.rstrip("'\"»”)] \t\xa0")[-1:] in _STOPS or bool(_END.search(x.strip())) for x in t) / max(1, len(t)) for t in lines])
    return [words, solid / np.maximum(words, 1), signs / np.maximum(signs + solid, 1), ended, known / np.maximum(words, 1)]


def statistics(df: DataFrame, key: str, text: str, model: Lines, common: Iterable[str]) -> DataFrame:
    """(key, words, mean_word_length, symbol_ratio, ended_lines, common_words, prose, list, table, junk) of each row.

    Words are runs of letters or digits. `symbol_ratio` counts signs among the characters that aren't blanks,
    `ended_lines` the lines that end in punctuation, `common_words` the words in the list of frequent ones; the last
    four are the shares of the line labels in the text's characters. A null, empty or blank text has 0 words and 0
    everywhere. Rows stay as they are, repeated or with a null key; nothing is shuffled; texts are read whole.
    """
    field, listed = df.schema[key], word_hashes(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for low, high in _spans(texts):
                some = texts[low:high]
                lines = [_counted_lines(t) if t else [] for t in some]
                seen, size = _seen(lines, listed)
                states = _shares(_coded(seen), size, np.fromiter(map(len, lines), np.int64, len(lines)), model)
                columns = [pa.array(x) for x in [*_worded(some, listed), *np.ascontiguousarray(states.T)]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), *columns], names=[key, *STATISTICS])

    shape = ", ".join([f"`{key}` {field.dataType.simpleString()}", "words long", *[f"`{s}` double" for s in STATISTICS[1:]]])
    return df.select(F.col(key), F.col(text)).mapInArrow(run, shape)


def shapes(seen: DataFrame, key: str, model: Lines) -> DataFrame:
    """(key, prose, list, table, junk) of each row of `observed`: the last four columns of `statistics`."""
    field = seen.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (codes, n), (sizes, _) = _lists(b.column(1)), _lists(b.column(2))
            columns = [pa.array(x) for x in np.ascontiguousarray(_shares(codes, sizes, n, model).T)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, *STATES])

    shape = ", ".join([f"`{key}` {field.dataType.simpleString()}", *[f"`{s}` double" for s in STATES]])
    return seen.select(key, "codes", "sizes").mapInArrow(run, shape)


def shape_of() -> F.Column:
    """The label of most of what isn't prose, if that is more than half of the text; null otherwise."""
    odd = F.col("list") + F.col("table") + F.col("junk")
    kind = F.when((F.col("table") >= F.col("list")) & (F.col("table") >= F.col("junk")), "table").when(F.col("list") >= F.col("junk"), "list").otherwise("junk")
    return F.when(odd > 0.5, kind)


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, frozenset[str]]:
    """The documents, what is seen in them, and the frequent words."""
    documents = table(spark, folder, "documents")
    common = common_words(table(spark, folder, "common_words"))
    return documents, materialize(observed(documents, "doc_id", "text", common)), common


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, shape): the documents of which more than half isn't prose."""
    _, seen, _ = _parts(spark, folder)
    return shapes(seen, "doc_id", fitted(seen)).select("doc_id", shape_of().alias("shape")).where("shape is not null")


def p8_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document, with its shape (prose where half or more is, null without text)."""
    documents, seen, common = _parts(spark, folder)
    rows = statistics(documents, "doc_id", "text", fitted(seen), common)
    kind = F.coalesce(shape_of(), F.when(F.col("prose") > 0, "prose"))
    return rows.select("doc_id", "words", *[F.round(c, 6).alias(c) for c in STATISTICS[1:]], kind.alias("shape"))


def p8_words(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, words, mean_word_length): the statistics that built-in functions give, for the SQL check."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    letters = F.aggregate(F.transform(words, F.length), F.lit(0), lambda a, x: a + x)
    return table(spark, folder, "documents").select(
        "doc_id", F.size(words).cast("long").alias("words"),
        F.when(F.size(words) > 0, F.round(letters / F.size(words), 4)).alias("mean_word_length"))


QUERIES = {"p8_found": p8_found, "p8_stats": p8_stats, "p8_words": p8_words}
ORACLES = {
    "p8_words": r"""select doc_id, len(w) as words, case when len(w) > 0 then round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 4) end as mean_word_length
      from (select doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+') as w from documents)""",
}
