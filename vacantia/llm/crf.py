"""A linear-chain conditional random field over words, trained and read in batches of numpy arrays."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

#: Buckets of hashed features.
BITS = 16


def features(word: str, lexicon: dict[str, Sequence[str]]) -> list[int]:
    """Hashed features of a lower-cased word: itself, its affixes, its character n-grams, the lexicons that list it."""
    w = f"^{word}$"
    named = [f"w{word}", *(f"p{w[:n]}" for n in (2, 3, 4)), *(f"s{w[-n:]}" for n in (2, 3, 4, 5))]
    named += [f"n{w[i : i + n]}" for n in (2, 3) for i in range(len(w) - n + 1)]
    named += [f"l{x}" for x in lexicon.get(word, ())]
    return [zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f in dict.fromkeys(named)]


class Field:
    """Weights: a row of label scores for each feature; transitions within a sentence and at the start of one."""

    def __init__(self, labels: Sequence[str], lexicon: dict[str, Sequence[str]]) -> None:
        k = len(labels)
        self.labels, self.lexicon = tuple(labels), lexicon
        self.weights = np.zeros((1 << BITS, k), np.float32)
        self.moves = np.zeros((2, k, k), np.float32)
        self.moves[0] += 4 * np.eye(k, dtype=np.float32)
        self.moves[1] += np.eye(k, dtype=np.float32)
        self.forget()

    def __getstate__(self) -> dict:
        return {"labels": self.labels, "lexicon": self.lexicon, "weights": self.weights, "moves": self.moves}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        """Drop the scores kept of words seen."""
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.labels)), np.float32)

    def look_up(self, words: Sequence[str]) -> list[int]:
        """The row of `scores` of each word; new words get theirs."""
        number = self.number
        if len(number) > 400_000:
            self.forget()
            number = self.number
        out = []
        for w in words:
            i = number.get(w)
            if i is None:
                i = number[w] = len(number)
                if i >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.scores[i] = self.weights[features(w, self.lexicon)].sum(axis=0)
            out.append(i)
        return out

    def marginals(self, emit: np.ndarray, start: np.ndarray, mask: np.ndarray, expect: bool = False) -> tuple:
        """Forward-backward over (time, batch): P(label) of every word, the log-likelihood's normaliser, expected moves.

        `emit` holds the words' scores, `start` marks the first word of a sentence, `mask` the words that are there.
        """
        steps, size, k = emit.shape
        top = emit.max(axis=2, keepdims=True)
        e = np.exp(emit - top)
        m0, m1 = np.exp(self.moves)
        ahead = np.empty((steps, size, k), np.float32)
        scale = np.ones((steps, size, 1), np.float32)
        now = e[0] / k
        for t in range(steps):
            if t:
                step = np.where(start[t][:, None], now @ m1, now @ m0) * e[t]
                now = np.where(mask[t][:, None], step, now)
            total = now.sum(axis=1, keepdims=True)
            now = now / total
            scale[t], ahead[t] = total, now
        back = np.ones((size, k), np.float32)
        out = np.empty_like(ahead)
        moved = np.zeros((2, k, k))
        for t in range(steps - 1, -1, -1):
            p = ahead[t] * back
            out[t] = p / p.sum(axis=1, keepdims=True)
            if t:
                seen = e[t] * back
                if expect:
                    here = mask[t][:, None] / scale[t]
                    for s, m in ((0, m0), (1, m1)):
                        w = here * (start[t] == bool(s))[:, None]
                        moved[s] += ((ahead[t - 1] * w).T @ seen) * m
                step = np.where(start[t][:, None], seen @ m1.T, seen @ m0.T)
                step = step / step.sum(axis=1, keepdims=True)
                if expect:
                    # keep back scaled so that ahead * back sums to one where moves are counted
                    prior = (ahead[t - 1] * step).sum(axis=1, keepdims=True)
                    step = step / prior
                back = np.where(mask[t][:, None], step, back)
        return out, float((np.log(scale[:, :, 0]) * mask + top[:, :, 0] * mask).sum()), moved

    def fit(self, texts: Sequence[tuple[list[str], list[bool], list[int]]], rounds: int, rate: float = 0.15, decay: float = 1e-4) -> None:
        """Gradient ascent (Adam) on the conditional likelihood of label sequences; `texts` are (words, starts, labels).

        The rate falls evenly to a twentieth, without which the last steps still swing by whole sentences.
        """
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t[0]))}
        lists = [features(w, self.lexicon) for w in vocabulary]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.array([i for x in lists for i in x])
        used, flat = np.unique(flat, return_inverse=True)
        k = len(self.labels)
        ids, start, mask, gold = pad([([vocabulary[w] for w in t[0]], t[1], t[2]) for t in texts])
        truth = np.zeros((*gold.shape, k), np.float32)
        np.put_along_axis(truth, gold[:, :, None], 1, axis=2)
        truth *= mask[:, :, None]
        counted = np.zeros((2, k, k))
        both = mask[1:]
        for s in (0, 1):
            at = both & (start[1:] == bool(s))
            np.add.at(counted[s], (gold[:-1][at], gold[1:][at]), 1)
        w = self.weights[used].astype(np.float64)
        first, second = np.zeros((len(used), k)), np.zeros((len(used), k))
        mfirst, msecond = np.zeros((2, k, k)), np.zeros((2, k, k))
        words = int(mask.sum())
        moves = self.moves.astype(np.float64)
        for n in range(1, rounds + 1):
            score = np.stack([np.bincount(owner, weights=w[flat, c], minlength=len(lists)) for c in range(k)], axis=1)
            self.moves = moves.astype(np.float32)
            p, _, moved = self.marginals(score[ids].astype(np.float32), start, mask, expect=True)
            left = (truth - p * mask[:, :, None]).reshape(-1, k)
            byword = np.stack([np.bincount(ids.ravel(), weights=left[:, c], minlength=len(lists)) for c in range(k)], axis=1)
            grad = np.stack([np.bincount(flat, weights=byword[owner, c], minlength=len(used)) for c in range(k)], axis=1) / words - decay * w
            mgrad = (counted - moved) / words - decay * moves
            for value, g, a, b in ((w, grad, first, second), (moves, mgrad, mfirst, msecond)):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                value += rate * (1.05 - n / rounds) * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.99**n)) + 1e-8)
        self.weights[used] = w
        self.moves = moves.astype(np.float32)
        self.forget()


def pad(texts: Sequence[tuple[list[int], list[bool], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, starts, mask, labels), each (time, batch), of texts of unequal length."""
    size = np.array([len(t[0]) for t in texts])
    steps = int(size.max(initial=1))
    mask = np.arange(steps)[:, None] < size[None, :]
    out = []
    for j, kind in ((0, np.int64), (1, bool), (2, np.int64)):
        a = np.zeros((len(texts), steps), kind)
        a[mask.T] = np.fromiter((x for t in texts for x in t[j]), kind, int(size.sum()))
        out.append(np.ascontiguousarray(a.T))
    return out[0], out[1], mask, out[2]
