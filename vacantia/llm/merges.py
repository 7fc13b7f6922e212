"""Byte-level BPE as a streaming transducer with bounded lookahead.

A merge across a position can only be decided by text within a fixed distance to its right, because every rule that
can pre-empt another needs a smaller rank: the chains of pre-emption are finite, and `sufficient_lookahead` finds the
longest. Bytes further left than that are final, so their tokens are emitted and forgotten.
"""

from __future__ import annotations

import base64
import codecs
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import regex

#: Fixed value: the public pattern that splits text before merging (contractions, letters, digits, other signs, blanks).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of one kind that may continue in the next chunk.
_RUNS = {k: regex.compile(p) for k, p in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+"), ("O", r"[^\s\p{L}\p{N}]+"))}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file (base64 and number on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The tokens of one piece: the pair of least rank merges first, the leftmost among equals.

    `below` admits only ranks under it, which gives a token's own two parts.
    """
    if len(piece) > 24:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    top = below if below is not None else 1 << 60
    while len(parts) > 1:
        best, at = top, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], top)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _merge_long(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """`merge` with a heap over a linked list, for pieces of many bytes."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the token that starts here
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None and rank < below:
            heap.append((rank, i, i + 2))
    heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            rank = ranks.get(piece[i : end[stop]])
            if rank is not None and rank < below:
                heappush(heap, (rank, i, end[stop]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(piece[left:stop])
            if rank is not None and rank < below:
                heappush(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """How many bytes right of a position decide whether any merge crosses it.

    For a rule (x, y) the right part y may lose its right spine's member c to a rule (c, z) of smaller rank than the
    one that would absorb c; z in turn may be lost the same way. Rules are met in order of rank, so the reach of every
    rule of smaller rank is known; each left part keeps a running maximum over its ranks.
    """
    known: dict[bytes, tuple[list[int], list[int]]] = {}
    parts: dict[bytes, tuple[bytes, bytes]] = {}
    longest = 0
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        two = _merge_long(token, ranks, rank) if len(token) > 24 else merge(token, ranks, rank)
        if len(two) != 2:
            continue  # never produced by merging
        x, y = parts[token] = (two[0], two[1])
        reach, c, bound = 0, y, rank
        while True:
            if c in known:
                at = bisect_left(known[c][0], bound)
                if at:
                    reach = max(reach, known[c][1][at - 1])
            if c not in parts:
                break
            c, bound = parts[c][1], ranks[c]
        reach += len(y)
        longest = max(longest, reach)
        order, best = known.setdefault(x, ([], []))
        order.append(rank)
        best.append(max(reach, best[-1]) if best else reach)
    return longest


class _Pieces(dict):
    """Ids of each piece seen, forgotten all at once beyond `room` pieces."""

    def __init__(self, coder: Transducer, room: int) -> None:
        super().__init__()
        self.coder, self.room = coder, room

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= self.room:
            self.clear()
        ids = self.coder.piece(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Transducer:
    """Text to ids. `feed` and `finish` take a text in chunks and yield ids as soon as they are final."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int, pattern: str = PATTERN, chunk: int = 1 << 16, room: int = 1 << 18) -> None:
        self.ranks, self.look, self.chunk = ranks, lookahead, chunk
        # a window must hold any token and the bytes that make it final, or nothing in it might ever be final
        self.window = max(4 * lookahead, lookahead + max(map(len, ranks), default=0))
        self.pattern = regex.compile(pattern)
        self.cache = _Pieces(self, room)
        self._text, self._bytes, self._run = "", b"", ""

    def piece(self, data: bytes) -> list[int]:
        """Ids of a whole piece, a window at a time."""
        out: list[int] = []
        while len(data) > self.window:
            done, rest = self._stable(data[: self.window])
            out.extend(done)
            data = data[self.window - len(rest) :]
        out.extend(map(self.ranks.__getitem__, merge(data, self.ranks)))
        return out

    def _stable(self, data: bytes) -> tuple[list[int], bytes]:
        """Ids that no continuation can change, and the bytes after them."""
        ids, at = [], 0
        for token in merge(data, self.ranks):
            if at + len(token) > len(data) - self.look:
                break
            ids.append(self.ranks[token])
            at += len(token)
        return ids, data[at:]

    def _push(self, text: str, last: bool) -> Iterator[int]:
        """Bytes of a piece that is still open, or that ends here."""
        data = self._bytes + text.encode()
        while len(data) > self.window:
            ids, rest = self._stable(data[: self.window])
            yield from ids
            data = rest + data[self.window :]
        self._bytes = data
        if last:
            self._bytes = b""
            yield from self.piece(data)

    def feed(self, text: str) -> Iterator[int]:
        """Ids that are final after this chunk."""
        text = self._text + text
        if self._run:
            m = _RUNS[self._run].match(text)
            stop = m.end() if m else 0
            if stop == len(text):
                hold = 1 if self._run == "S" else 0  # the last blank may belong to what follows
                self._text = text[stop - hold :]
                yield from self._push(text[: stop - hold], False)
                return
            stop -= 1 if self._run == "S" and stop else 0
            yield from self._push(text[:stop], True)
            self._run, text = "", text[stop:]
        at = 0
        for m in self.pattern.finditer(text):
            if m.end() > len(text) - 2:
                break
            yield from self.cache[m.group()]
            at = m.end()
        self._text = text = text[at:]
        if len(text) > self.window and (m := self.pattern.match(text)) and m.end() == len(text):
            self._run = next(k for k, p in _RUNS.items() if p.match(text[-1]))
            self._text = text[-1:] if self._run == "S" else ""
            yield from self._push(text[:-1] if self._run == "S" else text, False)

    def finish(self) -> Iterator[int]:
        """The ids left at the end of the text."""
        text, self._text = self._text, ""
        if self._run:
            self._run = ""
            yield from self._push(text, True)
        else:
            for piece in self.pattern.findall(text):
                yield from self.cache[piece]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; texts longer than a chunk go through in chunks."""
        if len(text) <= self.chunk:
            return list(chain.from_iterable(map(self.cache.__getitem__, self.pattern.findall(text))))
        out: list[int] = []
        for i in range(0, len(text), self.chunk):
            out.extend(self.feed(text[i : i + self.chunk]))
        out.extend(self.finish())
        return out


def decode(ids: Iterator[int], words: dict[int, bytes], errors: str = "strict") -> Iterator[str]:
    """Text of ids as they come; a character split over tokens waits in the state of the byte decoder."""
    machine = codecs.getincrementaldecoder("utf-8")(errors)
    for i in ids:
        if text := machine.decode(words[i]):
            yield text
    if text := machine.decode(b"", True):
        yield text
