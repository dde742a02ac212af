"""Cuts sequences into content-defined phrases, with hashes of spans.

A window is ``width`` consecutive items (words or bytes). Each window belongs to the least hash
of the short grams within it, its anchor, so equal windows have equal anchors wherever they
stand. A phrase is a run of consecutive windows with the same anchor. Equal windows can only be
found in phrases with the same anchor, and a phrase that occurs twice as a whole settles all its
windows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

U = np.uint64
#: Odd multipliers of the two polynomial hashes, and those of the finaliser (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Low bits of a gram's hash that give way to its place, so that the leftmost of equal grams is least; pieces have fewer items.
PLACE = U((1 << 21) - 1)
#: Bytes that one pass takes, and a longer text is cut into.
PASS_BYTES, PIECE_BYTES = 1 << 18, 1 << 20
#: Salt of each byte in the hash of a word.
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(MIX[0])
    x = (x ^ (x >> U(27))) * U(MIX[1])
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[base] = (both[0], both[1])
    return _powers[base]


class Spans:
    """Hashes of spans of a sequence of 64-bit values; equal spans have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of values first to last - 1."""
        return mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(U))

    def every(self, length: int) -> np.ndarray:
        """Of all spans of a length, by where they start, without the last mixing."""
        n = max(len(self.sums) - length, 0)
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n else np.zeros(0, U)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Phrases(NamedTuple):
    text: np.ndarray  # which text
    first: np.ndarray  # its first window, counted from the text's start
    n: np.ndarray  # windows
    anchor: np.ndarray
    phrase: np.ndarray  # hash of the items that the windows cover
    twice: np.ndarray  # windows can repeat within


class Items:
    """Items of some texts in a row: values, and where each text begins and ends."""

    def __init__(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: int) -> None:
        self.values, self.begin, self.end, self.reach = values, begin, end, reach
        self.one, self.two = Spans(values, BASES[0]), None

    def span(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.one(first, last - (self.reach - 1))

    def window_hashes(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each window."""
        if self.two is None:
            self.two = Spans(mix(self.values ^ U(BASES[1])), BASES[1])
        last = starts + width - (self.reach - 1)
        return self.one(starts, last).view(np.int64), self.two(starts, last).view(np.int64)

    def phrases(self, width: int, gram: int, longest: int) -> Phrases:
        size = len(self.values) + self.reach - 1
        valid = np.zeros(max(size - width + 1, 0) + 1, bool)
        for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True):
            if b - a >= width:
                valid[a : b - width + 1] = True
        if not valid.any():
            return Phrases(*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, U),) * 2, np.zeros(0, bool))
        grams = self.one.every(gram - self.reach + 1)
        place = np.arange(len(grams), dtype=U)
        least = sliding_min((grams & ~PLACE) | place, width - gram + 1)
        change = (least[1:] ^ least[:-1]) > PLACE
        opens = valid[:-1].copy()
        opens[1:] &= ~valid[:-2] | change
        closes = valid[:-1] & ~valid[1:]
        closes[:-1] |= valid[:-2] & change
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        # windows of a phrase can only be equal if their anchors stand in different places
        twice, anchor = least[first] != least[last], mix(grams[(least[first] & PLACE).astype(np.int64)])
        parts = -(-(last - first + 1) // longest)
        if (parts > 1).any():
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            stop = np.repeat(last, parts)
            first = np.repeat(first, parts) + step * longest
            last, anchor, twice = np.minimum(first + longest - 1, stop), np.repeat(anchor, parts), np.repeat((parts > 1) | twice, parts)
        text = np.searchsorted(self.begin, first, side="right") - 1
        return Phrases(text, first - self.begin[text], last - first + 1, anchor, self.span(first, last + width), twice)


def byte_pieces(text: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that share width - 1 bytes, with where they begin."""
    for at in range(0, max(len(text) - width + 1, 1), PIECE_BYTES):
        yield at, text[at : at + PIECE_BYTES + width - 1]


def word_pieces(text: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that share width - 1 words, with the words before them."""
    if len(text) <= PIECE_BYTES:
        yield 0, text
        return
    words, step = text.split(), PIECE_BYTES // 8
    for at in range(0, max(len(words) - width + 1, 1), step):
        yield at, b" ".join(words[at : at + step + width - 1])


def passes(texts: list[bytes], pieces: Callable[[bytes, int], Iterator[tuple[int, bytes]]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Pieces of the texts in lots of about PASS_BYTES: the text that each is of, where it begins, and the pieces."""
    rows: list[int] = []
    begins: list[int] = []
    lot: list[bytes] = []
    size = 0
    for row, text in enumerate(texts):
        for at, piece in pieces(text, width):
            if lot and size + len(piece) > PASS_BYTES:
                yield np.array(rows), np.array(begins), lot
                rows, begins, lot, size = [], [], [], 0
            rows.append(row)
            begins.append(at)
            lot.append(piece)
            size += len(piece)
    if lot:
        yield np.array(rows), np.array(begins), lot


def byte_items(texts: list[bytes]) -> Items:
    """The bytes of texts; a value mixes eight bytes, so spans are of eight or more."""
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    end = np.cumsum([len(x) for x in texts])
    n = max(len(data) - 15, 0)
    eight = np.ndarray((n,), "<u8", data.tobytes(), 0, (1,)) if n else np.zeros(0, U)
    return Items(mix(eight.astype(U)), end - np.array([len(x) for x in texts]), end, 8)


def word_items(texts: list[bytes]) -> Items:
    """The words of texts."""
    data = np.frombuffer(b"".join([b" " + x for x in texts]) + b" ", np.uint8)
    space = SPACE[data]
    first, last = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    begin = np.cumsum([0] + [len(x) + 1 for x in texts])
    edges = np.searchsorted(first, begin)
    return Items(Spans(BYTES[data], BASES[1])(first, last), edges[:-1], edges[1:], 1)
