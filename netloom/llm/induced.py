"""Suffix arrays by induced sorting.

Suffixes are classed as smaller or larger than the next one. The leftmost-smaller substrings are
sorted by inducing and named in order; where names repeat, the string of names is sorted in turn
by the same recursion. From the order of the leftmost-smaller suffixes all others are induced in
one pass up and one pass down over the buckets of first characters.

A string of bytes has few buckets: a pass takes a whole bucket at a time with numpy (the stable
sort of 16-bit characters there is a counting sort, so passes are linear). A string of names has
nearly as many buckets as places, and its passes go place by place. Common prefixes are then
computed in text order: only at places whose left neighbours differ is anything compared.
"""

from __future__ import annotations

import numpy as np

#: Places of a bucket on average from which passes take whole buckets.
FULL = 64


def _by_bucket(text: np.ndarray, smaller: np.ndarray, ordered: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones in order; whole buckets at a time."""
    n, sigma = len(text), len(counts)
    end = np.cumsum(counts)
    start = end - counts
    larger = np.bincount(text[~smaller], minlength=sigma)
    leftmosts = np.bincount(text[ordered], minlength=sigma)
    present = np.flatnonzero(counts)
    sa = np.full(n, -1, np.int32)
    chars = text[ordered]
    sa[(end - np.cumsum(leftmosts))[chars] + np.arange(len(chars))] = ordered
    fill = start.copy()

    def put(found: np.ndarray, want: bool, step: int) -> None:
        before = found[found > 0] - 1
        before = before[smaller[before] == want]
        if not len(before):
            return
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        chars = chars[order]
        many = np.bincount(chars, minlength=sigma)
        at = np.arange(len(chars)) - (np.cumsum(many) - many)[chars]
        sa[fill[chars] + at if step > 0 else fill[chars] - 1 - at] = before[order]
        fill[:] += step * many

    for c in present:
        done = start[c]
        while done < fill[c]:
            done, found = fill[c], sa[done : fill[c]]
            put(found, False, 1)
        put(sa[end[c] - leftmosts[c] : end[c]], False, 1)
    fill = end.copy()
    sa[0], fill[0] = n - 1, 0
    for c in present[::-1]:
        done = end[c]
        while done > fill[c]:
            done, found = fill[c], sa[fill[c] : done][::-1]
            put(found, True, -1)
        put(sa[start[c] : start[c] + larger[c]][::-1], True, -1)
    return sa


def _by_place(text: np.ndarray, smaller: np.ndarray, ordered: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same, place by place."""
    n = len(text)
    ends = np.cumsum(counts)
    leftmosts = np.bincount(text[ordered], minlength=len(counts))
    chars = text[ordered]
    first = np.full(n, -1, np.int64)
    first[(ends - np.cumsum(leftmosts))[chars] + np.arange(len(chars))] = ordered
    sa = first.tolist()
    # the character before each place, if that is to be put in on the way up, or down; the last entry is for -1
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = text[:-1]
    up, down = before.copy(), before
    up[1:n][smaller[:-1]] = -1
    down[1:n][~smaller[:-1]] = -1
    of, head = up.tolist(), (ends - counts).tolist()
    for i in sa:  # sees what is put in ahead of it
        c = of[i]
        if c >= 0:
            h = head[c]
            sa[h] = i - 1
            head[c] = h + 1
    of, tail = down.tolist(), ends.tolist()
    for i in reversed(sa):
        c = of[i]
        if c >= 0:
            tail[c] = t = tail[c] - 1
            sa[t] = i - 1
    return np.array(sa, np.int32)


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Sorted suffixes of ``text``: non-negative integers under ``sigma``, the last one 0 and the only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    differs = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=np.int32), np.int32(n - 2))
    differs = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = (text[:-1] < text[1:])[differs]
    left = np.zeros(n, bool)
    left[1:] = smaller[1:] & ~smaller[:-1]
    leftmost = np.flatnonzero(left).astype(np.int32)
    counts = np.bincount(text, minlength=sigma)
    induce = _by_bucket if n >= FULL * np.count_nonzero(counts) else _by_place
    sa = induce(text, smaller, leftmost[np.argsort(text[leftmost], kind="stable")], counts)
    ordered = sa[left[sa]]
    # names: a substring has the one before's if it is as long and equal
    length = np.zeros(n, np.int32)
    length[leftmost] = np.diff(leftmost, append=n - 1) + 1
    same = length[ordered[1:]] == length[ordered[:-1]]
    open_, k = np.flatnonzero(same), 0
    while len(open_):
        a, b = ordered[open_], ordered[open_ + 1]
        differ = text[a + k] != text[b + k]
        same[open_[differ]] = False
        k += 1
        open_ = open_[~differ & (length[a] > k)]
    names = np.zeros(n, np.int32)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    names = names[leftmost]
    kinds = int(names.max()) + 1
    if kinds < len(names):  # some repeat: the order of the suffixes of the string of names, whose last name is least
        ordered = leftmost[suffix_array(names, kinds)]
    return induce(text, smaller, ordered, counts)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In text order: the suffix sorted just before each one, and the length of their common prefix."""
    n = len(text)
    before = np.full(n, n - 1, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    starts = np.ones(n, bool)
    starts[1:] = (before[1:] <= 0) | (text[:-1] != text[before[1:] - 1])
    starts[0] = True
    places = np.flatnonzero(starts & (before >= 0))
    other = before[places]
    # eight bytes of symbols at once, or four if they need two bytes each
    kinds = np.flatnonzero(np.bincount(text))
    symbol = np.zeros(int(kinds[-1]) + 1, np.uint8 if len(kinds) <= 256 else "<u2")
    symbol[kinds] = np.arange(len(kinds))
    symbols = symbol[text]
    bits = symbols.itemsize * 8
    lot = np.ndarray((n,), "<u8", symbols.tobytes() + bytes(8), 0, (symbols.itemsize,))
    length = np.zeros(len(places), np.int64)
    open_ = np.arange(len(places))
    a, b = places, other
    while len(open_):
        differ = lot[a] ^ lot[b]
        more = differ == 0
        low = differ[~more]
        length[open_[~more]] = a[~more] - places[open_[~more]] + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) // bits
        open_, a, b = open_[more], a[more] + 64 // bits, b[more] + 64 // bits
    common = np.zeros(n, np.int64)
    common[places] = length
    last = np.maximum.accumulate(np.where(starts, at, 0))
    return before, common[last] - (at - last)


def repeated_windows(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment: which windows of ``width`` bytes also start elsewhere, in it or in another one."""
    if not segments:
        return []
    text = np.frombuffer(b"".join([x + b"\0" for x in segments]) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    ends = np.cumsum([len(x) + 1 for x in segments])
    text[ends - 1], text[-1] = 1, 0
    sa = suffix_array(text, 258)
    before, common = permuted_common_prefixes(text, sa)
    twice = common >= width
    twice[before[twice]] = True
    return [twice[b - len(x) - 1 : max(b - width, b - len(x) - 1)] for x, b in zip(segments, ends.tolist(), strict=True)]
