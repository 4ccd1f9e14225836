"""Simple-8b: a word-aligned code for small integers.

A 64-bit word has a selector in its top four bits, which tells how many integers of how many bits the other 60 hold. The first two
selectors stand for runs of zeros. An integer that does not fit into 60 bits, or is all ones there, is an escape: its word holds 60 ones and the
integer itself stands in a list of its own, in order.

Words are packed for documents one after another: no word holds ids of two documents, so coded documents can be joined as they are.
"""

from __future__ import annotations

import numpy as np

#: fixed values of the code: integers in a word and bits of each, by selector
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

ESCAPE = np.uint64((1 << 60) - 1)


_FEW = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each integer needs; 60 for escapes."""
    if int(ids.max()) < 1 << 16:
        return _FEW[ids.astype(np.intp)]
    return np.searchsorted(np.array([1 << b for b in range(60)], np.uint64), ids, side="right").astype(np.uint8)


def _selectors(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each place the selector that takes most integers from there on, of those that fit and of the ``left`` ones of its document (255 for more)."""
    widest = {1: bits}  # the most bits in the next 1, 2, ... integers

    def most(n: int) -> np.ndarray:
        if n not in widest:
            half = max(c for c in (1, 2, 4, 8, 15, 30, 60, 120) if c < n and 2 * c >= n)
            whole = most(half)
            out = np.full(len(bits), 255, np.uint8)
            if len(bits) >= n:
                np.maximum(whole[: len(bits) - n + 1], whole[n - half : len(bits) - half + 1], out=out[: len(bits) - n + 1])
            widest[n] = out
        return widest[n]

    best = np.full(len(bits), 15, np.uint8)
    for s in range(14, -1, -1):  # where one fits, all after it do: they take fewer integers of more bits
        fits = (most(int(COUNTS[s])) <= np.uint8(BITS[s])) & (left >= np.uint8(COUNTS[s]))
        if not fits.any():
            break
        best -= fits
    return best


def _firsts(steps: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the first integers of words: from each document's first one by the steps there, in many documents at a time."""
    is_first = np.zeros(len(steps), bool)
    on = sizes > 0
    at, end = (ends - sizes)[on], ends[on]
    while len(at) > 16:
        is_first[at] = True
        at = at + steps[at]
        on = at < end
        if not on.all():
            at, end = at[on], end[on]
    for a, b in zip(at.tolist(), end.tolist(), strict=True):
        held, own, i = steps[a:b].tobytes(), [], 0
        while i < b - a:
            own.append(i)
            i += held[i]
        is_first[a + np.array(own)] = True
    return np.flatnonzero(is_first)


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of ``sizes`` integers each, given one after another: (words, words of each document, escapes, escapes of each document)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    ends = np.cumsum(sizes)
    if not len(ids):
        none = np.zeros(len(sizes), np.int64)
        return np.zeros(0, np.uint64), none, ids, none
    large = ids >= ESCAPE
    fields = np.where(large, ESCAPE, ids)
    left = np.minimum(np.repeat(ends, sizes) - np.arange(len(ids)), 255).astype(np.uint8)
    selector = _selectors(_bits(fields), left)
    first = _firsts(COUNTS.astype(np.uint8)[selector], ends, np.asarray(sizes))
    own = selector[first]
    words = own.astype(np.uint64) << np.uint64(60)
    for s in np.unique(own):
        if BITS[s]:
            on = np.flatnonzero(own == s)
            value = np.zeros(len(on), np.uint64)
            for j in range(COUNTS[s]):
                value |= fields[first[on] + j] << np.uint64(j * BITS[s])
            words[on] |= value
    edges = np.append(0, ends)
    n_words = np.diff(np.searchsorted(first, edges))
    n_escapes = np.diff(np.searchsorted(np.flatnonzero(large), edges))
    return words, n_words, ids[large], n_escapes


def counts(words: np.ndarray) -> np.ndarray:
    """Integers in each word."""
    return COUNTS[(words >> np.uint64(60)).astype(np.int64)]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The integers of words in order, all words of one selector at a time."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selector])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - COUNTS[selector]
    for s in np.unique(selector):
        if BITS[s]:
            on = np.flatnonzero(selector == s)
            held, mask = words[on], np.uint64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                out[starts[on] + j] = (held >> np.uint64(j * BITS[s])) & mask
            if s == 15:
                out[starts[on[held & ESCAPE == ESCAPE]]] = escapes
    return out
