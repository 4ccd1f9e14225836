"""Words and word hashes of many texts at once.

A text column of an Arrow batch is one byte buffer with offsets; words, their 64-bit hashes and
k-gram hashes come from a few numpy passes over that buffer. Nothing here depends on Spark, the
process or its hash seed, so equal words hash alike on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts handled by one numpy pass; a longer text is a pass of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: words are [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    ALNUM[_lo : _hi + 1] = False

_B = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word in order: row, start, length and 64-bit hash of its bytes with A-Z lower-cased."""
    n = len(data)
    member = is_word[data]
    at = np.flatnonzero(member)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1]] = True
    opens = np.empty(len(at), bool)
    opens[0] = True
    opens[1:] = (at[1:] != at[:-1] + 1) | edge[at[1:]]
    first = np.flatnonzero(opens)
    lengths = np.diff(np.append(first, len(at)))
    starts = at[first]
    place = np.arange(len(at)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()) + 1, _B, np.uint64))
        h = np.add.reduceat((LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * powers[place], first)
        h = mix(h + lengths.astype(np.uint64) * _Q)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, starts, lengths, h


def grams(rows: np.ndarray, h: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of every run of k consecutive words of a row.

    With ``short``, a row of fewer words, but not none, has one gram of all of them.
    Place is the index of the run's first word in the arrays given.
    """
    if not len(rows):
        return rows, rows, h
    with np.errstate(over="ignore"):
        n = len(rows) - k + 1
        if n > 0:
            g = np.zeros(n, np.uint64)
            for i in range(k):
                g = g * _Q + h[i : i + n]
            place = np.flatnonzero(rows[:n] == rows[k - 1 :])
            g = mix(g[place] + np.uint64(k))
        else:
            place, g = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if not short:
            return rows[place], place, g
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        count = np.diff(np.append(first, len(rows)))
        few = first[count < k]
        if len(few):
            many = count[count < k]
            fold = np.zeros(len(few), np.uint64)
            for i in range(k - 1):
                has = many > i
                fold[has] = fold[has] * _Q + h[few[has] + i]
            place = np.concatenate([place, few])
            g = np.concatenate([g, mix(fold + many.astype(np.uint64))])
    return rows[place], place, g


def gram_sets(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, gram), sorted by row and gram."""
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    if len(g):
        keep = np.append(True, (rows[1:] != rows[:-1]) | (g[1:] != g[:-1]))
        rows, g = rows[keep], g[keep]
    return rows, g
