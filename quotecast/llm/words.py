"""Words of text batches as flat arrays, for use inside tasks.

A word is a run of bytes other than white space (space and the control codes 9
to 13). Bytes of longer UTF-8 characters are never white space, so byte runs and
character runs are the same words. Every function takes many rows at once.
"""

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = {}


def powers(n, inverse=False):
    """base**0 ... base**(n-1) modulo 2**64, or those of the inverse base."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        base = pow(_BASE, -1, 2**64) if inverse else _BASE
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[inverse] = np.cumprod(have)
    return have[:n]


def mix(x):
    """Spread every bit of a uint64 array over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values):
    """Prefix sums of values times powers; a run's number is their difference, shifted back."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def runs(prefix, starts, ends):
    """A 64-bit number of each run [start, end) of the values behind prefix sums."""
    size = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts] + size)


def slices(column, limit=1 << 20):
    """Split a batch's column into row ranges of about ``limit`` bytes, a row at least."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, to, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def word_spans(raw, bounds):
    """Start and end byte of every word, and the word bounds of every row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    word = ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = bounds[:-1][bounds[:-1] < len(raw)]
    first[cuts] = word[cuts]  # a row's first byte starts a word of its own
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_numbers(raw, starts, ends):
    """A 64-bit number for every word; equal words get equal numbers.

    Eight bytes at a time are mixed with their place in the word before they are
    summed, so no pattern of bytes cancels out, however long the word.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * nth
    left = np.minimum(np.repeat(ends, blocks) - at, 8).astype(np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))[at]  # the eight bytes from any byte on
    eight &= ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left)
    place = mix((nth.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    return mix(np.add.reduceat(mix(eight ^ place), first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def batches(column, lower=False):
    """(first row, end row, word numbers, word bounds of the rows) for parts of a batch."""
    for at, to, raw, bounds in slices(column):
        if lower:
            raw = LOWER[raw]
        starts, ends, rows = word_spans(raw, bounds)
        yield at, to, word_numbers(raw, starts, ends), rows


def window_numbers(numbers, size):
    """A number for the ``size`` words from every word on, also over row ends (callers mask those)."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = sums(numbers)
    return mix((prefix[size:] - prefix[:-size]) * powers(n, True))
