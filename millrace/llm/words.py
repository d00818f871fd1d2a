"""Words of whole texts as 64-bit hashes, found for many texts at once.

Bytes are classed by a table, words are the runs between separators, and a word's hash is the mixed sum of its bytes'
random numbers times powers of an odd number, taken from sums over the whole slice. Arrow's
own buffers are read, without a Python object for a text. Two different words share a hash with a chance of about 2^-60; memory follows SLICE, not the
length of a batch or text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are held as arrays at once.
SLICE = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


class Table:
    """Which bytes part words, and a random number for each byte in lower case."""

    def __init__(self, separators: Iterable[int]):
        lower = np.arange(256)
        lower[65:91] += 32
        self.parts = np.zeros(256, bool)
        self.parts[list(separators)] = True
        self.random = _RANDOM[lower]


#: Words of anything but the space and the controls from tab to carriage return.
SPACED = Table([0x20, *range(0x09, 0x0E)])
#: Words of letters, digits and everything beyond ASCII.
ALNUM = Table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UP, _DOWN = _powers(_ODD, SLICE + 1), _powers(pow(_ODD, -1, 1 << 64), SLICE + 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashed(data: np.ndarray, table: Table, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word; no word goes over a cut."""
    inside = ~table.parts[data]
    begin, stop = inside.copy(), np.zeros(len(data) + 1, bool)
    begin[1:] &= ~inside[:-1]
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    stop[cuts] = inside[cuts - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    up, down = (_UP, _DOWN) if len(data) < len(_UP) else (_powers(_ODD, len(data)), _powers(pow(_ODD, -1, 1 << 64), len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table.random[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start]), start


def _pieces(data: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices that end behind a separator, so that words stay whole; a word longer than a slice makes a longer one."""
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):
            back = np.flatnonzero(parts[data[max(at, end - 4096) : end]])
            if len(back):
                end = max(at, end - 4096) + int(back[-1]) + 1
                break
            end = min(end + 4096, len(data))
        yield at, end
        at = end


def texts_of(texts: Iterable[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (and the last ends); nulls are empty."""
    column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.large_string(), from_pandas=True)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    own = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), own


def tokens(texts: Iterable[str | None] | pa.Array, table: Table = SPACED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes, ends): words of neighbouring texts, where text i ends with word ends[i - first].

    Whole texts come together, about SLICE bytes at once; a longer text comes alone.
    """
    data, offsets = texts_of(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        own, cuts = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if len(own) > SLICE:
            h = np.concatenate([_hashed(own[a:e], table, cuts[:0])[0] for a, e in _pieces(own, table.parts)])
            yield first, h, np.array([len(h)])
        else:
            h, start = _hashed(own, table, cuts)
            yield first, h, np.searchsorted(start, cuts[1:])
        first = last


def sequences(texts: Iterable[str | None] | pa.Array, table: Table = SPACED) -> Iterator[np.ndarray]:
    """The word hashes of one text after the other."""
    for _, h, ends in tokens(texts, table):
        yield from np.split(h, ends[:-1])
