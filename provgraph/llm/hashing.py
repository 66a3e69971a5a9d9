"""Vectorised word hashing over Arrow string buffers.

The words of a whole batch are hashed at once in numpy: a polynomial rolling
hash over the bytes, taken between word ends and shifted back to position
zero, then mixed. Words are split at ASCII white space only, so the bytes of
other characters never need decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_R = 0x9E3779B97F4A7C15
_PIECE = 1 << 18
#: Bytes of text that operators take at once whose arrays are many times as large.
PART = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        r, q = np.full(n, _R, np.uint64), np.full(n, pow(_R, -1, 1 << 64), np.uint64)
        r[0] = q[0] = 1
        _powers, _inverse = np.cumprod(r, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def fold_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of U+00C0 to U+00DE in lower case."""
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    if not capital.any():
        return data
    data = data.copy()
    data[1:][capital] += 0x20
    return data


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses an offset."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    opens, closes = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    opens[offsets] = closes[offsets] = True
    starts = np.flatnonzero(solid & (opens[:-1] | ~np.concatenate(([False], solid[:-1]))))
    ends = np.flatnonzero(solid & (closes[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, skip: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of data[start:end] for ascending, disjoint spans.

    fold: A-Z count as a-z. skip: a mask of 256 byte values that do not count.
    """
    values = (_FOLDED if fold else _BYTE).copy()
    if skip is not None:
        values[skip] = 0
    out, at, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while at < n:
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _PIECE, "right")))
        high = ends[to - 1]
        _tables(int(high - low) + 1)
        if skip is None:
            run = np.zeros(high - low + 1, np.uint64)
            np.cumsum(values[data[low:high]] * _powers[: high - low], out=run[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (run[e] - run[s]) * _inverse[s]
        else:  # positions count kept bytes only
            kept = ~skip[data[low:high]]
            place = np.zeros(high - low + 1, np.int64)
            np.cumsum(kept, out=place[1:])
            run = np.zeros(high - low + 1, np.uint64)
            np.cumsum(values[data[low:high]] * _powers[place[:-1]], out=run[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (run[e] - run[s]) * _inverse[place[s]]
        at = to
    return mix(out)


def words_of(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, n + 1 word offsets by row, byte starts, byte ends)."""
    data, offsets = utf8(column)
    starts, ends = word_bounds(data, offsets)
    return hash_spans(data, starts, ends, fold), np.searchsorted(starts, offsets), starts, ends


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive items of each row and n + 1
    offsets; a shorter, non-empty row gives its whole sequence as one run."""
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(counts)), n)
    first = bounds[:-1][row] + np.arange(out_bounds[-1]) - out_bounds[:-1][row]
    left = np.minimum(size, counts)[row]
    total = np.zeros(len(first), np.uint64)
    if not len(first):
        return total, out_bounds
    last = len(hashes) - 1
    for k in range(size):
        item = hashes[np.minimum(first + k, last)]
        total = np.where(k < left, total * np.uint64(_R) + item, total)
    return mix(total ^ (left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), out_bounds


def unique_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and n + 1 offsets."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[fresh], row[fresh]
    return values, np.searchsorted(row, np.arange(len(bounds)))


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Parts of a record batch with about ``most`` bytes of text each; a longer
    text is alone in its part, whole."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column).cast(pa.large_string())), 0), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def fold_runs(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash of hashes[start:end] for each pair, whatever their overlap."""
    _tables(len(hashes) + 1)
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers[: len(hashes)], out=run[1:])
    return mix((run[ends] - run[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
