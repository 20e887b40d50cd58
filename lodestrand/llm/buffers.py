"""Arrow string columns as flat UTF-8 byte arrays, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, offsets - offsets[0]


def slices(flat: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in runs of rows of about ``limit`` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, rows)
        yield row, end, flat[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values: xor-shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling the reach of each position."""
    if width <= 1 or len(values) < width:
        return values if width <= 1 else values[:0]
    reach, out = 1, values
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:-rest], out[rest:]) if rest else out


#: Each byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_PLACES = powers(0x5851F42D4C957F2D, 4096)


def words_in(flat: np.ndarray, ends: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first byte, end byte, 64-bit hash) of each word, A-Z lower-cased. ``in_word`` says of each byte value whether words hold it.

    Words end with their text, whatever the next text begins with."""
    inside = in_word[flat]
    if not inside.any():
        none = np.empty(0, np.int64)
        return none, none, none, none
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    heads = ends[:-1][ends[:-1] < len(flat)]
    opens[heads] |= inside[heads]
    tails = ends[1:][ends[1:] > 0] - 1
    closes[tails] |= inside[tails]
    first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sizes = end - first
    at = np.cumsum(sizes) - sizes
    letters = LOWER[flat[inside]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(letters)) - np.repeat(at, sizes)
    hashes = mix(np.add.reduceat(letters * _PLACES[place & 4095], at) + sizes.astype(np.uint64)).view(np.int64)
    text = np.searchsorted(ends, first, "right") - 1
    return text, first, end, hashes
