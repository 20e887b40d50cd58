"""Pre-tokens of many texts at once: boundaries from classes of code points in flat arrays, and the distinct ones among them."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .buffers import mix, powers

BLANK, SPACE, LETTER, NUMBER, OTHER = range(5)
#: Code points that the pattern's \s stands for, beside the blank.
_SPACES = (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_PLACES = powers(0x5851F42D4C957F2D, 4096)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for first, end in ((0, 0xD800), (0xE000, 0x110000)):  # surrogates aren't characters
        chars = "".join(map(chr, range(first, end)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, chars):
                out[first + m.start() : first + m.end()] = kind
    out[list(_SPACES)] = SPACE
    out[0x20] = BLANK
    return out


def code_points(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(code points, byte where each begins) of UTF-8; None where every byte is one."""
    if not len(flat) or flat.max() < 0x80:
        return flat, None
    at = np.flatnonzero((flat & 0xC0) != 0x80)
    lead = flat[at]
    points = lead.astype(np.int32)
    for low, high, more, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0xF8, 3, 0x07)):
        these = np.flatnonzero((lead >= low) & (lead < high))
        value = (lead[these] & mask).astype(np.int32)
        for j in range(1, more + 1):
            value = (value << 6) | (flat[at[these] + j] & 0x3F)
        points[these] = value
    return points, at


def boundaries(flat: np.ndarray, ends: np.ndarray, special: re.Pattern[bytes] | None = None) -> np.ndarray:
    """First bytes of the pre-tokens, which tile ``flat``. No pre-token crosses a text's end; a match of ``special`` is one by itself.

    Runs of letters, numbers and other marks take one blank before them along; of white space before a mark the last one stands alone or goes along;
    an apostrophe that stands by itself takes s, t, m, d, re, ve or ll along."""
    if not len(flat):
        return np.empty(0, np.int64)
    whole: list[tuple[int, int]] = []
    if special is not None and special.search(flat):
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            whole += [(a + m.start(), a + m.end()) for m in special.finditer(flat[a:b])]
    points, at = code_points(flat)
    kind = kinds()[points]
    n = len(kind)
    fresh = np.zeros(n + 1, bool)  # a text or a part of one begins here
    edges = np.concatenate((ends, np.array(whole, np.int64).ravel()))
    fresh[edges if at is None else np.searchsorted(at, edges)] = True
    white = kind <= SPACE
    group = np.maximum(kind, SPACE)
    run = fresh[:-1].copy()
    run[0] = True
    run[1:] |= group[1:] != group[:-1]
    starts = run.copy()
    joined = ~fresh[1:-1] & (kind[:-1] == BLANK) & ~white[1:]
    starts[1:] &= ~joined
    starts[:-1] |= white[:-1] & ~white[1:] & ~fresh[1:-1]
    quote = np.flatnonzero(points[:-2] == 0x27) if n > 2 else np.empty(0, np.int64)
    if n > 1 and points[n - 2] == 0x27:
        quote = np.append(quote, n - 2)
    if len(quote):
        quote = quote[run[quote] & starts[quote] & run[quote + 1] & ~fresh[quote + 1]]
        one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, (0x73, 0x74, 0x6D, 0x64))
        long = ~fresh[quote + 2] & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & (quote + 2 < n)
        starts[quote[short | long] + 1] = False
        after = np.concatenate((quote[short] + 2, quote[long] + 3))
        starts[after[after < n]] = True
    for a, b in whole:
        i, j = (a, b) if at is None else np.searchsorted(at, (a, b))
        starts[i:j] = False
        starts[i] = True
    found = np.flatnonzero(starts)
    return found if at is None else at[found]


def distinct(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each pre-token's word, the words): equal byte strings have one number. Hashes find them, and the bytes are compared."""
    n = len(flat)
    sizes = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, sizes)
    hashes = mix(np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * _PLACES[place & 4095], starts) + sizes.astype(np.uint64))
    coded = pa.array(hashes).dictionary_encode()
    number = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    raw = flat.tobytes()
    twin = first[number]
    if (sizes[twin] != sizes).any() or (flat[np.repeat(starts[twin], sizes) + place] != flat).any():  # two words of one hash
        numbers: dict[bytes, int] = {}
        number = np.array([numbers.setdefault(raw[a : a + k], len(numbers)) for a, k in zip(starts.tolist(), sizes.tolist(), strict=True)], np.int32)
        return number, list(numbers)
    return number, [raw[a : a + k] for a, k in zip(starts[first].tolist(), sizes[first].tolist(), strict=True)]
