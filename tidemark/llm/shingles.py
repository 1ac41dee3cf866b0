"""Sets of word shingles of whole texts, as sorted 64-bit hashes, from batches of Arrow strings.

Words are what lies between white space (space and \\x09-\\x0D), with A-Z lower-cased. The
hash of a word is a polynomial over its bytes' random values modulo 2**64, taken from
running sums, so whole batches are hashed at once; a shingle's hash mixes its words'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
#: Bytes of text that are hashed at once.
SLICE_BYTES = 750_000

U = np.uint64
_MUL = 0x9E3779B97F4A7C15
_INVERSE = pow(_MUL, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them well."""
    x = x.astype(U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(factor)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(256, dtype=U) + U(_MUL))
_BYTES[65:91] = _BYTES[97:123]
#: Each byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(max(n - 1, 0), base, U)]), dtype=U)[:n]


def strings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null texts are empty."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]] if len(ends) else raw[:0], ends - ends[0]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES each; a longer text is a run of its own."""
    _, ends = strings(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, "right")) - 1)
        yield start, min(stop, len(texts))
        start = stop


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, and where each word begins and ends."""
    raw, ends = strings(texts)
    if not len(raw):
        return raw, np.empty(0, np.int64), np.empty(0, np.int64)
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # whether a text begins or ends before this byte
    edge[ends] = True
    letter = ~space
    begins = np.flatnonzero(letter & np.concatenate([[True], space[:-1]]) | letter & edge[:-1])
    last = np.flatnonzero(letter & np.concatenate([space[1:], [True]]) | letter & edge[1:]) + 1
    return raw, begins, last


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each text's words."""
    raw, begins, last = word_spans(texts)
    if not len(raw):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    sums = np.concatenate([[U(0)], np.cumsum(_BYTES[raw] * _powers(_MUL, len(raw)), dtype=U)])
    hashes = mix((sums[last] - sums[begins]) * _powers(_INVERSE, len(raw))[begins] + (last - begins).astype(U))
    return hashes, np.searchsorted(begins, strings(texts)[1])


def shingle_hashes(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words (all words as one, where a text has fewer), and the text that it is in."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    n = np.maximum(counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(bounds[:-1], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(np.repeat(counts, n), size)
    out = length.astype(U)
    padded = np.concatenate([words, np.zeros(size, U)])
    for i in range(size):
        out = mix(out * U(0xD6E8FEB86659FD93) + np.where(i < length, padded[first + i], U(0)))
    return out, owner


def sets(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets one after another, each sorted, and their bounds."""
    hashes, owner = shingle_hashes(texts, size)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit key per set: equal sets have equal keys."""
    sums = np.concatenate([[U(0)], np.cumsum(mix(hashes ^ U(0x5851F42D4C957F2D)), dtype=U)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U)).astype(np.int64)
