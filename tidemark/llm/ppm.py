"""Prediction by partial matching over bytes: the trie of byte contexts as sorted arrays.

A text is coded as its words in order, each closed by a space; its end is a further space.
The context of a byte is the ORDER bytes before it, across the borders of words; before the
text there are spaces. A context of k bytes and a symbol are one integer, so the trie is two
sorted arrays. ``ngrams`` and ``log10`` take short sequences whose contexts stop at their
beginning.

Escapes are estimated by method C: a context seen n times with q different symbols escapes
with q parts in n + q. After an escape, the symbols of the longer context are excluded from
the shorter one. As a context's symbols also occur in each of its suffixes, what is excluded
is one number per context, so symbols are coded for whole arrays at once.
"""

from __future__ import annotations

import numpy as np

ORDER = 5
SPACE = 32
U = np.uint64
_ORDER_SHIFT, _LOW = U(56), U((1 << 56) - 1)


def laid_out(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens' bytes with a space before and after each: bytes, place within the token (0: the space before), and the token of each byte."""
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size)), size + 2)
    start = ends[:-1] + 2 * np.arange(len(size))
    place = np.arange(len(owner)) - start[owner]
    out = np.full(len(owner), SPACE, np.uint8)
    inside = (place > 0) & (place <= size[owner])
    out[inside] = raw[ends[0] : ends[-1]]
    return out, place, owner


def contexts(symbols: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes before each byte as an integer, the nearest lowest."""
    out = np.zeros(len(symbols), U)
    for j in range(order):
        out[j + 1 :] |= symbols[: max(len(symbols) - j - 1, 0)].astype(U) << U(8 * j)
    return out


def keyed(context: np.ndarray, order: int) -> np.ndarray:
    return context | (U(order + 1) << _ORDER_SHIFT)


def ngrams(raw: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every context with every symbol after it, and how often: sorted keys and counts."""
    symbols, place, owner = laid_out(raw, ends)
    keys, weights = [], []
    for k in range(ORDER + 1):
        at = np.flatnonzero(place >= max(k, 1))
        key, inverse = np.unique(keyed(contexts(symbols, k)[at] << U(8) | symbols[at].astype(U), k), return_inverse=True)
        keys.append(key)
        weights.append(np.bincount(inverse, counts[owner[at]], len(key)))
    return np.concatenate(keys), np.concatenate(weights).astype(np.int64)


def running(raw: np.ndarray, letter: np.ndarray, sizes: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of running texts with the ORDER bytes before it as one integer, and each text's number of bytes.

    ``letter`` tells which bytes of ``raw`` are in words, ``sizes`` the words' lengths and ``text_of`` the text of each word.
    """
    words = np.bincount(text_of, minlength=n)
    letters = np.bincount(text_of, sizes, n).astype(np.int64)
    coded = letters + words + 1
    start = np.concatenate([[0], np.cumsum(coded + ORDER)])
    symbols = np.full(start[-1], SPACE, np.uint8)
    shift = np.arange(len(sizes)) + (ORDER + 1) * text_of + ORDER
    symbols[np.repeat(shift, sizes) + np.arange(int(letters.sum()))] = raw[letter]
    keys = contexts(symbols, ORDER) << U(8) | symbols
    inside = np.ones(len(symbols), bool)
    inside[(start[:-1, None] + np.arange(ORDER)).ravel()] = False
    return keys[inside], coded


def levels(keys: np.ndarray, counts: np.ndarray, longest: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams with contexts of ``longest`` down to ``shortest`` bytes, as in a trie, from those with contexts of ``longest`` bytes or more."""
    out, sums = [], []
    for k in range(longest, shortest - 1, -1):
        keys, inverse = np.unique(keys & U((1 << (8 * (k + 1))) - 1), return_inverse=True)
        counts = np.bincount(inverse, counts, len(keys))
        out.append(keyed(keys, k))
        sums.append(counts)
    return np.concatenate(out), np.concatenate(sums)


class Trie:
    """Counts of the n-grams given, at most those that the caller keeps in memory."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(float)
        k = (self.keys >> _ORDER_SHIFT) - U(1)
        context = ((self.keys & _LOW) >> U(8)) | ((k + U(1)) << _ORDER_SHIFT)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, int)
        self.context = context[first]
        self.total = np.add.reduceat(self.counts, first) if len(first) else np.empty(0)
        self.different = np.diff(np.append(first, len(context))).astype(float)
        # count of each n-gram's symbol in the next shorter context
        shorter = np.zeros(len(self.keys))
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(k == U(n))
            kept = (self.keys[at] & _LOW) & U((1 << (8 * n)) - 1)
            where = np.minimum(np.searchsorted(self.keys, found := keyed(kept, n - 1)), len(self.keys) - 1)
            shorter[at] = np.where(self.keys[where] == found, self.counts[where], 0)
        self.excluded = np.add.reduceat(shorter, first) if len(first) else np.empty(0)

    def log10(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each token's log10 probability."""
        return self.coded(*laid_out(raw, ends), len(ends) - 1)

    def coded(self, symbols: np.ndarray, place: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The log10 probabilities of bytes in their contexts, summed per owner; bytes at place 0 are given, not coded."""
        at = np.flatnonzero(place >= 1)
        each = self.each(contexts(symbols, ORDER)[at], symbols[at], place[at])
        return np.bincount(owner[at], each, n)

    def each(self, before: np.ndarray, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol after the ORDER bytes before it, of which ``place`` count."""
        out = np.zeros(len(symbols))
        left = np.arange(len(symbols))
        gone_total, gone_different = np.zeros(len(left)), np.zeros(len(left))
        for k in range(ORDER, -1, -1):
            if not len(left) or not len(self.context):
                break
            context = before[left] & U((1 << (8 * k)) - 1)
            c = np.minimum(np.searchsorted(self.context, key := keyed(context, k)), len(self.context) - 1)
            known = (self.context[c] == key) & (place[left] >= k)
            g = np.minimum(np.searchsorted(self.keys, key := keyed(context << U(8) | symbols[left].astype(U), k)), len(self.keys) - 1)
            hit = known & (self.keys[g] == key)
            total = self.total[c] - gone_total
            different = self.different[c] - gone_different
            whole = total + different
            step = np.where(hit, self.counts[g], different) / np.where(whole > 0, whole, 1)
            step = np.where(known & (whole > 0), step, 1.0)
            out[left] += np.log10(np.maximum(step, 1e-300))
            gone_total = np.where(known, self.excluded[c], gone_total)
            gone_different = np.where(known, self.different[c], gone_different)
            stay = ~hit
            left, gone_total, gone_different = left[stay], gone_total[stay], gone_different[stay]
        # symbols never seen share what the last escape leaves: all bytes that no context has
        out[left] -= np.log10(np.maximum(256 - gone_different, 1))
        return out
