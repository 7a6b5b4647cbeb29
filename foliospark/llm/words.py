"""Vectorised word scanning: numpy over UTF-8 bytes, no Python object per word.

A word is a maximal run, after lower-casing, of ASCII letters and digits and of
characters from U+00C0 on, without U+00D7, U+00F7, U+2000-U+206F and U+3000-U+303F
(``WORD_RE`` is the same as a regular expression). Words are 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_RE = "[0-9a-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{1fff}\\x{2070}-\\x{2fff}\\x{3040}-\\x{10ffff}]+"
_BLANK = re.compile("[\u0080-¿×÷ -⁯　-〿]+")
_TABLE = np.zeros(256, bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _TABLE[_a:_b] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def plain(text: str | None) -> bytes:
    """Lower-cased UTF-8 with the excluded characters blanked; null counts as empty."""
    if not text:
        return b""
    text = text.lower()
    if not text.isascii():
        text = _BLANK.sub(" ", text)
    return text.encode("utf-8", "replace")


def hash_spans(joined: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time; 8 more bytes must follow the last one."""
    view = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    h = (lens.astype(np.uint64) * U(2) + U(1)) * _GOLD
    at, left, idx = starts, lens, None
    while len(at):
        v = view[at] & _MASK[np.minimum(left, 8)]
        if idx is None:
            h = mix(h ^ v)
        else:
            h[idx] = mix(h[idx] ^ v)
        more = np.flatnonzero(left > 8)
        idx = more if idx is None else idx[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def scan(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Word hashes of all texts in order, word starts and ends in the joined bytes, the first
    word of each text (one entry more than texts) and the joined bytes."""
    parts = [plain(t) for t in texts]
    joined = b" " + b" ".join(parts) + b" " * 9
    data = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(_TABLE[data].view(np.int8)))
    edge += 1
    starts, ends = edge[0::2], edge[1::2]
    h = hash_spans(joined, starts, ends - starts)
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)), out=bounds[1:])
    return h, starts, ends, np.searchsorted(starts, bounds + 1), joined


def doc_of(first: np.ndarray) -> np.ndarray:
    """The text index of each word, from ``first`` as ``scan`` returns it."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the n-grams of words that stay within one text."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    pos = np.flatnonzero(left >= n)
    g = h[pos]
    for k in range(1, n):
        g = mix(g * U(2 * k + 1) + h[pos + k])
    return g, pos


def blocks(batches: Iterator, size: int) -> Iterator[tuple]:
    """Regroup Arrow batches (columns: any keys, then text last) into lists of whole rows with
    about ``size`` characters of text; a longer single text makes a block of its own."""
    keys: list[list] | None = None
    texts: list = []
    chars = 0
    for whole in batches:
        for b in slices(whole):
            cols = [c.to_pylist() for c in b.columns]
            if keys is None:
                keys = [[] for _ in cols[:-1]]
            for k, t in enumerate(cols[-1]):
                for to, c in zip(keys, cols):
                    to.append(c[k])
                texts.append(t)
                chars += len(t or "") + 1
                if chars >= size:
                    yield *keys, texts
                    keys, texts, chars = [[] for _ in keys], [], 0
    if texts:
        yield *keys, texts
    give_back()


def slices(batch, rows: int = 512) -> Iterator:
    """A batch in parts of few rows: only their values become Python objects at a time."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def give_back() -> None:
    """Hand freed memory back to the system: idle workers count towards their executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
