"""Words of whole Arrow batches of texts, found on the UTF-8 bytes with numpy.

A word is a maximal run of bytes of a given class; A-Z are lower-cased first. Each word gets a
64-bit hash from a polynomial over its bytes, finished with a mixing step. A text that is null
has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, INVERSE)):
            a = np.full(n, b, U64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all of its bits depend on all of the input's."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text starts, with the end last. Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    if len(texts) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text stands alone."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end (bytes) of each word, in order."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, U64), e, e, e
    low = LOWER[data]
    is_word = inside[low]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    before[first] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[at[1:][at[:-1] < at[1:]] - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    up, down = _grown(n + 1)
    total = np.zeros(n + 1, U64)
    sums = total[1:]  # in place: 8 bytes for each of the text's bytes are enough
    sums += low
    sums += U64(1)
    sums *= up[:n]
    np.cumsum(sums, out=sums)
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    return hashed, np.searchsorted(at, start, "right") - 1, start, end


def word_hashes(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, in order, by pieces of the texts: what words() needs meanwhile is many times its input."""
    hashed, doc = [], []
    for lo, hi in pieces(data, at):
        part = at[lo : hi + 1]
        h, d, _, _ = words(data[part[0] : part[-1]], part - part[0], inside)
        hashed.append(h)
        doc.append(d + lo)
    return np.concatenate(hashed), np.concatenate(doc)
