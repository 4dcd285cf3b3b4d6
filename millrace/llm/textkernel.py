"""Vectorised byte kernels shared by the text operators of this subpackage.

Every function works on one Arrow batch inside a task: the UTF-8 bytes of all texts of the batch
lie in one numpy buffer and words, word hashes and shingles come out of array arithmetic, without
a Python loop over words.  White space is ``[\\x20\\x09-\\x0D]``, letters ``A-Z`` are lower-cased,
null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUES = _BYTE_VALUES[LOWER]
_COMBINE = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: Bytes of text handled at once; bounds the temporary arrays of a task.
BLOCK_BYTES = 1 << 21
#: The same where words are hashed, which takes some 40 bytes for each byte of text.
WORD_BLOCK_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply), applied in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial base and of its inverse, mod 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = WORD_BLOCK_BYTES + 1 if n <= WORD_BLOCK_BYTES + 1 else max(n, BLOCK_BYTES + 1)  # stays with the worker
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def batch_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string or binary array into row ranges of about ``limit`` bytes (a longer text stands alone).

    Yields (first row, end row, bytes, offsets); row r of the block has bytes offsets[r]:offsets[r+1].
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words and the row each lies in; no word crosses a row.  ``between``: the bytes of no word."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    black = ~between[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = black[edges]
    last = black.copy()
    last[:-1] &= ~black[1:]
    last[edges - 1] = black[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans from one prefix sum of a polynomial in Z/2**64."""
    n = len(data)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER_VALUES if lower else _BYTE_VALUES)[data] * up[:n], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * down[starts]
    return mix64(value + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that stay in one row, with row and index of the first word.

    A row with fewer words (but at least one) yields its whole sequence as one shingle.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n >= size:
        inside = np.flatnonzero(rows[: n - size + 1] == rows[size - 1 :])
        value = np.full(len(inside), np.uint64(size))
        for j in range(size):
            value += words[inside + j] * _COMBINE[j]
    else:
        inside, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[heads, n])
    short = heads[counts < size]
    if len(short):
        extra = counts[counts < size].astype(np.uint64)
        for j in range(size - 1):
            has = counts[counts < size] > j
            extra[has] += words[short[has] + j] * _COMBINE[j]
        at = np.r_[inside, short]
        value, order = np.r_[value, extra], np.argsort(at, kind="stable")
        inside, value = at[order], value[order]
    return mix64(value), rows[inside], inside
