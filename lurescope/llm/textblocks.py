"""Words and n-gram hashes of many texts at once, on the bytes of an Arrow column.

Texts are UTF-8. A block joins some texts with one space after each, so that one numpy
pass serves them all and no word or n-gram crosses a text. A block holds about
``BLOCK_BYTES``; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base, kept between calls."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << int(n - 1).bit_length()
        table = np.full(size, _BASE, dtype=np.uint64)
        table[0] = 1
        _POWERS = np.multiply.accumulate(table)
    return _POWERS[:n]


@dataclass
class Block:
    """Texts ``first`` to ``first + count`` of a batch as one byte array."""

    first: int
    count: int
    data: np.ndarray
    starts: np.ndarray  # of each text, with the end of the last one behind

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts) - 1


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # index of the text within the block
    hash: np.ndarray
    first_word: np.ndarray  # per text: index of its first word; number of words behind


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks; a null is an empty text.

    Only one block's texts are copied out of the column at a time.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()

    def block(first: int, end: int) -> Block:
        return _block([x or b"" for x in column.slice(first, end - first).cast(pa.binary()).to_pylist()], first)

    first, size = 0, 0
    for i, n in enumerate(sizes):
        if i > first and size + n > limit:
            yield block(first, i)
            first, size = i, 0
        size += n
    if sizes:
        yield block(first, len(sizes))


def _block(texts: list[bytes], first: int) -> Block:
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return Block(first, len(texts), data, starts)


def words(block: Block, letters: bool = False, lower: bool = False) -> Words:
    """Words between white space (or runs of letters), with a 64-bit hash each.

    ``lower`` folds A to Z only. Bytes of 128 and above count as letters.
    """
    data = _LOWER[block.data] if lower else block.data
    inside = _LETTER[data] if letters else ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    text = np.searchsorted(block.starts, start, side="right") - 1
    first_word = np.searchsorted(start, block.starts)
    if not len(start):
        return Words(start, end, text, np.zeros(0, np.uint64), first_word)
    length = end - start
    within = np.arange(length.sum(), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
    coded = _BYTE_CODE[data[inside]] * powers(int(length.max()))[within]
    sums = np.add.reduceat(coded, np.cumsum(length) - length)
    return Words(start, end, text, mixed(sums + length.astype(np.uint64)), first_word)


def ngrams(w: Words, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each group of words at these offsets, within one text.

    ``(0, 1, 2)`` gives trigrams, ``(0, 2)`` pairs with one word between.
    """
    span = offsets[-1]
    n = len(w.hash) - span
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, np.uint64(len(offsets) * 131 + span), dtype=np.uint64)
    for k, o in enumerate(offsets):
        total = mixed(total * _BASE + w.hash[o : o + n] + np.uint64(k))
    same = w.text[:n] == w.text[span:]
    return total[same], w.text[:n][same]


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` bytes from each position on (the last n - 1 positions are left out)."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    packed = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        packed = (packed << np.uint64(8)) | data[k : k + m]
    return mixed(packed ^ _BYTE_CODE[n])
