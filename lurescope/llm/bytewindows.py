"""Hashes of byte windows and content-chosen anchors, for repeated substrings of a fixed length."""

from __future__ import annotations

import numpy as np

from lurescope.llm.textblocks import _BYTE_CODE, mixed

#: Bytes of the grams that anchors are chosen by.
GRAM = 32
_STEP = 0x9E3779B97F4A7C15


def _times(n: int) -> np.ndarray:
    return np.array([pow(_STEP, n, 1 << 64)], dtype=np.uint64)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of ``data[p : p + length]`` for each p, by joining hashes of half the length.

    For lengths that are no power of two, the binary digits of the length are joined.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size = _BYTE_CODE[data], 1
    total, done = None, 0
    rest = length
    while True:
        if rest & 1:
            if total is None:
                total, done = power[: len(data) - size + 1].copy(), size
            else:
                m = len(data) - done - size + 1
                total = total[:m] * _times(size) + power[done : done + m]
                done += size
        rest >>= 1
        if not rest:
            return mixed(total[:n])
        m = len(power) - size
        power = power[:m] * _times(size) + power[size : size + m]
        size *= 2


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start p: the place of the least gram in ``data[p : p + length]``; and every gram's hash.

    Equal windows have their anchor at the same place within them. Ties go to the first.
    """
    grams = window_hashes(data, GRAM)
    width = length - GRAM + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(packed) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(packed)] = packed
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), grams
