"""Hashed character n-grams of many texts at once, on the bytes of their UTF-8 form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Zero bytes between two texts: more than any n-gram is long, so no n-gram holds bytes of two texts.
GAP = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with gaps between, and of each byte the text's number."""
    gap = b"\0" * GAP
    data = np.frombuffer(gap.join([*raw, b""]), np.uint8)
    lengths = np.array([len(r) + GAP for r in raw], np.int64)
    return data, np.repeat(np.arange(len(raw), dtype=np.int32), lengths)


def grams(data: np.ndarray, sizes: range, bits: int) -> Iterator[np.ndarray]:
    """For each size n, of each position the hash (``bits`` wide) of the n bytes that begin there; the size is hashed too."""
    wide = data.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(data), np.uint64)
    for n in range(1, sizes.stop):
        h = h[: len(data) - n + 1] * _STEP + wide[n - 1 :] if len(data) >= n else h[:0]
        if n in sizes:
            yield (((h ^ (h >> np.uint64(29))) * (_SPREAD + np.uint64(2 * n))) >> np.uint64(64 - bits)).astype(np.int64)


def blocks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters each; a longer text stands alone."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
