"""Elias-Fano sequences on numpy arrays, and files of named arrays that are mapped into memory."""

from __future__ import annotations

import json
import mmap
import os
import shutil
import struct
import tempfile

import numpy as np
from pyarrow import fs as pafs

from .common import file_system

#: Values that are packed or searched at once, a multiple of 8: temporary arrays stay small.
AT_ONCE = 1 << 17


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Positions of the k-th set bits; ``before``: set bits before each 64-bit word."""
    w = np.searchsorted(before, k, "right") - 1
    x, k, at = words[w], (k - before[w]).astype(np.int64), w.astype(np.int64) * 64
    for s in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(x & np.uint64((1 << s) - 1)).astype(np.int64)
        up = k >= n
        k = np.where(up, k - n, k)
        x = np.where(up, x >> np.uint64(s), x)
        at += np.where(up, s, 0)
    return at


class EliasFano:
    """A non-decreasing sequence of whole numbers: low bits packed, high bits in unary. About 2 + log2(range / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low_bytes, self.high = n, low_bits, low, high
        self.view = np.ndarray((max(1, len(low) - 7),), "<u8", buffer=low, strides=(1,)) if n else np.zeros(1, np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(high) else np.zeros(1, np.int64)
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(8, np.uint8), np.zeros(1, np.uint64))
        top = int(v[-1]) + 1
        bits = max(0, min(56, (top // n).bit_length() - 1))
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        if bits:
            for a in range(0, n, AT_ONCE):
                part = (v[a : a + AT_ONCE] & np.uint64((1 << bits) - 1)).astype("<u8")
                flat = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].reshape(-1)
                packed = np.packbits(flat, bitorder="little")
                low[a * bits // 8 : a * bits // 8 + len(packed)] = packed
        high = (v >> np.uint64(bits)).astype(np.int64)
        marks = np.zeros((n + int(high[-1]) + 2 + 63) // 64 * 64, np.uint8)
        marks[high + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(marks, bitorder="little").view("<u8"))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low_bytes, self.high]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), arrays[1], arrays[2])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        return (self.view[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        i = np.asarray(i, np.int64)
        high = (_select(self.high, self.ones, i) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(i)

    def decode(self) -> np.ndarray:
        """All values."""
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - np.arange(self.n)
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self._low(np.arange(self.n))

    def find(self, v: np.ndarray) -> np.ndarray:
        """Positions of the values ``v``, -1 where one isn't in the sequence: the successor of each is searched.

        A value goes to its high part's bucket by two selects, and to its place there by a binary search on low parts.
        """
        if not self.n or not len(v):
            return np.full(len(v), -1, np.int64)
        none = (~self.high).astype(np.uint64)
        return np.concatenate([self._find(v[a : a + AT_ONCE].astype(np.uint64), none) for a in range(0, len(v), AT_ONCE)])

    def _find(self, v: np.ndarray, none: np.ndarray) -> np.ndarray:
        out = np.full(len(v), -1, np.int64)
        k = (v >> np.uint64(self.low_bits)).astype(np.int64)
        last = len(self.high) * 64 - self.n - 1
        ok = np.flatnonzero(k <= last)
        k = k[ok]
        begin = np.where(k > 0, _select(none, self.zeros, np.maximum(k - 1, 0)) - k + 1, 0)
        end = _select(none, self.zeros, k) - k
        low = v[ok] & np.uint64((1 << self.low_bits) - 1)
        a, b = begin.copy(), end.copy()
        while (live := a < b).any():
            mid = (a + b) // 2
            less = self._low(np.minimum(mid, self.n - 1)) < low
            a = np.where(live & less, mid + 1, a)
            b = np.where(live & ~less, mid, b)
        hit = (a < end) & (self._low(np.minimum(a, self.n - 1)) == low)
        out[ok] = np.where(hit, a, -1)
        return out


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> int:
    """Writes named arrays to one file (aligned to 64 bytes, with a directory at the front); returns its size."""
    store, path = file_system(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    entries, at = {}, 0
    for k, a in arrays.items():
        entries[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(entries).encode()
    head += b" " * (-(len(head) + 8) % 64)
    with store.open_output_stream(path, compression=None) as out:
        out.write(struct.pack("<Q", len(head)) + head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))
    return at + len(head) + 8


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory. A file of another store is copied first to an unnamed local one."""
    store, path = file_system(uri)
    if isinstance(store, pafs.LocalFileSystem):
        f = open(path, "rb")  # noqa: SIM115
    else:
        f = tempfile.TemporaryFile()  # noqa: SIM115
        with store.open_input_stream(path, compression=None) as src:
            shutil.copyfileobj(src, f)
        f.flush()
    with f:
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = struct.unpack("<Q", m[:8])[0]
    return {k: np.frombuffer(m, np.dtype(d), c, 8 + n + at) for k, (d, c, at) in json.loads(m[8 : 8 + n]).items()}
