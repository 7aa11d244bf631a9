"""Words of many texts at once, on the UTF-8 bytes of an Arrow column: places, 64-bit hashes, windows.

A word is `[^\\x20\\x09-\\x0D]+`. These are single bytes in UTF-8, so nothing is decoded. Hashes are the same
in every process. Null texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers; one to one."""
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


class Words:
    """bytes: all texts after one another; bounds: where each begins and ends; starts, ends, row, hash: of each word."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
        self.bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        first = int(self.bounds[0])
        self.bounds = self.bounds - first
        size = int(self.bounds[-1])
        self.padded = np.zeros(size + 8, np.uint8)
        if size:
            self.padded[:size] = np.frombuffer(column.buffers()[2], np.uint8)[first : first + size]
        self.bytes = self.padded[:size]
        space = _SPACE[self.bytes]
        edge = np.ones(size + 1, bool)
        edge[1:size] = space[:-1] if size else []
        edge[self.bounds] = True
        self.starts = np.flatnonzero(~space & edge[:size])
        edge[:size] = space
        edge[self.bounds] = True
        self.ends = np.flatnonzero(~space & edge[1:]) + 1
        self.row = np.searchsorted(self.bounds, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(self.bounds) - 1)
        self.space = space
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = self.ends - self.starts
            eight = np.ndarray((len(self.padded) - 7,), "<u8", self.padded, strides=(1,))
            h = mix(n.astype(np.uint64) * _M1)
            open_ = np.arange(len(n))
            for k in range(0, _LONG, 8):
                if not len(open_):
                    break
                left = n[open_] - k
                chunk = eight[self.starts[open_] + k]
                short = left < 8
                chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
                h[open_] = mix(h[open_] ^ (chunk * _M1))
                open_ = open_[left > 8]
            for i in open_:
                h[i] = xxhash.xxh64_intdigest(self.bytes[self.starts[i] : self.ends[i]].tobytes())
            self._hash = h
        return self._hash

    def windows(self, k: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words, by place of the first word, and which of these lie in one text. other: by
        another multiplier."""
        by = _M3 if other else _M1
        h, n = self.hash, len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = h[:n].copy()
        for j in range(1, k):
            out *= by
            out += h[j : j + n]
        return mix(out), self.row[:n] == self.row[k - 1 :]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Booleans for n words: those that a window of k words from one of the starts covers."""
    change = np.zeros(n + k + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + k, -1)
    return np.cumsum(change)[:n] > 0
