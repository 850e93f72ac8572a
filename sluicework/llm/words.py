"""Words of texts and hashes of their runs, from the bytes of an Arrow column.

Words are what stands between ASCII white space. A run's hash is a polynomial of its
items modulo 2**64, mixed with its length; it does not depend on where the run stands.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
U = np.uint64


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for n values of j and more."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        n = 1 << max(18, int(n).bit_length())
        up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] of each span, whatever their place."""
    up, down = _table(base, len(values) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(values * up[: len(values)], dtype=U)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """The words of a batch of texts."""

    def __init__(self, column: pa.Array, lower: bool = False):
        b = column.cast(pa.large_binary())
        n = len(b)
        off = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = b.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)  # A-Z alone
        self.data, off = data, off - off[0]
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        before = np.concatenate(([False], word[:-1])) if len(data) else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.concatenate((word[1:], [False])) if len(data) else word
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)  # of each text, and the end
        self.hash = span_hashes(data.astype(U) + U(1), BASES[0], self.start, self.end) if len(self.start) else np.empty(0, U)
