"""Words of a batch of texts by a table of the bytes that belong to words; each distinct word is held once, exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges (ends included); bytes of 0x80 and more, the parts of other characters, always belong to words."""
    table = np.zeros(256, bool)
    table[0x80:] = True
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: What is kept once A-Z have been lower-cased.
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A))
ALPHA = byte_table((0x61, 0x7A))


class BatchWords:
    """The words of a column of texts, A-Z alone lower-cased.

    distinct: the different words; code: each word's place in them; row: the text it stands in, ascending; first: each text's first word, and
    the end. A word never runs from one text into the next; a null text has none.
    """

    def __init__(self, column: pa.Array, table: np.ndarray):
        b = column.cast(pa.large_binary())
        n = len(b)
        off = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = b.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
        off = off - off[0]
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        keep = table[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        start = np.flatnonzero(keep & (~np.concatenate(([False], keep[:-1])) | edge[:-1])) if len(data) else np.empty(0, np.int64)
        end = np.flatnonzero(keep & (~np.concatenate((keep[1:], [False])) | edge[1:])) + 1 if len(data) else start
        bounds = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        body = pa.py_buffer(data[keep].tobytes())
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.tobytes()), body).dictionary_encode()
        self.distinct: pa.Array = words.dictionary
        self.code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.searchsorted(start, off)
        self.row = np.repeat(np.arange(n), np.diff(self.first))
