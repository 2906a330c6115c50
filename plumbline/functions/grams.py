"""Counts of letters and short letter groups in texts, for whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of texts that are counted at once; a longer text is taken alone.
STRETCH = 1 << 18


def gram_counts(texts: pa.Array, grams: list[str], stretch: int = STRETCH) -> np.ndarray:
    """A row for each text, a column for each gram (ASCII): how often it is there from left to right without overlap, as ``str.count`` has it; null texts count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    made, k = [np.zeros((0, len(grams)), np.int64)], 0
    while k < len(texts):
        last = max(k + 1, int(np.searchsorted(ends, ends[k] + stretch, "right")) - 1)
        made.append(_counted(data[ends[k] : ends[last]], ends[k : last + 1] - ends[k], [g.encode() for g in grams]))
        k = last
    return np.concatenate(made)


def _counted(data: np.ndarray, ends: np.ndarray, grams: list[bytes]) -> np.ndarray:
    rows = len(ends) - 1
    row = np.repeat(np.arange(rows), np.diff(ends))
    out = np.zeros((rows, len(grams)), np.int64)
    letters = np.bincount(row * 256 + data, minlength=rows * 256).reshape(rows, 256)
    number = np.zeros(1 << 16, np.uint8)  # pairs of different letters, from 1
    pairs = sorted({g for g in grams if len(g) == 2 and g[0] != g[1]})
    number[[g[0] << 8 | g[1] for g in pairs]] = np.arange(1, len(pairs) + 1)
    code = number[data[:-1].astype(np.uint16) << 8 | data[1:]]
    at = np.flatnonzero(code)
    at = at[row[at] == row[at + 1]]
    width = len(pairs) + 1
    paired = np.bincount(row[at] * width + code[at], minlength=rows * width).reshape(rows, width)
    for k, g in enumerate(grams):
        if len(g) == 1:
            out[:, k] = letters[:, g[0]]
        elif g in pairs:
            out[:, k] = paired[:, pairs.index(g) + 1]
        elif len(set(g)) == len(g):  # such a group can't overlap itself
            first = np.flatnonzero(np.logical_and.reduce([data[i : len(data) - len(g) + 1 + i] == c for i, c in enumerate(g)])) if len(data) >= len(g) else np.zeros(0, np.int64)
            out[:, k] = np.bincount(row[first[row[first] == row[first + len(g) - 1]]], minlength=rows)
        else:
            whole = data.tobytes()
            out[:, k] = [whole.count(g, ends[i], ends[i + 1]) for i in range(rows)]
    return out


def difference_hashes(grids: np.ndarray, rows: int = 8, columns: int = 9) -> np.ndarray:
    """``columns.difference_hash`` of each row of ``grids``."""
    cells = grids.reshape(-1, rows, columns)
    bits = (cells[:, :, :-1] > cells[:, :, 1:]).reshape(len(cells), -1)
    return np.packbits(bits, axis=1).view(">i8").reshape(-1).astype(np.int64)
