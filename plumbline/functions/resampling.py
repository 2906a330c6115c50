"""Shrinking of grey images with a triangle (bilinear) filter over all pixels that a cell covers, for whole batches.

A cell's filter is a triangle around its centre, as wide as the image is larger than the grid. Rows and columns are filtered one after the other, each result rounded to 8 bits, with weights rounded
to 22 binary digits: the arithmetic of 8-bit image libraries, so that hashes agree with theirs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

# Binary digits of a weight; parts of blue, green and red in grey, of 65536.
DIGITS = 22
GREY = (7471, 38470, 19595)
#: Pixels that are shrunk at once, but for single images of more.
PIXELS = 1 << 22


@lru_cache(maxsize=256)
def weights(size: int, cells: int) -> np.ndarray:
    """``cells`` x ``size`` whole-number weights."""
    scale = size / cells
    support = max(scale, 1.0)
    centre = (np.arange(cells) + 0.5)[:, None] * scale
    low, high = np.maximum((centre - support + 0.5).astype(int), 0), np.minimum((centre + support + 0.5).astype(int), size)
    at = np.arange(size)[None, :]
    w = np.maximum(1.0 - np.abs((at - centre + 0.5) / support), 0.0) * ((at >= low) & (at < high))
    return np.floor(w / w.sum(axis=1, keepdims=True) * (1 << DIGITS) + 0.5).astype(np.int64)


def _filtered(pixels: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The last axis filtered, rounded to 8 bits. Sums stay below 2**53, so the float product of matrices is exact."""
    total = pixels.astype(float) @ w.T.astype(float) + (1 << (DIGITS - 1))
    return np.clip(total.astype(np.int64) >> DIGITS, 0, 255)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey of images whose last axis is blue, green, red (and more), or one channel."""
    if pixels.shape[-1] < 3:
        return pixels[..., 0].astype(np.int64)
    return (pixels[..., :3].astype(np.int64) @ np.array(GREY) + 0x8000) >> 16


def shrink(images: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Grey images of one size (n x height x width) as n x rows x columns, columns first."""
    narrow = _filtered(images, weights(images.shape[2], columns))
    return _filtered(narrow.transpose(0, 2, 1), weights(images.shape[1], rows)).transpose(0, 2, 1)


def grids(width: pa.Array, height: pa.Array, channels: pa.Array, data: pa.Array, rows: int, columns: int) -> pa.Array:
    """A list of ``rows * columns`` greys for each image, null where there is no width: images of one shape are shrunk together."""
    shapes = np.stack([a.to_numpy(zero_copy_only=False) for a in (width, height, channels)], axis=1).astype(np.int64)
    out = np.zeros((len(shapes), rows * columns), np.int32)
    there = (shapes > 0).all(axis=1)
    for shape in np.unique(shapes[there], axis=0):
        own = np.flatnonzero(there & (shapes == shape).all(axis=1))
        w, h, n = (int(x) for x in shape)
        lot = max(1, PIXELS // (w * h))
        for some in (own[k : k + lot] for k in range(0, len(own), lot)):
            pixels = np.stack([np.frombuffer(data[i].as_buffer(), np.uint8) for i in some]).reshape(len(some), h, w, n)
            out[some] = shrink(grey(pixels), rows, columns).reshape(len(some), -1)
    offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * (rows * columns))
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(~there))
