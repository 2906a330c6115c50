"""A set of 64-bit keys as a bit filter of bounded size, to be sent to the tasks.

A row outside the filter is surely not in the set. A row inside may not be either, so whoever uses it joins the real set
afterwards: the filter saves shuffling, and its size, at most ``MOST_BITS`` whatever the set, is no limit on the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textbytes import mix

MOST_BITS = 1 << 27


def _bit(key: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (key >> np.uint64(32 * k)) & np.uint64(bits - 1)


class Bloom:
    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def __contains__(self, keys):  # pragma: no cover - arrays go through test()
        raise TypeError("use test()")

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for k in range(2):
            b = _bit(keys.astype(np.uint64, copy=False), k, self.bits)
            out &= (self.words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bloom(keys: DataFrame, key: str | Column, count: int | None = None):
    """A broadcast of the ``Bloom`` of a long column, whose values are hashes. Collected: one number for each 64 bits at most."""
    spark = keys.sparkSession
    key = F.col(key) if isinstance(key, str) else key
    n = keys.count() if count is None else count
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, n) * 16)), 16, np.log2(MOST_BITS)))
    places = keys.select(F.explode(F.array(*(F.shiftrightunsigned(key, 32 * k).bitwiseAND(F.lit(bits - 1)) for k in range(2)))).alias("bit"))
    words = places.groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    if words.num_rows:
        out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(Bloom(out, bits))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two 64-bit columns, signed as Spark holds it."""
    with np.errstate(over="ignore"):
        return mix(mix(a.astype(np.int64).view(np.uint64)) + b.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
