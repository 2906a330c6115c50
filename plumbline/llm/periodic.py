"""Maximal periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q, at least ``POWER`` * q and ``LEAST`` words long, that cannot be extended with that period.

Scale-tiled distribution: for each octave of periods, B <= q < 2B, a document is cut into overlapping tiles of 8B words around anchors 2B words apart. A run of such a period is so long that it
holds anchors, that a tile reaches past its next anchor by a period, and that at each anchor the text before or after it repeats for 1.5B words. Tiles where no shift
of the octave does so at the places looked at are left out; the others become rows, are dealt over the tasks, and are solved on their own: the Z-function of what stands after the anchor and that of what
stands before it, read backwards, give the extents of each period. Fragments are then brought together by document and period and stitched where they overlap by a period. Work is n log n for a
document of n words, however repetitive, and the tiles of one long document are solved in many tasks.

Words are numbered by their bytes, never by a hash alone. Null and empty texts have no words. Ids may repeat or be null: rows are told apart by their place in the input, which must be stored data.
Empty tables give no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.textbytes import SPACE, slices, word_bounds

LEAST, POWER = 6, 4
#: Pairs of anchor and period that are compared at once.
PAIRS = 1 << 20
#: Places at which a shift is looked at before its tile is made.
LOOKS = 8
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def z_function(s: list[int]) -> list[int]:
    """For each place, how far what follows equals the beginning; the whole length at 0."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primes(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] * (n > 1)


def solve_tile(words: list[int], anchor: int, octave: int) -> list[tuple[int, int, int]]:
    """(period, start, end) in the tile of the repetitions at its anchor whose period is in the octave and has no smaller one below it, and which are long enough or may go on outside of the tile."""
    low = 1 << octave
    most = min(2 * low - 1, len(words) - anchor - 1)
    after = z_function(words[anchor:])
    before = words[:anchor][::-1]
    back = z_function([*before, -1, *words[: anchor + most][::-1]])
    out = []
    for q in range(low, most + 1):
        right, left = after[q], back[anchor + 1 + most - q] if anchor else 0
        if (left + right >= (POWER - 1) * q or left == 4 * low or right == 4 * low - q) and not any(after[q // d] >= q - q // d for d in _primes(q)):
            out.append((q, anchor - left, anchor + q + right))
    return out


def _words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts as one binary array, and where the words of each text begin in it."""
    start, end, text = word_bounds(data, at)
    solid = data[~SPACE[data]]
    edges = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=edges[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(solid))])
    first = np.zeros(len(at), np.int64)
    np.cumsum(np.bincount(text, minlength=len(at) - 1), out=first[1:])
    return words, first


def _joined(words: pa.Array, first: np.ndarray) -> list[bytes]:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), words), b" ").to_pylist()


def hot_anchors(codes: np.ndarray, first: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (as places in ``codes``) and their texts at which some period of the octave may have a run."""
    low = 1 << octave
    need = (3 * low + 1) // 2
    sizes = np.diff(first)
    texts = np.flatnonzero(sizes >= max(LEAST, POWER * low))
    each = (sizes[texts] - 1 - low) // (2 * low) + 1
    own = np.repeat(texts, each)
    anchors = first[own] + (np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)) * 2 * low
    padded = np.concatenate([codes, np.full(2 * low + 1, -1, codes.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, low)
    looks = np.unique(np.linspace(0, need - 1, min(LOOKS, need)).astype(np.int64))
    hot = np.zeros(len(own), bool)
    step = max(1, PAIRS // low)
    for k in range(0, len(own), step):
        c, top, bottom = anchors[k : k + step], first[own[k : k + step] + 1], first[own[k : k + step]]
        row, q = np.nonzero(windows[c + low] == codes[c][:, None])
        q += low
        fits = c[row] + q + need <= top[row]
        row, q = row[fits], q[fits]
        for j in looks[1:]:
            same = codes[c[row] + j] == codes[c[row] + q + j]
            row, q = row[same], q[same]
        hot[k + row] = True
        back = np.flatnonzero((c - need >= bottom) & ~hot[k : k + step])
        row, q = np.nonzero(windows[c[back] - 1 + low] == codes[c[back] - 1][:, None])
        row, q = back[row], q + low
        fits = c[row] + q <= top[row]
        row, q = row[fits], q[fits]
        for j in looks[1:]:
            same = codes[c[row] - 1 - j] == codes[c[row] + q - 1 - j]
            row, q = row[same], q[same]
        hot[k + row] = True
    return anchors[hot], own[hot]


def _tile(digest: bool):
    """Rows of three kinds: 0, texts that have no run, done; 1, tiles; 2, texts whose tiles are to be solved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, at in slices(batch["text"]):
                some = batch.slice(start, stop - start)
                words, first = _words(data, at)
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                busy = np.zeros(stop - start, bool)
                octave = 0
                while POWER << octave <= int(np.diff(first).max(initial=0)):
                    anchors, own = hot_anchors(codes, first, octave)
                    busy[own] = True
                    reach = 4 << octave
                    low, high = np.maximum(anchors - reach, first[own]), np.minimum(anchors + reach, first[own + 1])
                    lot = max(1, PAIRS // (2 * reach))
                    for k in range(0, len(own), lot):
                        tiles = [codes[a:b].tobytes() for a, b in zip(low[k : k + lot].tolist(), high[k : k + lot].tolist(), strict=True)]
                        yield _rows(some, own[k : k + lot], 1, octave=np.full(len(tiles), octave, np.int32), start=low[k : k + lot] - first[own[k : k + lot]], anchor=(anchors - low)[k : k + lot], tile=tiles)
                    octave += 1
                yield _rows(some, np.flatnonzero(busy), 2)
                idle = np.flatnonzero(~busy)
                whole = _joined(words, first)
                yield _rows(some, idle, 0, collapsed=[hashlib.sha256(whole[i]).hexdigest() if digest else whole[i].decode() for i in idle])

    return run


_OWN = {"octave": pa.int32(), "start": pa.int64(), "anchor": pa.int64(), "tile": pa.binary(), "collapsed": pa.string()}


def _rows(some: pa.RecordBatch, at: np.ndarray, kind: int, **columns) -> pa.RecordBatch:
    at_ = pa.array(at, pa.int64())
    base = [pa.array(np.full(len(at), kind, np.int32)), some["row"].take(at_), some["key"].take(at_), some["text"].take(at_) if kind == 2 else pa.nulls(len(at), pa.string())]
    return pa.RecordBatch.from_arrays([*base, *(pa.array(columns[c], t) if c in columns else pa.nulls(len(at), t) for c, t in _OWN.items())], ["kind", "row", "key", "text", *_OWN])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, octave, start, anchor, tile in zip(*(batch[c].to_pylist() for c in ("row", "octave", "start", "anchor", "tile")), strict=True):
            out += [(row, q, start + a, start + b) for q, a, b in solve_tile(np.frombuffer(tile, np.int32).tolist(), anchor, octave)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "period", "low", "high"])


def stitch(fragments: DataFrame) -> DataFrame:
    """``row, runs``: fragments ``row, period, low, high`` that overlap by a period are one stretch; the stretches that are long enough, by start and period."""
    w = Window.partitionBy("row", "period").orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = fragments.distinct().withColumn("begins", F.coalesce((F.col("low") > reach - F.col("period")).cast("int"), F.lit(1)))
    parts = begins.withColumn("part", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("row", "period", "part").agg(F.min("low").alias("start"), (F.max("high") - F.min("low")).alias("length")).where(F.col("length") >= F.greatest(F.lit(LEAST), POWER * F.col("period")))
    runs = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    return whole.groupBy("row").agg(F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))


def _collapse(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, at in slices(batch["text"]):
                some = batch.slice(start, stop - start)
                words, first = _words(data, at)
                runs = some["runs"]
                own = np.repeat(np.arange(len(some)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
                begin, length, period = (pc.list_flatten(runs).field(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "period"))
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, first[own] + begin + period, 1)
                np.add.at(change, first[own] + begin + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[first]
                texts = _joined(words.filter(pa.array(keep)), kept)
                yield pa.RecordBatch.from_arrays([some["key"], runs, pa.array([hashlib.sha256(t).hexdigest() if digest else t.decode() for t in texts], pa.string())], ["key", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``key, runs, collapsed`` of each row: the runs by start and period, and the words that no run repeats, joined by one space; with ``digest`` the SHA-256 of that
    text (texts without a run are then not stored)."""
    store.bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    found = store.keep(rows.mapInArrow(_tile(digest), f"kind int, row long, key {kind}, text string, octave int, start long, anchor long, tile binary, collapsed string"), "tiles")
    tiles = found.where("kind = 1").select("row", "octave", "start", "anchor", "tile").repartition("row", "octave", "start", "anchor")
    runs = stitch(tiles.mapInArrow(_solve, "row long, period long, low long, high long"))
    busy = found.where("kind = 2").select("row", "key", "text").join(runs, "row", "left").select("key", "text", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"))
    done = found.where("kind = 0").select("key", F.array().cast(f"array<{RUN}>").alias("runs"), "collapsed")
    return done.unionByName(busy.mapInArrow(_collapse(digest), f"key {kind}, runs array<{RUN}>, collapsed string")).withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties go to the smallest start, then period (the order of ``runs``). Null without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))
