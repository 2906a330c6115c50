"""Suffix-array dedup: bytes covered by a ``width``-byte string that starts anywhere else too.

Every window of ``width`` bytes has an anchor that follows from its content: the place of its least ``GRAM``-byte hash. Neighbouring windows
with one anchor form a segment, so a text is some ``2 * len / width`` segments, and equal windows always lie in segments with equal anchors
at equal distances. Segments meet by the hash of their anchor; a key met once has no repeats. Segments that are equal as a
whole are one with a count. Where different segments share an anchor, they are cut into classes of neighbouring windows whose
common core is hashed. The classes that still meet go, by key, to suffix arrays (linear grouping), in which the core, the same for all strings of
a key, is one symbol; they tell exactly which windows repeat. A core that very many different strings share is cut once more, down to single
windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.bloom import bloom
from plumbline.llm.gsaca import repeated_windows
from plumbline.llm.textbytes import BASE, gram_digests, mix, range_digests, slices

WIDTH, GRAM, CLASS = 200, 48, 16
#: Different strings of one key that go to one suffix array.
MOST = 4096
#: Bytes of strings that share one suffix array; a key is never split.
ARRAY_BYTES = 1 << 16
_CHUNK = 1 << 23
_PLACE_BITS = 24


class Segments:
    """Segments of one stretch of bytes: window starts ``low`` to ``high``, anchor place, key."""

    def __init__(self, data: np.ndarray, at: np.ndarray, width: int, gram: int):
        self.width, self.data = width, data
        n = len(data)
        self.low = self.high = self.anchor = self.text = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n < width:
            return
        grams = gram_digests(data, gram)
        least = (grams & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(grams), dtype=np.uint64)
        span, have = width - gram + 1, 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        anchor = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)  # of the window at each start
        inside = np.repeat(at[1:], np.diff(at))[: len(anchor)] - np.arange(len(anchor)) >= width
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
        self.low = np.flatnonzero(new)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
        self.high = np.flatnonzero(last)
        self.anchor = anchor[self.low]
        self.key = grams[self.anchor]
        self.text = np.searchsorted(at, self.low, "right") - 1

    def identity(self) -> np.ndarray:
        """Equal for equal content at an equal distance from the anchor."""
        return mix(range_digests(self.data, self.low, self.high + self.width) + (self.anchor - self.low).astype(np.uint64) * BASE)

    def take(self, use: np.ndarray) -> None:
        for name in ("low", "high", "anchor", "text", "key"):
            setattr(self, name, getattr(self, name)[use])

    def cut(self, size: int) -> None:
        """Split into the classes of ``size`` neighbouring distances to the anchor; the key is the core of all windows of a class."""
        nearest, farthest = (self.anchor - self.high) // size, (self.anchor - self.low) // size
        times = farthest - nearest + 1
        own = np.repeat(np.arange(len(self.low)), times)
        number = nearest[own] + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
        self.take(own)
        self.core_start, self.core_end = self.anchor - number * size, self.anchor - (number * size + size - 1) + self.width
        core = range_digests(self.data, self.core_start, self.core_end)
        self.low = np.maximum(self.low, self.anchor - (number * size + size - 1))
        self.high = np.minimum(self.high, self.anchor - number * size)
        self.key = mix(core + number.astype(np.uint64) * BASE + np.uint64(size))


def _stretches(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the first byte in its text): a very long text comes in parts that overlap by a window."""
    for start, _, data, at in slices(column):
        if len(data) <= _CHUNK:
            yield start, data, at, 0
            continue
        for s in range(0, len(data) - width + 1, _CHUNK):
            part = data[s : s + _CHUNK + width - 1]
            yield start, part, np.array([0, len(part)]), s


def _scan(texts: DataFrame, width: int, gram: int, through: list[tuple[object, int]]) -> DataFrame:
    """``key, sid, row, low, windows``, and of classes also ``left`` and ``right``, the bytes beside the core. ``through``: (filter on the key, class size to cut those
    that pass), one level after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for start, data, at, base in _stretches(batch.column(1), width):
                s = Segments(data, at, width, gram)
                for keys, size in through:
                    s.take(keys.value.test(s.key))
                    s.cut(size)
                out = [pa.array(s.key.view(np.int64)), pa.array(s.identity().view(np.int64)), pa.array(rows[start + s.text]), pa.array(s.low - at[s.text] + base), pa.array((s.high - s.low + 1).astype(np.int32))]
                if through:
                    raw = data.tobytes()
                    out += [pa.array([raw[a:b] for a, b in zip(x.tolist(), y.tolist(), strict=True)], pa.binary()) for x, y in ((s.low, s.core_start), (s.core_end, s.high + width))]
                yield pa.RecordBatch.from_arrays(out, names=["key", "sid", "row", "low", "windows"] + ["left", "right"] * bool(through))

    return texts.mapInArrow(run, "key long, sid long, row long, low long, windows int" + ", left binary, right binary" * bool(through))


def _level(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept keys met more than once (``key, mixed``), and the kept segments that have them."""
    keys = store.keep(segments.groupBy("key").agg(F.count("*").alias("n"), F.min("sid").alias("a"), F.max("sid").alias("b")).where("n > 1").select("key", (F.col("a") != F.col("b")).alias("mixed")), "keys")
    there = bloom(keys, "key")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(there.value.test(batch.column(0).to_numpy().view(np.uint64))))

    near = segments.mapInArrow(inside, segments.schema)
    return keys, store.keep(near.join(keys, "key"), "met")


def repeated_spans(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, text_col: str = "text", most: int = MOST) -> DataFrame:
    """``row, start, end``: byte ranges (they may overlap) that cover exactly the bytes in ``width``-byte strings with another start. ``row`` is
    the number that ``monotonically_increasing_id`` gives the scan of ``docs``."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") >= width)

    def covered(rows: DataFrame) -> DataFrame:
        return rows.select("row", F.col("low").alias("start"), (F.col("low") + F.col("windows") - 1 + width).alias("end"))

    keys, met = _level(store.keep(_scan(texts, width, gram, []), "segments"))
    spans = [covered(met.where("not mixed"))]
    through: list[tuple[object, int]] = []
    for size in (CLASS, 1):
        if keys.where("mixed").isEmpty():
            break
        through = [*through, (bloom(keys.where("mixed"), "key"), size)]
        keys, met = _level(store.keep(_scan(texts, width, gram, through), "segments"))
        spans.append(covered(met.where("not mixed")))
        if size == 1:
            break  # windows of one key are equal
        strings = store.keep(met.where("mixed").groupBy("key", "sid").agg(F.count("*").alias("n"), F.max("left").alias("left"), F.max("right").alias("right")), "strings")
        crowded = strings.groupBy("key").agg(F.count("*").alias("strings"))
        keys = store.keep(crowded.withColumn("mixed", F.col("strings") > most).select("key", "mixed"), "crowded")
        spans.append(covered_by_arrays(strings.join(keys.where("not mixed").select("key"), "key"), met, width, size))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def covered_by_arrays(strings: DataFrame, met: DataFrame, width: int, size: int) -> DataFrame:
    """Spans of the segments in ``met`` whose strings go to suffix arrays. ``strings``: ``key, sid, n, left, right``. A window of ``width`` bytes is ``size`` symbols once
    its core is one."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple]) -> pa.RecordBatch:
            cores = {key: 256 + k for k, key in enumerate(dict.fromkeys(r[0] for r in rows))}
            pieces = [np.concatenate([np.frombuffer(left, np.uint8), [cores[key]], np.frombuffer(right, np.uint8)]).astype(np.int64) for key, _, _, left, right in rows]
            out = [[], [], [], []]
            for (key, sid, n, _, _), piece, hits in zip(rows, pieces, repeated_windows(pieces, size), strict=True):
                if n > 1:
                    hits = np.arange(len(piece) - size + 1)
                if len(hits):
                    breaks = np.flatnonzero(np.diff(hits) > 1)
                    for a, b in zip(hits[np.append(0, breaks + 1)].tolist(), hits[np.append(breaks, len(hits) - 1)].tolist(), strict=True):
                        for column, value in zip(out, (key, sid, a, b), strict=True):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "sid", "first", "last"])

        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held >= ARRAY_BYTES and row[0] != rows[-1][0]:
                    yield solved(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3]) + len(row[4]) + 2
        if rows:
            yield solved(rows)

    dealt = strings.select("key", "sid", "n", "left", "right").repartition("key").sortWithinPartitions("key")
    found = store.keep(dealt.mapInArrow(arrays, "key long, sid long, first long, last long"), "found")
    return met.join(found, ["key", "sid"]).select("row", (F.col("low") + F.col("first")).alias("start"), (F.col("low") + F.col("last") + width).alias("end"))


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, most: int = MOST) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the remaining bytes): each text without every byte that is covered by a
    ``width``-byte string which also starts elsewhere, in the same text or another; strings are judged on the input.

    Null and empty texts have no bytes and the digest of nothing. Texts shorter than ``width`` lose nothing. Repeated rows remove each other's
    bytes. Very long texts are searched whole, in overlapping parts. Extra columns are left out. An empty table gives no rows. ``docs``
    is read several times: give a stored table.
    """
    spans = repeated_spans(docs, width=width, gram=gram, text_col=text_col, most=most)
    lists = store.keep(spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", F.xxhash64("_row"))
    there = bloom(lists.select(F.xxhash64("row").alias("key")), "key")
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def digests(ids: pa.Array, texts: pa.Array, lists: pa.Array | None) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names[1:]]
        for k, text in enumerate(texts):
            data = text.as_buffer().to_pybytes()
            merged: list[list[int]] = []
            if lists is not None and lists[k].is_valid:
                flat = lists[k].values
                for s, e in zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
            at, kept = 0, []
            for s, e in merged:
                kept.append(data[at:s])
                at = e
            rest = b"".join([*kept, data[at:]])
            for column, value in zip(out, (len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest), strict=False):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(out, kinds, strict=False))], names=names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(~there.value.test(batch.column(2).to_numpy().view(np.uint64)))
            yield digests(batch.column(0).filter(keep), batch.column(1).filter(keep), None)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(there.value.test(batch.column(3).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(3)], names=["id", "text", "_row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield digests(batch.column(0), batch.column(1), batch.column(2))

    left = rows.select("id", "text", "_key").mapInArrow(untouched, schema)
    hit = rows.select("id", "text", "_row", "_key").mapInArrow(touched, f"id {kind}, text string, _row long").join(lists, F.col("_row") == F.col("row"), "left")
    return left.unionByName(hit.select("id", "text", "spans").mapInArrow(cut, schema))
