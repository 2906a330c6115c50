"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of words (lower-cased A-Z, parted by ASCII white space). Two lines are the same if their words are equal or, for
lines of ``NEAR_WORDS`` words and more, if one word inserted, deleted or replaced turns one into the other. Each line emits all variants
within the bound, itself and itself without one word, as hashed keys. A word replaced at a place leaves equal variants
at that place; a deleted word leaves a variant equal to the other line. Lines with an equal variant are joined through the earliest
line of the variant alone, never pair by pair, and the edit distance is verified on the words. The earliest line stays.

Only lines that share their first or their last words with another line can be within the bound, so only those emit variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.bloom import bloom, combine
from plumbline.llm.textbytes import BASE, Sums, _reduced, buffers, mix, slices, word_bounds, word_hashes

LEAST_WORDS, NEAR_WORDS = 5, 8


class Lines:
    """The lines of a slice that have ``least`` words at least."""

    def __init__(self, data: np.ndarray, at: np.ndarray, least: int):
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        start, end, text = word_bounds(data, at)
        self.words = word_hashes(data, start, end)
        self.sums = Sums(self.words)
        line = breaks[start] - breaks[at[text]]
        new = np.ones(len(start), bool)
        new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start))
        use = last - first >= least
        self.first, self.last = first[use], last[use]
        self.text, self.line = text[self.first], line[self.first]
        self.count = self.last - self.first
        self.byte_start, self.byte_end = start[self.first], end[self.last - 1]

    def whole(self) -> np.ndarray:
        return self.sums.ranges(self.first, self.last)

    def identity(self) -> np.ndarray:
        """``whole`` joined to a sum over the words, each mixed with its place in the line: two unrelated hashes, for lines that are taken as equal without a look at their words."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        edges = np.column_stack([self.first, self.last]).ravel()
        place = np.arange(len(self.words)) - np.repeat(np.append(0, self.first), np.diff(np.concatenate([[0], self.first, [len(self.words)]])))
        mixed = np.append(mix(self.words + mix(place.astype(np.uint64) * BASE + np.uint64(7))), np.uint64(0))
        return mix(self.whole() ^ mix(np.add.reduceat(mixed, edges)[::2]))

    def end_keys(self, near: int) -> tuple[np.ndarray, np.ndarray]:
        """(line number in the slice, key): the first and the last words of each line long enough, as many as the largest power of
        two not over half of it. At an edit, the words before it or those after it hold one of the two. A line whose length is a
        power of two also has the keys that a line one word shorter has."""
        own, keys = [], []
        for short in (0, 1):
            n = self.count - short
            half = np.left_shift(1, np.maximum(0, np.frexp(np.maximum(n, 2) // 2)[1] - 1))
            use = np.flatnonzero((n >= near - 1) & ((short == 0) | ((self.count & (self.count - 1)) == 0)))
            for side, (s, e) in enumerate(((self.first, self.first + half), (self.last - half, self.last))):
                own.append(use)
                keys.append(mix(self.sums.ranges(s[use], e[use]) + np.uint64(side + 1)))
        return np.concatenate(own), np.concatenate(keys)

    def without_one(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, place of the word left out, hash of the rest) for all words of some lines."""
        counts = self.count[lines]
        own = np.repeat(lines, counts)
        place = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        gap = self.first[own] + place
        one = np.ones(1, np.int64)
        before = self.sums.raw(self.first[own], gap)
        after = self.sums.shifted(self.sums.raw(gap + 1, self.last[own]), one)  # one place to the left
        rest = self.sums.shifted(_reduced(before + after), self.first[own])
        return own, place, mix(rest + (self.count[own] - 1).astype(np.uint64) * BASE)


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two word lists is 1 at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` without the lines that have an earlier same line, and ``n_lines``, ``n_removed`` (own columns of these names are replaced, and
    ``_row``, ``_key``, ``_gone`` and ``_gone_row`` are left out).

    Lines end at ``\\n``. Earlier: smaller id, then the order of rows, then of lines; a line goes if any earlier line is the same, itself kept
    or not. Lines under ``least_words`` words always stay. A null text stays null (0 lines), an empty one stays empty (1 line); a text that
    loses all lines becomes empty. Null ids come first. Very long texts are taken whole. Repeated rows and ids are rows of
    their own. Other columns stay. An empty table gives no rows. ``docs`` is read several times: give a stored table.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "_row", "_key", "_gone", "_gone_row")]
    rows = docs.select(*columns).withColumn("_row", F.monotonically_increasing_id())
    texts = rows.select(F.col("_row").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, at in slices(batch.column(2)):
                lines = Lines(data, at, least_words)
                own, keys = lines.end_keys(near_words)
                order = np.argsort(own, kind="stable")
                offsets = np.searchsorted(own[order], np.arange(len(lines.first) + 1)).astype(np.int32)
                taken = [batch.column(k).take(pa.array(lines.text + start)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(lines.line.astype(np.int32)), pa.array(lines.identity().view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[order].view(np.int64)))], names=["row", "id", "line", "h", "keys"])

    lines = store.keep(texts.mapInArrow(scan, f"row long, id {kind}, line int, h long, keys array<long>"), "lines")
    place = F.struct("id", "row", "line")
    firsts = store.keep(lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")), "firsts")

    # lines with an equal earlier line
    many = firsts.where("n > 1")
    in_many = bloom(many, "h")
    copies = lines.mapInArrow(_inside(in_many, 3, ["row", "id", "line", "h"]), f"row long, id {kind}, line int, h long").join(many.select("h", "first"), "h").where(place != F.col("first")).select("row", "line")

    # distinct lines that share an end with another one
    ends = firsts.select("first", F.explode("keys").alias("key"))
    shared = store.keep(ends.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-ends")
    in_shared = bloom(shared, "key")
    flat = ends.select(F.col("first.row").alias("row"), F.col("first.line").alias("line"), "key")
    emitting = store.keep(flat.mapInArrow(_inside(in_shared, 2, ["row", "line", "key"]), "row long, line int, key long").join(shared, "key").select("row", "line").distinct(), "emitting")
    in_emitting = bloom(emitting.mapInArrow(_combined, "key long"), "key")
    emitting_rows = bloom(emitting.select(F.xxhash64("row").alias("key")).distinct(), "key")

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows_inside(batches, emitting_rows):
            for start, _, data, at in slices(batch.column(2), 1 << 20):
                lines = Lines(data, at, max(least_words, near_words - 1))
                row = batch.column(0).to_numpy()[lines.text + start]
                use = np.flatnonzero(in_emitting.value.test(combine(row, lines.line).view(np.uint64)))
                # a line one word short of the bound is met by longer ones alone: its own shorter variants would only hide valid partners
                own, gap, h = lines.without_one(use[lines.count[use] >= near_words])
                own, gap, h = np.concatenate([use, own]), np.concatenate([np.full(len(use), -1), gap]), np.concatenate([lines.whole()[use], h])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(gap.astype(np.int32)), pa.array(row[own]), batch.column(1).take(pa.array(lines.text[own] + start)), pa.array(lines.line[own].astype(np.int32))], names=["h", "gap", "row", "id", "line"])

    schema = f"h long, gap int, row long, id {kind}, line int"
    keyed = texts.withColumn("key", F.xxhash64("row"))
    emitted = store.keep(keyed.mapInArrow(variants, schema), "variants")
    whole, short = F.when(F.col("gap") < 0, place), F.when(F.col("gap") >= 0, place)
    met = store.keep(emitted.groupBy("h").agg(F.count("*").alias("n"), F.min(whole).alias("whole"), F.min(short).alias("short")).where("n > 1").drop("n"), "met")
    meeting = store.keep(emitted.mapInArrow(_inside(bloom(met, "h"), 0, ["h", "gap", "row", "id", "line"]), schema), "meeting")
    other = F.when(F.col("gap") < 0, F.col("short")).otherwise(F.col("whole"))
    indel = meeting.join(met, "h").select("row", "line", place.alias("own"), other.alias("other"))
    same_gap = meeting.where("gap >= 0").groupBy("h", "gap").agg(F.count("*").alias("n"), F.min(place).alias("other")).where("n > 1").drop("n")
    replaced = meeting.where("gap >= 0").join(same_gap, ["h", "gap"]).select("row", "line", place.alias("own"), "other")
    pairs = store.keep(indel.unionByName(replaced).where(F.col("other") < F.col("own")).groupBy("row", "line").agg(F.min("other").alias("other")).select("row", "line", F.col("other.row").alias("other_row"), F.col("other.line").alias("other_line")), "pairs")

    # the words of both sides, to verify
    wanted = pairs.select("row", "line").unionByName(pairs.select(F.col("other_row").alias("row"), F.col("other_line").alias("line"))).distinct()
    in_wanted = bloom(wanted.mapInArrow(_combined, "key long"), "key")
    wanted_rows = bloom(wanted.select(F.xxhash64("row").alias("key")).distinct(), "key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows_inside(batches, wanted_rows):
            for start, _, data, at in slices(batch.column(2)):
                lines = Lines(data, at, max(least_words, near_words - 1))
                row = batch.column(0).to_numpy()[lines.text + start]
                use = np.flatnonzero(in_wanted.value.test(combine(row, lines.line).view(np.uint64)))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(row[use]), pa.array(lines.line[use].astype(np.int32)), pa.array([raw[s:e] for s, e in zip(lines.byte_start[use], lines.byte_end[use], strict=True)], pa.binary())], names=["row", "line", "content"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [[x.as_py().lower().split() for x in batch.column(k)] for k in (2, 3)]
            ok = [min(len(a), len(b)) >= near_words - 1 and max(len(a), len(b)) >= near_words and one_edit(a, b) for a, b in zip(*split, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["row", "line"])

    content = store.keep(keyed.mapInArrow(read, "row long, line int, content binary").join(wanted, ["row", "line"], "left_semi"), "content")
    both = pairs.join(content, ["row", "line"]).join(content.select(F.col("row").alias("other_row"), F.col("line").alias("other_line"), F.col("content").alias("other_content")), ["other_row", "other_line"])
    near = both.select("row", "line", "content", "other_content").mapInArrow(verify, "row long, line int")

    gone = store.keep(copies.unionByName(near).groupBy(F.col("row").alias("_gone_row")).agg(F.collect_set("line").alias("_gone")), "gone")
    return _rewrite(rows, gone, columns, text_col)


def _rows_inside(batches: Iterator[pa.RecordBatch], rows, step: int = 1024) -> Iterator[pa.RecordBatch]:
    """Small batches of the rows whose key, the last column, passes the filter."""
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield part.filter(pa.array(rows.value.test(part.column(part.num_columns - 1).to_numpy().view(np.uint64))))


def _inside(filter_, at: int, names: list[str]):
    """Keep the rows whose key, column ``at``, passes the filter; columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(filter_.value.test(batch.column(at).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(keep) for c in names], names=names)

    return run


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(combine(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], names=["key"])


def _rewrite(rows: DataFrame, gone: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """Texts without the lines in ``gone``; texts that surely lose none are not shuffled."""
    in_gone = bloom(gone.select(F.xxhash64("_gone_row").alias("key")), "key")
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    names = rows.columns

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    some = batch.slice(k, 512)
                    hit = in_gone.value.test(some.column(len(names)).to_numpy().view(np.uint64))
                    some = some.filter(pa.array(hit if inside else ~hit))
                    data, edges = buffers(some.column(at))
                    ends = np.flatnonzero(data[edges[0] : edges[-1]] == 10) + edges[0]
                    n = np.searchsorted(ends, edges[1:]) - np.searchsorted(ends, edges[:-1]) + 1
                    n[some.column(at).is_null().to_numpy(zero_copy_only=False)] = 0
                    yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], pa.array(n, pa.int64())], names=[*names, "n_lines"])

        return run

    at = names.index(text_col)
    keyed = rows.withColumn("_key", F.xxhash64("_row"))
    counted = schema + ", n_lines long"
    stay = keyed.mapInArrow(part(False), counted).select(*columns, "n_lines", F.lit(0).cast("long").alias("n_removed"))
    # the lists are hashed, so the texts are shuffled but not sorted, and the plan is the same at every size
    change = keyed.mapInArrow(part(True), counted).join(gone.hint("shuffle_hash"), F.col("_row") == F.col("_gone_row"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                texts, removed = [], []
                for text, lost in zip(batch.column(at), batch.column(len(names)), strict=True):
                    lost = set(lost.as_py() or ())
                    removed.append(len(lost))
                    texts.append(text.as_py() if not lost else "\n".join(x for k, x in enumerate(text.as_py().split("\n")) if k not in lost))
                out = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[: len(names)])]
                yield pa.RecordBatch.from_arrays([*out, batch.column(len(names) + 1), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    changed = change.select(*names, "_gone", "n_lines").mapInArrow(cut, counted + ", n_removed long")
    return stay.unionByName(changed.select(*columns, "n_lines", "n_removed"))
