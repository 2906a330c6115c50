"""Benchmark decontamination by pigeonhole edit matching.

An item of length L may be met with up to e = floor(rate * L) edits. It is split into e + 1 pieces: wherever the item occurs
within the budget, one piece at least occurs unchanged. Documents are searched for exact pieces by a rolling hash, and
each hit is verified with Myers' bit-parallel distance on the stretch of text around it.

A benchmark of at most ``PASS_BYTES``, measured first, is sent to the tasks whole. A larger one never leaves the executors: digests of
its pieces are joined with digests of the documents' windows, and each document that shares a piece meets its own items only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bloom import bloom
from plumbline.llm.store import bound_batches, keep
from plumbline.llm.textbytes import LOWER, SPACE, gram_digests, mixed_eights, slices

#: Bytes of items, with their ids, that a task holds at a time: a benchmark of this size is sent whole, a larger one is joined.
PASS_BYTES = 4 << 20
#: Shares into which the rows of one join key are dealt.
SHARES = 32
_FILTER_BITS = 24


def normal_form(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with each run of white space as one space: bytes, offsets, and the place of each in ``data``. Lower case
    for A-Z and the capitals from A-grave to Thorn, whose UTF-8 forms differ in one bit of the second byte."""
    space = SPACE[data]
    lower = LOWER[data]
    if len(data):
        accented = np.zeros(len(data), bool)
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lower[accented] += 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at[:-1][at[:-1] < at[1:]]] = True
    where = np.flatnonzero(keep)
    out = np.where(space, np.uint8(32), lower)[where]
    return out, np.searchsorted(where, at), where


def closest_end(pattern: bytes, text: bytes, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of ``text`` closest to ``pattern`` (the first such end), if within the budget. Myers 1999: one
    bit for each byte of the pattern, a few word operations for each byte of the text."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    match: dict[int, int] = {}
    for i, c in enumerate(pattern):
        match[c] = match.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end = budget + 1, -1
    for i, c in enumerate(text):
        eq = match.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(across | plus) & full), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        eq |= minus
        plus, minus = down | (~(eq | up) & full), up & eq
        if score < best:
            best, end = score, i + 1
    return (best, end) if best <= budget else None


def split_item(length: int, rate: float) -> tuple[int, list[tuple[int, int]]]:
    """The edit budget of an item and the (start, length) of its pieces, one more than the budget."""
    e = int(rate * length)
    edges = [length * k // (e + 1) for k in range(e + 2)]
    return e, [(s, t - s) for s, t in zip(edges[:-1], edges[1:], strict=True)]


class Pieces:
    """Exact search for the pieces of some items."""

    def __init__(self, items: list[tuple[object, bytes]], rate: float, filter_bits: int = _FILTER_BITS):
        self.items, self.budget, self.filter_bits, pieces = items, [], filter_bits, []
        for number, (_, item) in enumerate(items):
            e, own = split_item(len(item), rate)
            self.budget.append(e)
            pieces += [(number, s, n) for s, n in own]
        self.groups = []
        for gram in sorted({min(n, 16) for _, _, n in pieces}):
            own = [(number, s, n) for number, s, n in pieces if min(n, 16) == gram]
            hashes = np.array([gram_digests(np.frombuffer(items[number][1][s : s + gram], np.uint8), gram)[0] for number, s, _ in own], np.uint64)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << filter_bits >> 3, np.uint8)
            low = (hashes >> np.uint64(64 - filter_bits)).astype(np.int64)
            np.bitwise_or.at(bits, low >> 3, (1 << (low & 7)).astype(np.uint8))
            self.groups.append((gram, hashes[order], [own[i] for i in order], bits))

    def starts(self, data: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """For each text and item that share a piece, where the item would begin by each of the hits."""
        raw, out = data.tobytes(), {}
        whole = mixed_eights(data)
        for gram, hashes, own, bits in self.groups:
            if len(data) < gram:
                continue
            h = gram_digests(data, gram, whole)
            low = (h >> np.uint64(64 - self.filter_bits)).astype(np.int64)
            maybe = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
            place = np.searchsorted(hashes, h[maybe])
            ok = (place < len(hashes)) & (hashes[np.minimum(place, len(hashes) - 1)] == h[maybe])
            found = maybe[ok]
            for p, k, t in zip(found.tolist(), place[ok].tolist(), (np.searchsorted(at, found, "right") - 1).tolist(), strict=True):
                while k < len(hashes) and hashes[k] == h[p]:
                    number, offset, n = own[k]
                    k += 1
                    if p + n <= at[t + 1] and raw[p : p + n] == self.items[number][1][offset : offset + n]:
                        out.setdefault((t, number), set()).add(p - offset)
        return out

    def find(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, distance, start, end) of each item in each text, the first of the closest places, in normal form. What a hit stands for lies within the budget of its
        stretch; stretches that meet are searched as one, so a text is searched once for an item, however often its pieces are found."""
        raw = data.tobytes()
        for (t, number), starts in self.starts(data, at).items():
            item, budget = self.items[number][1], self.budget[number]
            first, last = int(at[t]), int(at[t + 1])
            exact = min((s for s in starts if s >= first and raw.startswith(item, s, last)), default=None)
            if exact is not None:  # all pieces hit: nothing to search
                yield t, number, 0, exact - first, exact + len(item) - first
                continue
            best, end, stretch = budget + 1, -1, None
            for start in [*sorted(starts), None]:
                begin, stop = (max(first, start - budget), min(last, start + len(item) + budget)) if start is not None else (last + 1, last + 1)
                if stretch and begin <= stretch[1]:
                    stretch = stretch[0], max(stretch[1], stop)
                    continue
                if stretch and (got := closest_end(item, raw[stretch[0] : stretch[1]], min(budget, best - 1))):
                    best, end = got[0], stretch[0] + got[1]
                stretch = begin, stop
            if end >= 0:
                back = closest_end(item[::-1], raw[max(first, end - len(item) - budget) : end][::-1], budget)
                yield t, number, best, end - (back[1] if back else len(item)) - first, end - first


def places(pieces: Pieces, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """What ``find`` tells of raw texts, as arrays; starts and ends are byte offsets of the raw text. None: no hit."""
    text, edges, where = normal_form(data, at)
    hits = list(pieces.find(text, edges))
    if not hits:
        return None
    where = np.append(where, len(data))
    t, number, distance = (np.array([h[k] for h in hits]) for k in range(3))
    start, end = (np.minimum(where[edges[t] + np.array([h[k] for h in hits])], at[t + 1]) - at[t] for k in (3, 4))
    return t, number, distance, start, end


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, least_bytes: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``id_col, item_col, distance, start, end`` (``item_`` before the second where both have one name): one row for each document row and item that meet within the edit budget, with the
    closest place as byte offsets of the text.

    Both sides are compared in lower case (A-Z and the accented Latin-1 capitals) with runs of white space as one space. Null and empty texts meet nothing. Items
    under ``least_bytes`` in that form are left out: they are too short to name a source. Very long texts are searched whole.
    Repeated rows each get their rows; equal items are each reported. Extra columns are left out. Empty tables give no rows.
    A benchmark of at most ``pass_bytes`` is sent to the tasks, a larger one is joined, with the same rows; then ``docs`` is read twice: give a stored table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    item_out = item_col if item_col != id_col else f"item_{item_col}"
    schema = f"`{id_col}` {kinds[0]}, `{item_out}` {kinds[1]}, distance int, start long, end long"
    names = [id_col, item_out, "distance", "start", "end"]

    from pyspark.sql.pandas.types import to_arrow_type

    id_type, item_type = to_arrow_type(docs.schema[id_col].dataType), to_arrow_type(benchmark.schema[item_col].dataType)
    least = max(1, least_bytes)
    raw = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where(F.octet_length("text") >= least)  # a normal form is never longer
    size = raw.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0))), F.lit(0))).first()[0]

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, at in slices(batch.column(2)):
                text, edges, _ = normal_form(data, at)
                whole = [text[a:b].tobytes().strip(b" ") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                use = [k for k, form in enumerate(whole) if len(form) >= least]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, stop - start).take(pa.array(use, pa.int64())) for c in (0, 1)), pa.array([whole[k] for k in use], pa.binary())], names=["item", "item_id", "form"])

    items = raw.select(F.monotonically_increasing_id().alias("item"), "id", "text").mapInArrow(forms, f"item long, item_id {kinds[1]}, form binary")
    if size > pass_bytes:
        return _joined(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, rate, schema, (id_type, item_type), pass_bytes)
    pieces = spark.sparkContext.broadcast(Pieces([(r["item_id"], bytes(r["form"])) for r in items.collect()], rate))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, at in slices(batch.column(1)):
                if got := places(pieces.value, data, at):
                    t, number, distance, s, e = got
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t + start)), pa.array([pieces.value.items[k][0] for k in number.tolist()], item_type), pa.array(distance, pa.int32()), pa.array(s), pa.array(e)], names=names)

    return docs.where(F.octet_length(text_col) > 0).select(id_col, text_col).mapInArrow(search, schema)


def _meet(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key``. The rows of a key of ``many`` are dealt into ``SHARES`` by column ``by``, and ``few`` is copied only to shares
    that have the key, so a key that everything has is no single task. ``many`` is read twice."""
    many = many.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(SHARES)))
    there = many.select(key, "_share").distinct().join(few, key)
    return many.join(there, [key, "_share"]).drop("_share")


def _joined(texts: DataFrame, items: DataFrame, rate: float, schema: str, types: tuple, pass_bytes: int) -> DataFrame:
    """``schema`` for ``texts`` (``row, id, text``) and ``items`` (``item, item_id, form``) of any number, by digests of pieces."""
    items = keep(items, "items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, grams, own = [], [], []
            for item, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s, n in split_item(len(form), rate)[1]:
                    gram = min(n, 16)
                    hashes.append(gram_digests(np.frombuffer(form[s : s + gram], np.uint8), gram)[0])
                    grams.append(gram)
                    own.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(grams, pa.int32()), pa.array(own, pa.int64())], names=["hash", "gram", "item"])

    pieces = keep(items.select("item", "form").mapInArrow(cut, "hash long, gram int, item long").distinct(), "pieces")
    lengths = sorted(r["gram"] for r in pieces.select("gram").distinct().collect())  # 16 numbers at most
    known = bloom(pieces, "hash")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, at in slices(batch.column(1)):
                text, edges, _ = normal_form(data, at)
                whole = mixed_eights(text)
                for gram in lengths:
                    h = gram_digests(text, gram, whole)
                    p = np.flatnonzero(known.value.test(h))
                    t = np.searchsorted(edges, p, "right") - 1
                    inside = p + gram <= edges[t + 1]
                    pairs = np.unique(np.stack([t[inside], h[p[inside]].view(np.int64)]), axis=1)
                    if pairs.shape[1]:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0] + start)), pa.array(pairs[1])], names=["row", "hash"])

    full = texts.where(F.octet_length("text") > 0)
    hits = keep(full.select("row", "text").mapInArrow(windows, "row long, hash long"), "hits")
    pairs = keep(_meet(hits, pieces.select("hash", "item"), "hash", "row").select("row", "item").distinct(), "pairs")
    rows = bloom(pairs.select(F.xxhash64("row").alias("key")).distinct(), "key")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays((kept := batch.filter(pa.array(rows.value.test(batch.column(0).to_numpy().view(np.uint64))))).columns[1:], names=kept.schema.names[1:])

    # a text comes first, then its items; a text that has none passed the filter by chance
    id_kind, item_kind = dict(texts.dtypes)["id"], dict(items.dtypes)["item_id"]
    found = full.select(F.xxhash64("row").alias("key"), "row", "id", F.col("text").cast("binary").alias("data")).mapInArrow(wanted, f"row long, id {id_kind}, data binary")
    found = found.select("row", F.lit(None).cast("long").alias("item"), "id", F.lit(None).cast(item_kind).alias("item_id"), "data")
    asked = _meet(pairs, items, "item", "row").select("row", "item", F.lit(None).cast(id_kind).alias("id"), "item_id", F.col("form").alias("data"))
    dealt = found.unionByName(asked).repartition("row").sortWithinPartitions("row", "item")
    names = [f.strip().split(" ")[0].strip("`") for f in schema.split(", ")]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[object, bytes]] = []  # texts
        numbers: dict[int, int] = {}  # item -> place among forms
        forms: list[tuple[object, bytes]] = []
        pairs: set[tuple[int, int]] = set()  # text and item of the group that share a piece
        last, texts_held, forms_held = None, 0, 0

        def solved() -> Iterator[pa.RecordBatch]:
            if not pairs:
                return
            at = np.cumsum([0, *(len(text) for _, text in group)])
            got = places(Pieces(forms, rate, 16), np.frombuffer(b"".join(text for _, text in group), np.uint8), at)
            if got:
                use = np.array([pair in pairs for pair in zip(got[0].tolist(), got[1].tolist(), strict=True)])
                t, number, distance, s, e = (x[use] for x in got)
                yield pa.RecordBatch.from_arrays([pa.array([group[k][0] for k in t.tolist()], types[0]), pa.array([forms[k][0] for k in number.tolist()], types[1]), pa.array(distance, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=names)

        for batch in batches:
            for row, item, own, item_id, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if item is None:
                    if texts_held >= pass_bytes or forms_held >= pass_bytes:
                        yield from solved()
                        group, numbers, forms, pairs, texts_held, forms_held = [], {}, [], set(), 0, 0
                    group.append((own, data))
                    last, texts_held = row, texts_held + len(data)
                    continue
                if row != last:
                    raise ValueError("docs gave other row numbers at its second read: give a stored table")
                if forms_held >= pass_bytes:  # the open text goes on with its other items
                    yield from solved()
                    group, numbers, forms, pairs, forms_held = group[-1:], {}, [], set(), 0
                    texts_held = len(group[0][1])
                if item not in numbers:
                    numbers[item] = len(forms)
                    forms.append((item_id, data))
                    forms_held += len(data)
                pairs.add((len(group) - 1, numbers[item]))
        yield from solved()

    return dealt.mapInArrow(verify, schema)
