"""Best-fit packing of token sequences into rows of a fixed length.

The number of ways to fill a row depends on the lengths alone, so the plan is made on the histogram of piece lengths (at most
``capacity`` numbers, whatever the corpus). Its configuration linear program

    minimise sum x_c  subject to  sum_c x_c * count(c, l) >= n_l  for every length l

is solved by multiplicative weights. The price of a length falls exponentially with the share of its pieces that is covered (``cover``), and each step
adds the configuration that a knapsack dynamic program finds for the prices. The program runs over the lengths with the dearest tokens and a draw of others first; as no
configuration is worth more than a row of the dearest tokens, its value shows by how much it may miss the best one, and where it
misses more, more lengths are priced. The same reasoning makes the prices a dual solution, a lower bound on the rows. The fractional solution is rounded: the fullest configurations get whole
rows while their pieces last, and the program is solved again for what is left. Only a last remainder, ``REMAINDER`` of the tokens, is placed by best-fit decreasing. Pieces then find their row by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.encoders import encoder
from plumbline.llm.textbytes import slices

#: Share of a length's pieces that one step may cover, the rate at which its price falls with the share covered, and the shortfall of a
#: configuration's value that is taken.
STEP, RATE, SLACK = 0.34, 0.7, 0.03
#: Lengths of the knapsack that is tried first, half of them the dearest, and of the one that is tried last.
DEAREST, WIDEST = 64, 256
#: Share of the tokens that a solution covers before it is rounded, and share that is left to best-fit decreasing in the end.
COVERED, REMAINDER = 0.9, 0.06
#: How much dearer the tokens of the longest pieces start, so that short ones are spared for filling: the first, and those tried while the rows are more
#: than ``GAP`` over the bound.
LARGE, GAP = (0.05, 0.3, 1.0, 3.0), 0.001
#: Room of a placed row above which it is given back, and share of the others that stays, in the plans that are compared.
RETURNED = ((4, 1.0), (1, 1.0), (0, 1.0), (0, 0.75), (0, 0.5))
#: Share of the fractional rows, the fullest, that get whole rows.
FULLEST = 0.7

#: Pieces of one length that are numbered in one window.
BUCKET_PIECES = 100_000

Configuration = dict[int, int]


def price_knapsack(prices: np.ndarray, lengths: np.ndarray, available: np.ndarray, capacity: int) -> tuple[float, Configuration]:
    """(value, configuration) of greatest total price within ``capacity`` and the ``available`` pieces; copies go in by powers of two."""
    items: list[tuple[int, int]] = []  # (index, copies)
    for k, (l, n) in enumerate(zip(lengths.tolist(), available.tolist(), strict=True)):
        left, times = min(n, capacity // l), 1
        while left > 0:
            items.append((k, min(times, left)))
            left, times = left - min(times, left), times * 2
    best = np.zeros(capacity + 1)
    took = np.zeros((len(items), capacity + 1), bool)
    for i, (k, times) in enumerate(items):
        w = int(lengths[k]) * times
        with_it = best[: capacity + 1 - w] + prices[k] * times
        np.greater(with_it, best[w:], out=took[i, w:])
        np.maximum(with_it, best[w:], out=best[w:])
    room, out = capacity, {}
    for i in range(len(items) - 1, -1, -1):
        if took[i, room]:
            k, times = items[i]
            out[int(lengths[k])] = out.get(int(lengths[k]), 0) + times
            room -= int(lengths[k]) * times
    return float(best[capacity]), out


def best_fit_decreasing(left: Configuration, capacity: int) -> list[tuple[Configuration, int]]:
    """Rows for what rounding left over: pieces, longest first, each into the fullest row that has room. Equal rows are filled together."""
    open_rows: dict[int, list[tuple[Configuration, int]]] = {}  # room -> (row, how many)
    for l in sorted((l for l, n in left.items() if n > 0), reverse=True):
        n = left[l]
        while n:
            room = min((r for r in open_rows if r >= l), default=None)
            row, times = open_rows[room].pop() if room is not None else ({}, n)
            if room is not None and not open_rows[room]:
                del open_rows[room]
            room = capacity if room is None else room
            copies = min(room // l, n)
            use = min(times, n // copies)
            if use < times and row:
                open_rows.setdefault(room, []).append((row, times - use))
            open_rows.setdefault(room - copies * l, []).append(({**row, l: copies}, use))
            n -= copies * use
    return [x for rows in open_rows.values() for x in rows]


def cover(need: Configuration, capacity: int, seed: int = 0, large: float = LARGE[0]) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """(fractional rows of each configuration, lower bound on the rows) of the covering program by multiplicative weights, up to ``COVERED`` of the tokens.
    Short of all, so that every row still finds pieces to be filled with and what is left has the mix of the whole."""
    rng = np.random.default_rng(seed)
    lengths = np.array(sorted(need, reverse=True))
    wanted = np.array([need[l] for l in lengths], float)
    tokens = wanted * lengths
    covered = np.zeros(len(lengths))
    out: dict[tuple[tuple[int, int], ...], float] = {}
    bound = 0.0
    while np.dot(tokens, covered) < COVERED * tokens.sum():
        # one price for each token is the dual solution where rows can be filled; coverage then moves the prices
        price = np.exp(-RATE * covered) * (1 + large * lengths / capacity)
        bound = max(bound, float(np.dot(tokens, price)) / capacity / float(price.max()))
        todo = np.flatnonzero(covered < 1 - 1e-9)
        todo = todo[np.argsort(-price[todo], kind="stable")]
        left = np.ceil(wanted * (1 - covered) - 1e-9).astype(np.int64)
        # no configuration is worth more than the dearest tokens that are left
        room = np.clip(capacity - np.concatenate([[0], np.cumsum((left * lengths)[todo])[:-1]]), 0, (left * lengths)[todo])
        most = float(np.dot(room, price[todo]))
        others, use = rng.permutation(todo[DEAREST // 2 :]), DEAREST // 2
        while True:
            own = np.sort(np.concatenate([todo[: DEAREST // 2], others[:use]]))
            value, config = price_knapsack(price[own] * lengths[own], lengths[own], left[own], capacity)
            if value >= (1 - SLACK) * most or sum(l * n for l, n in config.items()) == capacity or use >= min(WIDEST, len(others)):
                break
            use *= 4
        at = np.searchsorted(-lengths, -np.array(list(config)))
        copies = np.array(list(config.values()), float)
        rows = float(min(STEP * (wanted[at] / copies).min(), ((1 - covered[at]) * wanted[at] / copies).max()))
        covered[at] += rows * copies / wanted[at]
        key = tuple(sorted(config.items()))
        out[key] = out.get(key, 0.0) + rows
    return out, bound


def plan(histogram: Configuration, capacity: int) -> tuple[list[tuple[Configuration, int]], int]:
    """[(configuration, number of rows)] that together hold each length exactly ``histogram`` times, and how many of these rows the linear program placed. Solutions are tried until one is within
    ``GAP`` of the bound by volume. Of each, rows that are not full, and a share of the full ones, may also give their pieces back to what is left, which is then easier to fill (``RETURNED``); of plans of equally many rows
    the one with most rows of the program is taken."""
    bound = -(-sum(l * n for l, n in histogram.items()) // capacity)
    count = lambda rows: sum(n for _, n in rows)
    found: list[tuple[list[tuple[Configuration, int]], int]] = []
    for large in LARGE:
        got = _solved(histogram, capacity, large)
        found += [got, *(_returned(*got, capacity, waste, share) for waste, share in RETURNED)]
        if min(count(rows) for rows, _ in found) <= max(bound + 1, bound * (1 + GAP)):
            break
    return min(found, key=lambda x: (count(x[0]), -x[1]))


def _returned(rows: list[tuple[Configuration, int]], placed: int, capacity: int, waste: int, share: float) -> tuple[list[tuple[Configuration, int]], int]:
    """A plan of which only ``share`` of the placed rows of each configuration stay, and of those with more than ``waste`` of room none; best-fit decreasing gets the pieces of the others."""
    kept, left, upto = [], Counter(), 0
    for config, n in rows:
        stay = int(n * share + 0.5) if upto < placed and capacity - sum(l * k for l, k in config.items()) <= waste else 0
        if stay:
            kept.append((config, stay))
        left.update({l: k * (n - stay) for l, k in config.items() if n > stay})
        upto += n
    return kept + best_fit_decreasing(left, capacity), sum(n for _, n in kept)


def _solved(histogram: Configuration, capacity: int, large: float) -> tuple[list[tuple[Configuration, int]], int]:
    left = {l: n for l, n in histogram.items() if n > 0 and l < capacity}
    out: dict[tuple[tuple[int, int], ...], int] = {((capacity, 1),): histogram[capacity]} if histogram.get(capacity) else {}
    total, seed = sum(l * n for l, n in left.items()), 0
    while sum(l * n for l, n in left.items()) > max(REMAINDER * total, 2 * capacity):
        solution, _ = cover(left, capacity, seed, large)
        seed, before = seed + 1, sum(out.values())
        order = sorted(solution, key=lambda c: (-sum(l * n for l, n in c), -solution[c], c))
        fill = [sum(l * n for l, n in c) for c in order]
        enough = fill[min(len(fill) - 1, int(np.searchsorted(np.cumsum([solution[c] for c in order]), FULLEST * sum(solution.values()))))]
        for config, full in zip(order, fill, strict=True):
            if full < enough:
                break  # what fills rows worse is solved again with what is left
            whole = min(min(left.get(l, 0) // n for l, n in config), int(solution[config]) or 1)
            if whole:
                out[config] = out.get(config, 0) + whole
                for l, n in config:
                    left[l] -= n * whole
        left = {l: n for l, n in left.items() if n}
        if sum(out.values()) == before:
            break
    placed = sum(out.values())
    return [(dict(c), n) for c, n in out.items()] + best_fit_decreasing(left, capacity), placed


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` (and ``ids``): the pieces of each text's ids and a closing ``end_id``.
    Only longer texts are cut; their first piece takes what full pieces leave."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ids=True)
        for batch in batches:
            for first, last, data, at in slices(batch.column(1)):
                rows: list[list] = [[], [], [], [], [], []]
                for row, ids in enumerate(encode(data, at), first):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    head = (len(ids) - 1) % capacity + 1
                    edges = [0, *range(head, len(ids) + 1, capacity)]
                    for piece, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        for out, value in zip(rows, (row, piece, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e].astype(np.int32) if keep_ids else None), strict=True):
                            out.append(value)
                taken = batch.column(0).take(pa.array(rows[0], pa.int64()))
                columns = [taken, pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(rows[5], pa.list_(pa.int32()))] if keep_ids else []), names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` is read twice: give a kept table.

    Collected to the driver: the histogram, at most ``capacity`` rows. Sent to the tasks: the plan, some thousand configurations, a number that follows the
    number of different lengths and not that of the pieces.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, base = [], 0
    upto: Counter[int] = Counter()
    for config, rows in plan(histogram, capacity)[0]:
        offset = 0
        for l, n in sorted(config.items(), reverse=True):
            slots.append((l, upto[l], n, base, offset))
            upto[l] += n * rows
            offset += l * n
        base += rows
    slots.sort()
    chosen = spark.sparkContext.broadcast([np.array(c, np.int64) for c in zip(*slots, strict=True)] if slots else None)

    # rank within a length: place within (length, bucket), plus the pieces of the length in earlier buckets
    buckets = buckets or max(32, -(-max(histogram.values(), default=0) // BUCKET_PIECES))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32")).cast("long") - 1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = within.join(before, ["length", "bucket"]).withColumn("rank", F.col("place") + F.col("before"))

    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if chosen.value is None:
            return
        length, low, copies, base, begin = chosen.value
        for batch in batches:
            l, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            # slots are in order of (length, low): the last one not after (l, rank) holds the piece
            first = np.searchsorted(length, l)
            span = np.int64(max(int(rank.max(initial=0)), int(low.max())) + 1)
            at = np.searchsorted(length * span + low, l * span + rank, "right") - 1
            assert (at >= first).all()
            row = rank - low[at]
            found = [pa.array(base[at] + row // copies[at]), pa.array(begin[at] + row % copies[at] * l)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))] + found, names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document with its place in a packed sequence.

    Null and empty texts are the closing id alone, one piece of length 1. Very long texts are cut into as many pieces as they
    need. Repeated rows and ids are packed once each. Other columns are left out. An empty table gives no rows.
    """
    pieces = store.keep(token_pieces(docs, tokenizer_path, capacity=capacity, id_col=id_col, text_col=text_col, keep_ids=keep_ids), "pieces")
    return pack_pieces(pieces, capacity=capacity, id_col=id_col)
