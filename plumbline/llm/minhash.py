"""MinHash near-duplicates with tensored banding.

Two small collections of ``side`` keys each, a key being ``rows`` minhashes, are computed for a text; its table keys are
the pairs of one key of each collection. ``side`` squared tables thus cost ``2 * side * rows`` minhashes in place of
``2 * side ** 2 * rows``. Candidates are verified on whole shingle sets.

Texts with equal sets (by a digest of 128 bits) are one class from the start. A class keeps a key only if another class has it too, so the pairs of
keys are made for classes with possible partners alone. In each table bucket every member is first compared with the smallest
member, which costs as many comparisons as rows, and the links found are contracted. In a bucket that still holds several components, only pairs
across components count: the members outside its largest component meet all others, by one byte of each minhash. Those with a possible partner then
bring their whole sets to one task, which counts exact intersections through an inverted index and emits links between components alone: at most one less
than members, however many pairs are near the threshold. A pair counts in the first table that it shares; crowded buckets are dealt into blocks, and
no pair is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.bloom import bloom
from plumbline.llm.components import components
from plumbline.llm.textbytes import BASE, distinct_per_text, mix, shingles, slices

#: With 3 rows a pair at similarity 0.85 shares a key of one side of 10 with 0.99993, at 0.8 a key of 12 with 0.9998.
SIDE, ROWS = 12, 3
#: Members, and bytes of shingle sets, of one side of a group that is compared in a task; larger buckets are dealt into such blocks.
MOST, BLOCK_BYTES = 2000, 16 << 20


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * BASE)
    return seeds[:n] | np.uint64(1), seeds[n:]


def _digests(sets: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each non-empty set."""
    return tuple(mix(np.add.reduceat(mix(sets ^ seed), begin) + counts.astype(np.uint64)) for seed in (BASE, np.uint64(0xC2B2AE3D27D4EB4F)))


def signatures(docs: DataFrame, *, width: int, side: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, d1, d2, left, right, sketch``: ``d1, d2`` are a digest of the set (null for an empty one), ``left`` and ``right`` the keys, ``sketch`` one
    byte of each minhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _parameters(2 * side * rows)
        for batch in batches:
            for start, stop, data, at in slices(batch.column(1)):
                n = stop - start
                sets, edges = distinct_per_text(*shingles(data, at, width), n)
                counts = np.diff(edges)
                some = np.flatnonzero(counts)
                digest = np.zeros((2, n), np.uint64)
                keys = np.zeros((n, 2 * side), np.uint64)
                sketch = np.zeros((n, 2 * side * rows), np.uint8)
                if len(some):
                    begin = edges[some]
                    digest[:, some] = _digests(sets, begin, counts[some])
                    for k in range(2 * side):
                        key = np.full(len(some), k + 1, np.uint64)
                        for r in range(k * rows, (k + 1) * rows):
                            least = mix(np.minimum.reduceat(sets * times[r] + plus[r], begin))
                            sketch[some, r] = (least >> np.uint64(56)).astype(np.uint8)
                            key = mix(key * BASE + least)
                        keys[some, k] = key
                signed = keys.view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * side, side, dtype=np.int32)), pa.array(np.ascontiguousarray(signed[:, s]).ravel())) for s in (slice(0, side), slice(side, None))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(counts), *(pa.array(d.view(np.int64), mask=counts == 0) for d in digest), *lists, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["id", "n_shingles", "d1", "d2", "left", "right", "sketch"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, d1 long, d2 long, left array<long>, right array<long>, sketch binary")


def buckets(classes: DataFrame) -> DataFrame:
    """``key, i, j, node, members, least`` of every table bucket (i, j) with two classes at least. ``classes``: ``node, left, right``."""
    keys = store.keep(classes.select("node", F.size("left").alias("side"), F.posexplode(F.concat("left", "right")).alias("at", "value")).select("node", (F.col("at") >= F.col("side")).alias("right"), F.pmod("at", "side").cast("byte").alias("at"), "value"), "keys")
    shared = keys.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").drop("n")  # a value tells its side and place
    # at most 2 * side values for a node
    held = keys.join(shared, "value").groupBy("node").agg(*(F.collect_list(F.when(F.col("right") == s, F.struct("at", "value"))).alias(c) for s, c in ((False, "l"), (True, "r"))))
    pairs = held.where((F.size("l") > 0) & (F.size("r") > 0)).select("node", "r", F.explode("l").alias("l")).select("node", "l", F.explode("r").alias("r"))
    table_keys = store.keep(pairs.select("node", F.col("l.at").alias("i"), F.col("r.at").alias("j"), F.xxhash64("l.value", "r.value").alias("key")), "table-keys")
    full = table_keys.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("least")).where("members > 1")
    return store.keep(table_keys.join(full, "key"), "buckets")


def sketch_floor(threshold: int, hashes: int) -> int:
    """Equal bytes of ``hashes`` that a pair at the threshold has, less 5 standard deviations."""
    t = threshold / 100
    return int(hashes * t - 5 * (hashes * t * (1 - t)) ** 0.5)


def _whole_groups(batches: Iterator[pa.RecordBatch], solve: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``solve`` on tables that hold whole groups; rows come in the order of their group, the first column. Bounded by the batches and one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        last = int(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[-1])
        if held and (last or group[0] != held[-1].column(0)[-1].as_py()):  # what is held has ended
            yield from solve(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif last:
            yield from solve(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield from solve(pa.Table.from_batches(held))


def _partners(edges: np.ndarray, first: np.ndarray, inner: np.ndarray, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs to look at, in blocks of bounded size. Groups are runs between ``edges``; in each, rows with ``first`` stand before the
    others and meet them, and each other where ``inner`` says so."""
    end = np.repeat(edges[1:], np.diff(edges))
    u = np.flatnonzero(first)
    low = np.where(inner[u], u + 1, np.repeat(edges[:-1] + np.add.reduceat(first.astype(np.int64), edges[:-1]), np.diff(edges))[u])
    count = end[u] - low
    upto = np.concatenate([[0], np.cumsum(count)])
    k = 0
    while k < len(u):
        stop = max(k + 1, int(np.searchsorted(upto, upto[k] + block, "right")) - 1)
        own = count[k:stop]
        left = np.repeat(u[k:stop], own)
        yield left, np.repeat(low[k:stop], own) + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        k = stop


def groups(members: DataFrame, columns: list[str]) -> DataFrame:
    """``group, inner, other`` and ``columns``: the members of each mixed bucket dealt into the groups that together hold every pair across components.
    ``members``: ``key, node, root, columns`` and, of the bucket, ``main`` (its largest component), ``rest, rest_n, main_size, main_n`` (members and shingles).

    Members outside the main component (``other`` is false) are dealt into blocks, which meet each other and the blocks of the main one; all is one group where both have one block."""
    outside = F.col("root") != F.col("main")

    def parts(size: str, n: str):
        return F.greatest(F.lit(1), F.ceil(F.col(size) / MOST), F.ceil(F.col(n) * 8 / BLOCK_BYTES)).cast("int")

    dealt = members.withColumn("rest_parts", parts("rest", "rest_n")).withColumn("main_parts", parts("main_size", "main_n"))
    own = F.pmod(F.xxhash64("node"), F.when(outside, F.col("rest_parts")).otherwise(F.col("main_parts"))).cast("int")
    dealt = dealt.withColumn("own", own)

    def to(a, b, inner, other):
        return F.struct(F.xxhash64("key", a, b).alias("group"), inner.alias("inner"), F.lit(other).alias("other"))

    no = F.lit(False)
    with_main = F.transform(F.sequence(F.lit(0), F.col("main_parts") - 1), lambda j: to(F.col("own"), -1 - j, j == 0, False))
    with_rest = F.transform(F.filter(F.sequence(F.lit(0), F.col("rest_parts") - 1), lambda j: j != F.col("own")), lambda j: F.when(F.col("own") < j, to(F.col("own"), j, no, False)).otherwise(to(j, F.col("own"), no, True)))
    of_main = F.transform(F.sequence(F.lit(0), F.col("rest_parts") - 1), lambda i: to(i, -1 - F.col("own"), no, True))
    return dealt.select(F.explode(F.when(outside, F.concat(with_main, with_rest)).otherwise(of_main)).alias("to"), *columns).select("to.*", *columns)


def active(grouped: DataFrame, *, side: int, hashes: int, threshold: int) -> DataFrame:
    """``group, node, root``: the rows of each group with a row of another component whose size and sketch allow a link. A pair counts in the first table that it
    shares by its whole keys alone. ``grouped``: ``group, inner, other, i, j, node, root, n, left, right, sketch``."""
    floor = sketch_floor(threshold, hashes)

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, first, inner, i, j, node, root, n = (table[c].to_numpy() for c in ("group", "first", "inner", "i", "j", "node", "root", "n"))
        left, right = (table[c].combine_chunks().flatten().to_numpy().reshape(len(group), side) for c in ("left", "right"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(group), hashes)
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        inner = np.repeat(np.maximum.reduceat(inner, edges[:-1]), np.diff(edges)).astype(bool)
        on = np.zeros(len(group), bool)
        for u, v in _partners(edges, first.astype(bool), inner):
            ok = (root[u] != root[v]) & (100 * np.minimum(n[u], n[v]) >= threshold * np.maximum(n[u], n[v]))
            u, v = u[ok], v[ok]
            for k in range(0, len(u), 1 << 14):
                a, b = u[k : k + (1 << 14)], v[k : k + (1 << 14)]
                near = (sketch[a] == sketch[b]).sum(1) >= floor
                a, b = a[near], b[near]
                here = ((left[a] == left[b]).argmax(1) == i[a]) & ((right[a] == right[b]).argmax(1) == j[a])
                on[a[here]] = on[b[here]] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (group, node, root)], names=["group", "node", "root"])

    dealt = grouped.select("group", (~F.col("other")).cast("int").alias("first"), F.col("inner").cast("int").alias("inner"), "i", "j", "node", "root", "n", "left", "right", "sketch")
    return dealt.repartition("group").sortWithinPartitions("group", F.desc("first")).mapInArrow(lambda batches: _whole_groups(batches, solve), "group long, node long, root long")


def linked_roots(rows: DataFrame, threshold: int) -> DataFrame:
    """``a, b``: links between components found on the whole sets of the rows of each group, not more than a group needs to be joined.
    ``rows``: ``group, node, root, hashes`` (sorted 64-bit numbers)."""

    def links(root: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        names, own = np.unique(root, return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
        holder = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(shingle, kind="stable")
        posting, at = holder[order], np.concatenate([[0], np.cumsum(np.bincount(shingle))])  # rows that hold a shingle
        begin = np.concatenate([[0], np.cumsum(sizes)])
        largest = np.bincount(own).argmax()
        joined = np.arange(len(names))  # the joined components of this group so far
        for u in np.flatnonzero(own != largest).tolist():
            if (joined == joined[0]).all():
                return
            ids = shingle[begin[u] : begin[u + 1]]
            count = at[ids + 1] - at[ids]
            where = np.repeat(at[ids] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            both = np.bincount(posting[where], minlength=len(sets))
            ok = 100 * both >= threshold * (sizes + sizes[u] - both)
            for other in np.unique(own[ok]).tolist():
                if joined[other] != joined[own[u]]:
                    joined[joined == joined[other]] = joined[own[u]]
                    yield int(names[other]), int(names[own[u]])

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, root = table["group"].to_numpy(), table["root"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
        column, out = table["hashes"], []
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            out += links(root[s:e], [np.frombuffer(x.as_buffer(), np.uint64) for x in column.slice(s, e - s)])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.select("group", "root", "hashes").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(lambda batches: _whole_groups(batches, solve), "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` with 100 * intersection >= threshold * union. ``sets``: ``node, hashes`` (sorted 64-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = int(len(np.intersect1d(u, v, assume_unique=True)))
                ok.append(100 * both >= threshold * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    x, y = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"{k}_hashes")) for k in "ab")
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "a_hashes", "b_hashes").mapInArrow(run, "a long, b long")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, *, width: int, id_col: str, text_col: str) -> DataFrame:
    """``node, hashes`` of the classes in ``wanted`` (``node, d1, d2, id``), from the text of one row of each. Only rows whose id passes a filter of bounded size
    make their sets, and the exact join follows."""
    there = bloom(wanted.select(F.xxhash64("id").alias("key")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(there.value.test(batch.column(2).to_numpy().view(np.uint64))))
            for start, stop, data, at in slices(batch.column(1)):
                sets, edges = distinct_per_text(*shingles(data, at, width), stop - start)
                counts = np.diff(edges)
                if len(some := np.flatnonzero(counts)):
                    digests = (pa.array(d.view(np.int64)) for d in _digests(sets, edges[some], counts[some]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + start)), *digests, pa.array([sets[edges[i] : edges[i + 1]].tobytes() for i in some], pa.binary())], names=["id", "d1", "d2", "hashes"])

    kind = dict(docs.dtypes)[id_col]
    made = docs.select(F.col(id_col).alias("id"), text_col, F.xxhash64(id_col).alias("key")).mapInArrow(run, f"id {kind}, d1 long, d2 long, hashes binary")
    own = wanted.select("node", "d1", "d2", F.col("id").alias("own"))
    return made.join(own, ["d1", "d2"]).where(F.col("id").eqNullSafe(F.col("own"))).select("node", "hashes").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, *, width: int = 5, threshold: int = 80, side: int = SIDE, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept``: rows linked when their sets of distinct ``width``-word shingles (lower-cased A-Z, words
    parted by ASCII white space) have 100 * intersection >= ``threshold`` * union; ``component_id`` is the smallest id reachable.

    Texts of fewer words have their whole sequence as one shingle; null and blank texts have the empty set and are linked with nothing.
    Equal texts are linked at once. A repeated id gives a row for each of its rows. Null ids form no smallest id unless
    a component has no other. Very long texts are taken whole. Extra columns are left out. An empty table gives no rows.
    """
    signed = store.keep(signatures(docs, width=width, side=side, rows=rows, id_col=id_col, text_col=text_col), "signatures")
    one_of = signed.where("d1 is not null").groupBy("d1", "d2").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("left", "right", "n_shingles", "sketch")))
    # numbered as it is written, so the numbers last
    classes = store.keep(one_of.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "id", "left", "right", F.col("n_shingles").alias("n"), "sketch"), "classes")
    held = buckets(classes.select("node", "left", "right"))

    # every member against the smallest of its bucket
    star = held.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    shapes = classes.select("node", "n", "sketch")
    floor = sketch_floor(threshold, 2 * side * rows)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, 2 * side * rows) for k in (2, 3))
            keep = pa.array((x == y).sum(1) >= floor)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    x, y = (shapes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    sized = star.join(x, "a").join(y, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold)
    fitting = store.keep(sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(near, "a long, b long"), "star")

    wanted = classes.join(held.select("node").distinct(), "node").select("node", "d1", "d2", "id")
    sets = store.keep(_shingle_sets(docs, wanted, width=width, id_col=id_col, text_col=text_col), "sets")
    root = components(verified(fitting, sets, threshold))

    # buckets that hold several components: the members outside the largest one against all. What belongs to a class meets it once and is then dealt to its
    # places, of which it has side squared at most
    placed = held.where("members > 2").groupBy("node").agg(F.collect_list(F.struct("key", "i", "j")).alias("places"))
    placed = placed.join(root, "node", "left").join(classes.select("node", "n"), "node").select("node", F.coalesce("root", "node").alias("root"), "n", "places")
    placed = store.keep(placed, "placed").select("node", "root", "n", F.inline("places"))
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    mixed = by_root.groupBy("key").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "root", "s")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    mixed = mixed.select("key", F.col("main.root").alias("main"), (F.col("c") - F.col("main.c")).alias("rest"), (F.col("s") - F.col("main.s")).alias("rest_n"), F.col("main.c").alias("main_size"), F.col("main.s").alias("main_n"))
    of_place = ["key", "i", "j", "main", "rest", "rest_n", "main_size", "main_n"]
    members = placed.join(mixed, "key").groupBy("node", "root", "n").agg(F.collect_list(F.struct(*of_place)).alias("places"))
    members = members.join(classes.select("node", "left", "right", "sketch"), "node").select("node", "root", "n", "left", "right", "sketch", F.inline("places"))
    grouped = groups(members, ["i", "j", "node", "root", "n", "left", "right", "sketch"])
    near_rows = store.keep(active(grouped, side=side, hashes=2 * side * rows, threshold=threshold), "active")
    near_rows = near_rows.groupBy("node", "root").agg(F.collect_list("group").alias("groups")).join(sets, "node").select(F.explode("groups").alias("group"), "node", "root", "hashes")
    links = store.keep(linked_roots(near_rows, threshold), "links")
    named = classes.select("node", "d1", "d2", "id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not links.isEmpty():
        upper = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
        named = named.join(upper, "root", "left").withColumn("root", F.coalesce("top", "root"))

    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = named.join(least, "root").select("d1", "d2", "component_id")
    out = signed.select("id", "n_shingles", "d1", "d2").join(labels, ["d1", "d2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
