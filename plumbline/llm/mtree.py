"""Exact top-k by inner product with an M-tree.

Vectors of a block get one more component that brings them to one length; the largest inner product is then the smallest Euclidean
distance, a metric. The index is a table of pages: an inner page holds routing vectors with covering radii, child pages and distances
to the page's own routing vector; a leaf holds vectors with their distances to it. A search takes pages from a queue by their
least possible distance. Before a distance is computed, the stored ones bound it from below by the triangle
inequality: |d(q, parent) - d(entry, parent)| - radius; an entry beyond the k-th best so far is passed over.

Blocks have a bounded number of rows, dealt by a hash. A block's pages are read once by one task, through which all queries stream in bounded batches, and
each query's blocks are merged at the end. The bounds save only what the vectors' structure allows: on clustered ones most distances, on isotropic ones of many
dimensions, where all are about equally far, next to none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import store

BLOCK_ROWS = 8_192
LEAF, FAN = 64, 24
PAGE_SCHEMA = "dim int, block long, page int, leaf boolean, lift double, refs array<long>, vectors binary, radii array<double>, to_parent array<double>"


def build_pages(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(page, is leaf, refs, vectors, radii, distances to the parent's routing vector); page 0 is the root. ``vectors``: lifted
    float64 rows. Bulk-loaded: the rows of a page are parted around centres that a few rounds of k-means move, for small radii. Equal vectors, however many, are spread
    over leaves of bounded size."""
    rng = np.random.default_rng(len(ids))
    pages: list = [None]

    def split(rows: np.ndarray) -> list[np.ndarray]:
        k = min(fan, -(-len(rows) // (leaf // 2)))
        own = vectors[rows]
        pivots = own[rng.choice(len(rows), k, replace=False)]
        for _ in range(4):
            near = np.argmin((pivots**2).sum(1)[None, :] - 2 * own @ pivots.T, axis=1)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(pivots)
            np.add.at(total, near, own)
            pivots = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], pivots)
        parts = [rows[near == j] for j in range(k)]
        parts = [p for p in parts if len(p)]
        return parts if len(parts) > 1 else list(np.array_split(rows, k))

    todo = [(0, np.arange(len(ids)), None)]
    while todo:
        page, rows, routing = todo.pop()
        if len(rows) <= leaf:
            to_parent = np.zeros(len(rows)) if routing is None else np.sqrt(((vectors[rows] - routing) ** 2).sum(1))
            pages[page] = (page, True, ids[rows], vectors[rows], np.zeros(len(rows)), to_parent)
            continue
        centres, radii, refs = [], [], []
        for part in split(rows):
            mean = vectors[part].mean(0)
            centre = vectors[part[np.argmin(((vectors[part] - mean) ** 2).sum(1))]]
            centres.append(centre)
            radii.append(np.sqrt(((vectors[part] - centre) ** 2).sum(1).max()))
            refs.append(len(pages))
            pages.append(None)
            todo.append((refs[-1], part, centre))
        centres = np.array(centres)
        to_parent = np.zeros(len(refs)) if routing is None else np.sqrt(((centres - routing) ** 2).sum(1))
        pages[page] = (page, False, np.array(refs), centres, np.array(radii), to_parent)
    return iter(pages)


def _scores(vectors: np.ndarray, query: np.ndarray, safe: bool) -> list[int]:
    """Exact inner products of integer rows: by floating point where every product and sum is a whole number that it holds, else by Python's integers. Scores
    beyond 64 bits become the nearest number that a long holds."""
    if safe:
        return np.rint(vectors @ query).astype(np.int64).tolist()
    low, high = -(1 << 63), (1 << 63) - 1
    exact = [int(c) for c in query]
    return [min(high, max(low, sum(int(a) * b for a, b in zip(row, exact, strict=True)))) for row in vectors]


def search(pages: list[tuple], lift: float, query: np.ndarray, own: int, k: int, safe: bool = True, computed: list[int] | None = None) -> list[tuple[int, int]]:
    """[(score, id)] of the ``k`` best rows but those with id ``own``, best first, ties by smaller id. Leaves hold integer rows, inner pages lifted ones. ``computed``
    takes the number of distances and products computed."""
    exact = query.astype(np.float64) if safe else query
    q = np.append(query.astype(np.float64), 0.0)
    length = float(q @ q)
    slack = 1e-6 * (1.0 + np.sqrt(length + lift))
    best: list[tuple[int, int]] = []  # heap of (score, -id)
    limit = np.inf  # distance of the k-th best
    queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
    work = 0
    while queue and queue[0][0] <= limit + slack:
        _, page, to_page = heapq.heappop(queue)
        leaf, refs, vectors, radii, to_parent = pages[page]
        use = np.arange(len(refs)) if to_page < 0 else np.flatnonzero(np.abs(to_page - to_parent) - radii <= limit + slack)
        if not len(use):
            continue
        work += len(use)
        if leaf:
            for ref, score in zip(refs[use].tolist(), _scores(vectors[use], exact, safe), strict=True):
                if ref == own or (len(best) == k and score < best[0][0]):
                    continue
                entry = (score, -ref)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                limit = float(np.sqrt(max(0.0, length + lift - 2 * best[0][0])))
        else:
            d = np.sqrt(np.maximum(0.0, ((vectors[use] - q) ** 2).sum(1)))
            least = np.maximum(0.0, d - radii[use])
            for j in np.flatnonzero(least <= limit + slack).tolist():
                heapq.heappush(queue, (float(least[j]), int(refs[use[j]]), float(d[j])))
    if computed is not None:
        computed.append(work)
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, dim, v``: components floor(scale * x) as little-endian 64-bit integers (the nearest such number for larger ones); rows that take no part are left out."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(scale) * c.cast("double")))
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).where(finite).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            flat = flat.astype("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int32()), pa.array([flat[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "dim", "v"])

    return rows.mapInArrow(run, "id long, dim int, v binary")


def _matrix(column: pa.ChunkedArray, dim: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The page table of ``vectors``, kept in the shared folder."""
    rows = store.keep(_packed(vectors, id_col, vector_col, scale), "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1000).collect()}
    blocks = max(1, -(-max(sizes.values(), default=0) // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)))

    def build(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        whole = _matrix(table["v"], dim)
        x = whole.astype(np.float64)
        norms = (x * x).sum(1)
        lift = float(norms.max())
        lifted = np.column_stack([x, np.sqrt(np.maximum(0.0, lift - norms))])
        ids = table["id"].to_numpy()
        out = [
            (dim, block, page, leaf, lift, (ids[refs] if leaf else refs).tolist(), whole[refs].tobytes() if leaf else v.astype("<f8").tobytes(), radii.tolist(), to_parent.tolist())
            for page, leaf, refs, v, radii, to_parent in build_pages(np.arange(len(ids)), lifted)
        ]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        names = [c.strip().split(" ")[0] for c in PAGE_SCHEMA.split(",")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return store.keep(dealt.groupBy("dim", "block").applyInArrow(build, PAGE_SCHEMA), "pages")


def top_k(index: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` rows of the index with the greatest inner product (all, if fewer),
    ties to the smaller id; rows with the query's own id are left out.

    Null vectors, vectors without components and those with null or non-finite ones take no part. Vectors meet
    those of equal dimension. A repeated query id asks once, with the smallest of its vectors; repeated candidates each count. Components of any finite size
    count exactly up to 64 bits. Extra columns are left out. Empty tables give no rows.
    """
    asked = store.keep(_packed(queries, id_col, vector_col, scale).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.*"), "queries")
    blocks = store.keep(index.select("dim", "block").distinct(), "blocks")
    # the stated query set against all blocks: a block's pages come first, then the queries
    page = [c.strip().split(" ")[0] for c in PAGE_SCHEMA.split(",")]
    kinds = dict(index.dtypes)
    to_block = asked.join(blocks, "dim").select("dim", "block", *(F.col("id").alias(c) if c == "query" else F.col("v").alias(c) if c == "vectors" else F.lit(None).cast(kinds[c]).alias(c) for c in ["query", *page[2:]]))
    pages = index.select("dim", "block", F.lit(None).cast("long").alias("query"), *page[2:])
    both = pages.unionByName(to_block).withColumn("group", F.xxhash64("dim", "block")).repartition("group").sortWithinPartitions("dim", "block", F.col("query").isNotNull(), "page", "query")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, lift, largest = None, [], 0.0, 0
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            dims, numbers, asking, vectors = (batch.column(batch.schema.get_field_index(c)) for c in ("dim", "block", "query", "vectors"))
            others = [batch.column(batch.schema.get_field_index(c)) for c in ("leaf", "refs", "radii", "to_parent", "lift")]
            for i, (dim, block, query) in enumerate(zip(dims.to_pylist(), numbers.to_pylist(), asking.to_pylist(), strict=True)):
                if (dim, block) != at:
                    at, tree, largest = (dim, block), [], 0
                raw = vectors[i].as_buffer()
                if query is None:
                    leaf, refs, radii, to_parent, lift = (c[i].as_py() for c in others)
                    held = np.frombuffer(raw, "<i8" if leaf else "<f8").reshape(len(refs), -1)
                    if leaf:
                        largest = max(largest, -int(held.min()), int(held.max()))
                    tree.append((leaf, np.array(refs, np.int64), held, np.array(radii), np.array(to_parent)))
                elif tree:
                    v = np.frombuffer(raw, "<i8")
                    most = max(-int(v.min()), int(v.max()))
                    safe = dim * largest * most < 1 << 53
                    out += [(query, i, s) for s, i in search(tree, lift, v, query, k, safe)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(find, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
