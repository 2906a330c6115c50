"""Oriented boxes: polygons to minimum-area rectangles, with every repair and failure recorded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import area, clamp01, corner_order, dedup_points, finite, format_number, let, obb_error, points, staged

RECTANGLE = T.ArrayType(T.DoubleType())


#: Relative difference up to which two areas count as equal.
EQUAL = 1e-9
#: Numbers that one step over a batch holds at once, about.
STEP = 1 << 22


def _chains(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower hulls of many point sets at once (n x most x 2, sorted by x and y; ``counts`` of each are used): place of each hull point, and how many there are. Every set takes its next point in one step
    and drops the points that it makes inner, together with the others."""
    n, most = points.shape[:2]
    stack, size, every = np.zeros((n, most), np.int64), np.zeros(n, np.int64), np.arange(n)
    for i in range(most):
        on = i < counts
        while True:
            a, b = points[every, stack[every, np.maximum(size - 2, 0)]], points[every, stack[every, np.maximum(size - 1, 0)]]
            c = points[:, i]
            turn = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
            drop = on & (size > 1) & (turn <= 0)
            if not drop.any():
                break
            size -= drop
        stack[every[on], size[on]] = i
        size += on
    return stack, size


def least_rectangles(points: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Corners (n x 8) of the smallest rectangle around each of many point sets (n x most x 2, the first ``counts`` of each): one side lies on an edge of the hull, so all edge directions are tried; of equal rectangles the one turned least. NaN
    where the points lie on a line or are fewer than three."""
    n, most = points.shape[:2]
    out = np.full((n, 8), np.nan)
    if not n or not most:
        return out
    unused = np.arange(most)[None, :] >= counts[:, None]
    keys = np.where(unused, np.inf, points[:, :, 0]), np.where(unused, np.inf, points[:, :, 1])
    p = np.take_along_axis(points, np.lexsort((keys[1], keys[0]), axis=1)[:, :, None], axis=1)
    lower, low = _chains(p, counts)
    turned = np.where((np.arange(most)[None, :] < counts[:, None]), counts[:, None] - 1 - np.arange(most)[None, :], 0)
    upper, high = _chains(np.take_along_axis(p, turned[:, :, None], axis=1), counts)
    # the hull counter-clockwise: the lower chain without its last point, then the upper one without its last
    size = np.maximum(low - 1, 0) + np.maximum(high - 1, 0)
    place = np.arange(int(size.max(initial=0)))[None, :]
    first = np.maximum(low - 1, 0)[:, None]
    at_low, at_high = np.minimum(place, most - 1), np.clip(place - first, 0, most - 1)
    index = np.where(place < first, np.take_along_axis(lower, np.broadcast_to(at_low, (n, place.shape[1])), axis=1), np.take_along_axis(turned, np.take_along_axis(upper, at_high, axis=1), axis=1))
    real = place < size[:, None]
    hull = np.take_along_axis(p, np.where(real, index, 0)[:, :, None], axis=1)
    following = np.take_along_axis(hull, np.where(place + 1 < size[:, None], place + 1, 0)[:, :, None], axis=1)
    edges = following - hull
    length = np.linalg.norm(edges, axis=2)
    ok = real & (length > 0)
    axes = edges / np.where(ok, length, 1.0)[:, :, None]
    along, across = np.einsum("nhk,nek->neh", hull, axes), np.einsum("nhk,nek->neh", hull, np.stack([-axes[:, :, 1], axes[:, :, 0]], axis=2))
    shown = real[:, None, :]
    ends = [f(np.where(shown, x, empty), axis=2) for x in (along, across) for f, empty in ((np.min, np.inf), (np.max, -np.inf))] if place.shape[1] else []
    flat = size < 3
    if not ends:
        return out
    area = np.where(ok, (ends[1] - ends[0]) * (ends[3] - ends[2]), np.inf)
    # all rectangles around a triangle on one of its sides are equal: of equal ones that whose sides are turned least
    angle = np.round(np.mod(np.arctan2(axes[:, :, 1], axes[:, :, 0]), np.pi / 2), 9)
    angle[angle >= np.round(np.pi / 2, 9)] = 0.0
    best = np.where(area <= area.min(axis=1, keepdims=True) * (1 + EQUAL), angle, np.inf).argmin(axis=1)
    every = np.arange(n)
    u = axes[every, best]
    v = np.stack([-u[:, 1], u[:, 0]], axis=1)
    a, b, c, d = (e[every, best][:, None] for e in ends)
    corners = np.concatenate([a * u + c * v, b * u + c * v, b * u + d * v, a * u + d * v], axis=1)
    out[~flat] = corners[~flat]
    return out


def rectangles(coords: pa.Array) -> pa.Array:
    """Corners of the smallest rectangle for each list of coordinates, null where there is none: lists of one length in a batch are solved together."""
    counts = pc.fill_null(pc.list_value_length(coords), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    values = pc.list_flatten(coords).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(2 * counts)])
    out = np.full((len(coords), 8), np.nan)
    for k in np.unique(counts[counts > 2]).tolist():
        own = np.flatnonzero(counts == k)
        lot = max(1, STEP // (k * k))
        for some in (own[i : i + lot] for i in range(0, len(own), lot)):
            points = values[begin[some][:, None] + np.arange(2 * k)].reshape(len(some), k, 2)
            out[some] = least_rectangles(points, np.full(len(some), k))
    offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * 8)
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(np.isnan(out[:, 0])))


@F.arrow_udf(RECTANGLE)
def _rectangle(coords: pa.Array) -> pa.Array:
    return rectangles(coords)


def convert(polygons: DataFrame, coords: str = "coords", width: str = "width", height: str = "height", min_area: float = 1e-8) -> DataFrame:
    """``polygons`` with ``corners`` (8 numbers in [0, 1], clockwise from the top-most, left-most), ``reason`` of failure and ``warnings``.

    Order: insufficient_points (under three), conversion_failed (a number that isn't finite, or an unreadable image), clip (warning out_of_bounds), points once each
    (warning duplicate_points), insufficient_points, area_too_small, rectangle in pixels, area_too_small, clip, eight decimals, corner order. Only the
    rectangle itself is computed in Python, on Arrow batches; warnings stay when the line fails.
    """
    c, w, h = F.col(coords), F.col(width), F.col(height)
    clipped = F.transform(c, clamp01)
    known = F.col("_known")
    flat = F.flatten(F.transform(known, lambda p: F.array(p["x"], p["y"])))
    out_of_bounds = F.exists(c, lambda v: (v < 0) | (v > 1))
    step1 = staged(staged(polygons, _known=dedup_points(clipped)), _flat=flat)
    early = (
        F.when(F.size(c) < 6, "insufficient_points")
        .when(F.exists(c, lambda v: ~F.coalesce(finite(v), F.lit(False))) | (F.coalesce(w, F.lit(0)) <= 0) | (F.coalesce(h, F.lit(0)) <= 0) | (F.size(c) % 2 == 1), "conversion_failed")
        .when(F.size(known) < 3, "insufficient_points")
        .when(area(F.col("_flat")) < min_area, "area_too_small")
    )
    pixels = F.transform(F.col("_flat"), lambda v, i: v * F.when(i % 2 == 0, w).otherwise(h))
    step2 = step1.withColumn("_early", early).withColumn("_rect", _rectangle(F.when(F.col("_early").isNull(), pixels)))
    step2 = staged(step2, _normal=F.transform(F.col("_rect"), lambda v, i: v / F.when(i % 2 == 0, w).otherwise(h)))
    normal = F.col("_normal")
    late = F.when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("_rect").isNull(), "conversion_failed").when(area(normal) < min_area, "area_too_small")
    rounded = F.transform(F.transform(normal, clamp01), lambda v: F.bround(v, 8))
    ordered = let(points(rounded), lambda q: F.flatten(F.transform(corner_order(q), lambda p: F.array(p["x"], p["y"]))))
    warnings = F.array_compact(F.array(F.when(out_of_bounds, "out_of_bounds"), F.when(F.size(known) < F.floor(F.size(c) / 2), "duplicate_points")))
    done = step2.withColumn("reason", late).withColumn("warnings", F.when(F.coalesce(F.col("_early"), F.lit("")).isin("conversion_failed") | (F.size(c) < 6), F.expr("cast(array() as array<string>)")).otherwise(warnings))
    return done.withColumn("corners", F.when(F.col("reason").isNull(), ordered)).drop("_known", "_flat", "_early", "_rect", "_normal")


def label_line(class_id: Column, corners: Column) -> Column:
    """Text of an oriented-box line."""
    return F.concat_ws(" ", class_id.cast("string"), F.array_join(F.transform(corners, format_number), " "))


def issues(converted: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each warning and failure: ``keys, severity, reason``."""
    rows = F.concat(F.transform(F.col("warnings"), lambda x: F.struct(F.lit("warning").alias("severity"), x.alias("reason"))), F.when(F.col("reason").isNotNull(), F.array(F.struct(F.lit("error").alias("severity"), F.col("reason").alias("reason")))).otherwise(F.expr("cast(array() as array<struct<severity:string,reason:string>>)")))
    return converted.select(*keys, rows.alias("_rows")).select(*keys, F.inline("_rows"))


def statistics(converted: DataFrame, label: str) -> DataFrame:
    """Conversion counters by split and over all (``split`` = total)."""
    rolled = converted.rollup("split").agg(
        F.count("*").alias("lines"), F.count_if(F.col("reason").isNull()).alias("converted"), F.count_if(F.col("reason").isNotNull()).alias("failed"),
        F.countDistinct(label).alias("labels"), F.count_if(F.array_contains("warnings", "out_of_bounds")).alias("clipped"), F.grouping("split").alias("_all"),
    )
    return rolled.withColumn("split", F.when(F.col("_all") == 1, "total").otherwise(F.col("split"))).drop("_all")


def check_dataset(images: DataFrame, labels: DataFrame, lines: DataFrame, num_classes: int = 15, min_area: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(issues, counts) of a set of oriented boxes. Issues are ``split, key, line_no, error_type``: corrupt_image, missing_label, orphan_label, and the first fault of each line of a label that has an image. Counts
    are one row by split: ``images, labels, corrupt_images, missing_labels, orphan_labels, negative_images`` (labels of an image without a line), ``valid_instances, faulty_lines``.

    ``images``: ``split, key, error`` (null where the image can be read); ``labels``: ``split, key``; ``lines``: ``split, key, line_no, raw``, blank ones are no lines. Keys are unique in a split."""
    if num_classes <= 0 or min_area <= 0:
        raise ValueError("num_classes and min_area must be positive")
    both = images.select("split", "key", "error", F.lit(True).alias("image")).join(labels.select("split", "key", F.lit(True).alias("label")), ["split", "key"], "full_outer")
    image, label = F.col("image").isNotNull(), F.col("label").isNotNull()
    kinds = F.array_compact(F.array(F.when(image & F.col("error").isNotNull(), "corrupt_image"), F.when(image & ~label, "missing_label"), F.when(label & ~image, "orphan_label")))
    said = lines.where(F.trim("raw") != "").join(both.where(image & label).select("split", "key"), ["split", "key"], "left_semi")
    checked = said.select("split", "key", "line_no", obb_error(F.col("raw"), num_classes, min_area).alias("error_type"))
    files = both.select("split", "key", F.lit(None).cast("int").alias("line_no"), F.explode(kinds).alias("error_type"))
    found = files.unionByName(checked.where("error_type is not null"))
    by_file = checked.groupBy("split", "key").agg(F.count_if(F.col("error_type").isNull()).alias("valid"), F.count("error_type").alias("faulty"))
    whole = both.join(by_file, ["split", "key"], "left")
    has = lambda k: F.count_if(F.array_contains(kinds, k))
    counts = whole.groupBy("split").agg(
        F.count_if(image).alias("images"), F.count_if(label).alias("labels"), has("corrupt_image").alias("corrupt_images"), has("missing_label").alias("missing_labels"), has("orphan_label").alias("orphan_labels"),
        F.count_if(image & label & F.col("valid").isNull()).alias("negative_images"), F.coalesce(F.sum("valid"), F.lit(0).cast("long")).alias("valid_instances"), F.coalesce(F.sum("faulty"), F.lit(0).cast("long")).alias("faulty_lines"),
    )
    return found, counts
