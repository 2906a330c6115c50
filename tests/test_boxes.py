"""Smallest rectangles of whole batches, the check of oriented-box sets, and the repair gate."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.operators import freeze, obb


def best_over_angles(points):
    """Area of the smallest rectangle over the directions of all pairs of points."""
    best = math.inf
    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            d = math.hypot(b[0] - a[0], b[1] - a[1])
            if not d:
                continue
            u = ((b[0] - a[0]) / d, (b[1] - a[1]) / d)
            along = [p[0] * u[0] + p[1] * u[1] for p in points]
            across = [p[1] * u[0] - p[0] * u[1] for p in points]
            best = min(best, (max(along) - min(along)) * (max(across) - min(across)))
    return best


def on_a_line(points):
    a = points[0]
    return all(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) <= 0 for b in points for c in points)


def test_rectangles_of_a_batch():
    rng = random.Random(12)
    lists = [None, [], [1.0, 2.0], [0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0, 2.0, 2.0], [3.0, 3.0] * 4, [0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0], [0.0, 0.0, 2.0, 0.0, 1.0, 5.0]]
    for _ in range(300):
        n = rng.choice([3, 4, 5, 8, 30])
        grid = rng.random() < 0.3
        lists.append([float(rng.randrange(6)) if grid else rng.uniform(0, 100) for _ in range(2 * n)])
    got = obb.rectangles(pa.array(lists, pa.list_(pa.float64()))).to_pylist()
    for flat, corners in zip(lists, got, strict=True):
        points = list(zip((flat or [])[::2], (flat or [])[1::2], strict=True))
        if len(set(points)) < 3 or on_a_line(points):
            assert corners is None, flat
            continue
        c = np.array(corners).reshape(4, 2)
        sides = np.roll(c, -1, axis=0) - c
        assert abs(sides[0] @ sides[1]) < 1e-6 and np.allclose(sides[0], -sides[2])
        area = np.linalg.norm(sides[0]) * np.linalg.norm(sides[1])
        assert area == pytest.approx(best_over_angles(points), rel=1e-9, abs=1e-9)
        u, v = (s / np.linalg.norm(s) for s in sides[:2])
        inside = (np.array(points) - c[0]) @ np.column_stack([u, v])
        assert (inside >= -1e-6).all() and (inside[:, 0] <= np.linalg.norm(sides[0]) + 1e-6).all() and (inside[:, 1] <= np.linalg.norm(sides[1]) + 1e-6).all()


def test_check_of_a_box_set(spark):
    images = spark.createDataFrame([("train", "a", None), ("train", "b", "broken"), ("train", "c", None), ("val", "a", None), ("val", "n", None)], "split string, key string, error string")
    labels = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "a"), ("val", "x"), ("val", "n")], "split string, key string")
    good = "3 0.1 0.1 0.8 0.1 0.8 0.8 0.1 0.8"
    lines = spark.createDataFrame([("train", "a", 1, good), ("train", "a", 2, "3 0.1"), ("train", "b", 1, good), ("val", "a", 1, good.replace("3", "99", 1)), ("val", "x", 1, "bad"), ("val", "n", 1, "  ")], "split string, key string, line_no int, raw string")
    issues, counts = obb.check_dataset(images, labels, lines)
    assert {tuple(r) for r in issues.collect()} == {("train", "b", None, "corrupt_image"), ("train", "c", None, "missing_label"), ("val", "x", None, "orphan_label"), ("train", "a", 2, "obb_field_count"), ("val", "a", 1, "obb_class_id")}
    assert {r["split"]: tuple(r)[1:] for r in counts.collect()} == {"train": (3, 2, 1, 1, 0, 0, 2, 1), "val": (2, 3, 0, 0, 1, 1, 0, 1)}
    with pytest.raises(ValueError, match="positive"):
        obb.check_dataset(images, labels, lines, num_classes=0)


def test_repair_gate(spark):
    lines = spark.createDataFrame([("a", 1, "0 0.1 0.1 0.9 0.1 1.005 0.9"), ("a", 2, "0 0.1 0.1 0.9 0.1 0.5 0.9"), ("b", 1, "0 0.1 0.1 0.9 0.1 1.5 0.9"), ("c", 1, "x")], "file_id string, line_no int, raw string")
    passed, faults = freeze.repair_gate(lines, 15)
    assert {(r["file_id"], r["line_no"], r["text"], r["fixed_points"]) for r in passed.collect()} == {("a", 1, "0 0.1 0.1 0.9 0.1 1 0.9", 1), ("a", 2, "0 0.1 0.1 0.9 0.1 0.5 0.9", 0)}
    assert {(r["file_id"], r["error_type"]) for r in faults.collect()} == {("b", "polygon_coordinate_range"), ("c", "class_id")}
    with pytest.raises(ValueError, match="2 label files"):
        freeze.require_clean(faults)
    freeze.require_clean(faults.limit(0))
