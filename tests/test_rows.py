"""Row-level rules against plain Python on random lines, and some cases by hand."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import obb

NUMBER = re.compile(r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|nan|inf|infinity)", re.I)


def random_lines(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    out = ["", "   ", "\t"]
    for _ in range(n):
        count = rng.choice([0, 1, 4, 5, 6, 6, 6, 7, 8, 8, 10, 12])
        draw = lambda: rng.choice(["%.3f" % rng.random()] * 12 + ["0", "1", ".25", "7e-1", "-0.004", "1.007", "-0.01", "1.0101", "1.4", "-2", "NaN", "inf", "1d", "0x1", "2_0", "q"])
        coords = [draw() for _ in range(count)]
        if count >= 6 and rng.random() < 0.2:  # few different points
            coords = (coords[:2] * count)[:count]
        out.append(rng.choice(["", " "]) + rng.choice([" ", "  ", "\t"]).join([rng.choice(["3", "11", "0", "12", "-4", "7.5", "6.0", "1e1", "k", "nan", "40"]), *coords]))
    return out


def parsed(raw: str):
    tok = raw.split()
    num = [float(t) if NUMBER.fullmatch(t) else None for t in tok]
    head = num[0] if tok else None
    cls = int(head) if head is not None and math.isfinite(head) and head == int(head) and head >= 0 else None
    return tok, cls, num[1:], [(0.0 if math.isnan(v) else min(1.0, max(0.0, v))) if v is not None else None for v in num[1:]]


def within(v, low, high):
    return math.isfinite(v) and low <= v <= high


def pairs(c):
    return [(c[k], c[k + 1]) for k in range(0, len(c) - 1, 2)]


def slow_validation(raw: str, classes: int, strict: bool):
    tok, cls, coords, used = parsed(raw)
    if not tok:
        return "polygon_format", None, None
    if cls is None or cls >= classes:
        return "class_id", None, None
    if None in coords:
        return "polygon_non_numeric", None, None
    if len(coords) == 4:
        return "bbox_format", None, None
    if len(coords) % 2 or len(coords) < 6:
        return "polygon_coordinate_count", None, None
    soft = [p for p in pairs(coords) if not all(within(v, 0, 1) for v in p)]
    if any(not within(v, -0.01, 1.01) for v in coords) or (strict and soft):
        return "polygon_coordinate_range", None, None
    if len(set(pairs(used))) < 3:
        return "polygon_geometry", None, None
    if not soft:
        return None, None, None
    return None, " ".join([tok[0], *(t if within(v, 0, 1) else "0" if v < 0 else "1" for t, v in zip(tok[1:], coords, strict=True))]), len(soft)


@pytest.mark.parametrize("mode", ["strict", "auto-fix"])
def test_validation_equals_plain_python(spark, mode):
    lines = random_lines(11, 3000)
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, raw string")
    got = {r["k"]: (r["error_type"], r["fixed_line"], r["fixed_points"]) for r in C.validate_lines(rows, 12, mode).collect()}
    assert got == {k: slow_validation(x, 12, mode == "strict") for k, x in enumerate(lines)}
    assert len({e for e, _, _ in got.values()}) == 8


def test_validation_messages(spark):
    rows = spark.createDataFrame([(1, "40 0.2 0.3"), (2, "4 0.2 0.3 0.4 0.5 0.6"), (3, "4 0.2 0.3 0.4 1.7 0.6 0.1"), (4, "4 0.2 0.3 0.4 0.5 0.6 1.004")], "k int, raw string")
    assert {r["k"]: r["message"] for r in C.validate_lines(rows, 12, "strict").collect()} == {1: "40", 2: "5", 3: "point 2", 4: "point 3"}
    soft = C.validate_lines(rows.where("k = 4"), 12, "auto-fix").first()
    assert (soft["fixed_line"], soft["fixed_points"]) == ("4 0.2 0.3 0.4 0.5 0.6 1", 1) and soft["max_offset"] == pytest.approx(0.004)


def slow_statistics(raw: str, classes: range):
    tok, cls, coords, used = parsed(raw)
    if cls is None or cls not in classes:
        return None, None, "class_id", False
    if len(tok) < 7 or len(coords) % 2:
        return cls, None, "polygon_coordinate_count", False
    if None in coords:
        return cls, None, "polygon_coordinate_value", False
    outside = any(not within(v, 0, 1) for v in coords)
    if outside and any(not within(v, -0.01, 1.01) for v in coords):
        return cls, None, "polygon_coordinate_range", False
    p = pairs(used)
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2
    if len(set(p)) < 3 or area <= 0:
        return cls, None, "polygon_geometry", outside
    return cls, "soft_clipped" if outside else "valid", None, outside


def test_statistics_parse_equals_plain_python(spark):
    lines = random_lines(12, 3000)
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, raw string")
    got = {r["k"]: (r["class_id"], r["geometry_status"], r["hard_error"], r["soft_error"]) for r in C.parse_instances(rows, list(range(12))).collect()}
    assert got == {k: slow_statistics(x, range(12)) for k, x in enumerate(lines)}
    plan = C.parse_instances(rows, list(range(12))).select("class_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "exists(" not in plan  # classes alone parse no coordinates


def test_coordinate_issues_equal_plain_python(spark):
    rng = random.Random(13)
    lines = [[rng.choice([rng.random(), rng.uniform(-0.02, 1.02), 3.5, -1.0]) for _ in range(2 * rng.randint(3, 6))] for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, coords array<double>").select("k", F.inline(C.coordinate_issues(F.col("coords"))))
    got = sorted((r["k"], r["position"], r["coordinate_severity"], r["line_severity"], r["reset_value"], r["direction"], r["action"]) for r in rows.collect())
    want = []
    for k, c in enumerate(lines):
        soft = all(-0.01 <= v <= 1.01 for v in c)
        for i, v in enumerate(c):
            if not 0 <= v <= 1:
                want.append((k, f"point_{i // 2 + 1}_{'xy'[i % 2]}", "soft" if -0.01 <= v <= 1.01 else "hard", "soft" if soft else "hard", float(v > 1) if soft else None, "below" if v < 0 else "above", "clip" if soft else "review"))
    assert got == sorted(want, key=lambda r: r[:2])


def test_geometry_of_a_right_triangle(spark):
    rows = spark.createDataFrame([([0.25, 0.5, 0.75, 0.5, 0.25, 0.75], 160, 80)], "c array<double>, w int, h int")
    g = rows.select(C.geometry(F.col("c"), F.col("w"), F.col("h")).alias("g")).first()["g"]
    assert [round(x, 9) for x in (g["bbox_width_px"], g["bbox_height_px"], g["bbox_area_px"], g["mask_area_px"], g["mask_area_relative"])] == [80, 20, 1600, 800, 0.0625]
    assert g["size"] == "medium"


def slow_box(raw: str):
    tok, _, coords, _ = parsed(raw)
    if len(tok) != 9:
        return "obb_field_count"
    head = float(tok[0]) if NUMBER.fullmatch(tok[0]) else math.nan
    if not math.isfinite(head):
        return "obb_numeric_format"
    if head != int(head) or not 0 <= head < 15:
        return "obb_class_id"
    if any(v is None or not math.isfinite(v) for v in coords):
        return "obb_numeric_format"
    if any(not 0 <= v <= 1 for v in coords):
        return "obb_coordinate_range"
    p = pairs(coords)
    if len({(round(x, 12), round(y, 12)) for x, y in p}) < 4:
        return "obb_duplicate_points"
    signed = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2
    if abs(signed) <= 1e-8:
        return "obb_area_too_small"
    return "obb_point_order" if signed <= 0 or p[0] != min(p, key=lambda q: (q[1], q[0])) else None


def test_obb_lines_equal_plain_python(spark):
    rng = random.Random(14)
    lines = []
    for _ in range(1500):
        x, y, w, h = rng.uniform(0, 0.5), rng.uniform(0, 0.5), rng.uniform(0, 0.6), rng.uniform(0, 0.6)
        p = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        turn = rng.randrange(4)
        p = p[turn:] + p[:turn] if rng.random() < 0.4 else p
        p = p[::-1] if rng.random() < 0.2 else p
        if rng.random() < 0.15:
            p[rng.randrange(4)] = p[rng.randrange(4)]
        if rng.random() < 0.1:
            p = [(0.125 * k, 0.125 * k) for k in range(1, 5)]
        tok = [rng.choice(["0", "9", "14", "15", "2.5", "nan", "z"][: rng.choice([3, 7])]), *(repr(round(v, 4)) for q in p for v in q)]
        lines.append(" ".join(tok[: rng.choice([9] * 9 + [7])]))
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, raw string").select("k", C.obb_error(F.col("raw")).alias("e"))
    got = {r["k"]: r["e"] for r in rows.collect()}
    assert got == {k: slow_box(x) for k, x in enumerate(lines)} and len(set(got.values())) == 8


def rectangle(cx, cy, w, h, angle):
    c, s = math.cos(angle), math.sin(angle)
    return [(cx + x * c - y * s, cy + x * s + y * c) for x, y in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]


def test_conversion_finds_the_least_rectangle(spark):
    """Points on a turned rectangle give it back; for random points no rectangle at any of many angles is smaller."""
    rng = random.Random(15)
    size, cases, boxes = 1000, [], {}
    for k in range(60):
        box = rectangle(rng.uniform(400, 600), rng.uniform(400, 600), rng.uniform(50, 300), rng.uniform(50, 300), rng.uniform(0, math.pi))
        boxes[k] = box
        inner = [(box[0][0] + t * (box[2][0] - box[0][0]), box[0][1] + t * (box[2][1] - box[0][1])) for t in (0.25, 0.5)]
        cases.append((k, [v / size for p in [*box, *inner] for v in p], size, size))
    clouds = {100 + k: [(rng.uniform(200, 800), rng.uniform(200, 800)) for _ in range(rng.randint(3, 9))] for k in range(60)}
    cases += [(k, [v / size for p in c for v in p], size, size) for k, c in clouds.items()]
    got = {r["k"]: r for r in obb.convert(spark.createDataFrame(cases, "k int, coords array<double>, width int, height int")).collect()}
    for k, box in boxes.items():
        assert sorted((round(x * size), round(y * size)) for x, y in pairs(got[k]["corners"])) == sorted((round(x), round(y)) for x, y in box)
    for k, cloud in clouds.items():
        p = [(x * size, y * size) for x, y in pairs(got[k]["corners"])]
        made = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2
        best = math.inf
        for step in range(1800):
            c, s = math.cos(step * math.pi / 3600), math.sin(step * math.pi / 3600)
            xs, ys = [x * c + y * s for x, y in cloud], [y * c - x * s for x, y in cloud]
            best = min(best, (max(xs) - min(xs)) * (max(ys) - min(ys)))
        assert made <= best * 1.0001


def test_conversion_reports_why(spark):
    cases = {1: [0.2, 0.3, 0.6, 0.7], 2: [0.1, 0.1, 0.4, 0.4, 0.7, 0.7], 3: [0.3, 0.2, 0.3, 0.2, 0.6, 0.9], 4: [-0.25, 0.25, 0.5, 0.25, 0.5, 0.75, -0.25, 0.75]}
    rows = spark.createDataFrame([(k, c, 64, 32) for k, c in cases.items()], "k int, coords array<double>, width int, height int")
    got = {r["k"]: (r["reason"], r["warnings"]) for r in obb.convert(rows).collect()}
    assert got == {1: ("insufficient_points", []), 2: ("area_too_small", []), 3: ("insufficient_points", ["duplicate_points"]), 4: (None, ["out_of_bounds"])}


def test_small_forms(spark):
    row = spark.createDataFrame([("7-3-204-DSC00042-9.png", "Some.Folder/Pic.Of.X.png")], "name string, path string").select(
        C.capture_key(F.col("name")), C.frame_number(F.col("name")), C.sample_key(F.col("path")), C.format_number(F.lit(25.0)), C.format_number(F.lit(0.0625)), C.clamp01(F.lit(float("nan"))), C.class_label(F.lit(None).cast("string"), F.lit(3)), C.class_group(F.lit("left--right"))
    ).first()
    assert list(row) == ["7-3-204", 42, "some.folder/pic.of.x", "25", "0.0625", 0.0, "unknown_3", "left"]


def test_near_hash_pairs_are_whole(spark, monkeypatch):
    from plumbline.operators import dedup

    monkeypatch.setattr(dedup, "HASHES", 3)
    spread = sum(1 << k for k in (3, 20, 40, 60))  # one bit in each 16-bit chunk
    hashes = [0, spread, -1, (1 << 63) - 1, 7, 15, 1 << 50] + [1 << k for k in range(30)]
    rows = [(k, "val" if k % 3 == 0 else "train", h - (1 << 64) if h >= 1 << 63 else h) for k, h in enumerate(hashes)] + [(1000 + k, "val" if k % 2 else "train", 99) for k in range(600)]
    got = {tuple(r) for r in dedup.near_hash_pairs(spark.createDataFrame(rows, "id long, split string, hash long")).collect()}
    want = {(a, b, n) for a, s, x in rows if s == "train" for b, t, y in rows if t == "val" and (n := ((x ^ y) & (1 << 64) - 1).bit_count()) <= 4}
    assert got == want and (1, 0, 4) in want and len(want) > 90_000


def test_dataset_digest_holds_no_group(spark):
    import hashlib
    import zlib

    from plumbline.operators.dedup import dataset_digest

    names = [f"f{k}" for k in range(300)]
    files = spark.createDataFrame([(n, f"s{n}") for n in names], "path string, sha256 string")

    def digest(lines):
        return hashlib.sha256("".join(lines).encode()).hexdigest()

    for buckets in (None, 16):
        out = dataset_digest(files, "path", "sha256", buckets)
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
        by = [sorted(n for n in names if buckets is None or zlib.crc32(n.encode()) % buckets == k) for k in range(buckets or 1)]
        parts = [digest(f"{n}:s{n}\n" for n in b) for b in by if b]
        assert tuple(out.first()) == (parts[0] if buckets is None else digest(parts), 300)
    assert tuple(dataset_digest(files.limit(0), "path", "sha256").first()) == (digest([]), 0)
