"""The whole statistics of a small set: decisions, errors of every kind, unreadable images, reports on disk."""

import json

import pytest

from plumbline.operators.analysis import analyze

SQUARE = "0 0.1 0.1 0.5 0.1 0.5 0.5 0.1 0.5"


@pytest.fixture
def found(spark):
    images = [("t/a", "train", "a.JPG", 100, 50, None), ("t/b", "train", "b.jpg", 10, 10, None), ("t/c", "train", "c.jpg", 0, 0, "cut off"), ("t/d", "train", "d.jpg", 20, 10, None), ("t/e", "train", "e.jpg", 8, 8, None), ("t/n", "train", "n.jpg", 6, 6, None), ("v/a", "val", "va.jpg", 64, 64, None), ("v/m", "val", "m.jpg", 4, 4, None)]
    labels = [("t/a", "train"), ("t/b", "train"), ("t/c", "train"), ("t/d", "train"), ("t/e", "train"), ("v/a", "val"), ("v/x", "val")]
    lines = [
        ("t/a", 1, SQUARE), ("t/a", 2, "1 1.005 0.1 0.5 0.1 0.5 0.5"), ("t/a", 3, "   "), ("t/a", 4, "1 1.5 0.1 -0.2 0.1 0.5 0.5"), ("t/b", 1, "7 0.1 0.1"), ("t/b", 2, "0 0.1 0.1 0.2"), ("t/b", 3, "0 0.1 0.1 0.2 x 0.3 0.3"),
        ("t/b", 4, "0 0.1 0.1 0.2 0.2 0.3 0.3"), ("t/c", 1, SQUARE), ("t/d", 1, SQUARE), ("v/a", 1, SQUARE), ("v/a", 2, "1.0 0 0 1 0 1 1"), ("v/x", 1, SQUARE), ("gone", 1, SQUARE), (None, 1, SQUARE),
    ]
    decisions = [("D.jpg", "exclude", "corrupted_file", "seen", "ok"), ("n.JPG", "keep_negative", None, "seen", "ok"), ("other.jpg", "review", "x", "seen", "ok")]
    classes = spark.createDataFrame([(0, "blade--crack"), (1, "blade--edge"), (2, "tower")], "class_id int, name string")
    return analyze(
        spark.createDataFrame(images, "file_id string, split string, filename string, width int, height int, error string"), spark.createDataFrame(labels, "file_id string, split string"),
        spark.createDataFrame(lines, "file_id string, line_no int, raw string"), classes, ["train", "val"], spark.createDataFrame(decisions, "filename string, action string, issue string, reason string, status string"),
    )


def test_counters(found):
    rows = {r["split"]: r.asDict() for r in found.split_statistics().collect()}
    want = {
        "train": dict(raw_images=6, raw_labels=5, images=5, labels=5, paired=5, missing_labels=0, orphan_labels=0, empty_labels=2, virtual_empty_labels=1, excluded_by_filter=1, review_by_filter=0, negative_by_filter=1, corrupted_by_filter=1, instances=7, usable_polygon_instances=2,
                      soft_clippable_instances=1, geometry_instances=3, sized_geometry_instances=2, hard_invalid_lines=5, invalid_lines=6, out_of_bounds_coordinates=3, soft_reset_coordinates=1, hard_review_coordinates=2, image_read_errors=1),
        "val": dict(raw_images=2, raw_labels=2, images=2, labels=2, paired=1, missing_labels=1, orphan_labels=1, empty_labels=0, virtual_empty_labels=0, excluded_by_filter=0, review_by_filter=0, negative_by_filter=0, corrupted_by_filter=0, instances=2, usable_polygon_instances=2,
                    soft_clippable_instances=0, geometry_instances=2, sized_geometry_instances=2, hard_invalid_lines=0, invalid_lines=0, out_of_bounds_coordinates=0, soft_reset_coordinates=0, hard_review_coordinates=0, image_read_errors=0),
    }
    for split, counters in want.items():
        assert {k: v for k, v in rows[split].items() if k != "split"} == counters
    assert {k: v for k, v in rows["total"].items() if k != "split"} == {k: want["train"][k] + want["val"][k] for k in want["train"]}


def test_tables(found):
    invalid = {(r["file_id"], r["line_no"], r["issue_type"], r["severity"]) for r in found.invalid_lines().collect()}
    assert invalid == {("t/a", 2, "polygon_coordinate_range", "soft"), ("t/a", 4, "polygon_coordinate_range", "hard"), ("t/b", 1, "class_id", "hard"), ("t/b", 2, "polygon_coordinate_count", "hard"), ("t/b", 3, "polygon_coordinate_value", "hard"), ("t/b", 4, "polygon_geometry", "hard")}
    assert {(r["line_no"], r["position"], r["line_severity"]) for r in found.coordinates().collect()} == {(2, "point_1_x", "soft"), (4, "point_1_x", "hard"), (4, "point_2_x", "hard")}
    assert [r["coordinates"] for r in found.hard_error_by_class().collect()] == [2]
    assert {r["class_id"]: (r["train"], r["val"], r["total"]) for r in found.class_distribution().collect()} == {0: (5, 1, 6), 1: (2, 1, 3), 2: (0, 0, 0)}
    assert {r["class_id"]: r["total"] for r in found.class_distribution(images=True).collect()} == {0: 4, 1: 2, 2: 0}
    images = {r["file_id"]: (r["instances"], r["is_negative"], r["has_effective_label"]) for r in found.images().collect()}
    assert images == {"t/a": (3, False, True), "t/b": (3, False, True), "t/c": (1, False, True), "t/e": (0, False, True), "t/n": (0, True, True), "v/a": (2, False, True), "v/m": (0, False, False)}
    assert {(r["file_id"], r["line_no"], r["class_group"]) for r in found.objects().collect()} == {("t/a", 1, "blade"), ("t/a", 2, "blade"), ("v/a", 1, "blade"), ("v/a", 2, "blade")}
    assert [(r["file_id"], r["reason"]) for r in found.read_errors().collect()] == [("t/c", "cut off")]
    assert [(r["file_id"], r["action"]) for r in found.corrupted_images().collect()] == [("t/d", "exclude")]
    s = found.summary().first()
    assert (s["readable_images"], s["minimum_width"], s["median_width"], s["maximum_objects"], s["images_without_objects"], s["soft_lines"], s["hard_lines"]) == (6, 4, 9.0, 3, 3, 1, 1)


def test_gate_and_report(found, tmp_path):
    assert found.observed == {"hard_lines": 5, "missing_labels": 1, "orphan_labels": 1, "read_errors": 1}
    with pytest.raises(ValueError, match="hard_lines 5, missing_labels 1"):
        found.require_clean()
    found.write(str(tmp_path / "report"))
    assert len(list((tmp_path / "report").iterdir())) == 13
    text = next((tmp_path / "report" / "image_read_errors").glob("part-*")).read_text(encoding="utf-8-sig")
    assert text.splitlines()[0] == "split,file_id,reason"
    assert json.loads(next((tmp_path / "report" / "summary").glob("part-*")).read_text())["hard_lines"] == 1
    with pytest.raises(Exception, match="(?i)exist"):
        found.write(str(tmp_path / "report"))


def test_empty_set(spark):
    found = analyze(spark.createDataFrame([], "file_id string, split string, filename string, width int, height int, error string"), spark.createDataFrame([], "file_id string, split string"), spark.createDataFrame([], "file_id string, line_no int, raw string"), spark.createDataFrame([(0, "a")], "class_id int, name string"), ["train"])
    assert found.observed == {"hard_lines": 0, "missing_labels": 0, "orphan_labels": 0, "read_errors": 0}
    found.require_clean()
    assert found.invalid_lines().count() == found.images().count() == 0
    assert found.class_distribution().first()["total"] == 0 and found.summary().first()["readable_images"] == 0
