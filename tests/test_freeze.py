"""The freeze chain on small tables: reviewed repairs, negatives, faults, repeated and contradicting reviews, empty tables."""

from plumbline.operators import freeze, stats

LINES = "file_id long, line_no long, raw string, text string"
FILES = "file_id long, split string, status string, text string"
REVIEWS = "file_id long, line_no long, review_decision string, confirmed string"

GOOD = "1 0.25 0.5 0.75 0.5 0.5 0.125"
SOFT = "1 0.25 0.5 1.004 0.5 0.5 -0.002"
HARD = "1 0.25 0.5 1.75 0.5 0.5 0.125"
FLAT = "1 1.25 1.5 1.75 1.5 1.0 1.0"


def frozen(spark, lines, files, reviews):
    lines = spark.createDataFrame([(*r, "own") for r in lines], LINES)
    files = spark.createDataFrame([(*r, "own") for r in files], FILES)
    reviews = spark.createDataFrame([(*r, "own") for r in reviews], REVIEWS)
    out = freeze.frozen_lines(lines, files, reviews, 3)
    return out, freeze.frozen_files(files, out)


def test_chain(spark):
    lines = [(1, 1, GOOD), (1, 2, SOFT), (1, 2, SOFT), (2, 1, HARD), (2, 2, HARD), (2, 3, HARD), (2, 4, FLAT), (3, 1, GOOD), (4, 1, GOOD), (6, 1, "7 0 0 1 0 1 1"), (6, 2, None), (9, 1, GOOD), (None, 1, GOOD)]
    files = [(1, "train", "kept"), (2, "val", "kept"), (3, "train", "dropped"), (4, "train", "kept_negative"), (5, "val", "kept"), (6, "val", "kept")]
    yes = "repair_confirmed"
    reviews = [(2, 1, yes), (2, 1, yes), (2, 2, yes), (2, 2, None), (2, 4, yes), (None, None, yes)]
    out, texts = frozen(spark, lines, files, reviews)
    fixed = "1 0.25 0.5 1 0.5 0.5 0"
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(
        [(1, 1, GOOD, False, None), (1, 2, fixed, True, None), (1, 2, fixed, True, None), (2, 1, "1 0.25 0.5 1 0.5 0.5 0.125", True, None), (2, 2, HARD, False, "unconfirmed_hard_range"),
         (2, 3, HARD, False, "unconfirmed_hard_range"), (2, 4, "1 1 1 1 1 1 1", True, "polygon_geometry"), (6, 1, "7 0 0 1 0 1 1", False, "class_id"), (6, 2, None, False, "polygon_format")], key=repr)
    got = {r["file_id"]: (r["split"], r["text"], r["lines"], r["repaired"], r["violations"]) for r in texts.collect()}
    assert got == {
        1: ("train", "\n".join([GOOD, fixed, fixed]), 3, 2, 0), 2: ("val", "1 0.25 0.5 1 0.5 0.5 0.125", 1, 2, 3), 4: ("train", "", 0, 0, 0), 5: ("val", "", 0, 0, 0), 6: ("val", "", 0, 0, 2)
    }


def test_empty(spark):
    out, texts = frozen(spark, [], [], [])
    assert out.count() == texts.count() == 0


def test_counters(spark):
    images = spark.createDataFrame([("train", 1, "kept"), ("train", 2, "dropped"), ("train", 3, "kept_negative"), ("val", 4, "kept_negative"), ("val", 5, "kept"), ("val", 6, "dropped")], "split string, k long, status string")
    labels = spark.createDataFrame([("train", 1), ("train", 2), ("train", 3), ("val", 7)], "split string, k long")
    got = {r["split"]: r.asDict() for r in stats.file_counters(images, labels, "k").collect()}
    assert got["total"] == {"split": "total", "raw_images": 6, "raw_labels": 4, "dropped_images": 2, "dropped_labels": 1, "negatives": 2, "negatives_with_label": 1, "virtual_empty_labels": 1, "images": 4, "labels": 4, "paired": 3, "missing": 1, "orphan": 1}
    assert got["val"]["missing"] == 1 and got["train"]["missing"] == 0 and got["val"]["orphan"] == 1
    assert [r["raw_images"] for r in stats.file_counters(images.limit(0), labels.limit(0), "k").collect()] in ([], [0])
