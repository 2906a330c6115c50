"""Readers and writers on small folders."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import resampling
from plumbline.operators import freeze, leakage, pairing, sampling
from plumbline.sources import files, listing


@pytest.fixture
def root(tmp_path):
    for name, data in {"images/train/Nested/A.JPG": b"x", "images/train/b.png": b"", "images/val/c.jpeg": b"xx", "images/train/skip.gif": b"x", "labels/train/nested/a.TXT": b"0 0.1 0.1\n\n1 0.2", "labels/train/b.txt": b"", "labels/val/d.txt": b"\xef\xbb\xbf2 0.1"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_scan_keeps_empty_files(spark, root):
    images = files.images(spark, str(root / "images"))
    assert {(r["split"], r["sample_key"], r["length"]) for r in images.collect()} == {("train", "nested/a", 1), ("train", "b", 0), ("val", "c", 2)}
    labels = files.labels(spark, str(root / "labels"), bom="strip")
    assert {(r["split"], r["sample_key"], r["text"]) for r in labels.collect()} == {("train", "nested/a", "0 0.1 0.1\n\n1 0.2"), ("train", "b", ""), ("val", "d", "2 0.1")}
    keys = ["split", "sample_key"]
    assert pairing.paired(images, labels.select(*keys), keys).count() == 2
    assert [r["sample_key"] for r in pairing.missing_labels(images, labels, keys).collect()] == ["c"]
    assert [r["sample_key"] for r in pairing.orphan_labels(images, labels, keys).collect()] == ["d"]


def test_lists_decisions_and_records(spark, tmp_path):
    (tmp_path / "train.txt").write_text("./a.jpg\n\n  \n/abs/b.jpg\n")
    assert sorted(r["path"] for r in files.sample_list(spark, str(tmp_path / "train.txt"), "/data").collect()) == ["/abs/b.jpg", "/data/a.jpg"]
    (tmp_path / "d.yaml").write_text("images:\n  - {filename: A.jpg, action: exclude, issue: missing_label, reason: r, status: s}\n  - {filename: b.jpg, action: keep_negative, reason: r, status: s}\n")
    decisions = files.decisions(spark, str(tmp_path / "d.yaml"))
    assert {(r["filename"], r["issue"]) for r in decisions.collect()} == {("A.jpg", "missing_label"), ("b.jpg", None)}
    items = spark.createDataFrame([("a.JPG",), ("B.jpg",), ("c.jpg",)], "filename string")
    assert {r["filename"]: r["status"] for r in pairing.apply_decisions(items, decisions, "filename").collect()} == {"a.JPG": "dropped", "B.jpg": "kept_negative", "c.jpg": "kept"}
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.json").write_text(json.dumps({"name": run if run == "r1" else None, "map50": 0.5}, indent=1))
    got = files.json_records(spark, str(tmp_path / "runs" / "*" / "metrics.json"), "name string, map50 double, experiment_id string")
    assert {r["experiment_id"] for r in got.collect()} == {"r1", "r2"}


def test_writers_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("train", "b.jpg"), ("train", "a.jpg"), ("val", "c.jpg")], "split string, rel_path string")
    files.write_sample_lists(df, str(tmp_path / "lists"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lists" / "split=train")).collect()] == ["a.jpg", "b.jpg"]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_csv(df, str(tmp_path / "lists"), ["split"])
    out = str(tmp_path / "out")
    df.limit(1).write.parquet(out)
    done = spark.createDataFrame(spark.read.parquet(out).collect(), df.schema)
    files.append_missing(df, done, ["rel_path"], out)
    assert spark.read.parquet(out).count() == 3


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = (sampling.ratio_split(df.repartition(n), "k", (0.7, 0.2, 0.1), 3) for n in (1, 7))
    assert {r["split"]: r["n"] for r in a.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 700, "val": 200, "test": 100}
    assert a.exceptAll(b).count() == 0
    with pytest.raises(ValueError):
        sampling.ratio_split(df, "k", (0.7, 0.2, 0.2), 3)
    sample, report = sampling.backfill_sample(df.withColumn("ok", F.col("k") % 3 != 0), "k", "ok", 50, 3)
    r = report.first()
    assert sample.count() == 50 == r["selected"] and r["checked"] == r["selected"] + r["rejected"]


def test_adjacent_frames_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [(k, rng.choice(["train", "val"]), rng.choice(["a", "b", ""]), rng.choice([None, *range(40)])) for k in range(200)]
    got = {(r["train_id"], r["val_id"], r["frame_delta"]) for r in leakage.adjacent_frames(spark.createDataFrame(rows, "id long, split string, capture_key string, frame long")).collect()}
    want = {(x[0], y[0], abs(x[3] - y[3])) for x in rows for y in rows if x[1] == "train" and y[1] == "val" and x[2] == y[2] != "" and x[3] is not None and y[3] is not None and abs(x[3] - y[3]) <= 3}
    assert got == want


def test_repair_needs_a_review(spark):
    issues = spark.createDataFrame([(1, 1, "point_1_x", -0.001, "soft"), (1, 2, "point_1_x", 1.2, "hard"), (2, 1, "point_1_y", 1.3, "hard")], "file_id long, line_no int, position string, value double, coordinate_severity string")
    reviews = spark.createDataFrame([(1, 2, "repair_confirmed")], "file_id long, line_no int, review_decision string")
    log, bad = freeze.repair_log(issues, issues, reviews)
    assert {(r["file_id"], r["line_no"], r["after"]) for r in log.collect()} == {(1, 1, 0.0), (1, 2, 1.0)}
    assert [(r["file_id"], r["line_no"]) for r in bad.collect()] == [(2, 1)]
    with pytest.raises(ValueError):
        pairing.require_none(bad, "unconfirmed")


def test_dataset_configuration(spark, tmp_path):
    (tmp_path / "data.yaml").write_text("path: sets/one\ntrain: images/train\nval: /elsewhere/val\nnames:\n  0: crack\n  1: 'dent'\n")
    assert {tuple(r) for r in files.class_names(spark, str(tmp_path / "data.yaml")).collect()} == {(0, "crack"), (1, "dent")}
    assert files.split_roots(spark, str(tmp_path / "data.yaml")) == {"train": f"{tmp_path}/sets/one/images/train", "val": "/elsewhere/val"}
    (tmp_path / "list.yaml").write_text("names: [a, b, c]\n")
    assert files.class_names(spark, str(tmp_path / "list.yaml")).count() == 3 and files.split_roots(spark, str(tmp_path / "list.yaml")) == {}
    for bad in ("names: {0: a, 2: b}\n", "path: x\n", ""):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            files.class_names(spark, str(tmp_path / "bad.yaml"))
    (tmp_path / "groups.yaml").write_text("version: 1\ngroups:\n  edge:\n    name: Edge\n    class_ids: [0, 2]\n  face:\n    name_de: Haut\n    class_ids: []\n")
    groups = files.hierarchy(spark, str(tmp_path / "groups.yaml"))
    assert {tuple(r) for r in groups.collect()} == {("edge", "Edge", 0), ("edge", "Edge", 2)}
    classes = spark.createDataFrame([(0,), (1,), (2,)], "class_id int")
    assert {tuple(r) for r in pairing.hierarchy_violations(classes, groups).collect()} == {(1, "missing")}
    (tmp_path / "groups.yaml").write_text("groups:\n  edge:\n    class_ids: [0]\n")
    with pytest.raises(ValueError):
        files.hierarchy(spark, str(tmp_path / "groups.yaml"))


def png(pixels: list[list[int]]) -> bytes:
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_are_decoded(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png([[10 * (c // 2) + r // 2 for c in range(18)] for r in range(16)]))
    (tmp_path / "b.png").write_bytes(b"no image")
    sizes = {r["path"].rpartition("/")[2]: (r["width"], r["height"], r["decode_error"]) for r in files.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {"a.png": (18, 16, None), "b.png": (0, 0, "undecodable")}
    grids = {r["path"].rpartition("/")[2]: r["grid"] for r in files.grey_grids(spark, str(tmp_path)).collect()}
    assert grids["b.png"] is None and grids["a.png"] == slow_grid([[10 * (c // 2) + r // 2 for c in range(18)] for r in range(16)], 8, 9)
    hashes = {r["path"].rpartition("/")[2]: (r["hash"], r["decode_error"]) for r in files.image_hashes(spark, str(tmp_path)).collect()}
    assert hashes == {"a.png": (0, None), "b.png": (None, "undecodable")}


def slow_line(line, cells):
    """One row of pixels shrunk to ``cells``: a triangle filter with whole-number weights, pixel by pixel."""
    scale = len(line) / cells
    support = max(scale, 1.0)
    out = []
    for c in range(cells):
        centre = (c + 0.5) * scale
        places = range(max(0, int(centre - support + 0.5)), min(len(line), int(centre + support + 0.5)))
        w = [max(0.0, 1 - abs((x - centre + 0.5) / support)) for x in places]
        total = sum(line[x] * int(k / sum(w) * (1 << 22) + 0.5) for x, k in zip(places, w, strict=True)) + (1 << 21)
        out.append(min(255, max(0, total >> 22)))
    return out


def slow_grid(pixels, rows, columns):
    narrow = [slow_line(r, columns) for r in pixels]
    return [v for r in zip(*(slow_line(list(c), rows) for c in zip(*narrow, strict=True)), strict=True) for v in r]


def test_shrinking_equals_a_slow_kernel():
    rng = random.Random(4)
    rows = []
    for w, h, n in [(9, 8, 1), (9, 8, 3), (64, 48, 3), (64, 48, 3), (5, 3, 1), (1, 1, 4), (101, 77, 4), (300, 20, 1)]:
        rows.append((w, h, n, bytes(rng.randrange(256) for _ in range(w * h * n))))
    rows.insert(3, (0, 0, -1, b""))
    got = resampling.grids(*(pa.array(c) for c in zip(*rows, strict=True)), 8, 9).to_pylist()
    for (w, h, n, data), grid in zip(rows, got, strict=True):
        if not w:
            assert grid is None
            continue
        dots = [data[k : k + n] for k in range(0, len(data), n)]
        grey = [d[0] if n < 3 else (7471 * d[0] + 38470 * d[1] + 19595 * d[2] + 0x8000) >> 16 for d in dots]
        assert grid == slow_grid([grey[k : k + w] for k in range(0, w * h, w)], 8, 9), (w, h, n)


def test_listing_in_tasks(spark, tmp_path):
    want = {}
    for k in range(3000):
        p = tmp_path / f"split{k % 3}" / f"d{k % 7}" / ("deep/er" if k % 5 == 0 else "") / f"f {k}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (k % 4))
        want[f"file:{p}"] = k % 4
    (tmp_path / "top.txt").write_bytes(b"t")
    want[f"file:{tmp_path}/top.txt"] = 1
    (tmp_path / "empty" / "folder").mkdir(parents=True)
    for depth in (0, 1, 2):
        listed = listing.list_files(spark, str(tmp_path), depth)
        assert {r["path"]: r["length"] for r in listed.collect()} == want
        assert listed.count() == 3001 and listed.where("modified is null").isEmpty()
    assert listing.list_files(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="gone"):
        listing.list_files(spark, str(tmp_path / "gone")).count()


def test_csv_begins_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "x")], "a int, b string, c string").coalesce(1)
    files.write_csv(df, str(tmp_path / "out"), ["b", "a"])
    text = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert text == "\ufeffb,a\né,1\n".encode()
    assert files.summary_csv(spark, str(tmp_path / "out"), "b string, a int").first() == ("é", 1)


def test_tables_of_runs_and_reports(spark, tmp_path):
    for run, rows in (("r1", "1, 0.5\n2, 0.25\n"), ("r2", "1, 2.0\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.csv").write_text("epoch, loss \n" + rows)
    got = files.run_csvs(spark, str(tmp_path / "*" / "results.csv"))
    assert got.columns == ["epoch", "loss", "run"] and {(r["run"], int(r["epoch"]), float(r["loss"])) for r in got.collect()} == {("r1", 1, 0.5), ("r1", 2, 0.25), ("r2", 1, 2.0)}
    (tmp_path / "s.csv").write_text("\ufeffrun,note\nr1,\u00e9\n", encoding="utf-8")
    assert [tuple(r) for r in files.summary_csv(spark, str(tmp_path / "s.csv")).collect()] == [("r1", "\u00e9")]
    (tmp_path / "none.csv").write_text("run,note\n")
    with pytest.raises(ValueError):
        files.summary_csv(spark, str(tmp_path / "none.csv"))
    files.write_json(got, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_json(got, str(tmp_path / "report"))
    labels = spark.createDataFrame([("train", "a.txt", "0 0.5"), ("val", "b.txt", "")], "split string, rel_path string, text string")
    files.write_labels(labels, str(tmp_path / "fixed"))
    assert spark.read.parquet(str(tmp_path / "fixed")).where("split = 'val' and text = ''").count() == 1
    chosen = spark.createDataFrame([("/in/a.jpg", "train", "a.jpg", "kept", "0 0.5"), ("/in/b.jpg", "val", "b.jpg", "kept_negative", "0 0.1"), ("/in/c.jpg", "val", "c.jpg", "kept", None)], "path string, split string, filename string, status string, text string")
    assert {tuple(r) for r in files.copy_manifest(chosen, "/out/").collect()} == {("/in/a.jpg", "/out/images/train/a.jpg", "0 0.5"), ("/in/b.jpg", "/out/images/val/b.jpg", ""), ("/in/c.jpg", "/out/images/val/c.jpg", "")}


def test_refreshed_report(spark):
    risks = spark.createDataFrame([("full_decode_error", 1), ("near_duplicate", 2), ("near_duplicate", 3)], "risk_type string, train_image long")
    left, counts = leakage.refresh(risks)
    assert left.count() == 2 and [tuple(r) for r in counts.collect()] == [("near_duplicate", 2)]


def test_class_diverse_equals_plain_greedy(spark):
    import random

    rng = random.Random(2)
    rows = [(k, sorted(rng.sample(range(12), rng.randint(0, 4)))) for k in range(80)]
    got = [r["k"] for r in sampling.class_diverse(spark.createDataFrame(rows, "k long, classes array<int>"), "k", "classes", 10).collect()]
    assert len(got) == len(set(got)) == 10
    want, covered = [], set()
    while best := max((r for r in rows if set(r[1]) - covered), key=lambda r: (len(set(r[1]) - covered), -r[0]), default=None):
        want.append(best[0])
        covered |= set(best[1])
    assert sorted(got) == sorted(want + [k for k, _ in rows if k not in want][: 10 - len(want)])
