"""Near hashes as classes, first rows of groups."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import dedup, leakage, sampling

U64 = (1 << 64) - 1


def signed(h):
    h &= U64
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("threshold", [0, 1, 3, 4, 5])
def test_every_near_pair_of_hashes_is_found_once(spark, monkeypatch, threshold):
    monkeypatch.setattr(dedup, "HASHES", 4)  # crowded keys are dealt into blocks
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, U64]
    hashes = list(dict.fromkeys(b ^ sum({1 << rng.randrange(64) for _ in range(k)}) for b in base for k in range(7)))
    rows = [(k, ("train", "val")[rng.randrange(2)], signed(h)) for k, h in enumerate(hashes * 2)]
    rows += [(10_000 + k, "val" if k % 2 else "train", signed(hashes[0])) for k in range(300)] + [(20_000, "test", 5), (20_001, "train", None)]
    prints = spark.createDataFrame(rows, "id long, split string, hash long")
    sides = {}
    for i, split, h in rows:
        if split != "test" and h is not None:
            sides.setdefault((h, split), []).append(i)
    want = [(a, b, n, len(x), len(y), min(x), min(y)) for (a, s), x in sides.items() if s == "train" for (b, t), y in sides.items() if t == "val" and (n := ((a ^ b) & U64).bit_count()) <= threshold]
    assert sorted(map(tuple, dedup.near_hash_classes(prints, threshold).collect())) == sorted(want)
    if threshold == 4:
        for pieces in (5, 6, 8):
            assert sorted(map(tuple, dedup.near_hash_classes(prints, threshold, pieces).collect())) == sorted(want)
        members = {tuple(r) for r in dedup.hash_members(prints, dedup.identical_hash_classes(prints)).collect()}
        assert members == {(h, s, i) for (h, s), x in sides.items() for i in x if len({t for g, t in sides if g == h}) == 2}


def test_keys_of_random_hashes_are_short():
    """10**6 hashes: no key holds more than 32, so the join grows with the hashes."""
    hashes = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 10**6)
    pieces = dedup.key_pieces(len(hashes), 4)
    assert max(np.unique(hashes & m, return_counts=True)[1].max() for m in dedup._masks(pieces, 4)) <= 32
    assert (dedup.key_pieces(10**9, 4), len(dedup._masks(8, 4))) == (8, 70)
    assert {bin(m & U64).count("1") for m in dedup._masks(8, 4)} == {32}


def test_first_n_of_hot_groups(spark):
    rng = random.Random(3)
    rows = [("hot" if k % 3 else f"g{k % 40}", rng.choice([None, *range(60)]), k) for k in range(3000)] + [(None, 1, 5000), (None, 2, 5001)]
    df = spark.createDataFrame(rows, "g string, o int, id long").repartition(8)
    for n in (1, 7, 2000):
        got = sorted(map(tuple, sampling.first_n(df, ["g"], ["o", "id"], n).collect()), key=repr)
        groups = {}
        for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            groups.setdefault(r[0], []).append(r)
        assert got == sorted((r for x in groups.values() for r in x[:n]), key=repr)
    plan = sampling.first_n(df, ["g"], ["o", "id"], 7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("_salt") > 1  # shares are cut before they are shuffled, and hold a salt


def test_hot_hash_gives_classes_not_pairs(spark):
    rows = [(f"a{k}", "val" if k % 2 else "train", "", None, "p", 7, None) for k in range(3000)]
    prints = spark.createDataFrame(rows, "id string, split string, capture_key string, frame long, part_key string, hash long, decode_error string")
    found = leakage.leakage_report(prints, classes=True).where("risk_type in ('identical_hash', 'near_duplicate')").collect()
    assert [(r["group_key"], r["train_group_count"], r["val_group_count"], r["train_image"], r["val_image"]) for r in found] == [("0000000000000007", 1500, 1500, "a0", "a1")]
    pairs = dedup.identical_hash_pairs(prints).collect()
    assert len(pairs) == 100 and {r["train_group_count"] for r in pairs} == {1500}


def test_places_in_any_order_and_bounded_buckets(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(50), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, id long").repartition(7)
    got = {r["id"]: r["place"] for r in sampling.place_by_range(df, ["g", "o", "id"]).collect()}
    want = {r[2]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])))}
    assert got == want
    assert sampling.place_by_range(df.limit(0), ["id"]).count() == 0
    assert [sampling.bucket_digits(n) for n in (0, 10**6, 10**9, 10**12)] == [1, 1, 4, 6]
    digests = df.withColumn("d", sampling.seed_order(df["id"], 3))
    order = sorted((r["d"], r["id"]) for r in digests.collect())
    for digits in (None, 1, 2):
        assert {r["id"]: r["place"] for r in sampling.place_in_order(digests, "d", digits=digits).collect()} == {i: k + 1 for k, (_, i) in enumerate(order)}


def test_pairs_of_files_of_near_hashes_without_excluded_ones(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FILES", 3)  # crowded hashes are dealt into blocks
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(4)]
    hashes = [b ^ sum({1 << rng.randrange(64) for _ in range(k)}) for b in base for k in (0, 1, 2, 4)]
    rows = [(f"i{k}", ("train", "val")[rng.randrange(2)], signed(rng.choice(hashes[:3] if k % 2 else hashes))) for k in range(160)] + [("x", "test", 5), (None, "train", signed(hashes[0])), ("y", "val", None)]
    rows += rows[:3]
    gone = [(a, b) for a, s, _ in rows for b, t, _ in rows if (s, t) == ("train", "val") and rng.random() < 0.2] + [("i1", "nobody"), (None, "i2")]
    want = {(a, b, n) for a, s, g in rows if s == "train" for b, t, h in rows if t == "val" and h is not None and (n := ((g ^ h) & U64).bit_count()) <= 4}
    prints = spark.createDataFrame(rows, "id string, split string, hash long")
    assert sorted(map(tuple, dedup.near_hash_pairs(prints).collect()), key=repr) == sorted(want, key=repr)
    left = sorted((r for r in want if r[:2] not in {g for g in gone if None not in g}), key=repr)
    got = dedup.near_hash_pairs(prints, exclude=spark.createDataFrame(gone, "train_id string, val_id string"))
    assert sorted(map(tuple, got.collect()), key=repr) == left and len(left) < len(want)


_HOT = """
import sys, tempfile
from pyspark.sql import Observation, SparkSession, functions as F
from plumbline.operators import dedup, leakage
conf = {"spark.driver.memory": "700m", "spark.driver.extraJavaOptions": "-XX:+ExitOnOutOfMemoryError", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="plumbline-"), "spark.local.dir": tempfile.mkdtemp(prefix="plumbline-")}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
k = F.col("id")
columns = [k.cast("string").alias("id"), F.when(k % 8 == 0, "val").otherwise("train").alias("split"), F.lit("").alias("capture_key"), F.lit(None).cast("long").alias("frame"), F.lit("p").alias("part_key"), F.lit(7).cast("long").alias("hash"), F.lit(None).cast("string").alias("decode_error")]
report = leakage.leakage_report(spark.range(12_000).select(*columns)).where("risk_type = 'near_duplicate'")
seen = Observation("seen")
report.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
print("rows", seen.get["n"])
"""


def test_hot_hash_is_unfolded_within_a_small_heap():
    """15 million pairs of one hash: a broadcast join made them at once and held them."""
    run = subprocess.run([sys.executable, "-c", _HOT], capture_output=True, text=True, env=os.environ, timeout=600)
    assert f"rows {10_500 * 1_500}" in run.stdout, run.stderr[-2000:]


@pytest.mark.parametrize("threshold,pieces", [(0, 1), (1, 3), (4, 6), (4, 8), (5, 9)])
def test_first_shared_key_of_any_two_hashes(spark, threshold, pieces):
    rng = random.Random(pieces)
    masks = [m & U64 for m in dedup._masks(pieces, threshold)]
    rows = [(k, signed(d)) for d in [0, *(sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, threshold + 2))}) for _ in range(60))] for k, m in enumerate(masks) if d & m == 0]
    got = spark.createDataFrame(rows, "k int, d long").select("k", "d", dedup.first_key(F.col("d"), F.col("k"), pieces, threshold).alias("first")).collect()
    firsts = {d: min(k for k, e in rows if e == d) for _, d in rows}
    assert all(r["first"] == (firsts[r["d"]] == r["k"]) for r in got) and len(got) == len(rows) > 0


def test_few_near_hashes_are_unfolded_in_all_tasks(spark):
    """Tasks are not joined by the few bytes that they read: 2,000 files make half a million pairs."""
    prints = spark.range(2000).selectExpr("id", "if(id % 2 = 0, 'train', 'val') as split", "id % 200 as hash")
    used = dedup.near_hash_pairs(prints).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(used) == 4 and sum(r["count"] for r in used) > 500_000
    classes = dedup.near_hash_classes(prints)
    classes.collect()
    assert classes.rdd.getNumPartitions() == 4
