"""Stored structures: digest trees, the hash index, batches with commit records; exact medians."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.operators import dedup, freeze, stats
from plumbline.operators.hash_index import HashIndex
from plumbline.sources import batches


def test_exact_medians(spark):
    rng = random.Random(8)
    draw = {"plain": lambda: rng.random(), "few": lambda: float(rng.randrange(3)), "wide": lambda: rng.choice([1e-300, 1.0, 1e300]) * rng.random(), "same": lambda: 5.5, "big": lambda: 2.0**60 + rng.randrange(5)}
    rows = [(g, f(), rng.choice([None, float("nan"), float("inf"), rng.gauss(0, 1), -1e9])) for g, f in draw.items() for _ in range(rng.choice([700, 701]))] + [(None, 1.0, None), (None, 2.0, None), ("one", -3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    for passes, bins in ((0, 7), (1, 3), (2, 4096)):
        got = {r["g"]: (r["a"], r["b"]) for r in stats.exact_medians(df, ["g"], ["a", "b"], bins, passes).collect()}
        for g in {r[0] for r in rows}:
            middle = lambda k: statistics.median(v) if (v := [r[k] for r in rows if r[0] == g and r[k] is not None and abs(r[k]) < float("inf")]) else None  # noqa: E731, B023
            assert got[g] == (middle(1), middle(2)), (g, passes)
    assert stats.exact_medians(df, [], ["a"]).first()["a"] == statistics.median(r[1] for r in rows)
    assert stats.exact_medians(df.limit(0), ["g"], ["a"]).count() == 0
    plan = stats.exact_medians(df, ["g"], ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "median" not in plan  # no buffer that grows with a group


def test_digest_tree_tells_what_changed(spark):
    old = {f"f{k}": f"s{k}" for k in range(3000)}
    new = {p: s for p, s in old.items() if p not in ("f5", "f77")} | {"f9": "other", "new": "s", "é": None}
    a, b = (spark.createDataFrame(list(x.items()), "path string, sha256 string").repartition(3) for x in (old, new))
    for depth in (1, 2, 4):
        ta, tb = (dedup.digest_tree(x, "path", "sha256", depth) for x in (a, b))
        got = {(r["path"], r["before"], r["after"], r["change"]) for r in dedup.changed_files(a, b, ta, tb, "path", "sha256").collect()}
        assert got == {("f5", "s5", None, "removed"), ("f77", "s77", None, "removed"), ("f9", "s9", "other", "changed"), ("new", None, "s", "added"), ("é", None, None, "added")}
        assert dedup.changed_files(a, a, ta, ta, "path", "sha256").isEmpty()
        # from bounded nodes: children of an inner node, and the leaves by hand
        nodes = {(r["level"], r["prefix"]): (r["digest"], r["files"]) for r in ta.collect()}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        by = {}
        for p, s in sorted(old.items()):
            by.setdefault(sha(p)[:depth], []).append(f"{p}:{s}\n")
        want = {(depth, k): (sha("".join(v)), len(v)) for k, v in by.items()}
        for level in reversed(range(depth)):
            for prefix in {k[1][:level] for k in want if k[0] == level + 1}:
                kids = sorted((k[1], *v) for k, v in want.items() if k[0] == level + 1 and k[1].startswith(prefix))
                want[level, prefix] = sha("".join(f"{p}:{d}\n" for p, d, _ in kids)), sum(n for _, _, n in kids)
        assert nodes == want
        assert tuple(dedup.tree_root(ta).first()) == nodes[0, ""]
    assert tuple(dedup.tree_root(dedup.digest_tree(a.limit(0), "path", "sha256")).first()) == (hashlib.sha256(b"").hexdigest(), 0)


def test_totals_of_a_freeze(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    instances = spark.createDataFrame([(0,), (0,), (3,)], "class_id int")
    made = freeze.manifest(files, instances, "path")
    bad = {r["total"]: (r["expected"], r["found"]) for r in freeze.unexpected_totals(made, {"files": 2, "instances": 4}, {0: 2, 1: 5}).collect()}
    assert bad == {"instances": (4, 3), "class_1": (5, 0), "class_3": (0, 1)}
    assert freeze.unexpected_totals(made, {"files": 2, "instances": 3}).isEmpty()
    tree = dedup.digest_tree(files, "path", "sha256")
    assert freeze.manifest(files, instances, "path", tree=tree).first()["digest"] == made.first()["digest"] != freeze.manifest(files, instances, "path", stream=True).first()["digest"]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_and_additions_equal_the_whole(spark, tmp_path, no_broadcast):
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(20)]
    rows = [(f"i{k}", rng.choice(["train", "val", "test"]), base[rng.randrange(20)] ^ sum({1 << rng.randrange(62) for _ in range(rng.randrange(4))}) if k % 50 else None) for k in range(400)]
    schema = "id string, split string, hash long"
    index = HashIndex("plumbline_hashes", str(tmp_path / "index"), buckets=4)
    spark.sql(f"DROP TABLE IF EXISTS {index.table}")
    found = set()
    for k in range(0, 400, 100):
        links = index.add(spark.createDataFrame(rows[k : k + 100], schema))
        found |= {(r["train_hash"], r["val_hash"], r["distance"]) for r in links.collect()}
    want = {(r["train_hash"], r["val_hash"], r["distance"]) for r in dedup.near_hash_classes(spark.createDataFrame(rows, schema)).collect()}
    assert found == want and len(want) > 50
    # another session finds the files by their place alone
    spark.sql(f"DROP TABLE {index.table}")
    assert index.attach(spark).count() == 70 * len({(r[1], r[2], k // 100) for k, r in enumerate(rows) if r[2] is not None and r[1] != "test"})
    new = index.keyed(spark.createDataFrame(rows[:50], schema))
    plan = index.links(new, index.attach(spark))._jdf.queryExecution().executedPlan().toString()
    old_side = plan[plan.index("Bucketed: true") - 900 : plan.index("Bucketed: true")]
    assert plan.count("Exchange hashpartitioning(_key_index") + plan.count("Exchange hashpartitioning(key_index") == 1 and "Exchange hashpartitioning(key_index" not in old_side


def test_code_that_compares_hashes_is_compiled(spark, tmp_path, no_broadcast):
    """The JVM leaves methods of more than 8,000 bytes uncompiled, which made each comparison cost microseconds."""
    index = HashIndex("plumbline_compiled", str(tmp_path / "index"), buckets=4)
    rows = index.keyed(spark.createDataFrame([(1, "train", 5), (2, "val", 7)], "id long, split string, hash long"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = [d._jdf.queryExecution().debug().codegenToSeq() for d in (index.links(rows, rows), index.links(rows, index.attach(spark)), dedup.near_hash_classes(spark.range(40).selectExpr("id", "'train' as split", "id as hash"), pieces=8))]
        sizes = [s.apply(k)._3().maxMethodCodeSize() for s in made for k in range(s.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_a_killed_write_is_resumed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "labels")
    df = spark.range(1000).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("key"), (F.col("id") * 2).alias("v"))
    real, calls = batches.commit, []

    def dies(spark_, path_, batch, folder):
        calls.append(batch)
        if len(calls) == 4:
            raise RuntimeError("killed")  # after the data, before the record
        return real(spark_, path_, batch, folder)

    monkeypatch.setattr(batches, "commit", dies)
    with pytest.raises(RuntimeError, match="killed"):
        batches.write_resumably(df, path, F.col("key"), 8)
    assert len(batches.committed(spark, path)) == 3
    part = batches.read_committed(spark, path, "key long, v long").count()
    assert 0 < part < 1000
    assert batches.write_resumably(df, path, F.col("key"), 8) == 5
    assert batches.write_resumably(df, path, F.col("key"), 8) == 0
    got = batches.read_committed(spark, path, "key long, v long")
    assert got.count() == 1000 and sorted(r["v"] for r in got.collect()) == list(range(0, 2000, 2))
    assert not batches.write_batch(df, path, "000002-of-8")  # a run that comes second: its rows are never read
    assert batches.read_committed(spark, path, "key long, v long").count() == 1000
    assert batches.read_committed(spark, str(tmp_path / "none"), "key long, v long").count() == 0
