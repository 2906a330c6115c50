"""Counts of letter groups in batches, and the hashes made from them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.functions.columns import difference_hash
from plumbline.functions.grams import difference_hashes, gram_counts
from plumbline.plans import views as V


@pytest.mark.parametrize("stretch", [1, 50, 1 << 20])
def test_grams_are_counted_as_in_strings(stretch):
    rng = random.Random(stretch)
    texts = ["", None, "l", "ll", "lll", "llll", "th", "t", "h", "bl", "e", "ble", "ébleé", "ingingin", "aaaa", "abab"] * 2
    texts += ["".join(rng.choice("etlhb ionéß") for _ in range(rng.randrange(60))) for _ in range(200)]
    grams = [*V.GRID, "aa", "aba", "x", "zzz"]
    for part in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(texts).slice(3, 40), pa.array(texts).slice(0, 0), pa.array(["", None])):
        want = [[(t or "").count(g) for g in grams] for t in part.to_pylist()]
        assert gram_counts(part, grams, stretch).tolist() == want


def test_prints_of_odd_texts_equal_the_string_rule(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("etaoinshrdlu ll the and éß") for _ in range(rng.randrange(400)))) for k in range(100)] + [(100, None), (101, ""), (102, "lll" * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: (r["split"], r["hash"]) for r in V.prints(spark, str(tmp_path)).collect()}
    grids = [(k, [(t or "").count(g) for g in V.GRID]) for k, t in rows]
    want = {r["k"]: r["h"] for r in spark.createDataFrame(grids, "k long, g array<int>").select("k", difference_hash("g").alias("h")).collect()}
    assert got == {k: ("train" if k % 10 else "val", h) for k, h in want.items()}
    assert difference_hashes(np.array([g for _, g in grids])).tolist() == [want[k] for k, _ in grids]
