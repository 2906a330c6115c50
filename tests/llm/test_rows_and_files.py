"""Pipeline stages with null and repeated ids, files of archives, one surrogate a name."""

import gzip
import os
import re

import pytest

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def pipeline(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{k}" for k in range(400)]
    x, y, z = " ".join(words[:90]), " ".join(words[100:190]), " ".join(words[200:290])
    item = "this very sentence stands in the benchmark and nowhere else at all"
    rows = [(1, x), (5, x), (5, y), (None, x), (None, z), (7, None), (None, None), (8, ""), (None, f"before {item} after"), (9, f"{item} again"), (9, "clean words only here"), (12, y + " tail")]
    docs = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(docs)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return corpus_pipeline, spark.read.parquet(docs), str(tmp_path), (x, y, z, item)


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")


def test_near_dedup_keeps_rows_not_ids(spark, pipeline):
    stages, docs, sf, (x, y, z, item) = pipeline
    out = stages.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    kept = [(r["doc_id"], r["text"]) for r in docs.collect() if (r["doc_id"], r["text"]) not in ((5, x), (None, x), (12, y + " tail"))]
    assert texts == sorted((i is None, i or 0, t or "") for i, t in kept)


def test_decontamination_keeps_rows_not_ids(spark, pipeline):
    stages, docs, sf, (x, y, z, item) = pipeline
    out = stages.decontamination(spark, docs, sf).collect()
    assert sorted(map(key, out)) == sorted(key(r) for r in docs.collect() if item not in (r["text"] or ""))


def test_results_do_not_lose_their_files(spark, pipeline):
    stages, docs, sf, _ = pipeline
    first, second = stages.near_dedup(spark, docs, sf), stages.near_dedup(spark, docs, sf)
    assert sorted(map(key, second.collect())) == sorted(map(key, first.collect()))
    assert sorted(map(key, stages.line_dedup(spark, docs, sf).collect()))
    assert first.count() == second.count() > 0


def test_empty_tables_pass(spark, pipeline):
    stages, docs, sf, _ = pipeline
    for stage in (stages.line_dedup, stages.near_dedup, stages.decontamination):
        out = stage(spark, docs.limit(0), sf)
        assert out.columns == docs.columns and out.count() == 0
    assert stages.packing(spark, docs.limit(0), sf).count() == 0


def test_archive_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    from plumbline.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 2 << 20)
    pages = [(k, f"https://h/{k}", ("x%d " % k) * 120_000) for k in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "pages"))
    warc.write_archives(spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "out"))
    sizes = [len(gzip.decompress(open(os.path.join(tmp_path, "out", f), "rb").read())) for f in os.listdir(tmp_path / "out") if f.endswith(".gz")]
    assert sum(sizes) > 18_000_000 and max(sizes) < 6 << 20
    assert warc.read_archives(spark, str(tmp_path / "out"), False).count() == 120


def test_one_surrogate_a_name_whatever_its_title(spark, tmp_path):
    from plumbline.llm.surrogates import replace_entities

    given = [f"Anna{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(300)]
    titles = ["Dr", "Ms", "Prof", "Mrs", "Mr", "Herr", "Frau"]
    rows = [(k, f"{titles[(k + j) % 7]} {given[k]} Lee met {titles[(k + 3 * j) % 7]} {given[(k * 7) % 300]} Müller-Öz") for k in range(300) for j in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = {}
    out = {}
    for r in replace_entities(docs, key="k").select("doc_id", "text").collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    for k, text in rows:
        assert len(out[k]) == 3
    pattern = re.compile(r"^(\S+) (\S+) (\S+) met (\S+) (\S+) (\S+)$")
    for k, texts in out.items():
        own = sorted(t for i, t in rows if i == k)
        # titles stay, so each new text is known by its two titles
        by_titles = {(m[1], m[4]): m for t in texts if (m := pattern.match(t))}
        for t in own:
            m, n = pattern.match(t), by_titles[pattern.match(t)[1], pattern.match(t)[4]]
            for a, b in ((m[2], n[2]), (m[3], n[3]), (m[5], n[5]), (m[6], n[6])):
                found.setdefault(a, set()).add(b)
    assert all(len(x) == 1 for x in found.values()), {k: v for k, v in found.items() if len(v) > 1}
    assert len({next(iter(x)) for x in found.values()}) == len(found)  # different names stay different
