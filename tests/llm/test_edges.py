"""Empty tables, null and repeated ids, and clashing names, for every operator that reads documents or pages."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    line = "one two three four five six seven eight nine"
    rows = [(None, f"{line}\n{line}"), (None, None), (1, ""), (1, f"{line} ten\nanother line of some seven words here"), (1, f"{line} ten\nanother line of some seven words here"), (2, "Dr Anna Lee wrote to anna@example.org"), (None, "Dr Anna Lee wrote to anna@example.org")]
    path = str(tmp_path_factory.mktemp("odd") / "d")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_empty_tables(spark, odd, tmp_path):
    from plumbline.llm import decontaminate, linededup, minhash, packing, substrings, surrogates, token_counts, toxicity, warc

    none = odd.limit(0)
    items = spark.createDataFrame([(1, "a sentence of the benchmark that is long enough")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.captures(pages).count() == 0
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert surrogates.replace_entities(none, key="k").count() == 0
    for most in (decontaminate.PASS_BYTES, 0):
        assert decontaminate.benchmark_hits(none, items, pass_bytes=most).count() == 0 and decontaminate.benchmark_hits(odd, items.limit(0), pass_bytes=most).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model"), cache_path=str(tmp_path / "c")).count() == 0


def test_null_and_repeated_ids(spark, odd, tmp_path):
    import sentencepiece

    from plumbline.llm import linededup, minhash, packing, substrings, surrogates, token_counts

    n = odd.count()
    lines = linededup.dedup_lines(odd.withColumn("n_lines", odd["n_chars"])).collect()
    assert len(lines) == n and sum(r["n_removed"] for r in lines) == 1 + 1 + 1 + 1 + 1  # each copy, and the lines one word longer than the first
    near = minhash.near_duplicates(odd).collect()
    assert len(near) == n and sum(r["n_shingles"] == 0 for r in near) == 2
    assert substrings.remove_repeats(odd, width=30).count() == n
    names = [r["text"] for r in surrogates.replace_entities(odd, key="k").collect() if r["text"] and r["text"].startswith("Dr ")]
    assert len(names) == 2 and len(set(names)) == 1 and "Anna" not in names[0]
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(r["n_tokens"] for r in token_counts.token_counts(odd, path, cache_path=str(tmp_path / "c")).collect())
    assert got == sorted(len(library.encode(r["text"] or "")) for r in odd.collect())
    pieces = packing.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(pieces) == n and sorted(r["offset"] for r in pieces)[0] == 0
