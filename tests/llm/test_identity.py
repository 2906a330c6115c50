"""Texts that linear hashes take as equal: strings in Thue-Morse order and their complements."""

import hashlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def thue_morse(n, zero, one):
    return [(zero, one)[bin(k).count("1") % 2] for k in range(n)]


def pairs(n, zero, one, joint):
    return joint.join(thue_morse(n, zero, one)), joint.join(thue_morse(n, one, zero))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = []
    for n in (128, 1024, 4096):
        rows += [*pairs(n, "alpha", "beta", " "), *pairs(n, "a", "b", ""), *pairs(n, "ab ", "ba ", "")]
    path = str(tmp_path_factory.mktemp("tm") / "d")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_digests_tell_them_apart():
    from plumbline.llm.linededup import Lines
    from plumbline.llm.textbytes import range_digests

    for n in (128, 1024, 4096):
        a, b = (np.frombuffer(t.encode(), np.uint8) for t in pairs(n, "a", "b", ""))
        whole = np.array([0]), np.array([n])
        assert range_digests(a, *whole)[0] != range_digests(b, *whole)[0]
        words = [np.frombuffer(t.encode(), np.uint8) for t in pairs(n, "alpha", "beta", " ")]
        lines = [Lines(d, np.array([0, len(d)]), 5) for d in words]
        assert lines[0].whole()[0] != lines[1].whole()[0] and lines[0].identity()[0] != lines[1].identity()[0]


def test_lines(docs, texts):
    from plumbline.llm.linededup import dedup_lines

    got = dedup_lines(docs).collect()
    # no two of these lines are within one word of each other
    assert all(r["n_removed"] == 0 and r["text"] == texts[r["doc_id"]] for r in got)


def test_near_duplicates(docs, texts):
    from plumbline.llm.minhash import near_duplicates

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)}

    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, width=3, threshold=85, side=10).collect()}
    assert got == {k: (len(sets[k]), root[k]) for k in sets}


def test_token_counts_and_pieces(docs, texts, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    from plumbline.llm.packing import token_pieces
    from plumbline.llm.token_counts import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, path, cache_path=str(tmp_path / "cache")).collect()}
    assert got == {k: len(library.encode(t)) for k, t in texts.items()}
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = {}
    for r in token_pieces(docs, path, capacity=2048, keep_ids=True).orderBy("doc_id", "piece").collect():
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    assert ids == {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}


def test_repeats(docs, texts):
    from plumbline.llm.substrings import remove_repeats

    data = {k: t.encode() for k, t in texts.items()}
    starts = {}
    for t in data.values():
        for s in range(len(t) - 199):
            starts[t[s : s + 200]] = starts.get(t[s : s + 200], 0) + 1
    for r in remove_repeats(docs, width=200).collect():
        t = data[r["doc_id"]]
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - 199):
            if starts[t[s : s + 200]] > 1:
                gone[s] += 1
                gone[s + 200] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        assert (r["n_removed"], r["kept_sha256"]) == (int((~keep).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[keep])).hexdigest())


def test_repetitive_text_against_an_item_is_searched_once():
    import time

    from plumbline.llm.decontaminate import Pieces

    data = np.frombuffer(b"abcdefghij, " * (1 << 16), np.uint8)
    began = time.time()
    found = list(Pieces([(0, b"abcdefghij, abcdefxx")], 0.1).find(data, np.array([0, len(data)])))
    assert [(f[2], f[3]) for f in found] == [(2, 0)]
    assert time.time() - began < 30
