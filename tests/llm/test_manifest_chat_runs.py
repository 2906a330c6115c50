"""Merkle manifest, chat formatting and periodic runs against brute force."""

import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

pytest.importorskip("plumbline.llm.merkle")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def stored(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


# --- Merkle manifest --------------------------------------------------------------------------------------------------


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and for each node the list of (left, right) up to it."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for i, place in enumerate(at):
            run, slot = runs[place // 16], place % 16
            ways[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[i] = place // 16
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], ways


def manifest_of(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups, roots = {}, []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        root, ways = tree([leaf_of(*r) for r in own])
        groups[s] = own, root, ways
        roots.append(root)
    top, outer = tree(roots)
    out = []
    for s, outside in zip(sources, outer, strict=True):
        own, root, ways = groups[s]
        out += [(r[0], leaf_of(*r), root, top, w + outside) for r, w in zip(own, ways, strict=True)]
    return out


def test_manifest(spark, tmp_path):
    from plumbline.llm import merkle

    rng = random.Random(5)
    rows = [(k, "hot", "en", k % 7, f"text {k} Ü") for k in range(300)] + [(k, f"s{k % 19}", None, None, None if k % 5 == 0 else "Some " * (k % 9)) for k in range(300, 420)]
    rows += [(900, None, "de", 1, ""), (901, None, "de", 1, "x"), (902, "lone", "fr", None, "y"), (None, "hot", "en", 3, "no id"), (7, "hot", "en", 0, "text 7 Ü"), (7, "hot", "en", 0, "text 7 Ü"), (7, "hot", "en", 0, "other")]
    rng.shuffle(rows)
    docs = stored(spark, tmp_path, [(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    got = merkle.manifest(docs, merkle.leaf_digest(*map(F.col, columns)), "source", "doc_id", {"doc_id": F.col("doc_id"), "n": F.col("n_chars")})
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof(F.col("path"))).collect()
    want = manifest_of(rows)
    assert sorted((r["doc_id"] or -1, r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == sorted((i or -1, a, b, c, "".join(x + y for x, y in w)) for i, a, b, c, w in want)
    assert all(r["folded"] == r["root"] for r in got)
    # any other leaf folds to another root
    forged = spark.createDataFrame([(r["path"],) for r in got if r["path"]], "path array<struct<left: string, right: string>>")
    assert forged.where(merkle.fold(F.lit(sha("forged")), F.col("path")) == got[0]["root"]).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_manifest_of_one_source(spark, tmp_path, n):
    from plumbline.llm import merkle

    rows = [(k, "s", "en", 1, str(k)) for k in range(n)]
    docs = stored(spark, tmp_path, rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs, merkle.leaf_digest(*map(F.col, docs.columns)), "source", "doc_id", {"doc_id": F.col("doc_id")}).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["path"]]) for r in got] == (manifest_of(rows) if n else [])


# --- chat formatting --------------------------------------------------------------------------------------------------

NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<", "|", "a<", "|im_end|>\n", "\n\n", "", None, "é日本", "%0A%25", "<|" * 5]


def chat_of(turns):
    """n_turns, turn digest, characters and digest of the loss, validity, first error, by reading the table itself."""
    follow = {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user", "tool"}, "tool": {"assistant", "tool"}}
    state, wrong = "start", None
    for k, (role, _) in enumerate(turns):
        if role not in follow.get(state, ()) and wrong is None:
            wrong = k
        state = role
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), wrong is None and state == "assistant", wrong


def test_chat(spark, tmp_path):
    from plumbline.llm.chat import format_turns, read_back

    rng = random.Random(9)
    rows = []
    for conv in range(40):
        n = 3000 if conv == 7 else rng.randint(1, 9)
        for k in range(n):
            role = ("user", "assistant")[k % 2] if conv % 3 else rng.choice(["system", "user", "assistant", "tool", "ro\nle<|im_end|>%0A", None])
            rows.append((conv if conv != 5 else None, k if k else None, role, rng.choice(NASTY), "x"))
    rows.append((3, 1, "user", "same turn", "x"))
    table = stored(spark, tmp_path, rows, "conv_id long, turn long, role string, text string, segments string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        formatted = format_turns(table)
        got = {r["conv_id"]: r for r in read_back(formatted).collect()}
        texts = formatted.select("conv_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"), "segments").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["valid"], r["first_error"]) == chat_of(turns), conv
        whole = "".join(s["text"] for row in sorted((x for x in texts if x["conv_id"] == conv), key=lambda x: x["at"]) for s in row["segments"])
        assert r["formatted_chars"] == len(whole)
        # a reader that knows the marks alone finds as many turns in the whole text, and the same
        found = re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", whole, re.S)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in found) == whole
        plain = [(re.sub(r"<\\(\\*)\|", r"<\1|", a).replace("%0A", "\n").replace("%25", "%"), re.sub(r"<\\(\\*)\|", r"<\1|", b)) for a, b in found]
        assert plain == turns


def test_chat_template_and_empty(spark, tmp_path):
    from plumbline.llm.chat import Template, format_turns, read_back

    table = stored(spark, tmp_path, [("a", 0, "q", "Why?"), ("a", 1, "r", "So."), ("b", 0, "r", "<|x")], "conv_id string, turn long, role string, text string")
    plain = Template(opening="<|turn|>[{role}]\n", closing="<|stop|>\n", loss_roles=("r",), accept=("r",), follow={"start": ("q",), "q": ("r",), "r": ("q",)})
    got = {r["conv_id"]: r for r in read_back(format_turns(table, plain), plain).collect()}
    assert (got["a"]["valid"], got["a"]["loss_sha256"], got["a"]["turns_sha256"]) == (True, sha("So."), sha("q\nWhy?\nr\nSo.\n"))
    assert (got["b"]["valid"], got["b"]["first_error"], got["b"]["loss_chars"], got["b"]["loss_sha256"]) == (False, 0, 3, sha("<|x"))
    assert read_back(format_turns(table.limit(0))).count() == 0


# --- periodic runs ----------------------------------------------------------------------------------------------------


def runs_of(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if k + q - i >= max(6, 4 * q):
                out.setdefault((i, k + q - i), q)
            i = k + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed_of(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = random.Random(11)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x " + "a b " * 4, "a b " * 3 + "a", "ü ü\x0bü\x0cü\rü\nü", "a b " * 6]
    for n in (30, 80, 200):
        for letters in ("ab", "abc", "abcdefgh"):
            out += [" ".join(rng.choice(letters) for _ in range(n)) for _ in range(6)]
    for _ in range(60):
        words = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(1, 4)):
            root = [rng.choice("abcd") + rng.choice("xyz") for _ in range(rng.randint(1, 40))]
            n = int(len(root) * rng.uniform(2.5, 9))
            words += [root[i % len(root)] for i in range(n)] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
        out.append(" ".join(words))
    out += ["one " * 700, "one two " * 500 + "three " + "one two " * 400, ("a " * 6 + "b ") * 40]
    return out


def test_periodic_runs(spark, tmp_path):
    from plumbline.llm.periodic import periodic_runs, strongest

    texts = periodic_texts()
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    docs = stored(spark, tmp_path, rows, "doc_id long, text string, runs string, row int")
    plain = periodic_runs(docs).withColumn("best", strongest(F.col("runs"))).collect()
    digests = {r["doc_id"]: r["collapsed"] for r in periodic_runs(docs, digest=True).collect()}
    assert len(plain) == len(texts)
    some = 0
    for r in plain:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        runs = runs_of(words)
        some += len(runs)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs, r["doc_id"]
        assert r["collapsed"] == collapsed_of(words, runs)
        assert digests[r["doc_id"]] == sha(r["collapsed"])
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (tuple(r["best"]) if r["best"] else None) == best
    assert some > 100


def test_periodic_runs_long_repeated_and_null_ids(spark, tmp_path):
    from plumbline.llm.periodic import periodic_runs

    rng = random.Random(1)
    noise = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]  # over one slice of bytes
    root = [f"r{k}" for k in range(9_000)]
    long = noise[:70_000] + root * 5 + root[:10] + noise[70_000:]
    docs = stored(spark, tmp_path, [(1, " ".join(long)), (1, "a " * 9), (None, "b " * 8), (None, None)], "doc_id long, text string")
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], len(r["collapsed"].split())) for r in periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, [(70_000, 45_010, 9_000)], len(long) - 36_010), (1, [(0, 9, 1)], 1), (None, [(0, 8, 1)], 1), (None, [], 0)], key=repr)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_z_function():
    from plumbline.llm.periodic import z_function

    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 20))]
        assert z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
