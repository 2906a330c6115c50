"""Content hashes, exact duplicates, dataset digests and perceptual near-duplicates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import hamming, hash_chunks
from plumbline.operators.sampling import first_n
from plumbline.sources.tables import keep

#: Distinct hashes of a side that one block of a crowded key holds, about.
HASHES = 2000
#: Files of a side that one block of a crowded hash holds, about; a task holds the pairs of two blocks.
FILES = 256


def content_hash(files: DataFrame, content: str, out: str = "sha256") -> DataFrame:
    return files.withColumn(out, F.sha2(F.col(content), 256))


def exact_duplicates(files: DataFrame, content: str, path: str) -> DataFrame:
    """``path, first_path`` of every file whose content an earlier path has. Only digests are shuffled."""
    hashed = files.where(F.col(content).isNotNull()).select(path, F.sha2(F.col(content), 256).alias("sha256"))
    firsts = hashed.groupBy("sha256").agg(F.min(path).alias("first_path"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(firsts, "sha256").where(F.col(path) != F.col("first_path")).select(path, "first_path", "sha256")


def dataset_digest(files: DataFrame, path: str, sha256: str, buckets: int | None = None, bucket: Column | None = None) -> DataFrame:
    """One digest of a set of files in path order. With ``buckets`` (by CRC of the path) or an own integer ``bucket``, of digests by path bucket, made in many tasks; the buckets are
    then part of the digest's definition. Sorted rows are streamed through the hash, so no task holds the paths of a bucket, however many there are."""
    name = F.col(path).cast("string")
    own = bucket if bucket is not None else F.lit(0) if buckets is None else F.pmod(F.crc32(name.cast("binary")), F.lit(buckets))
    parts = _digests(files.select(own.cast("long").alias("bucket"), name.alias("path"), F.concat(name, F.lit(":"), F.col(sha256), F.lit("\n")).alias("line")))
    if bucket is not None or buckets is not None:
        parts = _digests(parts.select(F.lit(0).cast("long").alias("bucket"), F.format_string("%020d", "bucket").alias("path"), F.col("digest").alias("line"), "files"))
    nothing = hashlib.sha256(b"").hexdigest()
    return parts.agg(F.coalesce(F.first("digest"), F.lit(nothing)).alias("digest"), F.coalesce(F.sum("files"), F.lit(0).cast("long")).alias("files"))


def _digests(rows: DataFrame) -> DataFrame:
    """``bucket, digest, files``: the digest of each bucket's lines in path order; null lines are counted alone. ``rows``: ``bucket, path, line`` and perhaps the ``files`` of a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, files = None, hashlib.sha256(), 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([digest.hexdigest()]), pa.array([files], pa.int64())], names=["bucket", "digest", "files"])

        for batch in batches:
            for bucket, line, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if files and bucket != last:
                    yield made()
                    digest, files = hashlib.sha256(), 0
                last, files = bucket, files + n
                digest.update((line or "").encode())
        if files:
            yield made()

    n = F.col("files") if "files" in rows.columns else F.lit(1).cast("long")
    dealt = rows.withColumn("files", n).repartition("bucket").sortWithinPartitions("bucket", "path", "line")
    return dealt.select("bucket", "line", "files").mapInArrow(run, "bucket long, digest string, files long")


def digest_tree(files: DataFrame, path: str, sha256: str, depth: int = 4) -> DataFrame:
    """``level, prefix, digest, files``: a Merkle tree of a set of files over the leading ``depth`` hexadecimal digits of the SHA-256 of their paths, from the leaves (``level`` = depth) to the root
    (0, empty prefix). A leaf hashes the ``path:sha256`` lines of its files in order (16 ** depth leaves share all files, so one holds some 15,000 of 10**9); an inner node hashes the prefixes
    and digests of its 16 children at most. A null digest counts as ``-``; a file that is listed twice counts twice; no files, no nodes. Store it: two trees tell which files to compare."""
    name = F.col(path).cast("string")
    lines = files.select(F.substring(F.sha2(name, 256), 1, depth).alias("prefix"), F.struct(name.alias("path"), F.coalesce(F.col(sha256), F.lit("-")).alias("sha256")).alias("file"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("file")), lambda f: F.concat(f["path"], F.lit(":"), f["sha256"], F.lit("\n"))), "")
    nodes = lines.groupBy("prefix").agg(F.sha2(text, 256).alias("digest"), F.count("*").alias("files"))
    levels = [nodes]
    for k in reversed(range(depth)):
        child = F.struct("prefix", "digest")
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat(c["prefix"], F.lit(":"), c["digest"], F.lit("\n"))), "")
        up = F.substring("prefix", 1, k) if k else F.lit("")
        levels.append(levels[-1].groupBy(up.alias("_up")).agg(F.sha2(kids, 256).alias("digest"), F.sum("files").alias("files")).withColumnRenamed("_up", "prefix"))
    return reduce(DataFrame.unionByName, [n.select(F.lit(depth - k).alias("level"), "prefix", "digest", "files") for k, n in enumerate(levels)])


def tree_root(tree: DataFrame) -> DataFrame:
    """``digest, files`` of a whole tree; without nodes the digest of nothing."""
    nothing = hashlib.sha256(b"").hexdigest()
    return tree.where("level = 0").agg(F.coalesce(F.first("digest"), F.lit(nothing)).alias("digest"), F.coalesce(F.sum("files"), F.lit(0).cast("long")).alias("files"))


def changed_files(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame, path: str, sha256: str) -> DataFrame:
    """``path, before, after, change`` of the files that two sets do not share: added, removed or changed. Only files below leaves that differ are compared. Paths are unique in a set."""
    depth = F.length("prefix") > 0
    a, b = (t.where(depth).where(F.col("level") == F.length("prefix")).select("level", "prefix", F.col("digest").alias(n)) for t, n in ((old_tree, "_a"), (new_tree, "_b")))
    deepest = a.select("level").unionByName(b.select("level")).agg(F.max("level").alias("level"))
    leaves = a.join(b, ["level", "prefix"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).join(F.broadcast(deepest), "level")  # one row
    width = leaves.select("prefix", "level")

    def touched(files: DataFrame, name: str) -> DataFrame:
        rows = files.select(F.col(path).cast("string").alias("path"), F.col(sha256).alias(name)).withColumn("_sha", F.sha2("path", 256)).join(F.broadcast(deepest), F.lit(True))
        return rows.withColumn("prefix", F.expr("substring(_sha, 1, level)")).join(width, ["prefix", "level"], "left_semi").select("path", name, F.lit(True).alias(f"_{name}"))

    both = touched(old, "before").join(touched(new, "after"), "path", "full_outer")
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("changed")
    return both.where(F.col("_before").isNull() | F.col("_after").isNull() | ~F.col("before").eqNullSafe(F.col("after"))).select("path", "before", "after", change.alias("change"))


def hash_classes(prints: DataFrame, sides: tuple[str, str] = ("train", "val")) -> DataFrame:
    """``hash, train_count, val_count, train_id, val_id``: one row for each hash that one of two splits has, with the number of files of each side and the smallest id of each. ``prints``: ``id, split, hash``."""
    one = {n: F.col("split") == s for s, n in zip(sides, ("train", "val"), strict=True)}
    known = prints.where(F.col("hash").isNotNull() & F.col("split").isin(*sides))
    return known.groupBy("hash").agg(*(F.count_if(c).alias(f"{n}_count") for n, c in one.items()), *(F.min(F.when(c, F.col("id"))).alias(f"{n}_id") for n, c in one.items()))


def identical_hash_classes(prints: DataFrame, sides: tuple[str, str] = ("train", "val")) -> DataFrame:
    """The hashes that both splits have, as ``hash_classes``: whole, without pairs. ``hash_members`` gives the files of each."""
    return hash_classes(prints, sides).where("train_count > 0 and val_count > 0")


def hash_members(prints: DataFrame, hashes: DataFrame, sides: tuple[str, str] = ("train", "val")) -> DataFrame:
    """``hash, split, id`` of the files of some hashes (``hash``)."""
    return prints.where(F.col("split").isin(*sides)).join(hashes.select("hash").distinct(), "hash", "left_semi").select("hash", "split", "id")


def identical_hash_pairs(prints: DataFrame, exclude: DataFrame | None = None, each: int = 10, sides: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Pairs across two splits with one hash, at most ``each`` files of a side to a hash (the smallest ids), with the counts of the whole group: the reference's cut, for its reports;
    ``identical_hash_classes`` has none. Counts are partial aggregates, and a hot hash is cut in shares, so no task sees it whole. ``exclude``: ``train_id, val_id``."""
    classes = identical_hash_classes(prints, sides).select("hash", F.col("train_count").alias("train_group_count"), F.col("val_count").alias("val_group_count"))
    some = first_n(prints.where(F.col("hash").isNotNull() & F.col("split").isin(*sides)).select("id", "split", "hash"), ["hash", "split"], ["id"], each)
    a, b = (some.where(F.col("split") == s).select("hash", F.col("id").alias(f"{n}_id")) for s, n in zip(sides, ("train", "val"), strict=True))
    pairs = a.join(b, "hash").join(classes, "hash")
    return pairs if exclude is None else pairs.join(exclude.select("train_id", "val_id"), ["train_id", "val_id"], "left_anti")


def _parts(pieces: int) -> list[int]:
    edges = [64 * k // pieces for k in range(pieces + 1)]
    return [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _masks(pieces: int, threshold: int) -> list[int]:
    """The bits of each choice of ``pieces - threshold`` out of ``pieces`` nearly equal parts of a hash, as signed numbers."""
    return [_signed(sum(chosen)) for chosen in combinations(_parts(pieces), pieces - threshold)]


def first_key(different: Column, key_index: Column, pieces: int, threshold: int) -> Column:
    """Whether the key of number ``key_index`` that two hashes share is the first that they share, from the bits in which they differ: every part that its choice leaves out before the last one taken
    differs. A comparison with each of 70 keys in turn is so much code that the JVM no longer compiles it."""
    chosen = combinations(range(pieces), pieces - threshold)
    needed = F.get(F.array(*(F.lit(sum(1 << p for p in range(max(c)) if p not in c)) for c in chosen)), key_index)
    differ = reduce(Column.bitwiseOR, (F.when(different.bitwiseAND(F.lit(_signed(m)).cast("long")) != 0, F.lit(1 << p)).otherwise(F.lit(0)) for p, m in enumerate(_parts(pieces))))
    return differ.bitwiseAND(needed) == needed


def key_pieces(hashes: int, threshold: int) -> int:
    """Parts that a hash is cut into: as few as give keys of more bits than it takes to number the hashes, ``threshold + 4`` at most (bytes at 4: 70 keys of 32 bits). The pairs are the same with any."""
    return next((m for m in range(threshold + 1, threshold + 4) if 64 * (m - threshold) // m > max(1, hashes).bit_length()), threshold + 4)


def near_hash_classes(prints: DataFrame, threshold: int = 4, pieces: int | None = None, sides: tuple[str, str] = ("train", "val")) -> DataFrame:
    """All pairs of hashes across two splits that differ in ``threshold`` bits at most: ``train_hash, val_hash, distance, train_count, val_count, train_id, val_id`` (the number of
    files behind each hash and the smallest id). Files are not expanded into pairs; ``hash_members`` gives them.

    Cut into ``pieces`` parts, two such hashes are equal in all but ``threshold`` of them, so they share the key of some choice of the others; a pair is given by the first key
    that it shares alone. Keys have so many bits that random hashes hardly meet; a key that many hashes have all the same is dealt into blocks, and blocks meet in pairs. The
    table of distinct hashes is stored, as it is read for its size and by both sides."""
    return near_classes(keep(hash_classes(prints, sides), "hashes"), threshold, pieces)


def near_classes(classes: DataFrame, threshold: int = 4, pieces: int | None = None) -> DataFrame:
    """``near_hash_classes`` of a stored table of ``hash_classes``."""
    pieces = pieces or key_pieces(classes.count(), threshold)
    masks = _masks(pieces, threshold)
    keyed = classes.select("*", F.posexplode(F.array(*(F.col("hash").bitwiseAND(F.lit(m).cast("long")) for m in masks))).alias("key_index", "key"))
    keys = ["key_index", "key"]
    held = {n: F.count_if(F.col(f"{n}_count") > 0) for n in ("train", "val")}
    crowded = keyed.groupBy(*keys).agg(*(F.greatest(F.ceil(h / HASHES), F.lit(1)).alias(f"{n}_parts") for n, h in held.items())).where("train_parts > 1 or val_parts > 1")
    dealt = keyed.join(crowded, keys, "left").fillna(1, ["train_parts", "val_parts"])

    def side(own: str, other: str) -> DataFrame:
        """One side in its own blocks, once for each block of the other."""
        block = F.pmod(F.xxhash64("hash"), F.col(f"{own}_parts")).alias(f"{own}_block")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1)).alias(f"{other}_block")
        rows = dealt.where(F.col(f"{own}_count") > 0).select(*keys, block, every, F.col("hash").alias(f"{own}_hash"), f"{own}_count", f"{own}_id")
        return rows.repartition(tasks, *keys, "train_block", "val_block")

    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as few bytes meet in many pairs, tasks are not joined by their bytes
    met = side("train", "val").join(side("val", "train"), [*keys, "train_block", "val_block"])
    different = F.col("train_hash").bitwiseXOR(F.col("val_hash"))
    near = met.withColumn("distance", F.bit_count(different)).where(F.col("distance") <= threshold).where(first_key(different, F.col("key_index"), pieces, threshold))
    return near.select("train_hash", "val_hash", "distance", "train_count", "val_count", "train_id", "val_id")


def near_hash_pairs(prints: DataFrame, threshold: int = 4, exclude: DataFrame | None = None, sides: tuple[str, str] = ("train", "val")) -> DataFrame:
    """The pairs of files behind ``near_hash_classes``: ``train_id, val_id, distance``. Files of one hash are all paired, so ask for it where that is wanted. ``exclude``: ``train_id, val_id``.

    No pair of files is shuffled: the files of a hash lie in blocks of some ``FILES`` ids, pairs of blocks are shuffled with the ids of one side, and the last stage joins the other side's ids and unfolds
    both. It is dealt over all shuffle partitions, however small the blocks are. The joins are sort-merge joins, as a broadcast join makes all rows of one key at once and holds them."""
    known = prints.where(F.col("hash").isNotNull() & F.col("split").isin(*sides)).select("id", "split", "hash").distinct()
    crowded = known.groupBy("hash", "split").agg(F.ceil(F.count("*") / FILES).alias("parts")).where("parts > 1")
    members = known.join(crowded, ["hash", "split"], "left").withColumn("block", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0).cast("long")))
    members = keep(members.select("id", "split", "hash", "block"), "members")

    def side(n: str) -> DataFrame:
        own = members.where(F.col("split") == sides[("train", "val").index(n)])
        return own.select(F.col("id").alias(f"{n}_id"), F.col("hash").alias(f"{n}_hash"), F.col("block").alias(f"{n}_block"))

    keys = {n: [f"{n}_hash", f"{n}_block"] for n in ("train", "val")}
    parts = {n: keys[n][:1] + [f"{n}_parts"] for n in keys}
    near = near_hash_classes(prints, threshold, sides=sides).select("train_hash", "val_hash", "distance")
    for n, own in parts.items():
        near = near.join(crowded.where(F.col("split") == sides[("train", "val").index(n)]).select(F.col("hash").alias(own[0]), F.col("parts").alias(own[1])), own[0], "left")
    blocks = [F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"{n}_parts", F.lit(1).cast("long")) - 1)).alias(f"{n}_block") for n in keys]
    met = near.select("*", blocks[0]).select("*", blocks[1]).select(*keys["train"], *keys["val"], "distance")
    if exclude is not None:
        gone = exclude.select("train_id", "val_id").distinct().join(side("train"), "train_id").join(side("val"), "val_id").where(F.bit_count(F.col("train_hash").bitwiseXOR(F.col("val_hash"))) <= threshold)
        met = met.join(gone.groupBy(*keys["train"], *keys["val"]).agg(F.collect_list(F.struct("train_id", "val_id")).alias("gone")), [*keys["train"], *keys["val"]], "left")
    listed = {n: F.transform(F.collect_list(F.struct(F.col(f"{n}_id").alias("id"))), lambda x: x["id"]) for n in keys}  # null ids too
    ids = {n: side(n).groupBy(*keys[n]).agg(listed[n].alias(f"{n}_ids")) for n in keys}
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.join(ids["val"].hint("merge"), keys["val"]).repartition(tasks, *keys["train"]).join(ids["train"].repartition(tasks, *keys["train"]).hint("merge"), keys["train"])
    pairs = met.select("*", F.explode("val_ids").alias("val_id"))
    if exclude is not None:
        out = F.transform(F.filter("gone", lambda g: g["val_id"] == F.col("val_id")), lambda g: g["train_id"])
        pairs = pairs.withColumn("train_ids", F.when(F.col("gone").isNull(), F.col("train_ids")).otherwise(F.array_except("train_ids", out)))
    return pairs.select("val_id", "distance", F.explode("train_ids").alias("train_id")).select("train_id", "val_id", "distance")


def near_hash_report(prints: DataFrame, threshold: int = 4, bucket_pairs: int = 50_000, cap: int = 50_000, exclude: DataFrame | None = None, sides: tuple[str, str] = ("train", "val")) -> DataFrame:
    """The reference's cut of ``near_hash_pairs``, for its reports: pairs across two splits that share one of four 16-bit chunks of their hash and differ in ``threshold`` bits at most: the first ``cap`` by distance and ids. Buckets of more than
    ``bucket_pairs`` pairs are skipped. Four chunks find every pair up to distance 3; at 4 some may be missed."""
    chunks = prints.where(F.col("hash").isNotNull()).select("id", "split", "hash", F.inline(hash_chunks(F.col("hash"))))
    keys = ["chunk_index", "chunk"]
    small = chunks.groupBy(*keys).agg(F.count_if(F.col("split") == sides[0]).alias("a"), F.count_if(F.col("split") == sides[1]).alias("b")).where((F.col("a") > 0) & (F.col("b") > 0) & (F.col("a") * F.col("b") <= bucket_pairs)).select(*keys)
    kept = chunks.join(small, keys)
    a, b = (kept.where(F.col("split") == s).select(*keys, F.col("id").alias(f"{n}_id"), F.col("hash").alias(f"{n}_hash")) for s, n in zip(sides, ("train", "val"), strict=True))
    pairs = a.join(b, keys).withColumn("distance", hamming(F.col("train_hash"), F.col("val_hash"))).where(F.col("distance") <= threshold).select("train_id", "val_id", "distance").distinct()
    if exclude is not None:
        pairs = pairs.join(exclude.select("train_id", "val_id"), ["train_id", "val_id"], "left_anti")
    return pairs.orderBy("distance", "train_id", "val_id").limit(cap)
