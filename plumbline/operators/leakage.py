"""Leakage between splits: shared groups, neighbouring frames, and the combined risk report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import hash_hex
from plumbline.operators.dedup import identical_hash_classes, identical_hash_pairs, near_hash_classes, near_hash_pairs, near_hash_report
from plumbline.sources.tables import keep

RISK_COLUMNS = ["risk_type", "group_key", "train_image", "val_image", "frame_delta", "dhash_distance", "train_group_count", "val_group_count", "note"]


def cross_split_groups(items: DataFrame, key: str, sides: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Keys that both splits have, with their counts."""
    return items.groupBy(key).agg(F.count_if(F.col("split") == sides[0]).alias("train_count"), F.count_if(F.col("split") == sides[1]).alias("val_count")).where("train_count > 0 and val_count > 0")


def adjacent_frames(frames: DataFrame, most: int = 3, sides: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Train and val frames of one capture at most ``most`` frames apart. Frames meet by (capture, frame div bin): one side lists its bin and both neighbours, so a capture of any length is dealt over many
    keys and no task sees all its pairs. ``frames``: ``id, split, capture_key, frame``."""
    width = most + 1
    usable = frames.where(F.col("frame").isNotNull() & (F.coalesce("capture_key", F.lit("")) != ""))
    bin_ = F.floor(F.col("frame") / width)
    a = usable.where(F.col("split") == sides[0]).select("capture_key", bin_.alias("bin"), F.col("id").alias("train_id"), F.col("frame").alias("train_frame"))
    b = usable.where(F.col("split") == sides[1]).select("capture_key", F.explode(F.sequence(bin_ - 1, bin_ + 1)).alias("bin"), F.col("id").alias("val_id"), F.col("frame").alias("val_frame"))
    pairs = a.join(b, ["capture_key", "bin"]).withColumn("frame_delta", F.abs(F.col("train_frame") - F.col("val_frame")))
    return pairs.where(F.col("frame_delta") <= most).select("capture_key", "train_id", "val_id", "frame_delta")


def risk_counts(risks: DataFrame) -> DataFrame:
    return risks.groupBy("risk_type").agg(F.count("*").alias("n"))


def refresh(risks: DataFrame, dropped: str = "full_decode_error") -> tuple[DataFrame, DataFrame]:
    """A stored report after its files were filtered: the rows without the type that filtering settles, and their counts."""
    left = risks.where(F.col("risk_type") != dropped)
    return left, risk_counts(left)


def leakage_report(prints: DataFrame, threshold: int = 4, capped: bool = False, classes: bool = False) -> DataFrame:
    """All risks in one table; ``prints``: ``id, split, capture_key, frame, part_key, hash, decode_error``; rows with a decode error are reported and take no further part.

    ``classes``: one row for each hash that both splits have and for each pair of near hashes, with the smallest id and the number of files of each side; nothing is cut, and no pairs of files are made, so pairs
    that are neighbouring frames are not left out either. Otherwise rows are pairs of files without neighbouring frames: of one hash the first ten files of a side (as ``note`` says where there are more),
    of near hashes all, or with ``capped`` those within the reference's limits."""
    prints = keep(prints.select("id", "split", "capture_key", "frame", "part_key", "hash", "decode_error"), "prints")  # five detectors read it
    bad = prints.where(F.col("decode_error").isNotNull())
    good = prints.where(F.col("decode_error").isNull())

    def row(df: DataFrame, kind: str, **columns) -> DataFrame:
        kinds = {"frame_delta": "long", "dhash_distance": "int", "train_group_count": "long", "val_group_count": "long"}
        return df.select(*((F.lit(kind) if c == "risk_type" else columns.get(c, F.lit(None))).cast(kinds.get(c, "string")).alias(c) for c in RISK_COLUMNS))

    images = {"train_image": F.col("train_id"), "val_image": F.col("val_id")}
    near_frames = adjacent_frames(good)
    groups = cross_split_groups(good, "part_key")
    if classes:
        counts = {"train_group_count": F.col("train_count"), "val_group_count": F.col("val_count")}
        same = row(identical_hash_classes(good), "identical_hash", group_key=hash_hex(F.col("hash")), dhash_distance=F.lit(0), **images, **counts)
        apart = near_hash_classes(good, threshold).where("distance > 0")
        close = row(apart, "near_duplicate", group_key=F.concat_ws("-", hash_hex(F.col("train_hash")), hash_hex(F.col("val_hash"))), dhash_distance=F.col("distance"), **images, **counts)
    else:
        counts = {"train_group_count": F.col("train_group_count"), "val_group_count": F.col("val_group_count")}
        cut = F.when(F.greatest(*counts.values()) > 10, "first 10 of a side")
        same = row(identical_hash_pairs(good, near_frames), "identical_hash", group_key=hash_hex(F.col("hash")), dhash_distance=F.lit(0), note=cut, **images, **counts)
        close = row((near_hash_report if capped else near_hash_pairs)(good, threshold, exclude=near_frames), "near_duplicate", dhash_distance=F.col("distance"), **images)
    return (
        row(bad, "full_decode_error", train_image=F.when(F.col("split") == "train", F.col("id")), val_image=F.when(F.col("split") == "val", F.col("id")), note=F.col("decode_error"))
        .unionByName(row(groups, "cross_split_group", group_key=F.col("part_key"), train_group_count=F.col("train_count"), val_group_count=F.col("val_count")))
        .unionByName(row(near_frames, "adjacent_frame", group_key=F.col("capture_key"), frame_delta=F.col("frame_delta"), **images))
        .unionByName(same)
        .unionByName(close)
    )
