"""Pairing images with labels, decisions and dimensions: joins, anti-joins and keep-one windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import decision_status


def paired(images: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    return images.join(labels, keys, "inner")


def missing_labels(images: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Images without a label."""
    return images.join(labels.select(*keys), keys, "left_anti")


def orphan_labels(images: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels without an image."""
    return labels.join(images.select(*keys), keys, "left_anti")


def effective_labels(labels: DataFrame, negatives: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that count as labelled: those with a label and those kept as negatives."""
    return labels.select(*keys).unionByName(negatives.select(*keys)).distinct()


def shared_splits(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Splits that both sides have."""
    return images.select("split").intersect(labels.select("split"))


def keep_one(df: DataFrame, keys: list[str], order: list, column: str = "rank") -> DataFrame:
    """All rows with their place within the key; place 1 is the one to keep."""
    return df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def duplicate_keys(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows after the first of their key, with the first row's order column as ``first_path``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("first_path", F.first(order[0]).over(w)).withColumn("rank", F.row_number().over(w)).where("rank > 1").drop("rank")


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return keep_one(df, keys, [F.col(c).desc() for c in order]).where("rank = 1").drop("rank")


def best_match(labels: DataFrame, images: DataFrame, stem: str, suffix: str, priority: list[str]) -> DataFrame:
    """For each label the image of its stem whose suffix comes first in ``priority``; of other suffixes one only if it is the sole image."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(p) for p in priority)), F.col(suffix)), F.lit(0))
    ranked = images.withColumn("suffix_rank", F.when(rank > 0, rank).otherwise(F.lit(len(priority) + 1))).withColumn("images", F.count("*").over(Window.partitionBy(stem)))
    chosen = keep_one(ranked, [stem], ["suffix_rank", suffix]).where((F.col("rank") == 1) & ((F.col("suffix_rank") <= len(priority)) | (F.col("images") == 1)))
    return labels.join(chosen.drop("rank", "images"), stem, "left")


def apply_decisions(items: DataFrame, decisions: DataFrame, filename: str) -> DataFrame:
    """``items`` with ``action`` and ``status``; names match in any case. The decisions are a reviewed list, small next to the items; Spark
    broadcasts them if their size allows."""
    d = decisions.select(F.lower("filename").alias("_key"), "action")
    joined = items.withColumn("_key", F.lower(filename)).join(d, "_key", "left").drop("_key")
    return joined.withColumn("status", decision_status(F.col("action")))


def readable(items: DataFrame, length: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(files worth decoding, files that are too short to be any), by their length alone, before a byte is read. A null length is too short."""
    enough = F.coalesce(F.col(length) >= least, F.lit(False))
    return items.where(enough), items.where(~enough)


def unmatched_decisions(items: DataFrame, decisions: DataFrame, filename: str) -> DataFrame:
    return decisions.withColumn("_key", F.lower("filename")).join(items.select(F.lower(filename).alias("_key")), "_key", "left_anti").drop("_key")


def excluded_locations(items: DataFrame, decisions: DataFrame, filename: str) -> DataFrame:
    """Where each excluded file is; of several places the one in the last split. A null split: it is nowhere."""
    places = keep_one(items.withColumn("_key", F.lower(filename)), ["_key"], [F.col("split").desc(), F.col(filename).desc()]).where("rank = 1").select("_key", "split")
    return decisions.where("action = 'exclude'").withColumn("_key", F.lower("filename")).join(places, "_key", "left").drop("_key")


def three_way(images: DataFrame, first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Images that both label tables have."""
    return images.join(first, keys).join(second, keys)


def decision_violations(decisions: DataFrame, actions: list[str], issues: list[str]) -> DataFrame:
    """``filename, violation`` for each broken rule of the decision table."""
    checks = F.array(
        F.when(~F.col("action").isin(*actions) | F.col("action").isNull(), "unknown_action"),
        F.when(F.col("issue").isNotNull() & ~F.col("issue").isin(*issues), "unknown_issue"),
        F.when(F.col("filename").rlike(r"[/\\]") | (F.trim("filename") == ""), "bad_filename"),
        F.when(F.col("action").isin("exclude", "review") & F.col("issue").isNull(), "issue_required"),
        F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "blank_reason"),
        F.when(F.coalesce(F.trim("status"), F.lit("")) == "", "blank_status"),
    )
    rows = decisions.select("filename", F.explode(F.array_compact(checks)).alias("violation"))
    twice = decisions.groupBy(F.lower("filename").alias("filename")).agg(F.count("*").alias("n")).where("n > 1").select("filename", F.lit("duplicate_filename").alias("violation"))
    return rows.unionByName(twice)


def hierarchy_violations(classes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``class_id, violation``: ids of the dimension that no group has, ids of groups that the dimension lacks, ids in several groups.
    ``classes``: ``class_id``; ``hierarchy``: ``key, class_id``."""
    uses = hierarchy.groupBy("class_id").agg(F.count("*").alias("uses"))
    both = classes.select("class_id", F.lit(True).alias("known")).join(uses, "class_id", "full_outer")
    kind = F.when(F.col("uses").isNull(), "missing").when(F.col("known").isNull(), "extra").when(F.col("uses") > 1, "duplicate")
    return both.select("class_id", kind.alias("violation")).where("violation is not null")


def contiguity(dimension: DataFrame, id_col: str) -> DataFrame:
    """One row: whether the ids are 0 .. n-1, each once."""
    return dimension.agg(F.count("*").alias("n"), F.min(id_col).alias("low"), F.max(id_col).alias("high"), F.countDistinct(id_col).alias("distinct_ids")).withColumn("contiguous", F.coalesce((F.col("low") == 0) & (F.col("high") + 1 == F.col("n")) & (F.col("distinct_ids") == F.col("n")), F.lit(False)))


def require_none(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raise with some of the rows unless there is none."""
    rows = violations.limit(show).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))
