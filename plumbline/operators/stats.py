"""Distributions and summaries: partial aggregates first, dimensions joined to the small results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import bin_number, finite, line_class
from plumbline.sources.tables import keep


def with_zeros(counts: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of a dimension table, with 0 where nothing was counted."""
    return dimension.join(counts, keys, "left").fillna(0)


def class_distribution(instances: DataFrame, classes: DataFrame, splits: list[str], images: bool = False, image: str = "image") -> DataFrame:
    """Class by split, zero-filled over all classes, and ``total``: instances, or with ``images`` different images."""
    rows = instances.select("split", "class_id", image).distinct() if images else instances
    wide = rows.groupBy("class_id").pivot("split", splits).agg(F.count(F.lit(1)))
    out = with_zeros(wide, classes, ["class_id"])
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(s) for s in splits]))


def split_summary(files: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Named conditional sums by split, and over all splits (``split`` = total)."""
    return files.rollup("split").agg(*(m.alias(k) for k, m in measures.items()), F.grouping("split").alias("_all")).withColumn("split", F.when(F.col("_all") == 1, "total").otherwise(F.col("split"))).drop("_all")


def file_counters(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Counters of files by split and in all (``split`` = total), before and after decisions. ``images``: ``split, key, status``; ``labels``: ``split, key``; keys are unique in a split.

    A dropped image drops its label, a negative counts as labelled whether it has a label or not. ``missing``: kept images without any; ``orphan``: labels without an image."""
    both = images.select("split", key, "status", F.lit(True).alias("image")).join(labels.select("split", key, F.lit(True).alias("label")), ["split", key], "full_outer")
    image, label, negative, dropped = F.col("image").isNotNull(), F.col("label").isNotNull(), F.col("status") == "kept_negative", F.coalesce(~F.col("status").isin("kept", "kept_negative"), F.lit(False))
    negative = F.coalesce(negative, F.lit(False))
    measures = {
        "raw_images": image, "raw_labels": label, "dropped_images": dropped, "dropped_labels": dropped & label, "negatives": negative, "negatives_with_label": negative & label, "virtual_empty_labels": negative & ~label,
        "images": image & ~dropped, "labels": (label & ~dropped) | negative, "paired": image & ~dropped & (label | negative), "missing": image & ~dropped & ~label & ~negative, "orphan": label & ~image,
    }
    return split_summary(both, {k: F.count_if(m) for k, m in measures.items()})


def exact_medians(rows: DataFrame, by: list[str], values: list[str], bins: int = 4096, passes: int = 2) -> DataFrame:
    """``by`` and the median of each of ``values`` (mean of the two middle ones of an even number), exactly, with no group in one buffer.

    Selection by histograms: each pass counts the rows of a group in ``bins`` bins between the smallest and the greatest value that may still be the middle, and keeps the bin that holds it; what
    is left is counted by value. A bin is a rounded linear function of the value, so it keeps the order, and any data give the same result. Moved between tasks are ``bins`` counts of a
    group at most, and for the last step the values of one bin. Null, NaN and infinite values take no part; a group without others has no row. ``rows`` is read once a pass: give stored data."""
    plain = [c for c in by if c in rows.columns]
    numbers = F.explode(F.array(*(F.struct(F.lit(k).alias("_of"), F.col(v).cast("double").alias("_v")) for k, v in enumerate(values))))
    long = rows.select(*plain, numbers.alias("_x")).select(*plain, "_x.*").where(finite(F.col("_v")))
    keys, target = [*plain, "_of"], [*plain, "_of", "_rank"]
    ends = long.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    middle = F.explode(F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2"))))
    state = ends.select(*keys, middle.alias("_rank"), "_low", "_high", F.lit(0).cast("long").alias("_below"))
    running = Window.partitionBy(*target).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(passes + 1):
        width = F.col("_high") - F.col("_low")
        bin_ = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0).cast("long")) if k < passes else F.col("_v")
        inside = on_keys(long, state, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        counts = inside.groupBy(*target, "_below", bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = counts.withColumn("_upto", F.col("_below") + F.sum("_n").over(running))
        found = upto.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        state = found.select(*target, "_low", "_high", (F.col("_upto") - F.col("_n")).alias("_below"))
    return state.groupBy(*plain).agg(*(F.avg(F.when(F.col("_of") == k, F.col("_low"))).alias(v) for k, v in enumerate(values)))


def on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null, which then are equal."""
    other = right.select(*(F.col(c).alias(f"_k_{c}") if c in keys else c for c in right.columns))
    return left.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])).drop(*(f"_k_{c}" for c in keys))


def object_size_by_class(objects: DataFrame, classes: DataFrame, splits: list[str]) -> DataFrame:
    """Counts by size, shares, mean and median areas by class and split (and ``total``), with a row for every class."""
    areas = ["bbox_area_px", "mask_area_relative"]
    stored = keep(objects.select("split", "class_id", "size", *areas), "objects")
    each = stored.withColumn("split", F.explode(F.array("split", F.lit("total"))))
    measures = [
        F.count("*").alias("objects"),
        *(F.count_if(F.col("size") == s).alias(s) for s in ("small", "medium", "large")),
        F.avg("bbox_area_px").alias("mean_area_px"), F.avg("mask_area_relative").alias("mean_mask"),
    ]
    grouped = each.groupBy("split", "class_id").agg(*measures)
    middles = exact_medians(each, ["split", "class_id"], areas).select("split", "class_id", F.col("bbox_area_px").alias("median_area_px"), F.col("mask_area_relative").alias("median_mask"))
    names = classes.select("class_id").withColumn("split", F.explode(F.array(*(F.lit(s) for s in [*splits, "total"]))))
    out = with_zeros(grouped.join(middles, ["split", "class_id"], "left"), names, ["split", "class_id"])
    for s in ("small", "medium", "large"):
        out = out.withColumn(f"{s}_ratio", F.when(F.col("objects") > 0, F.col(s) / F.col("objects")).otherwise(F.lit(0.0)))
    return out


def hard_error_by_class(issues: DataFrame, instances: DataFrame) -> DataFrame:
    """Files, lines and coordinates with hard errors by class, and the share of the class's images that they touch. ``issues``: hard coordinates with
    ``file_id, line_no, class_id, value, amount``."""
    hard = issues.groupBy("class_id").agg(F.countDistinct("file_id").alias("files"), F.countDistinct("file_id", "line_no").alias("lines"), F.count("*").alias("coordinates"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("amount").alias("most"))
    all_images = instances.groupBy("class_id").agg(F.countDistinct("file_id").alias("class_files"), F.count("*").alias("instances"))
    return all_images.join(hard, "class_id").withColumn("file_ratio", F.col("files") / F.col("class_files"))


def coordinate_summary(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count("*").alias("coordinates"), F.count_if(F.col("coordinate_severity") == "soft").alias("soft_coordinates"), F.count_if(F.col("line_severity") == "hard").alias("hard_line_coordinates"),
        F.countDistinct("file_id", "line_no").alias("lines"), F.countDistinct("file_id").alias("files"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("amount").alias("most"),
    )


def dimension_summary(images: DataFrame) -> DataFrame:
    read = images.where("width > 0 and height > 0")
    return read.agg(F.count("*").alias("images"), *(f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max), ("median", F.median))))


def objects_per_image(images: DataFrame, objects: DataFrame, key: str, top: int = 6) -> DataFrame:
    """Images by number of objects, ``top`` and more as one bin, with a row for every bin."""
    n = objects.groupBy(key).agg(F.count("*").alias("n"))
    counted = images.select(key).join(n, key, "left").select(F.least(F.coalesce("n", F.lit(0)), F.lit(top)).cast("int").alias("objects"))
    bins = images.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("objects"))
    return with_zeros(counted.groupBy("objects").agg(F.count("*").alias("images")), bins, ["objects"])


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """``bin, n`` over left-closed bins, every bin with a row; bin 0 is below the first edge."""
    bins = rows.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return with_zeros(rows.groupBy(bin_number(value, edges).alias("bin")).agg(F.count("*").alias("n")), bins, ["bin"])


def size_pivot(objects: DataFrame) -> DataFrame:
    return objects.groupBy("class_id").pivot("size", ["small", "medium", "large"]).agg(F.count(F.lit(1))).fillna(0)


def error_type_counts(issues: DataFrame, missing: DataFrame, orphan: DataFrame) -> DataFrame:
    """Issues by type, with missing and orphan labels among the types."""
    extra = missing.select(F.lit("missing_label").alias("error_type")).unionByName(orphan.select(F.lit("orphan_label").alias("error_type")))
    return issues.select("error_type").unionByName(extra).groupBy("error_type").agg(F.count("*").alias("n"))


def coarse_rollup(instances: DataFrame, hierarchy: DataFrame, splits: list[str], image: str = "image") -> DataFrame:
    """Instances and images by split and coarse group, every pair with a row. ``hierarchy``: ``key, class_id``."""
    joined = instances.join(hierarchy, "class_id")
    counts = joined.groupBy("split", "key").agg(F.count("*").alias("instances"), F.countDistinct(image).alias("images"))
    groups = hierarchy.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_set("class_id")), lambda x: x.cast("string")), ",").alias("fine_class_ids")).withColumn("split", F.explode(F.array(*(F.lit(s) for s in splits))))
    return with_zeros(counts, groups, ["split", "key"])


def class_count_map(instances: DataFrame) -> DataFrame:
    """One row: ``class_counts``, a map from class to its instances in the order of classes; null classes are not counted."""
    counts = instances.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "n")))).alias("class_counts"))


def class_sets(lines: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """``key, classes``: the classes of each label file, sorted, from the first tokens of its lines; what is no class is left out, and a file without any has no row."""
    found = lines.select(key, line_class(F.col(raw)).alias("_class")).where("_class is not null")
    return found.groupBy(key).agg(F.array_sort(F.collect_set("_class")).alias("classes"))


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two one-row tables as ``metric, before, after, difference``."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in df.columns)), F.array(*(F.col(c).cast("double") for c in df.columns)))).alias("metric", name))

    return long(before, "before").join(long(after, "after"), "metric", "full_outer").withColumn("difference", F.col("after") - F.col("before"))


def dataset_check(lines: DataFrame, auto_fix: bool) -> DataFrame:
    """File level of a label check: ``lines`` has ``file_id, error_type, fixed_points, hard_range``. A file with a hard range error is removed when fixing, else
    a file with any fixed line is fixed, and only then do its fix counters count."""
    files = lines.groupBy("file_id").agg(F.bool_or("hard_range").alias("hard"), F.count_if(F.col("error_type").isNotNull()).alias("issues"), F.count_if(F.col("fixed_points").isNotNull()).alias("fixed_lines"), F.coalesce(F.sum("fixed_points"), F.lit(0)).alias("fixed_points"), F.count_if(F.col("error_type").isNull()).alias("valid_lines"))
    removed = F.col("hard") & F.lit(auto_fix)
    fixed = ~removed & (F.col("fixed_lines") > 0)
    return files.withColumn("action", F.when(removed, "remove").when(fixed, "fix").otherwise("keep")).withColumn("fixed_lines", F.when(fixed, F.col("fixed_lines")).otherwise(0)).withColumn("fixed_points", F.when(fixed, F.col("fixed_points")).otherwise(0))
