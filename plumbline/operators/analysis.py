"""The statistics of a labelled image set: every report table from one parse of the labels.

``analyze`` applies the decisions, parses each label line once, and stores two fact tables, one row a file and one row a line. All tables are then light queries on them, and the counts that a
gate asks for are observed while the facts are written, so a gate is no job of its own.

Inputs: ``images``: ``file_id, split, filename, width, height, error`` (sizes 0 and an error where an image can't be read); ``labels``: ``file_id, split``; ``lines``: ``file_id, line_no, raw``; ``decisions``:
``filename, action, issue, reason, status``; ``classes``: ``class_id, name``. A file id is one file in one split. Blank lines are no lines; lines without a label file, or of files that are
dropped, negative or without an image, take no part; null file ids take none either. Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import stats
from plumbline.operators.pairing import decision_status
from plumbline.sources.files import write_csv, write_json
from plumbline.sources.tables import keep

# Fixed value: how many bad lines a report shows.
SAMPLES = 100


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Analysis:
    """``files`` and ``lines`` are the stored facts, ``observed`` what was counted while they were written."""

    files: DataFrame
    lines: DataFrame
    classes: DataFrame
    splits: list[str]
    observed: dict[str, int]
    corrupted: str = "corrupted_file"

    # --- tables

    def class_distribution(self, images: bool = False) -> DataFrame:
        known = self.lines.where("class_id is not null").select("split", "class_id", "file_id")
        return stats.class_distribution(known, self.classes.select("class_id"), self.splits, images, "file_id")

    def invalid_lines(self) -> DataFrame:
        """Each error of a line: at most a range error and then another one. Coordinates are those that were looked at: as written for a range error, clamped for the geometry."""
        soft = F.when(F.col("soft_error"), self._error(F.lit("polygon_coordinate_range"), "soft", F.col("values")))
        range_ = F.col("hard_error") == "polygon_coordinate_range"
        hard = F.when(F.col("hard_error").isNotNull(), self._error(F.col("hard_error"), "hard", F.when(range_ | (F.col("hard_error") == "polygon_geometry"), F.when(range_, F.col("values")).otherwise(F.transform("values", C.clamp01)))))
        return self.lines.select("split", "file_id", "line_no", "class_id", F.inline(F.array_compact(F.array(soft, hard))))

    @staticmethod
    def _error(kind: Column, severity: str, values: Column) -> Column:
        return F.struct(kind.alias("issue_type"), F.lit(severity).alias("severity"), F.array_min(values).alias("min_coordinate"), F.array_max(values).alias("max_coordinate"), F.array_max(F.transform(values, C.overflow)).alias("max_offset"))

    def coordinates(self, severity: str | None = None) -> DataFrame:
        """One row for each coordinate outside [0, 1]; ``severity='hard'``: of lines beyond the tolerance only."""
        outside = self.lines.where(F.col("soft_error") | (F.col("hard_error") == "polygon_coordinate_range"))
        rows = outside.select("split", "file_id", "line_no", "class_id", F.inline(C.coordinate_issues(F.col("values"))))
        return rows if severity is None else rows.where(F.col("line_severity") == severity)

    def hard_error_by_class(self) -> DataFrame:
        return stats.hard_error_by_class(self.coordinates("hard"), self.lines.where("class_id is not null"))

    def images(self) -> DataFrame:
        """Each image that decisions keep, with its number of instances."""
        kept = self.files.where("image and not dropped")
        return kept.select("split", "file_id", "width", "height", C.aspect_ratio(F.col("width"), F.col("height")).alias("aspect_ratio"), "instances", F.col("negative").alias("is_negative"), (F.col("label") | F.col("negative")).alias("has_effective_label"), "error")

    def objects(self) -> DataFrame:
        """Each usable polygon of an image that can be read, with its geometry."""
        sized = self.lines.where("geometry_status is not null and error is null")
        rows = sized.select("split", "file_id", "line_no", "class_id", "geometry_status", "width", "height", C.geometry(F.col("coords"), F.col("width"), F.col("height")).alias("g"))
        names = rows.join(self.classes.select("class_id", F.col("name").alias("class_name"), C.class_group(F.col("name")).alias("class_group")), "class_id")
        return names.select("split", "file_id", "line_no", "class_id", "class_name", "class_group", "geometry_status", "width", "height", "g.*")

    def object_sizes(self) -> DataFrame:
        return stats.object_size_by_class(self.objects(), self.classes, self.splits)

    def read_errors(self) -> DataFrame:
        return self.files.where("image and not dropped and error is not null").select("split", "file_id", F.col("error").alias("reason"))

    def corrupted_images(self) -> DataFrame:
        """Images that a decision calls corrupted, whatever its action."""
        return self.files.where(F.col("image") & (F.col("issue") == self.corrupted)).select("split", "file_id", "action", "issue", "reason", "decision_status")

    def split_statistics(self) -> DataFrame:
        """24 counters by split, and in all (``total``)."""
        own = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
        on = lambda c: F.count_if(F.expr(c) if isinstance(c, str) else c)
        return stats.split_summary(
            self.files,
            {
                "raw_images": on("image"), "raw_labels": on("label"), "images": on("image and not dropped"), "labels": on("(label and not dropped) or negative"), "paired": on("paired"),
                "missing_labels": on("image and not dropped and not label and not negative"), "orphan_labels": on("label and not image"), "empty_labels": on("negative or (paired and instances = 0 and errors = 0)"),
                "virtual_empty_labels": on("negative and not label"), "excluded_by_filter": on(F.col("action") == "exclude"), "review_by_filter": on(F.col("action") == "review"), "negative_by_filter": on("negative"),
                "corrupted_by_filter": on(F.col("image") & (F.col("issue") == self.corrupted)), "instances": own("instances"), "usable_polygon_instances": own("valid"), "soft_clippable_instances": own("soft_clipped"),
                "geometry_instances": own(F.col("valid") + F.col("soft_clipped")), "sized_geometry_instances": own(F.when(F.col("error").isNull(), F.col("valid") + F.col("soft_clipped")).otherwise(0)), "hard_invalid_lines": own("hard_errors"),
                "invalid_lines": own("errors"), "out_of_bounds_coordinates": own(F.col("soft_coordinates") + F.col("hard_coordinates")), "soft_reset_coordinates": own("soft_coordinates"), "hard_review_coordinates": own("hard_coordinates"),
                "image_read_errors": on("image and not dropped and error is not null"),
            },
        )

    def summary(self) -> DataFrame:
        """One row: coordinate anomalies, image sizes, objects per image, object sizes."""
        range_ = self.invalid_lines().where("issue_type = 'polygon_coordinate_range'")
        lines = range_.agg(
            F.count_if(F.col("severity") == "soft").alias("soft_lines"), F.count_if(F.col("severity") == "hard").alias("hard_lines"), F.countDistinct("file_id").alias("affected_files"),
            F.min("min_coordinate").alias("minimum_coordinate"), F.max("max_coordinate").alias("maximum_coordinate"), F.coalesce(F.max("max_offset"), F.lit(0.0)).alias("maximum_offset"),
        )
        coordinates = self.coordinates().agg(
            F.count_if(F.col("direction") == "below").alias("below_zero"), F.count_if(F.col("direction") == "above").alias("above_one"), F.countDistinct(F.when(F.col("line_severity") == "hard", F.col("file_id"))).alias("hard_images"),
            F.countDistinct(F.when(F.col("line_severity") == "hard", F.col("class_id"))).alias("hard_classes"), F.max(F.when(F.col("line_severity") == "hard", F.col("amount"))).alias("hard_maximum_overflow"),
        )
        images = self.images()
        seen = [F.when((F.col("width") > 0) & (F.col("height") > 0), F.col(c)) for c in ("width", "height")]
        shapes = images.agg(
            F.count(seen[0]).alias("readable_images"), F.min(seen[0]).alias("minimum_width"), F.max(seen[0]).alias("maximum_width"), F.min(seen[1]).alias("minimum_height"), F.max(seen[1]).alias("maximum_height"),
            F.coalesce(F.avg("instances"), F.lit(0.0)).alias("mean_objects"), F.coalesce(F.max("instances"), F.lit(0)).alias("maximum_objects"), F.count_if(F.col("instances") == 0).alias("images_without_objects"),
        )
        middles = stats.exact_medians(images.select(seen[0].alias("median_width"), seen[1].alias("median_height"), F.col("instances").alias("median_objects")), [], ["median_width", "median_height", "median_objects"])
        sizes = self.objects().agg(*(F.count_if(F.col("size") == s).alias(f"{s}_objects") for s in ("small", "medium", "large")))
        out = lines
        for more in (coordinates, shapes, middles, sizes):
            out = out.join(F.broadcast(more), F.lit(True))  # one row each
        return out

    def samples(self) -> DataFrame:
        """The first bad lines, by split, file and line."""
        return self.invalid_lines().orderBy("split", "file_id", "line_no", "issue_type").limit(SAMPLES)

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "class_image_distribution": self.class_distribution(images=True), "class_instance_distribution": self.class_distribution(), "invalid_annotations": self.invalid_lines(), "out_of_bounds_coordinates": self.coordinates(),
            "hard_error_coordinates": self.coordinates("hard"), "hard_error_by_class": self.hard_error_by_class(), "image_statistics": self.images(), "object_statistics": self.objects(), "object_size_by_class": self.object_sizes(),
            "image_read_errors": self.read_errors(), "corrupted_images_by_filter": self.corrupted_images(), "split_statistics": self.split_statistics(),
        }

    def write(self, path: str, overwrite: bool = False) -> None:
        """Every table as a CSV folder and the summary as JSON below ``path``."""
        for name, table in self.tables.items():
            write_csv(table, f"{path}/{name}", table.columns, overwrite)
        write_json(self.summary(), f"{path}/summary", overwrite)

    def require_clean(self) -> None:
        """Raise if the facts hold a hard error, a missing or orphan label, or an image that can't be read: from the observed counts, without a job."""
        found = {k: v for k, v in self.observed.items() if v}
        if found:
            raise ValueError("the dataset is not clean: " + ", ".join(f"{k} {v}" for k, v in sorted(found.items())))


def analyze(images: DataFrame, labels: DataFrame, lines: DataFrame, classes: DataFrame, splits: list[str], decisions: DataFrame | None = None, corrupted: str = "corrupted_file") -> Analysis:
    """Parse once, store the facts, and give the tables."""
    spark = images.sparkSession
    if decisions is None:
        decisions = spark.createDataFrame([], "filename string, action string, issue string, reason string, status string")
    decided = decisions.select(F.lower("filename").alias("_name"), "action", "issue", "reason", F.col("status").alias("decision_status"))
    pictures = images.select("file_id", "split", F.lower("filename").alias("_name"), "width", "height", "error", F.lit(True).alias("image")).join(decided, "_name", "left").drop("_name")
    both = pictures.join(labels.select("file_id", "split", F.lit(True).alias("label")), ["file_id", "split"], "full_outer")
    state = decision_status(F.col("action"))
    known = both.withColumns({"image": _yes(F.col("image")), "label": _yes(F.col("label")), "dropped": _yes(F.col("action").isNotNull() & (state == "dropped")), "negative": _yes(F.col("action").isNotNull() & (state == "kept_negative"))})
    files = known.withColumn("paired", F.col("image") & ~F.col("dropped") & (F.col("label") | F.col("negative")))

    read = files.where("paired and label and not negative").select("file_id", "split", "width", "height", "error")
    parsed = C.parse_instances(lines.where(F.trim("raw") != "").select("file_id", "line_no", "raw"), [r[0] for r in classes.select("class_id").collect()], values="values")
    hard = Observation()
    facts = parsed.drop("raw").join(read, "file_id").observe(hard, F.count_if(F.col("hard_error").isNotNull()).alias("hard_lines"))
    facts = keep(facts, "line-facts")

    # Of the coordinates outside [0, 1] only their number is counted here; they are listed on demand.
    beyond = F.size(F.filter("values", lambda v: ~C.inside(v)))
    errors = F.col("soft_error").cast("int") + F.col("hard_error").isNotNull().cast("int")
    counts = facts.groupBy("file_id").agg(
        F.count("class_id").alias("instances"), F.count_if(F.col("geometry_status") == "valid").alias("valid"), F.count_if(F.col("geometry_status") == "soft_clipped").alias("soft_clipped"), F.sum(errors).alias("errors"),
        F.count("hard_error").alias("hard_errors"), F.sum(F.when(F.col("soft_error"), beyond).otherwise(0)).alias("soft_coordinates"), F.sum(F.when(F.col("hard_error") == "polygon_coordinate_range", beyond).otherwise(0)).alias("hard_coordinates"),
    )
    whole = files.join(counts, "file_id", "left").fillna(0, [c for c in counts.columns if c != "file_id"])
    gate = Observation()
    missing = F.col("image") & ~F.col("dropped") & ~F.col("label") & ~F.col("negative")
    whole = whole.observe(gate, F.count_if(missing).alias("missing_labels"), F.count_if(F.col("label") & ~F.col("image")).alias("orphan_labels"), F.count_if(F.col("image") & ~F.col("dropped") & F.col("error").isNotNull()).alias("read_errors"))
    return Analysis(keep(whole, "file-facts"), facts, classes, splits, {**hard.get, **gate.get}, corrupted)
