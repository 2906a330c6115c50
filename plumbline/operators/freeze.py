"""Reviewed repairs, review cases and the frozen dataset's manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import clamp01, number, tokens, validate_lines, within_tolerance
from plumbline.operators.dedup import dataset_digest, digest_tree, tree_root
from plumbline.operators.sampling import place_by_range


def repair_log(lines: DataFrame, issues: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, violations): each coordinate outside [0, 1] with its value before and after. A hard one is repaired only where its line's review says ``repair_confirmed``, else it is a violation.
    ``issues``: coordinate issues with ``file_id, line_no``; ``reviews``: ``file_id, line_no, review_decision``."""
    joined = issues.join(reviews.select("file_id", "line_no", "review_decision"), ["file_id", "line_no"], "left")
    allowed = (F.col("coordinate_severity") == "soft") | (F.coalesce("review_decision", F.lit("")) == "repair_confirmed")
    log = joined.where(allowed).select("file_id", "line_no", "position", F.col("value").alias("before"), clamp01(F.col("value")).alias("after"), "coordinate_severity", "review_decision")
    return log, joined.where(~allowed).select("file_id", "line_no", "position", "value", "review_decision")


def repaired_text(raw):
    """A repaired line: its coordinates at 0 or 1 after clamping are printed as 0 and 1, the others stay as written."""
    t = tokens(raw)
    rest = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    return F.concat_ws(" ", F.get(t, F.lit(0)), F.array_join(F.transform(rest, lambda s: F.when(clamp01(number(s)) == 0, "0").when(clamp01(number(s)) == 1, "1").otherwise(s)), " "))


def regroup(lines: DataFrame, keys: list[str], order: str = "line_no", text: str = "raw") -> DataFrame:
    """One text for each file, its lines in order. A file is one label's lines, never many."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n").alias("text"), F.count("*").alias("lines"))


def review_cases(issues: DataFrame, exceptions: DataFrame, default: str) -> DataFrame:
    """Hard lines as numbered cases in (split, file, line as text) order, with their coordinates in one text and a decision: the case's exception, else ``default``. Places are found by ranges
    (``sampling.place_by_range``), so no single task sees all cases."""
    hard = issues.where("coordinate_severity = 'hard'")
    cases = hard.groupBy("split", "file_id", "line_no").agg(
        F.count("*").alias("hard_coordinate_count"), F.max("amount").alias("max_overflow"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("point_index", "axis", "position"))), lambda x: x["position"]), ";").alias("positions"),
    )
    keyed = cases.withColumn("_file", F.col("file_id").cast("string")).withColumn("_line", F.col("line_no").cast("string"))
    numbered = place_by_range(keyed, ["split", "_file", "_line"], "case_id")
    decided = numbered.join(exceptions.select("case_id", F.col("review_decision").alias("_own")), "case_id", "left").withColumn("review_decision", F.coalesce("_own", F.lit(default)))
    return decided.select("case_id", "split", "file_id", "line_no", "hard_coordinate_count", "max_overflow", "positions", "review_decision")


def review_pages(cases: DataFrame, per_sheet: int = 12, columns: int = 3) -> DataFrame:
    """Sheet, row and column of each case, from 1."""
    k = F.col("case_id") - 1
    place = k % per_sheet
    return cases.withColumn("sheet", F.floor(k / per_sheet) + 1).withColumn("sheet_row", F.floor(place / columns) + 1).withColumn("sheet_column", place % columns + 1)


def review_tally(cases: DataFrame) -> DataFrame:
    return cases.groupBy("review_decision").agg(F.count("*").alias("n"))


def frozen_lines(lines: DataFrame, files: DataFrame, reviews: DataFrame, num_classes: int) -> DataFrame:
    """``file_id, line_no, text, repaired, violation``: the lines of the files that decisions keep, soft ones repaired, hard ones only where their review says
    ``repair_confirmed`` (all reviews of the line, if it has several). ``violation`` is null for a line that may be frozen, else ``unconfirmed_hard_range`` or the first
    fault: repaired lines are validated again, strictly; the others were strictly right before.

    ``lines``: ``file_id, line_no, raw``, no blank ones; ``files``: ``file_id, status``; ``reviews``: ``file_id, line_no, review_decision``. A null or empty
    line has the fault polygon_format; lines of unknown or null files are left out, as are other columns."""
    kept = files.where("status = 'kept'").select("file_id")
    own = lines.select("file_id", "line_no", "raw", F.coalesce("raw", F.lit("")).alias("line")).join(kept, "file_id", "left_semi")
    confirmed = reviews.groupBy("file_id", "line_no").agg(F.min(F.coalesce(F.col("review_decision") == "repair_confirmed", F.lit(False))).alias("confirmed"))
    first = validate_lines(own, num_classes, "auto-fix", raw="line").select("file_id", "line_no", "raw", F.col("error_type").alias("fault"), F.col("fixed_line").isNotNull().alias("soft"))
    hard = F.coalesce(F.col("fault") == "polygon_coordinate_range", F.lit(False))
    judged = first.join(confirmed, ["file_id", "line_no"], "left").withColumn("repaired", F.col("soft") | (hard & F.coalesce("confirmed", F.lit(False))))
    again = validate_lines(judged.withColumn("fixed", F.when(F.col("repaired"), repaired_text(F.col("raw")))), num_classes, "strict", raw="fixed")
    violation = F.when(F.col("repaired"), F.col("error_type")).otherwise(F.when(hard, "unconfirmed_hard_range").otherwise(F.col("fault")))
    return again.select("file_id", "line_no", F.coalesce("fixed", "raw").alias("text"), "repaired", violation.alias("violation"))


def frozen_files(files: DataFrame, frozen: DataFrame) -> DataFrame:
    """``file_id, split, text, lines, repaired, violations, sha256`` of every file that decisions keep; negatives and files without lines have an empty text. Lines with a
    violation are in no text: a set is frozen where all ``violations`` are 0 (``pairing.require_none``). ``frozen``: of ``frozen_lines``."""
    good = regroup(frozen.where("violation is null"), ["file_id"], text="text")
    counts = frozen.groupBy("file_id").agg(F.count_if("repaired").alias("repaired"), F.count("violation").alias("violations"))
    out = files.where("status in ('kept', 'kept_negative')").select("file_id", "split").join(counts, "file_id", "left").join(good, "file_id", "left")
    text = F.coalesce("text", F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("file_id", "split", text.alias("text"), zero("lines"), zero("repaired"), zero("violations"), F.sha2(text, 256).alias("sha256"))


def manifest(files: DataFrame, instances: DataFrame, path: str = "file_id", sha256: str = "sha256", tree: DataFrame | None = None, stream: bool = False) -> DataFrame:
    """One row: digest of all label files, their number, and instances in all and by class. The digest is the root of ``tree`` (``dedup.digest_tree``, made here unless one that is
    stored is given); with ``stream`` it is that of all files in one sequence, for sets that were frozen so, which one task has to hash."""
    digest = dataset_digest(files, path, sha256) if stream else tree_root(tree if tree is not None else digest_tree(files, path, sha256))
    by_class = instances.groupBy("class_id").agg(F.count("*").alias("n"))
    counts = by_class.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("instances"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("class_id").cast("string"), "n")))).alias("class_counts"))
    return digest.join(F.broadcast(counts))  # one row each


def unexpected_totals(made: DataFrame, expected: dict[str, int], classes: dict[int, int] | None = None) -> DataFrame:
    """``total, expected, found`` of each number of a manifest that is not as expected: ``files``, ``instances``, and with ``classes`` the instances of each class (``class_<id>``; a class that is
    not there has 0). A set is frozen where it is empty (``pairing.require_none``)."""
    own = [(k, F.lit(v).cast("long"), F.col(k).cast("long")) for k, v in expected.items()]
    own += [(f"class_{k}", F.lit(v).cast("long"), F.coalesce(F.try_element_at("class_counts", F.lit(str(k))), F.lit(0)).cast("long")) for k, v in (classes or {}).items()]
    rows = made.select(F.inline(F.array(*(F.struct(F.lit(k).alias("total"), e.alias("expected"), f.alias("found")) for k, e, f in own))))
    if classes is not None:
        others = made.select(F.explode("class_counts").alias("c", "found")).where(~F.col("c").isin(*map(str, classes)))
        rows = rows.unionByName(others.select(F.concat(F.lit("class_"), "c").alias("total"), F.lit(0).cast("long").alias("expected"), "found"))
    return rows.where("expected <> found")


def repair_gate(lines: DataFrame, num_classes: int, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(lines, faults) of a set that was written anew: soft errors are repaired (``text, fixed_points``), then every line is validated strictly as it now stands, and what is still at fault, or could not be
    repaired, is a fault with its ``error_type``. Hard errors are never repaired here. ``require_clean`` raises on faults."""
    first = validate_lines(lines, num_classes, "auto-fix", raw=raw)
    own = [c for c in lines.columns]
    fixed = first.select(*own, F.coalesce("fixed_line", raw).alias("text"), F.coalesce("fixed_points", F.lit(0)).alias("_points"), F.col("error_type").alias("_first"))
    again = validate_lines(fixed, num_classes, "strict", raw="text").withColumn("error_type", F.coalesce("_first", "error_type"))
    return again.where("error_type is null").select(*own, "text", F.col("_points").alias("fixed_points")), again.where("error_type is not null").select(*own, "text", "error_type")


def require_clean(faults: DataFrame, key: str = "file_id") -> None:
    """Raise with the number of files at fault, unless there is none."""
    n = faults.agg(F.countDistinct(key)).first()[0]
    if n:
        raise ValueError(f"{n} label files hold hard or invalid lines: confirm and repair them, or exclude them by a decision")


def gate(lines: DataFrame, missing: DataFrame, orphan: DataFrame) -> DataFrame:
    """One row by split: missing, orphan and faulty lines, and whether the split passes. ``lines``: ``split, error_type``."""
    parts = [lines.where("error_type is not null").select("split", F.lit("faults").alias("kind")), missing.select("split", F.lit("missing").alias("kind")), orphan.select("split", F.lit("orphan").alias("kind"))]
    counted = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").pivot("kind", ["faults", "missing", "orphan"]).agg(F.count(F.lit(1)))
    out = lines.select("split").distinct().join(counted, "split", "left").fillna(0)
    return out.withColumn("passed", F.col("faults") + F.col("missing") + F.col("orphan") == 0)


def soft_only(coords):
    return F.forall(coords, within_tolerance)
