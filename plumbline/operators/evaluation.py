"""Predictions, failure cases, and run metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import class_label


def predict(samples: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, names: DataFrame, confidence: float = 0.25, sample: str = "image") -> DataFrame:
    """Nested predictions of each sample. ``factory`` makes the user's predict function once a task; it gives rows of ``sample, class_id, confidence, x1, y1, x2, y2`` (``schema``).
    Confidences under the threshold go, the rest is rounded and gathered, best first. Samples without predictions keep a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield model(batch)

    found = samples.mapInPandas(run, schema).where(F.col("confidence") >= confidence).join(names, "class_id", "left")
    box = F.array(*(F.bround(c, 2) for c in ("x1", "y1", "x2", "y2")))
    rows = found.select(sample, F.struct((-F.bround("confidence", 4)).alias("order"), F.col("class_id"), class_label(F.col("class_name"), F.col("class_id")).alias("class_name"), F.bround("confidence", 4).alias("confidence"), box.alias("bbox")).alias("p"))
    nested = rows.groupBy(sample).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.dropFields("order")).alias("predictions"), F.array_sort(F.collect_set("p.class_id")).alias("predicted_classes"))
    empty = F.from_json(F.lit("[]"), "array<struct<class_id:int,class_name:string,confidence:double,bbox:array<double>>>")
    joined = samples.select(sample).distinct().join(nested, sample, "left")
    return joined.withColumn("predictions", F.coalesce("predictions", empty)).withColumn("predicted_classes", F.coalesce("predicted_classes", F.from_json(F.lit("[]"), "array<int>")))


def failure_cases(truth: DataFrame, predictions: DataFrame, keys: list[str], class_col: str = "class_id", error_only: bool = False) -> DataFrame:
    """One row for each class of truth or prediction of a sample: matched, false_negative or false_positive, and the greatest confidence (not on false negatives)."""
    p = predictions.groupBy(*keys, class_col).agg(F.bround(F.max("confidence"), 4).alias("confidence"))
    t = truth.select(*keys, class_col).distinct().withColumn("_true", F.lit(True))
    both = t.join(p.withColumn("_found", F.lit(True)), [*keys, class_col], "full_outer")
    kind = F.when(F.col("_true").isNull(), "false_positive").when(F.col("_found").isNull(), "false_negative").otherwise("matched")
    out = both.select(*keys, class_col, kind.alias("case_type"), "confidence")
    return out.where("case_type <> 'matched'") if error_only else out


def metric_summary(metrics: DataFrame, aliases: dict[str, list[str]], name: str = "experiment", model: str = "model", status: str = "status") -> DataFrame:
    """Finished runs with each metric from the first of its columns that has a value, under the run's label."""
    ok = metrics.where(F.coalesce(status, F.lit("ok")) == "ok") if status in metrics.columns else metrics
    present = {k: [c for c in v if c in metrics.columns] for k, v in aliases.items()}
    return ok.select(run_label(F.col(name), F.col(model)).alias("run"), *((F.coalesce(*v) if v else F.lit(None).cast("double")).alias(k) for k, v in present.items()))


def run_label(name: Column, model: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(model, F.lit("")), F.lit("unknown"))


def loss_curves(epochs: DataFrame, run: str, order: str) -> DataFrame:
    """``run, epoch, train_loss, val_loss`` from wide epoch rows: the sum of all columns named train/*loss* and val/*loss*; epochs count from 1."""
    from pyspark.sql import Window

    def total(prefix: str) -> Column:
        found = [F.col(f"`{c}`") for c in epochs.columns if c.startswith(prefix) and "loss" in c]
        return sum(found[1:], found[0]) if found else F.lit(None).cast("double")

    return epochs.select(run, F.row_number().over(Window.partitionBy(run).orderBy(order)).alias("epoch"), total("train/").alias("train_loss"), total("val/").alias("val_loss"))


def long_curve(curves: DataFrame, run: str, column: str) -> DataFrame:
    """An array of numbers as rows; epochs count from 1."""
    return curves.select(run, F.posexplode(column).alias("_at", "value")).select(run, (F.col("_at") + 1).alias("epoch"), "value")


def overlay(base: DataFrame, over: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values of ``over`` where it has any, else those of ``base``."""
    joined = base.alias("b").join(over.alias("o"), keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}")).alias(c) for c in columns))


def map_sum(runs: DataFrame, column: str) -> DataFrame:
    return runs.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def hetero_union(tables: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns, under the sorted union of their names."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def set_outcome(truth: Column, found: Column) -> Column:
    """Matched, missed and surplus classes of two class arrays."""
    return F.struct(F.array_sort(F.array_intersect(truth, found)).alias("matched"), F.array_sort(F.array_except(truth, found)).alias("missed"), F.array_sort(F.array_except(found, truth)).alias("surplus"))
