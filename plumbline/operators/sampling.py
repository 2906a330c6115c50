"""Seeded splits and samples. The order is that of ``md5(seed:key)``: the same rows for the same seed on any cluster and partitioning.

Exact places in that order are found in two steps, by bucket of the leading hash digits and then within the bucket, so no task sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.tables import keep


def seed_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


#: Rows of one bucket that are numbered in one window, about.
BUCKET_ROWS = 100_000


def bucket_digits(rows: int, most: int = BUCKET_ROWS) -> int:
    """Leading hex digits of a digest by which ``rows`` fall into buckets of ``most`` at most, about: digests are spread evenly, so equal steps are the borders that quantiles would give."""
    digits = 1
    while rows > most << 4 * digits:
        digits += 1
    return digits


def place_in_order(df: DataFrame, order: str, by: list[str] | None = None, digits: int | None = None, value: Column | None = None, out: str = "place") -> DataFrame:
    """Running count (or sum of ``value``) in the order of a column of hex digests, from 1: within the bucket of its first ``digits`` digits, plus all earlier buckets. Without ``digits`` they follow from the
    number of rows, so buckets stay bounded at any size. The table of bucket sums has 16 ** digits rows for each group at most."""
    by = by or []
    digits = digits or bucket_digits(df.count())
    value = F.lit(1) if value is None else value
    marked = df.withColumn("_bucket", F.substring(order, 1, digits)).withColumn("_value", value.cast("long"))
    sums = marked.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_n"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_inner", F.sum("_value").over(inner)).join(before, [*by, "_bucket"]).withColumn(out, F.col("_inner") + F.col("_before")).drop("_bucket", "_value", "_inner", "_before")


def place_by_range(df: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """``df`` with the place of each row in the order of any columns, from 1, nulls first: dealt by ranges whose borders Spark takes from sampled quantiles, numbered within them, and moved on by the counts of
    the ranges before. Rows that tie take places in any order. ``df`` is stored once, so that its rows keep their numbers."""
    dealt = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_row", 33))
    heads = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))  # one row a range
    before = heads.select("_part", "_first", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(before, "_part").withColumn(out, F.col("_row") - F.col("_first") + F.col("_before") + 1).drop("_part", "_row", "_first", "_before")


def ratio_split(df: DataFrame, key: str, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """``df`` with ``split``: floor(n * r) rows to train and val, the rest to test."""
    if min(ratios) < 0 or abs(sum(ratios) - 1.0) > 1e-8:
        raise ValueError("ratios must be non-negative and sum to 1")
    n = df.agg(F.count("*").alias("_n"))
    placed = place_in_order(df.withColumn("_order", seed_order(F.col(key), seed)), "_order").join(F.broadcast(n))  # one row
    train, val = F.floor(F.col("_n") * ratios[0]), F.floor(F.col("_n") * ratios[1])
    return placed.withColumn("split", F.when(F.col("place") <= train, "train").when(F.col("place") <= train + val, "val").otherwise("test")).drop("_order", "_n", "place")


def sample_per_split(df: DataFrame, key: str, counts: dict[str, int], seed: int) -> DataFrame:
    """The first ``counts[split]`` rows of each split in seed order."""
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv)), F.col("split"))
    placed = place_in_order(df.where(F.col("split").isin(*counts)).withColumn("_order", seed_order(F.col(key), seed)), "_order", ["split"])
    return placed.where(F.col("place") <= wanted).drop("_order", "place")


def first_n(df: DataFrame, group: list[str], order: list[str], n: int, salts: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group in the order of ``order``, nulls first; of rows that tie at the end, any. Two levels: rows are dealt by group and a salt, which keeps the first ``n`` of a
    share of the group, and only those meet as a group. So no task sees a group whole, however hot, and with small ``n`` Spark limits the shares before it shuffles them. ``salts``: the shuffle partitions."""
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    shares = df.withColumn("_salt", salt).withColumn("_place", place(*group, "_salt")).where(F.col("_place") <= n).drop("_salt", "_place")
    return shares.withColumn("_place", place(*group)).where(F.col("_place") <= n).drop("_place")


def first_per_split(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return first_n(df, ["split"], order, n)


def backfill_sample(df: DataFrame, key: str, valid: str, count: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The first ``count`` valid rows in seed order, and one row of counts: checked, rejected, selected. A row is checked while too few valid ones stand before it."""
    ordered = df.withColumn("_order", seed_order(F.col(key), seed))
    placed = place_in_order(ordered, "_order", value=F.col(valid).cast("int"), out="_valid")
    scanned = placed.where(F.col("_valid") - F.col(valid).cast("int") < count)
    report = scanned.agg(F.count("*").alias("checked"), F.count_if(~F.col(valid)).alias("rejected"), F.count_if(F.col(valid)).alias("selected"))
    return scanned.where(F.col(valid)).drop("_order", "_valid"), report


def balanced_sample(df: DataFrame, key: str, splits: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows dealt evenly: n // k to each split but the last, which takes the rest."""
    each = n // len(splits)
    return sample_per_split(df, key, {s: each if k + 1 < len(splits) else n - each * (len(splits) - 1) for k, s in enumerate(splits)}, seed)


def class_diverse(df: DataFrame, key: str, classes: str, count: int) -> DataFrame:
    """``count`` rows chosen greedily: each round takes the row with most classes not covered yet (ties to the smaller key) until none adds any, then the rest in key
    order. Rows with the same classes compete by key alone, so the rounds look at one row for each set of classes; at most as many rounds as there are classes."""
    kind = df.schema[classes].dataType
    sets = df.where(F.size(classes) > 0).groupBy(F.array_sort(F.array_distinct(classes)).alias("_set")).agg(F.min(key).alias("_key")).cache()
    chosen, covered = [], []
    while len(chosen) < count:
        gain = F.size(F.array_except("_set", F.array(*(F.lit(c) for c in covered)).cast(kind)))
        best = sets.select("_key", "_set", gain.alias("gain")).orderBy(F.desc("gain"), "_key").limit(1).collect()
        if not best or best[0]["gain"] <= 0:
            break
        chosen.append(best[0]["_key"])
        covered = sorted({*covered, *best[0]["_set"]})
    sets.unpersist()
    first = df.where(F.col(key).isin(*chosen)) if chosen else df.limit(0)
    rest = (df.where(~F.col(key).isin(*chosen)) if chosen else df).orderBy(key).limit(max(0, count - len(chosen)))
    return first.unionByName(rest)
