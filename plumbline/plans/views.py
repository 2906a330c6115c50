"""Reference-shaped inputs derived from the given tables, each as a DataFrame and as the SQL that DuckDB needs for the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import number, parse_instances, staged, tokens, validate_lines

CLASSES = 15
SPLITS = ["train", "val"]
# Coordinates of a label line: the faults that a row's part key gives it.
_FAULTS = {0: (61, "abc"), 1: (29, "1.005"), 2: (23, "1.2"), 3: (59, "-0.004")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is one file, which one task would read and work on alone, over all cores; other tables as they are."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, image_id, split, class_id, coords, width, height``: four points from the first eight components."""
    image = F.when(F.col("vec_id") % 3 == 2, F.col("vec_id") - 1).otherwise(F.col("vec_id"))
    return read(spark, sf_dir, "embeddings").select("vec_id", image.alias("image_id"), F.col("label").alias("class_id"), F.transform(F.slice("embedding", 1, 8), lambda x: F.lit(0.5) + F.lit(2.0) * x.cast("double")).alias("coords")).select(
        "vec_id", "image_id", F.when(F.col("image_id") % 10 == 0, "val").otherwise("train").alias("split"), "class_id", "coords",
        F.when(F.col("image_id") % 97 == 0, 0).otherwise(640 + 64 * (F.col("image_id") % 7)).cast("long").alias("width"),
        F.when(F.col("image_id") % 97 == 0, 0).otherwise(480 + 32 * (F.col("image_id") % 5)).cast("long").alias("height"),
    )


POLYGONS = """(SELECT vec_id, image_id, CASE WHEN image_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, class_id, coords,
  CASE WHEN image_id % 97 = 0 THEN 0 ELSE 640 + 64 * (image_id % 7) END::BIGINT AS width, CASE WHEN image_id % 97 = 0 THEN 0 ELSE 480 + 32 * (image_id % 5) END::BIGINT AS height
  FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 2 THEN vec_id - 1 ELSE vec_id END AS image_id, label AS class_id, list_transform(embedding[1:8], lambda x: 0.5::DOUBLE + 2.0::DOUBLE * x::DOUBLE) AS coords FROM embeddings))"""


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, split, line_no, raw``: lines of polygon label files with faults of every kind."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")

    def coordinate(i: int):
        plain = F.concat(F.lit("0."), F.lpad(((p * (i * i + 3) + s * (2 * i + 1) + n * 17) % 1000).cast("string"), 3, "0"))
        flat = F.concat(F.lit("0."), F.lpad(((p + i % 2) % 1000).cast("string"), 3, "0"))
        value = F.when(p % 67 == 0, flat).otherwise(plain)
        return F.when(p % _FAULTS[i][0] == 0, _FAULTS[i][1]).otherwise(value) if i in _FAULTS else value

    cls = F.when(p % 53 == 0, "x").when(p % 47 == 0, "2.5").when(p % 43 == 0, "99").otherwise((p % CLASSES).cast("string"))
    count = F.when(p % 41 == 0, 4).when(p % 37 == 0, 7).otherwise(8)
    raw = F.when(p % 71 == 0, "").otherwise(F.concat_ws(" ", cls, F.array_join(F.slice(F.array(*(coordinate(i) for i in range(8))), F.lit(1), count), " ")))
    rows = staged(spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), raw=raw)  # made once, as if it were read
    return rows.select(F.col("l_orderkey").alias("file_id"), F.when(F.col("l_orderkey") % 10 == 0, "val").otherwise("train").alias("split"), n.alias("line_no"), "raw")


def _coordinate_sql(i: int) -> str:
    plain = f"CASE WHEN l_partkey % 67 = 0 THEN '0.' || lpad(((l_partkey + {i % 2}) % 1000)::VARCHAR, 3, '0') ELSE '0.' || lpad(((l_partkey * {i * i + 3} + l_suppkey * {2 * i + 1} + l_linenumber * 17) % 1000)::VARCHAR, 3, '0') END"
    return f"CASE WHEN l_partkey % {_FAULTS[i][0]} = 0 THEN '{_FAULTS[i][1]}' ELSE {plain} END" if i in _FAULTS else plain


LINES = f"""(SELECT l_orderkey AS file_id, CASE WHEN l_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, l_linenumber AS line_no,
  CASE WHEN l_partkey % 71 = 0 THEN '' ELSE CASE WHEN l_partkey % 53 = 0 THEN 'x' WHEN l_partkey % 47 = 0 THEN '2.5' WHEN l_partkey % 43 = 0 THEN '99' ELSE (l_partkey % {CLASSES})::VARCHAR END || ' ' ||
  array_to_string(([{", ".join(_coordinate_sql(i) for i in range(8))}])[1:CASE WHEN l_partkey % 41 = 0 THEN 4 WHEN l_partkey % 37 = 0 THEN 7 ELSE 8 END], ' ') END AS raw FROM lineitem)"""

#: Lines with their tokens, class value, coordinates and points.
PARSED = f"""(SELECT *, list_transform(range(0, len(coords) // 2), lambda i: {{'x': coords[2 * i + 1], 'y': coords[2 * i + 2]}}) AS pts,
  list_transform(coords, lambda v: least(1.0::DOUBLE, greatest(0.0::DOUBLE, v))) AS used
  FROM (SELECT *, tok[1] AS head, try_cast(tok[1] AS DOUBLE) AS cls, tok[2:] AS rest, list_transform(tok[2:], lambda t: try_cast(t AS DOUBLE)) AS coords
  FROM (SELECT *, CASE WHEN raw = '' THEN []::VARCHAR[] ELSE string_split(raw, ' ') END AS tok FROM {LINES})))"""
_OK_CLASS = "(cls IS NOT NULL AND cls = floor(cls) AND cls >= 0)"
_DISTINCT = "len(list_distinct(list_transform(range(0, len({c}) // 2), lambda i: {{'x': {c}[2 * i + 1], 'y': {c}[2 * i + 2]}})))"


def distinct_sql(c: str) -> str:
    return _DISTINCT.format(c=c)


def signed_sql(c: str) -> str:
    n = f"(len({c}) // 2)"
    return f"(coalesce(list_sum(list_transform(range(0, {n}), lambda i: {c}[2 * i + 1] * {c}[2 * ((i + 1) % {n}) + 2] - {c}[2 * ((i + 1) % {n}) + 1] * {c}[2 * i + 2])), 0.0::DOUBLE) / 2.0::DOUBLE)"


#: Strict and repairing validation of each line.
_RANGE = "len(list_filter(pts, lambda q: NOT (q.x BETWEEN {lo} AND {hi} AND q.y BETWEEN {lo} AND {hi})))"
_HARD, _SOFT = _RANGE.format(lo="-0.01::DOUBLE", hi="1.01::DOUBLE"), _RANGE.format(lo="0.0::DOUBLE", hi="1.0::DOUBLE")
_HEAD = f"CASE WHEN len(tok) = 0 THEN 'polygon_format' WHEN NOT {_OK_CLASS} OR cls >= {CLASSES} THEN 'class_id' WHEN len(list_filter(coords, lambda v: v IS NULL)) > 0 THEN 'polygon_non_numeric' WHEN len(rest) = 4 THEN 'bbox_format' WHEN len(rest) % 2 = 1 OR len(rest) < 6 THEN 'polygon_coordinate_count' WHEN {_HARD} > 0 THEN 'polygon_coordinate_range'"
VALIDATED = f"""(SELECT *, {_HEAD} WHEN {_SOFT} > 0 THEN 'polygon_coordinate_range' WHEN {distinct_sql('coords')} < 3 THEN 'polygon_geometry' END AS strict_error,
  {_HEAD} WHEN {_SOFT} > 0 AND {distinct_sql('used')} < 3 THEN 'polygon_geometry' WHEN {_SOFT} = 0 AND {distinct_sql('coords')} < 3 THEN 'polygon_geometry' END AS error_type,
  {_HARD} AS hard_points, {_SOFT} AS soft_points FROM {PARSED})"""


def validated(spark: SparkSession, sf_dir: str, mode: str = "auto-fix") -> DataFrame:
    """Lines with the results of validation."""
    return validate_lines(label_lines(spark, sf_dir), CLASSES, mode)


def instances(spark: SparkSession, sf_dir: str, mask: str | None = None) -> DataFrame:
    return parse_instances(label_lines(spark, sf_dir).where("raw <> ''"), list(range(CLASSES)), mask=mask)


_ALL_SOFT = "len(list_filter(coords, lambda v: NOT v BETWEEN -0.01::DOUBLE AND 1.01::DOUBLE)) = 0"
_OUTSIDE = "len(list_filter(coords, lambda v: NOT v BETWEEN 0.0::DOUBLE AND 1.0::DOUBLE)) > 0"
#: Statistics parse: class, status, hard error, and whether there is a soft one.
INSTANCES = f"""(SELECT file_id, split, line_no, raw, coords, rest, used, CASE WHEN NOT known THEN NULL ELSE cls::INTEGER END AS class_id, hard, CASE WHEN hard IS NULL OR hard = 'polygon_geometry' THEN outside ELSE FALSE END AS soft,
  CASE WHEN hard IS NULL THEN CASE WHEN outside THEN 'soft_clipped' ELSE 'valid' END END AS geometry_status
  FROM (SELECT *, CASE WHEN NOT known THEN 'class_id' WHEN len(tok) < 7 OR len(rest) % 2 = 1 THEN 'polygon_coordinate_count' WHEN len(list_filter(coords, lambda v: v IS NULL)) > 0 THEN 'polygon_coordinate_value'
  WHEN outside AND NOT {_ALL_SOFT} THEN 'polygon_coordinate_range' WHEN {distinct_sql('used')} < 3 OR abs({signed_sql('used')}) <= 0 THEN 'polygon_geometry' END AS hard
  FROM (SELECT *, {_OK_CLASS} AND cls < {CLASSES} AS known, {_OUTSIDE} AS outside FROM {PARSED} WHERE raw <> '')))"""


def issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose coordinates are all numbers, in pairs, of a known class."""
    step = staged(label_lines(spark, sf_dir).where("raw <> ''"), t=tokens(F.col("raw")))
    lines = staged(step, class_id=F.get("t", F.lit(0)).try_cast("int"), coords=F.transform(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), number)).drop("t")
    return lines.where(F.col("class_id").between(0, CLASSES - 1) & (F.size("coords") >= 6) & (F.size("coords") % 2 == 0) & ~F.exists("coords", lambda v: v.isNull()))


#: One row for each coordinate outside [0, 1].
ISSUES = """(SELECT file_id, split, line_no, class_id, (i // 2 + 1)::INTEGER AS point_index, CASE WHEN i % 2 = 0 THEN 'x' ELSE 'y' END AS axis, 'point_' || (i // 2 + 1)::VARCHAR || '_' || CASE WHEN i % 2 = 0 THEN 'x' ELSE 'y' END AS position,
  v AS value, CASE WHEN v < 0 THEN 0 ELSE 1 END AS boundary, CASE WHEN v < 0 THEN 'below' ELSE 'above' END AS direction, greatest(-v, v - 1.0::DOUBLE, 0.0::DOUBLE) AS amount,
  CASE WHEN v BETWEEN -0.01::DOUBLE AND 1.01::DOUBLE THEN 'soft' ELSE 'hard' END AS coordinate_severity, CASE WHEN line_soft THEN 'soft' ELSE 'hard' END AS line_severity,
  CASE WHEN line_soft THEN CASE WHEN v < 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS reset_value, CASE WHEN line_soft THEN 'clip' ELSE 'review' END AS action
  FROM (SELECT *, cls::INTEGER AS class_id, unnest(coords) AS v, unnest(range(0, len(coords))) AS i, """ + _ALL_SOFT + f""" AS line_soft FROM {PARSED}
  WHERE raw <> '' AND {_OK_CLASS} AND cls < {CLASSES} AND len(coords) >= 6 AND len(coords) % 2 = 0 AND len(list_filter(coords, lambda v: v IS NULL)) = 0) WHERE NOT v BETWEEN 0.0::DOUBLE AND 1.0::DOUBLE)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``doc_id, split, path, filename``."""
    folder = F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train")
    name = F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".JPG").otherwise(".png"))
    return read(spark, sf_dir, "documents").withColumn("split", folder).withColumn("filename", name).withColumn("path", F.concat(F.col("split"), F.lit("/"), name))


DOCUMENTS = """(SELECT *, split || '/' || filename AS path FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, 'Doc_' || doc_id::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN '.JPG' ELSE '.png' END AS filename FROM documents))"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision list over the documents' file names, in other case, and some that match nothing or break a rule."""
    docs = read(spark, sf_dir, "documents").select("doc_id").where("doc_id % 37 = 0 or doc_id % 41 = 0 or doc_id % 43 = 0")
    action = F.when(F.col("doc_id") % 37 == 0, "exclude").when(F.col("doc_id") % 41 == 0, "review").otherwise("keep_negative")
    name = F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("gone_")).otherwise(F.lit("doc_")), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".jpg").otherwise(".PNG"))
    return docs.select(name.alias("filename"), F.when(F.col("doc_id") % 11 == 0, "discard").otherwise(action).alias("action"), F.when(F.col("doc_id") % 7 != 0, "missing_label").alias("issue"), F.when(F.col("doc_id") % 13 == 0, "").otherwise("seen").alias("reason"), F.lit("confirmed").alias("status"))


DECISIONS = """(SELECT CASE WHEN doc_id % 5 = 0 THEN 'gone_' ELSE 'doc_' END || doc_id::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN '.jpg' ELSE '.PNG' END AS filename,
  CASE WHEN doc_id % 11 = 0 THEN 'discard' WHEN doc_id % 37 = 0 THEN 'exclude' WHEN doc_id % 41 = 0 THEN 'review' ELSE 'keep_negative' END AS action,
  CASE WHEN doc_id % 7 <> 0 THEN 'missing_label' END AS issue, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'seen' END AS reason, 'confirmed' AS status
  FROM documents WHERE doc_id % 37 = 0 OR doc_id % 41 = 0 OR doc_id % 43 = 0)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, split, filename, action, status``: the label files, one for each order, with the decisions on their names."""
    from plumbline.operators.pairing import apply_decisions

    k = F.col("o_orderkey")
    name = F.concat(F.lit("Doc_"), k.cast("string"), F.when(k % 3 == 0, ".JPG").otherwise(".png"))
    rows = read(spark, sf_dir, "orders").select(k.alias("file_id"), F.when(k % 10 == 0, "val").otherwise("train").alias("split"), name.alias("filename"))
    return apply_decisions(rows, decisions(spark, sf_dir), "filename")


FILES = f"""(SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN action IN ('exclude', 'review') THEN 'dropped' WHEN action = 'keep_negative' THEN 'kept_negative' ELSE 'kept' END AS status
  FROM orders LEFT JOIN {DECISIONS} k ON lower(k.filename) = 'doc_' || o_orderkey::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN '.jpg' ELSE '.png' END)"""


def analysis(spark: SparkSession, sf_dir: str):
    """The label files as a whole set: every sixth file has no image, every fifth no label, and some images can't be read."""
    from plumbline.operators.analysis import analyze

    k = F.col("file_id")
    named = F.concat(F.lit("Doc_"), k.cast("string"), F.when(k % 3 == 0, ".JPG").otherwise(".png"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderkey") % 10 == 0, "val").otherwise("train").alias("split"))
    broken = k % 97 == 0
    images = orders.where("file_id % 6 <> 1").select("file_id", "split", named.alias("filename"), F.when(broken, 0).otherwise(640 + 64 * (k % 7)).alias("width"), F.when(broken, 0).otherwise(480 + 32 * (k % 5)).alias("height"), F.when(broken, "unreadable").alias("error"))
    classes = spark.range(CLASSES).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("group"), (F.col("id") % 3).cast("string"), F.lit("--class"), F.col("id").cast("string")).alias("name"))
    return analyze(images, orders.where("file_id % 5 <> 2"), label_lines(spark, sf_dir), classes, SPLITS, decisions(spark, sf_dir), corrupted="missing_label")


#: Files of that set: whether there is an image (i) and a label (l), and what decisions make of them.
ANALYZED = f"""(SELECT *, i AND NOT dropped AND (l OR negative) AS paired FROM (SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, o_orderkey % 6 <> 1 AS i, o_orderkey % 5 <> 2 AS l, action, issue, reason, k.status AS decision_status,
  coalesce(action IN ('exclude', 'review'), FALSE) AS dropped, coalesce(action = 'keep_negative', FALSE) AS negative, CASE WHEN o_orderkey % 6 = 1 THEN NULL WHEN o_orderkey % 97 = 0 THEN 0 ELSE 640 + 64 * (o_orderkey % 7) END::BIGINT AS width,
  CASE WHEN o_orderkey % 6 = 1 THEN NULL WHEN o_orderkey % 97 = 0 THEN 0 ELSE 480 + 32 * (o_orderkey % 5) END::BIGINT AS height, CASE WHEN o_orderkey % 6 <> 1 AND o_orderkey % 97 = 0 THEN 'unreadable' END AS error
  FROM orders LEFT JOIN {DECISIONS} k ON o_orderkey % 6 <> 1 AND lower(k.filename) = 'doc_' || o_orderkey::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN '.jpg' ELSE '.png' END WHERE o_orderkey % 6 <> 1 OR o_orderkey % 5 <> 2))"""
#: Their lines, parsed.
ANALYZED_LINES = f"(SELECT n.*, a.width, a.height, a.error FROM {INSTANCES} n JOIN (SELECT * FROM {ANALYZED} WHERE paired AND l AND NOT negative) a USING (file_id))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, split, capture_key, frame``: events numbered within their user."""
    from pyspark.sql import Window

    number_ = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("capture_key"), number_.alias("frame"))


FRAMES = "(SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, 'u' || user_id::VARCHAR AS capture_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events)"

#: A coarse 8 x 9 grid of a text: counts of letters and letter pairs.
GRID = ["e", "n", "t", "a", "o", "r", "i", "s", "h", "d", "l", "u", "g", "c", "m", "w", "b", "f", "p", "v", "k", "th", "he", "an", "in", "er", "on", "re", "nd", "ed", "ou", "es", "en", "st", "nt", "at", "is", "or", "ti", "le", "ng", "al", "se", "de", "la", "te", "ch", "ie", "sh", "ea", "ble", "ion", "ent", "ing", "wh", "ra", "ci", "ll", "au", "eu", "ei", "be", "ge", "un", "ne", "ll", "ai", "oi", "qu", "ue", "as", "os"]


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, split, hash``: difference hashes of the documents' grids. Letters are counted on Arrow batches, once over a text for the whole grid; 72 string expressions would read it 72 times."""
    from plumbline.functions.grams import difference_hashes, gram_counts
    from plumbline.sources.tables import bound_batches

    grid = list(GRID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(difference_hashes(gram_counts(batch.column(2), grid)))], names=["id", "split", "hash"])

    bound_batches(spark, 16 << 20)
    rows = spread(read(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"), "text")
    return rows.mapInArrow(run, "id long, split string, hash long")


def _cell_sql(g: str) -> str:
    return f"((length(text) - length(replace(text, '{g}', ''))) // {len(g)})"


def _bit_sql(k: int) -> str:
    r, c = divmod(k, 8)
    one = f"CASE WHEN g[{r * 9 + c + 1}] > g[{r * 9 + c + 2}] THEN 1 ELSE 0 END"
    return f"({one})::BIGINT * {1 << (63 - k)}::BIGINT" if k else f"CASE WHEN g[1] > g[2] THEN -9223372036854775808 ELSE 0 END::BIGINT"


PRINTS = f"(SELECT id, split, {' + '.join(_bit_sql(k) for k in range(64))} AS hash FROM (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, [{', '.join(_cell_sql(g) for g in GRID)}] AS g FROM documents))"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, class_id``: nations by region, with one nation in two regions and one in none."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = n.where("n_nationkey <> 7").select(F.col("r_name").alias("key"), F.col("n_nationkey").alias("class_id"))
    return base.unionByName(n.where("n_nationkey = 3").select(F.lit("EXTRA").alias("key"), F.col("n_nationkey").alias("class_id"))).unionByName(n.where("n_nationkey = 4").select(F.lit("EXTRA").alias("key"), (F.col("n_nationkey") + 95).cast("int").alias("class_id")))


HIERARCHY = """(SELECT r_name AS key, n_nationkey AS class_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7
  UNION ALL SELECT 'EXTRA', n_nationkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'EXTRA', n_nationkey + 95 FROM nation WHERE n_nationkey = 4)"""


def truth_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events")
    truth = e.where("event_id % 2 = 0 and event_id % 3 <> 0").select(F.col("user_id").alias("image"), F.col("event_type").alias("class_name")).distinct()
    found = e.where("event_id % 2 = 1 and value > 50").select(F.col("user_id").alias("image"), F.col("event_type").alias("class_name"), (F.col("value") / 1009).alias("confidence"))
    return truth, found
