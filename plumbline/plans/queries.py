"""Every operator of the quality engine as a query on the given tables, with the SQL that it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import dedup, evaluation, freeze, leakage, obb, pairing, sampling, stats
from plumbline.operators.hash_index import HashIndex
from plumbline.plans import views as V
from plumbline.sources.tables import keep, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def names(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("class_id"))


# --- sources and keys -------------------------------------------------------------------------------------------------


@query(f"SELECT path, n_chars FROM {V.DOCUMENTS} WHERE filename ILIKE '%.jpg'")
def scan_documents(spark, d):
    return V.documents(spark, d).where(F.lower("filename").endswith(".jpg")).select("path", "n_chars")


@query("SELECT page_id, url, first_page FROM (SELECT page_id, url, first_value(page_id) OVER w AS first_page, row_number() OVER w AS r FROM (SELECT *, lower(regexp_replace(url, '^[a-z]+://([^/]+)/.*$', '\\1')) AS host FROM pages) WINDOW w AS (PARTITION BY host ORDER BY page_id)) WHERE r > 1")
def duplicate_keys(spark, d):
    pages = V.read(spark, d, "pages").withColumn("host", F.lower(F.regexp_replace("url", "^[a-z]+://([^/]+)/.*$", "$1")))
    return pairing.duplicate_keys(pages, ["host"], ["page_id"]).select("page_id", "url", F.col("first_path").alias("first_page"))


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(url, '^[a-z]+://([^/]+)/.*$', '\\1')) ORDER BY page_id DESC) AS r FROM pages) WHERE r = 1")
def keep_last(spark, d):
    pages = V.read(spark, d, "pages").withColumn("host", F.lower(F.regexp_replace("url", "^[a-z]+://([^/]+)/.*$", "$1")))
    return pairing.keep_last(pages, ["host"], ["page_id"]).select("page_id", "url")


@query("SELECT count(*) AS n, min(label) AS low, max(label) AS high, count(DISTINCT label) AS distinct_ids, min(label) = 0 AND max(label) + 1 = count(*) AND count(DISTINCT label) = count(*) AS contiguous FROM (SELECT DISTINCT label FROM embeddings WHERE label <> 5)")
def dim_contiguity(spark, d):
    return pairing.contiguity(V.read(spark, d, "embeddings").select("label").where("label <> 5").distinct(), "label")


@query("SELECT DISTINCT source AS split FROM documents INTERSECT SELECT DISTINCT source AS split FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def split_intersect(spark, d):
    docs = V.read(spark, d, "documents").select("doc_id", F.col("source").alias("split"))
    return pairing.shared_splits(docs, docs.join(V.read(spark, d, "labels").where("toxic = 1"), "doc_id"))


@query(f"SELECT file_id, string_agg(raw, chr(10) ORDER BY line_no, raw) AS text, count(*) AS lines FROM {V.LINES} GROUP BY file_id")
def regroup_lines(spark, d):
    return freeze.regroup(V.label_lines(spark, d), ["file_id"])


@query(f"SELECT vec_id, image_id, split FROM {V.POLYGONS} p WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti(spark, d):
    done = V.read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return V.polygons(spark, d).join(done, "vec_id", "left_anti").select("vec_id", "image_id", "split")


@query(f"SELECT doc_id, lower(regexp_replace(path, '\\.[^./]+$', '')) AS sample_key FROM {V.DOCUMENTS}")
def sample_key(spark, d):
    return V.documents(spark, d).select("doc_id", C.sample_key(F.col("path")).alias("sample_key"))


@query(r"""SELECT doc_id, line_no, len(list_filter(regexp_split_to_array(raw, '[ \t\x0B\f]+'), lambda t: t <> ''))::INTEGER AS n_tokens FROM (SELECT doc_id, unnest(lines) AS raw, unnest(range(1, len(lines) + 1))::INTEGER AS line_no
  FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS lines FROM documents)) WHERE len(list_filter(regexp_split_to_array(raw, '[ \t\x0B\f]+'), lambda t: t <> '')) > 0""")
def label_lines(spark, d):
    rows = V.read(spark, d, "documents").select("doc_id", F.inline(C.numbered_lines(F.col("text"))))
    return rows.select("doc_id", "line_no", F.size(C.tokens(F.col("raw"))).alias("n_tokens"))


# --- parsing and validation -------------------------------------------------------------------------------------------


@query(f"SELECT file_id, line_no, class_id, geometry_status, hard AS hard_error, soft AS soft_error, count(*) AS n FROM {V.INSTANCES} GROUP BY ALL")
def parse_instances(spark, d):
    keys = ["file_id", "line_no", "class_id", "geometry_status", "hard_error", "soft_error"]
    return V.instances(spark, d).groupBy(*keys).agg(F.count("*").alias("n"))


@query(f"SELECT file_id, line_no, error_type, count(*) AS n FROM {V.VALIDATED} GROUP BY ALL")
def validate_lines(spark, d):
    return V.validated(spark, d).groupBy("file_id", "line_no", "error_type").agg(F.count("*").alias("n"))


@query(f"SELECT split, strict_error AS error_type, count(*) AS n FROM {V.VALIDATED} GROUP BY ALL")
def validate_strict(spark, d):
    return V.validated(spark, d, "strict").groupBy("split", "error_type").agg(F.count("*").alias("n"))


def issues(spark, d) -> DataFrame:
    return V.issue_lines(spark, d).where(F.exists("coords", lambda v: ~C.inside(v))).select("file_id", "split", "line_no", "class_id", F.inline(C.coordinate_issues(F.col("coords"))))


@query(f"SELECT file_id, line_no, class_id, point_index, axis, position, value, boundary, direction, round(amount, 6) AS amount, coordinate_severity, line_severity, reset_value, action FROM {V.ISSUES}")
def coordinate_issues(spark, d):
    return issues(spark, d).drop("split").withColumn("amount", F.round("amount", 6))


@query(f"SELECT file_id, line_no, hard AS error_type, list_min(coords) AS low, list_max(coords) AS high, round(list_max(list_transform(coords, lambda v: greatest(-v, v - 1.0::DOUBLE, 0.0::DOUBLE))), 6) AS most FROM {V.INSTANCES} WHERE hard IN ('polygon_coordinate_range', 'polygon_geometry')")
def line_errors(spark, d):
    rows = V.instances(spark, d).where(F.col("hard_error").isin("polygon_coordinate_range", "polygon_geometry"))
    return rows.select("file_id", "line_no", F.col("hard_error").alias("error_type"), C.line_span(F.col("raw")).alias("s")).select("file_id", "line_no", "error_type", "s.low", "s.high", F.round("s.most", 6).alias("most"))


@query(f"SELECT vec_id, i::INTEGER AS place, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, v)), 6) AS clamped FROM (SELECT vec_id, unnest(coords) AS v, unnest(range(0, 8)) AS i FROM {V.POLYGONS})")
def clamp(spark, d):
    return V.polygons(spark, d).select("vec_id", F.posexplode("coords").alias("place", "v")).select("vec_id", "place", F.round(C.clamp01(F.col("v")), 6).alias("clamped"))


_REPAIRED = f"(SELECT file_id, line_no, head || ' ' || array_to_string(list_transform(range(1, len(rest) + 1), lambda i: CASE WHEN coords[i] BETWEEN 0.0::DOUBLE AND 1.0::DOUBLE THEN rest[i] WHEN coords[i] < 0 THEN '0' ELSE '1' END), ' ') AS fixed_line, soft_points::INTEGER AS fixed_points, round(list_max(list_transform(coords, lambda v: greatest(-v, v - 1.0::DOUBLE, 0.0::DOUBLE))), 6) AS max_offset FROM {V.VALIDATED} WHERE error_type IS NULL AND soft_points > 0)"


@query(f"SELECT * FROM {_REPAIRED}")
def repair_lines(spark, d):
    return V.validated(spark, d).where("fixed_line is not null").select("file_id", "line_no", "fixed_line", "fixed_points", F.round("max_offset", 6).alias("max_offset"))


@query(f"SELECT file_id, line_no, position, value AS before, CASE WHEN value < 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS after, coordinate_severity, CASE WHEN file_id % 4 < 2 THEN CASE WHEN file_id % 2 = 0 THEN 'repair_confirmed' ELSE 'rejected' END END AS review_decision FROM {V.ISSUES} WHERE coordinate_severity = 'soft' OR file_id % 4 = 0")
def repair_log(spark, d):
    found = issues(spark, d)
    reviews = found.where("file_id % 4 < 2").select("file_id", "line_no", F.when(F.col("file_id") % 2 == 0, "repair_confirmed").otherwise("rejected").alias("review_decision")).distinct()
    return freeze.repair_log(found, found, reviews)[0]


def obb_lines(spark, d) -> DataFrame:
    """Nine-field lines as integers padded to six decimals, so both engines see one text; every fifth is a square in good order."""
    v = F.col("vec_id")
    digits = [F.lpad(((v * (13 * i + 7) + i * 31) % 997).cast("string"), 3, "0") for i in range(8)]
    rough = F.concat_ws(" ", (v % 17).cast("string"), *(F.concat(F.when((v % 19 == 0) & F.lit(i == 2), "1.").when((v % 23 == 0) & F.lit(i == 1), "-0.").otherwise("0."), x) for i, x in enumerate(digits)))
    square = F.concat_ws(" ", F.when(v % 7 == 0, "1.5").when(v % 11 == 0, "nan").otherwise((v % 15).cast("string")), F.lit("0.1 0.1 0.8 0.1 0.8 0.8 0.1 0.8"))
    turned = F.concat_ws(" ", (v % 15).cast("string"), F.lit("0.8 0.1 0.8 0.8 0.1 0.8 0.1 0.1"))
    raw = F.when(v % 5 == 0, square).when(v % 5 == 1, turned).when(v % 29 == 0, "3 0.1 0.1 0.8").when(v % 31 == 0, "3 0.1 0.1 0.8 0.1 0.1 0.1 0.1 0.8").when(v % 37 == 0, "3 0.1 0.1 0.4 0.4 0.5 0.5 0.8 0.8").otherwise(rough)
    return V.polygons(spark, d).select("vec_id", "image_id", "split", raw.alias("raw"))


_OBB_DIGITS = " || ' ' || ".join(f"CASE WHEN {i} = 2 AND vec_id % 19 = 0 THEN '1.' WHEN {i} = 1 AND vec_id % 23 = 0 THEN '-0.' ELSE '0.' END || lpad(((vec_id * {13 * i + 7} + {i * 31}) % 997)::VARCHAR, 3, '0')" for i in range(8))
OBB_LINES = f"""(SELECT vec_id, image_id, split, CASE WHEN vec_id % 5 = 0 THEN CASE WHEN vec_id % 7 = 0 THEN '1.5' WHEN vec_id % 11 = 0 THEN 'nan' ELSE (vec_id % 15)::VARCHAR END || ' 0.1 0.1 0.8 0.1 0.8 0.8 0.1 0.8'
  WHEN vec_id % 5 = 1 THEN (vec_id % 15)::VARCHAR || ' 0.8 0.1 0.8 0.8 0.1 0.8 0.1 0.1' WHEN vec_id % 29 = 0 THEN '3 0.1 0.1 0.8' WHEN vec_id % 31 = 0 THEN '3 0.1 0.1 0.8 0.1 0.1 0.1 0.1 0.8' WHEN vec_id % 37 = 0 THEN '3 0.1 0.1 0.4 0.4 0.5 0.5 0.8 0.8'
  ELSE (vec_id % 17)::VARCHAR || ' ' || {_OBB_DIGITS} END AS raw FROM {V.POLYGONS})"""
OBB_CHECKED = f"""(SELECT vec_id, image_id, split, CASE WHEN len(tok) <> 9 THEN 'obb_field_count' WHEN cls IS NULL OR isnan(cls) THEN 'obb_numeric_format' WHEN cls <> floor(cls) OR cls < 0 OR cls >= 15 THEN 'obb_class_id'
  WHEN len(list_filter(coords, lambda v: v < 0 OR v > 1)) > 0 THEN 'obb_coordinate_range' WHEN {V.distinct_sql('coords')} < 4 THEN 'obb_duplicate_points' WHEN abs({V.signed_sql('coords')}) <= 1e-8 THEN 'obb_area_too_small' WHEN {V.signed_sql('coords')} <= 0 THEN 'obb_point_order'
  WHEN coords[2] <> least(coords[2], coords[4], coords[6], coords[8]) OR coords[1] <> list_min(list_transform(list_filter(range(0, 4), lambda i: coords[2 * i + 2] = least(coords[2], coords[4], coords[6], coords[8])), lambda i: coords[2 * i + 1])) THEN 'obb_point_order' END AS error_type
  FROM (SELECT *, try_cast(tok[1] AS DOUBLE) AS cls, list_transform(tok[2:], lambda t: try_cast(t AS DOUBLE)) AS coords FROM (SELECT *, string_split(raw, ' ') AS tok FROM {OBB_LINES})))"""


@query(f"SELECT vec_id, error_type FROM {OBB_CHECKED}")
def obb_validate(spark, d):
    return obb_lines(spark, d).select("vec_id", C.obb_error(F.col("raw"), 15).alias("error_type"))


@query(f"SELECT split, coalesce(error_type, 'ok') AS error_type, count(*) AS n FROM {OBB_CHECKED} GROUP BY ALL UNION ALL SELECT split, 'missing_label', count(*) FROM {V.DOCUMENTS} WHERE doc_id < 400 AND doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY ALL UNION ALL SELECT split, 'orphan_label', count(*) FROM {V.POLYGONS} WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id < 400) GROUP BY ALL")
def check_obb(spark, d):
    lines = obb_lines(spark, d).withColumn("error_type", F.coalesce(C.obb_error(F.col("raw"), 15), F.lit("ok")))
    images, labels = V.documents(spark, d).where("doc_id < 400").withColumnRenamed("doc_id", "vec_id"), lines.select("vec_id", "split")
    parts = [lines.select("split", "error_type"), pairing.missing_labels(images, labels, ["vec_id"]).select("split", F.lit("missing_label").alias("error_type")), pairing.orphan_labels(images, labels, ["vec_id"]).select("split", F.lit("orphan_label").alias("error_type"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split", "error_type").agg(F.count("*").alias("n"))


_OBB_IMAGES = "(SELECT doc_id, split, n_chars < 100 AS broken FROM " + V.DOCUMENTS + ")"
_OBB_FILES = f"(SELECT coalesce(i.split, l.split) AS split, coalesce(i.doc_id, l.image_id) AS k, i.doc_id IS NOT NULL AS i, l.image_id IS NOT NULL AS l, coalesce(i.broken, FALSE) AS broken FROM {_OBB_IMAGES} i FULL JOIN (SELECT DISTINCT image_id, split FROM {V.POLYGONS}) l ON i.doc_id = l.image_id AND i.split = l.split)"
_OBB_SAID = f"(SELECT c.* FROM {OBB_CHECKED} c JOIN (SELECT * FROM {_OBB_FILES} WHERE i AND l) f ON f.k = c.image_id AND f.split = c.split WHERE c.vec_id % 9 <> 4)"


def obb_set(spark, d) -> tuple[DataFrame, DataFrame]:
    """All documents as images, the polygons' images as labels, each ninth line blank."""
    images = V.documents(spark, d).select("split", F.col("doc_id").alias("key"), F.when(F.col("n_chars") < 100, "undecodable").alias("error"))
    lines = obb_lines(spark, d).select("split", F.col("image_id").alias("key"), F.col("vec_id").cast("int").alias("line_no"), F.when(F.col("vec_id") % 9 == 4, "  ").otherwise(F.col("raw")).alias("raw"))
    return obb.check_dataset(images, lines.select("split", "key").distinct(), lines)


@query(f"""SELECT split, k AS key, NULL::INTEGER AS line_no, 'corrupt_image' AS error_type FROM {_OBB_FILES} WHERE broken UNION ALL SELECT split, k, NULL, 'missing_label' FROM {_OBB_FILES} WHERE i AND NOT l UNION ALL SELECT split, k, NULL, 'orphan_label' FROM {_OBB_FILES} WHERE l AND NOT i
  UNION ALL SELECT split, image_id, vec_id::INTEGER, error_type FROM {_OBB_SAID} WHERE error_type IS NOT NULL""")
def obb_check_issues(spark, d):
    return obb_set(spark, d)[0]


@query(f"""SELECT f.split, count(*) FILTER (i) AS images, count(*) FILTER (l) AS labels, count(*) FILTER (broken) AS corrupt_images, count(*) FILTER (i AND NOT l) AS missing_labels, count(*) FILTER (l AND NOT i) AS orphan_labels, count(*) FILTER (i AND l AND ok IS NULL) AS negative_images,
  coalesce(sum(ok), 0)::BIGINT AS valid_instances, coalesce(sum(bad), 0)::BIGINT AS faulty_lines FROM {_OBB_FILES} f LEFT JOIN (SELECT split, image_id, count(*) FILTER (error_type IS NULL) AS ok, count(error_type) AS bad FROM {_OBB_SAID} GROUP BY ALL) s ON s.image_id = f.k AND s.split = f.split GROUP BY f.split""")
def obb_check_counts(spark, d):
    return obb_set(spark, d)[1]


@query(f"SELECT file_id, line_no, cls::INTEGER AS class_id FROM {V.PARSED} WHERE len(tok) >= 3 AND regexp_full_match(head, '[+-]?[0-9]+')")
def light_parse(spark, d):
    return V.label_lines(spark, d).select("file_id", "line_no", C.light_class(F.col("raw")).alias("class_id")).where("class_id is not null")


@query(f"SELECT file_id, array_to_string(list_sort(list_distinct(list(cls::INTEGER))), ',') AS classes FROM {V.PARSED} WHERE {V._OK_CLASS} GROUP BY file_id")
def class_sets(spark, d):
    return stats.class_sets(V.label_lines(spark, d), "file_id").select("file_id", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))


@query("SELECT vec_id, coalesce(name, 'unknown_' || label::VARCHAR) AS class_name, split_part(coalesce(name, 'unknown_' || label::VARCHAR), '--', 1) AS class_group FROM embeddings LEFT JOIN (SELECT DISTINCT label, 'group' || (label % 3)::VARCHAR || '--class' || label::VARCHAR AS name FROM embeddings WHERE label <> 5) USING (label)")
def class_lookup(spark, d):
    e = V.read(spark, d, "embeddings")
    dim = e.select("label").distinct().where("label <> 5").withColumn("name", F.concat(F.lit("group"), (F.col("label") % 3).cast("string"), F.lit("--class"), F.col("label").cast("string")))
    named = e.join(dim, "label", "left").withColumn("class_name", C.class_label(F.col("name"), F.col("label")))
    return named.select("vec_id", "class_name", C.class_group(F.col("class_name")).alias("class_group"))


_BOX = "(list_max(xs) - list_min(xs)) AS bw, (list_max(ys) - list_min(ys)) AS bh"
GEOMETRY = f"""(SELECT vec_id, image_id, split, class_id, width, height, bw * width AS bbox_width_px, bh * height AS bbox_height_px, bw * width * (bh * height) AS bbox_area_px, bw * bh AS bbox_area_relative, mask * width * height AS mask_area_px, mask AS mask_area_relative,
  CASE WHEN bw * width * (bh * height) < 1024 THEN 'small' WHEN bw * width * (bh * height) < 9216 THEN 'medium' ELSE 'large' END AS size
  FROM (SELECT *, {_BOX}, abs({V.signed_sql('coords')}) AS mask FROM (SELECT *, [coords[1], coords[3], coords[5], coords[7]] AS xs, [coords[2], coords[4], coords[6], coords[8]] AS ys FROM {V.POLYGONS})))"""


def geometry_rows(spark, d) -> DataFrame:
    p = V.polygons(spark, d)
    return p.select("vec_id", "image_id", "split", "class_id", "width", "height", C.geometry(F.col("coords"), F.col("width"), F.col("height")).alias("g")).select("vec_id", "image_id", "split", "class_id", "width", "height", "g.*")


@query(f"SELECT vec_id, round(bbox_width_px, 6) AS bbox_width_px, round(bbox_height_px, 6) AS bbox_height_px, round(bbox_area_px, 6) AS bbox_area_px, round(bbox_area_relative, 6) AS bbox_area_relative, round(mask_area_px, 6) AS mask_area_px, round(mask_area_relative, 6) AS mask_area_relative, size FROM {GEOMETRY}")
def polygon_geometry(spark, d):
    g = geometry_rows(spark, d)
    return g.select("vec_id", *(r6(c) for c in ("bbox_width_px", "bbox_height_px", "bbox_area_px", "bbox_area_relative", "mask_area_px", "mask_area_relative")), "size")


@query(f"SELECT image_id, split, max(width) AS width, max(height) AS height, round(CASE WHEN max(height) <> 0 THEN max(width) / max(height)::DOUBLE ELSE 0.0 END, 6)::DOUBLE AS aspect, count(*) AS instances FROM {V.POLYGONS} GROUP BY image_id, split")
def image_stats(spark, d):
    g = V.polygons(spark, d).groupBy("image_id", "split").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("instances"))
    return g.withColumn("aspect", F.round(C.aspect_ratio(F.col("width"), F.col("height")), 6))


_STEM = "CASE WHEN event_id % 7 = 0 THEN 'plain-' || event_id::VARCHAR ELSE (user_id % 5)::VARCHAR || '-' || event_type || '-DSC' || lpad((event_id % 100000)::VARCHAR, 5, '0') || '-9' END"


@query(f"SELECT event_id, CASE WHEN stem LIKE '%DSC%' THEN regexp_replace(regexp_extract(stem, '(?i)^(.*?)-?DSC([0-9]{{5}})', 1), '-+$', '') ELSE 'unparsed' END AS capture_key, try_cast(regexp_extract(stem, '(?i)^(.*?)-?DSC([0-9]{{5}})', 2) AS INTEGER) AS frame FROM (SELECT event_id, {_STEM} AS stem FROM events)")
def extract_keys(spark, d):
    stem = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("plain-"), F.col("event_id").cast("string"))).otherwise(F.concat((F.col("user_id") % 5).cast("string"), F.lit("-"), "event_type", F.lit("-DSC"), F.lpad((F.col("event_id") % 100000).cast("string"), 5, "0"), F.lit("-9")))
    return V.read(spark, d, "events").select("event_id", stem.alias("stem")).select("event_id", C.capture_key(F.col("stem")).alias("capture_key"), C.frame_number(F.col("stem")).alias("frame"))


@query(f"SELECT id, hash FROM {V.PRINTS}")
def dhash_bits(spark, d):
    return V.prints(spark, d).select("id", "hash")


@query(f"SELECT id, k::INTEGER AS chunk_index, CASE WHEN k < 3 THEN (hash >> (16 * k)) & 65535 ELSE ((hash >> 48) & 65535) END::INTEGER AS chunk, lower(printf('%016x', hash)) AS hex FROM {V.PRINTS}, (SELECT unnest(range(0, 4)) AS k)")
def hash_chunks(spark, d):
    return V.prints(spark, d).select("id", F.inline(C.hash_chunks(F.col("hash"))), C.hash_hex(F.col("hash")).alias("hex")).select("id", "chunk_index", "chunk", "hex")


@query(f"SELECT doc_id, action, CASE WHEN action IN ('exclude', 'review') THEN 'dropped' WHEN action = 'keep_negative' THEN 'kept_negative' ELSE 'kept' END AS status FROM {V.DOCUMENTS} d LEFT JOIN {V.DECISIONS} k ON lower(d.filename) = lower(k.filename)")
def apply_decisions(spark, d):
    return pairing.apply_decisions(V.documents(spark, d), V.decisions(spark, d), "filename").select("doc_id", "action", "status")


@query(f"SELECT doc_id, n_chars FROM {V.DOCUMENTS} WHERE n_chars < 100")
def zero_size(spark, d):
    return pairing.readable(V.documents(spark, d), "n_chars", least=100)[1].select("doc_id", "n_chars")


@query("SELECT event_id, CASE WHEN value - 20 > 0 THEN round(1000.0::DOUBLE / (value - 20), 6) ELSE 0.0::DOUBLE END AS fps FROM events")
def fps(spark, d):
    return V.read(spark, d, "events").select("event_id", F.round(C.fps(F.col("value") - 20), 6).alias("fps"))


@query("SELECT vec_id, CASE WHEN p + r <> 0 THEN round(2.0::DOUBLE * p * r / (p + r), 6) ELSE 0.0::DOUBLE END AS f1 FROM (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 0.0::DOUBLE ELSE abs(embedding[1]::DOUBLE) END AS p, CASE WHEN vec_id % 13 = 0 THEN 0.0::DOUBLE ELSE abs(embedding[2]::DOUBLE) END AS r FROM embeddings)")
def f1(spark, d):
    part = lambda k: F.when(F.col("vec_id") % 13 == 0, F.lit(0.0)).otherwise(F.abs(F.element_at("embedding", k).cast("double")))
    return V.read(spark, d, "embeddings").select("vec_id", F.round(C.f1(part(1), part(2)), 6).alias("f1"))


@query("SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN event_type ELSE regexp_extract(props, '([0-9]+)', 1) END AS DOUBLE), -1.0::DOUBLE) AS v FROM events")
def tolerant_float(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.regexp_extract("props", "([0-9]+)", 1))
    v = C.tolerant_float(text)
    return V.read(spark, d, "events").select("event_id", F.when(F.isnan(v), -1.0).otherwise(v).alias("v"))


@query("SELECT l_orderkey, l_partkey, regexp_replace(format('{:.8f}', l_quantity / 64), '\\.?0+$', '') AS written FROM lineitem")
def format_obb(spark, d):
    return V.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", C.format_number(F.col("l_quantity") / 64).alias("written"))


@query(f"SELECT file_id, line_no, len(list_distinct(list_transform(range(0, len(coords) // 2), lambda i: {{'x': round(coords[2 * i + 1], 1), 'y': round(coords[2 * i + 2], 1)}})))::INTEGER AS points FROM {V.PARSED} WHERE len(coords) = 8 AND len(list_filter(coords, lambda v: v IS NULL)) = 0")
def dedup_points(spark, d):
    coords = F.transform(F.slice(C.tokens(F.col("raw")), F.lit(2), F.lit(8)), C.number)
    rows = V.label_lines(spark, d).withColumn("c", coords).where((F.size("c") == 8) & ~F.exists("c", lambda v: v.isNull()))
    return rows.select("file_id", "line_no", F.size(C.dedup_points(F.col("c"), 1)).alias("points"))


# --- oriented boxes ---------------------------------------------------------------------------------------------------


def converted(spark, d) -> DataFrame:
    return obb.convert(V.polygons(spark, d))


@query()
def obb_convert(spark, d):
    c = converted(spark, d)
    return c.select("vec_id", "reason", F.array_join("warnings", ",").alias("warnings"), obb.label_line(F.col("class_id"), F.col("corners")).alias("line"), F.round(C.area(F.col("corners")), 6).alias("area"))


#: The smallest rectangle over the directions of all pairs of points, which include all edges of the hull.
_RECTANGLES = f"""(SELECT vec_id, reason, area_px, cs FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN turned >= round(pi() / 2, 9) THEN 0.0 ELSE turned END) AS r FROM (SELECT *, min(area_px) OVER (PARTITION BY vec_id) AS least_px FROM (SELECT *, round(mod(atan2(uy, ux) + 2 * pi(), pi() / 2), 9) AS turned, (a1 - a0) * (b1 - b0) AS area_px, [{{'x': a0 * ux - b0 * uy, 'y': a0 * uy + b0 * ux}}, {{'x': a1 * ux - b0 * uy, 'y': a1 * uy + b0 * ux}}, {{'x': a1 * ux - b1 * uy, 'y': a1 * uy + b1 * ux}}, {{'x': a0 * ux - b1 * uy, 'y': a0 * uy + b1 * ux}}] AS cs
  FROM (SELECT *, list_min(list_transform(px, lambda q: q.x * ux + q.y * uy)) AS a0, list_max(list_transform(px, lambda q: q.x * ux + q.y * uy)) AS a1, list_min(list_transform(px, lambda q: q.y * ux - q.x * uy)) AS b0, list_max(list_transform(px, lambda q: q.y * ux - q.x * uy)) AS b1
  FROM (SELECT *, (px[j].x - px[i].x) / sqrt((px[j].x - px[i].x) ** 2 + (px[j].y - px[i].y) ** 2) AS ux, (px[j].y - px[i].y) / sqrt((px[j].x - px[i].x) ** 2 + (px[j].y - px[i].y) ** 2) AS uy
  FROM (SELECT *, unnest(range(1, 5)) AS i FROM (SELECT vec_id, width, height, CASE WHEN width = 0 THEN 'conversion_failed' WHEN {V.distinct_sql('c')} < 3 THEN 'insufficient_points' WHEN abs({V.signed_sql('c')}) < 1e-8 THEN 'area_too_small' END AS reason,
  list_transform(range(0, 4), lambda k: {{'x': c[2 * k + 1] * width, 'y': c[2 * k + 2] * height}}) AS px FROM (SELECT *, list_transform(coords, lambda v: least(1.0::DOUBLE, greatest(0.0::DOUBLE, v))) AS c FROM {V.POLYGONS}))), (SELECT unnest(range(1, 5)) AS j)
  WHERE reason IS NULL AND i < j AND (px[i].x <> px[j].x OR px[i].y <> px[j].y))))) WHERE area_px <= least_px * (1 + 1e-9)) WHERE r = 1
  UNION ALL SELECT vec_id, CASE WHEN width = 0 THEN 'conversion_failed' WHEN {V.distinct_sql('c')} < 3 THEN 'insufficient_points' ELSE 'area_too_small' END, NULL, NULL FROM (SELECT *, list_transform(coords, lambda v: least(1.0::DOUBLE, greatest(0.0::DOUBLE, v))) AS c FROM {V.POLYGONS}) WHERE width = 0 OR {V.distinct_sql('c')} < 3 OR abs({V.signed_sql('c')}) < 1e-8)"""
_SIDE = "round_even(list_{f}(list_transform(cs, lambda q: least(1.0::DOUBLE, greatest(0.0::DOUBLE, q.{a} / {s})))), 8) AS {a}_{f}"


@query(f"SELECT vec_id, reason, {', '.join(_SIDE.format(f=f, a=a, s=s) for a, s in (('x', 'width'), ('y', 'height')) for f in ('min', 'max'))} FROM {_RECTANGLES} JOIN (SELECT vec_id, width, height FROM {V.POLYGONS}) USING (vec_id)")
def obb_rectangles(spark, d):
    """Where the converted boxes end on each side."""
    b = C.bounds(F.col("corners"))
    return converted(spark, d).select("vec_id", "reason", *(F.when(F.col("reason").isNull(), b[f"{a}_{f}"]).alias(f"{a}_{f}") for a in "xy" for f in ("min", "max")))


@query(f"SELECT vec_id, 'warning' AS severity, 'out_of_bounds' AS reason FROM {V.POLYGONS} WHERE width > 0 AND len(list_filter(coords, lambda v: v < 0 OR v > 1)) > 0 UNION ALL SELECT vec_id, 'error', 'conversion_failed' FROM {V.POLYGONS} WHERE width = 0")
def obb_issues(spark, d):
    found = obb.issues(converted(spark, d), ["vec_id"])
    return found.where("reason in ('out_of_bounds', 'conversion_failed')")


@query(f"SELECT CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split, count(*) AS lines, count(*) FILTER (width > 0) AS converted, count(*) FILTER (width = 0) AS failed, count(DISTINCT image_id) AS labels, count(*) FILTER (width > 0 AND len(list_filter(coords, lambda v: v < 0 OR v > 1)) > 0) AS clipped FROM {V.POLYGONS} GROUP BY ROLLUP (split)")
def obb_stats(spark, d):
    return obb.statistics(converted(spark, d), "image_id")


@query("""SELECT vec_id, round(xs[1], 6) AS first_x, round(ys[1], 6) AS first_y, round(p[1].x, 6) AS second_x FROM (SELECT vec_id, [list_min(list_transform(list_filter(pts, lambda q: q.y = top), lambda q: q.x))] AS xs, [top] AS ys, list_filter(pts, lambda q: FALSE) AS p0, pts, top, cx, cy,
  list_transform(list_sort(list_transform(pts, lambda q: {'a': atan2(q.y - cy, q.x - cx), 'x': q.x, 'y': q.y})), lambda q: q) AS ring FROM (SELECT *, list_min(list_transform(pts, lambda q: q.y)) AS top, list_sum(list_transform(pts, lambda q: q.x)) / 4 AS cx, list_sum(list_transform(pts, lambda q: q.y)) / 4 AS cy
  FROM (SELECT vec_id, list_transform(range(0, 4), lambda i: {'x': coords[2 * i + 1], 'y': coords[2 * i + 2]}) AS pts FROM """ + V.POLYGONS + """))), LATERAL (SELECT [ring[(list_position(list_transform(ring, lambda q: q.y = top), true) % 4) + 1]] AS p)""")
def corner_order(spark, d):
    p = V.polygons(spark, d).select("vec_id", C.corner_order(C.points(F.col("coords"))).alias("c"))
    return p.select("vec_id", F.round(F.get("c", F.lit(0))["x"], 6).alias("first_x"), F.round(F.get("c", F.lit(0))["y"], 6).alias("first_y"), F.round(F.get("c", F.lit(1))["x"], 6).alias("second_x"))


@query(f"SELECT vec_id, array_to_string(list_transform(range(0, 8), lambda i: round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, coords[i + 1])) * CASE WHEN i % 2 = 0 THEN width - 1 ELSE height - 1 END, 0)::INTEGER), ' ') AS pixels FROM {V.POLYGONS} WHERE width > 0")
def to_pixels(spark, d):
    return V.polygons(spark, d).where("width > 0").select("vec_id", F.array_join(C.to_pixels(F.col("coords"), F.col("width"), F.col("height")).cast("array<string>"), " ").alias("pixels"))


_WINDOW = f"""(SELECT vec_id, width, height, greatest(0, trunc(x0 * width - greatest(180.0::DOUBLE, (x1 - x0) * width * 0.35::DOUBLE))::INTEGER) AS l, greatest(0, trunc(y0 * height - greatest(140.0::DOUBLE, (y1 - y0) * height * 0.35::DOUBLE))::INTEGER) AS t,
  least(width, trunc(x1 * width + greatest(180.0::DOUBLE, (x1 - x0) * width * 0.35::DOUBLE))::INTEGER)::INTEGER AS r, least(height, trunc(y1 * height + greatest(140.0::DOUBLE, (y1 - y0) * height * 0.35::DOUBLE))::INTEGER)::INTEGER AS b
  FROM (SELECT vec_id, width, height, least(c[1], c[3], c[5], c[7]) AS x0, greatest(c[1], c[3], c[5], c[7]) AS x1, least(c[2], c[4], c[6], c[8]) AS y0, greatest(c[2], c[4], c[6], c[8]) AS y1 FROM (SELECT *, list_transform(coords, lambda v: least(1.0::DOUBLE, greatest(0.0::DOUBLE, v))) AS c FROM {V.POLYGONS} WHERE width > 0)))"""


@query(f'SELECT vec_id, CASE WHEN tiny THEN 0 ELSE l END AS "left", CASE WHEN tiny THEN 0 ELSE t END AS top, CASE WHEN tiny THEN width::INTEGER ELSE r END AS "right", CASE WHEN tiny THEN height::INTEGER ELSE b END AS bottom FROM (SELECT *, r - l < 32 OR b - t < 32 AS tiny FROM {_WINDOW})')
def crop_window(spark, d):
    return V.polygons(spark, d).where("width > 0").select("vec_id", C.crop_window(F.col("coords"), F.col("width"), F.col("height")).alias("w")).select("vec_id", "w.*")


# --- joins ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def paired(spark, d):
    return pairing.paired(V.read(spark, d, "documents"), V.read(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang", "quality", "toxic")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark, d):
    return pairing.missing_labels(V.read(spark, d, "documents"), V.read(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_labels(spark, d):
    return pairing.orphan_labels(V.read(spark, d, "documents").where("lang = 'en'"), V.read(spark, d, "labels"), ["doc_id"]).select("doc_id", "quality", "toxic")


@query(f"SELECT k.filename, action FROM {V.DECISIONS} k WHERE lower(k.filename) NOT IN (SELECT lower(filename) FROM {V.DOCUMENTS})")
def unmatched_decisions(spark, d):
    return pairing.unmatched_decisions(V.documents(spark, d), V.decisions(spark, d), "filename").select("filename", "action")


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE doc_id % 43 = 0")
def effective_labels(spark, d):
    return pairing.effective_labels(V.read(spark, d, "labels"), V.read(spark, d, "documents").where("doc_id % 43 = 0"), ["doc_id"])


@query(f"""SELECT s.split, g.key, g.fine_class_ids, coalesce(instances, 0) AS instances, coalesce(images, 0) AS images FROM (SELECT key, string_agg(class_id::VARCHAR, ',' ORDER BY class_id) AS fine_class_ids FROM (SELECT DISTINCT key, class_id FROM {V.HIERARCHY}) GROUP BY key) g
  CROSS JOIN (SELECT unnest(['BUILDING', 'MACHINERY']) AS split) s LEFT JOIN (SELECT c_mktsegment AS split, key, count(*) AS instances, count(DISTINCT c_custkey) AS images FROM customer JOIN {V.HIERARCHY} ON c_nationkey = class_id GROUP BY ALL) c ON c.split = s.split AND c.key = g.key""")
def coarse_rollup(spark, d):
    rows = V.read(spark, d, "customer").select(F.col("c_mktsegment").alias("split"), F.col("c_nationkey").alias("class_id"), F.col("c_custkey").alias("image"))
    return stats.coarse_rollup(rows, V.hierarchy(spark, d), ["BUILDING", "MACHINERY"])


@query(f"SELECT n_nationkey AS class_id, 'missing' AS violation FROM nation WHERE n_nationkey NOT IN (SELECT class_id FROM {V.HIERARCHY}) UNION ALL SELECT DISTINCT class_id, 'extra' FROM {V.HIERARCHY} WHERE class_id NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT class_id, 'duplicate' FROM {V.HIERARCHY} WHERE class_id IN (SELECT n_nationkey FROM nation) GROUP BY class_id HAVING count(*) > 1")
def hierarchy_violations(spark, d):
    return pairing.hierarchy_violations(V.read(spark, d, "nation").select(F.col("n_nationkey").alias("class_id")), V.hierarchy(spark, d))


@query(f"SELECT capture_key, t.id AS train_id, v.id AS val_id, abs(t.frame - v.frame) AS frame_delta FROM {V.FRAMES} t JOIN {V.FRAMES} v USING (capture_key) WHERE t.split = 'train' AND v.split = 'val' AND abs(t.frame - v.frame) <= 3")
def adjacent_frames(spark, d):
    return leakage.adjacent_frames(V.frames(spark, d))


@query(f"SELECT capture_key, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count FROM {V.FRAMES} GROUP BY ALL HAVING train_count > 0 AND val_count > 0")
def cross_split_groups(spark, d):
    return leakage.cross_split_groups(V.frames(spark, d), "capture_key")


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY hash, split ORDER BY id) AS place, count(*) OVER (PARTITION BY hash, split) AS group_count FROM {V.PRINTS})"
_SAME = f"SELECT t.id AS train_id, v.id AS val_id, t.group_count AS train_group_count, v.group_count AS val_group_count FROM {_RANKED} t JOIN {_RANKED} v ON t.hash = v.hash WHERE t.split = 'train' AND v.split = 'val' AND t.place <= 10 AND v.place <= 10"


@query(_SAME)
def identical_hash_pairs(spark, d):
    return dedup.identical_hash_pairs(V.prints(spark, d)).select("train_id", "val_id", "train_group_count", "val_group_count")


_CHUNKS = f"(SELECT id, split, hash, k, (hash >> (16 * k)) & 65535 AS c FROM {V.PRINTS}, (SELECT unnest(range(0, 4)) AS k))"
_NEAR = f"""SELECT DISTINCT t.id AS train_id, v.id AS val_id, bit_count(xor(t.hash, v.hash))::INTEGER AS distance FROM {_CHUNKS} t JOIN {_CHUNKS} v ON t.k = v.k AND t.c = v.c JOIN (SELECT k, c FROM {_CHUNKS} GROUP BY ALL HAVING count(*) FILTER (split = 'train') * count(*) FILTER (split = 'val') BETWEEN 1 AND 50000) s ON s.k = t.k AND s.c = t.c
  WHERE t.split = 'train' AND v.split = 'val' AND bit_count(xor(t.hash, v.hash)) <= 4 ORDER BY distance, train_id, val_id LIMIT 50000"""


@query(_NEAR)
def near_duplicates(spark, d):
    """Within the reference's limits, as its SQL; ``near_duplicates_whole`` has none."""
    return dedup.near_hash_report(V.prints(spark, d))


@query(f"SELECT t.id AS train_id, v.id AS val_id, bit_count(xor(t.hash, v.hash))::INTEGER AS distance FROM {V.PRINTS} t JOIN {V.PRINTS} v ON bit_count(xor(t.hash, v.hash)) <= 4 WHERE t.split = 'train' AND v.split = 'val'")
def near_duplicates_whole(spark, d):
    return dedup.near_hash_pairs(keep(V.prints(spark, d), "prints"))  # both the hashes and their files are taken from it


_HASHES = f"(SELECT hash, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count, min(id) FILTER (split = 'train') AS train_id, min(id) FILTER (split = 'val') AS val_id FROM {V.PRINTS} GROUP BY hash)"


@query(f"SELECT hash, train_count, val_count, train_id, val_id FROM {_HASHES} WHERE train_count > 0 AND val_count > 0")
def identical_hash_classes(spark, d):
    return dedup.identical_hash_classes(V.prints(spark, d))


@query(f"SELECT hash, split, id FROM {V.PRINTS} WHERE hash IN (SELECT hash FROM {_HASHES} WHERE train_count > 0 AND val_count > 0)")
def identical_hash_members(spark, d):
    prints = V.prints(spark, d)
    return dedup.hash_members(prints, dedup.identical_hash_classes(prints))


@query(f"""SELECT t.hash AS train_hash, v.hash AS val_hash, bit_count(xor(t.hash, v.hash))::INTEGER AS distance, t.train_count, v.val_count, t.train_id, v.val_id FROM {_HASHES} t JOIN {_HASHES} v ON bit_count(xor(t.hash, v.hash)) <= 4 WHERE t.train_count > 0 AND v.val_count > 0""")
def near_hash_classes(spark, d):
    """Nearest first: the order is a range partition."""
    return dedup.near_hash_classes(V.prints(spark, d)).orderBy("distance", "train_hash", "val_hash")


@query(f"SELECT t.hash AS train_hash, v.hash AS val_hash, bit_count(xor(t.hash, v.hash))::INTEGER AS distance FROM {_HASHES} t JOIN {_HASHES} v ON bit_count(xor(t.hash, v.hash)) <= 4 WHERE t.train_count > 0 AND v.val_count > 0")
def hash_index_additions(spark, d):
    """The same pairs from a stored index to which the documents are added in two parts."""
    name = f"hashes_{uuid.uuid4().hex}"
    index = HashIndex(name, f"{shared_dir(spark)}/plumbline/{name}", id_type="bigint", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    prints = keep(V.prints(spark, d), "prints")
    links = [index.add(prints.where(part)) for part in ("id % 3 > 0", "id % 3 = 0")]
    return links[0].unionByName(links[1]).select("train_hash", "val_hash", "distance").distinct()


@query("SELECT d.doc_id, d.lang, l.quality, c.role FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN (SELECT conv_id AS doc_id, min(role) AS role FROM conversations GROUP BY conv_id) c ON c.doc_id = d.doc_id")
def three_way(spark, d):
    c = V.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("role").alias("role"))
    return pairing.three_way(V.read(spark, d, "documents"), V.read(spark, d, "labels"), c, ["doc_id"]).select("doc_id", "lang", "quality", "role")


@query(f"SELECT k.filename, d.split FROM {V.DECISIONS} k LEFT JOIN {V.DOCUMENTS} d ON lower(d.filename) = lower(k.filename) WHERE k.action = 'exclude'")
def excluded_locations(spark, d):
    return pairing.excluded_locations(V.documents(spark, d), V.decisions(spark, d), "filename").select("filename", "split")


_HOST = "regexp_extract(url, '^[a-z]+://([^/.]+)', 1) AS stem, regexp_extract(url, '^[a-z]+://[^/]*[.]([a-z]+)/', 1) AS suffix"


@query(f"""SELECT stem, page_id, suffix FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY rk, suffix, page_id) AS r, count(*) OVER (PARTITION BY stem) AS n FROM (SELECT page_id, stem, suffix, CASE suffix WHEN 'com' THEN 1 WHEN 'org' THEN 2 ELSE 3 END AS rk FROM (SELECT page_id, {_HOST} FROM pages))) WHERE r = 1 AND (rk <= 2 OR n = 1)""")
def best_match(spark, d):
    pages = V.read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/.]+)", 1).alias("stem"), F.regexp_extract("url", "^[a-z]+://[^/]*[.]([a-z]+)/", 1).alias("suffix"))
    one = pages.groupBy("stem", "suffix").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    alone = pages.groupBy("stem").agg(F.count("*").alias("all_pages"))
    matched = pairing.best_match(pages.select("stem").distinct(), one.drop("n"), "stem", "suffix", ["com", "org"])
    return matched.join(alone, "stem").where((F.col("suffix_rank") <= 2) | (F.col("all_pages") == 1)).select("stem", "page_id", "suffix")


@query(f"""SELECT filename, unnest(list_filter([CASE WHEN action NOT IN ('exclude', 'review', 'keep_negative') THEN 'unknown_action' END, CASE WHEN action IN ('exclude', 'review') AND issue IS NULL THEN 'issue_required' END, CASE WHEN reason = '' THEN 'blank_reason' END], lambda x: x IS NOT NULL)) AS violation FROM {V.DECISIONS}
  UNION ALL SELECT lower(filename), 'duplicate_filename' FROM {V.DECISIONS} GROUP BY lower(filename) HAVING count(*) > 1""")
def decision_violations(spark, d):
    return pairing.decision_violations(V.decisions(spark, d), ["exclude", "review", "keep_negative"], ["missing_label"])


# --- aggregates -------------------------------------------------------------------------------------------------------

_CLASSES = f"(SELECT unnest(range(0, {V.CLASSES}))::INTEGER AS class_id)"


def _distribution_sql(what: str) -> str:
    return f"SELECT class_id, coalesce(train, 0) AS train, coalesce(val, 0) AS val, coalesce(train, 0) + coalesce(val, 0) AS total FROM {_CLASSES} LEFT JOIN (SELECT class_id, count({what}) FILTER (split = 'train') AS train, count({what}) FILTER (split = 'val') AS val FROM {V.INSTANCES} WHERE class_id IS NOT NULL GROUP BY class_id) USING (class_id)"


@query(_distribution_sql("file_id"))
def class_instance_dist(spark, d):
    return stats.class_distribution(V.instances(spark, d).where("class_id is not null"), names(spark, V.CLASSES), V.SPLITS)


@query(_distribution_sql("DISTINCT file_id"))
def class_image_dist(spark, d):
    return stats.class_distribution(V.instances(spark, d).where("class_id is not null"), names(spark, V.CLASSES), V.SPLITS, images=True, image="file_id")


@query(f"SELECT CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split, count(*) AS lines, count(*) FILTER (class_id IS NOT NULL) AS instances, count(*) FILTER (geometry_status IS NOT NULL) AS geometry_instances, count(*) FILTER (geometry_status = 'soft_clipped') AS soft_clipped, count(*) FILTER (hard IS NOT NULL) AS hard_lines FROM {V.INSTANCES} GROUP BY ROLLUP (split)")
def split_summary(spark, d):
    return stats.split_summary(V.instances(spark, d), {"lines": F.count("*"), "instances": F.count("class_id"), "geometry_instances": F.count("geometry_status"), "soft_clipped": F.count_if(F.col("geometry_status") == "soft_clipped"), "hard_lines": F.count("hard_error")})


_SIZED = f"(SELECT * FROM {GEOMETRY} WHERE width > 0)"


@query(f"""SELECT s.split, c.class_id, coalesce(objects, 0) AS objects, coalesce(small, 0) AS small, coalesce(medium, 0) AS medium, coalesce(large, 0) AS large, round(coalesce(mean_area_px, 0.0), 4) AS mean_area_px, round(coalesce(median_area_px, 0.0), 4) AS median_area_px, round(coalesce(mean_mask, 0.0), 6) AS mean_mask, round(coalesce(median_mask, 0.0), 6) AS median_mask,
  round(coalesce(small / objects::DOUBLE, 0.0), 6) AS small_ratio, round(coalesce(medium / objects::DOUBLE, 0.0), 6) AS medium_ratio, round(coalesce(large / objects::DOUBLE, 0.0), 6) AS large_ratio
  FROM {_CLASSES} c CROSS JOIN (SELECT unnest(['train', 'val', 'total']) AS split) s LEFT JOIN (SELECT CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split, class_id, count(*) AS objects, count(*) FILTER (size = 'small') AS small, count(*) FILTER (size = 'medium') AS medium, count(*) FILTER (size = 'large') AS large,
  avg(bbox_area_px) AS mean_area_px, median(bbox_area_px) AS median_area_px, avg(mask_area_relative) AS mean_mask, median(mask_area_relative) AS median_mask FROM {_SIZED} GROUP BY GROUPING SETS ((split, class_id), (class_id))) g ON g.split = s.split AND g.class_id = c.class_id""")
def object_size_by_class(spark, d):
    out = stats.object_size_by_class(geometry_rows(spark, d).where("width > 0"), names(spark, V.CLASSES), V.SPLITS)
    return out.select("split", "class_id", "objects", "small", "medium", "large", *(F.round(c, 4).alias(c) for c in ("mean_area_px", "median_area_px")), *(r6(c) for c in ("mean_mask", "median_mask", "small_ratio", "medium_ratio", "large_ratio")))


@query(f"""SELECT h.class_id, class_files, instances, files, lines, coordinates, low, high, round(most, 6) AS most, round(files / class_files::DOUBLE, 6) AS file_ratio FROM (SELECT class_id, count(DISTINCT file_id) AS files, count(DISTINCT (file_id, line_no)) AS lines, count(*) AS coordinates, min(value) AS low, max(value) AS high, max(amount) AS most FROM {V.ISSUES} WHERE coordinate_severity = 'hard' GROUP BY class_id) h
  JOIN (SELECT class_id, count(DISTINCT file_id) AS class_files, count(*) AS instances FROM {V.INSTANCES} WHERE class_id IS NOT NULL GROUP BY class_id) i ON h.class_id = i.class_id""")
def hard_error_by_class(spark, d):
    out = stats.hard_error_by_class(issues(spark, d).where("coordinate_severity = 'hard'"), V.instances(spark, d).where("class_id is not null"))
    return out.withColumn("most", F.round("most", 6)).withColumn("file_ratio", F.round("file_ratio", 6))


@query(f"SELECT count(*) AS coordinates, count(*) FILTER (coordinate_severity = 'soft') AS soft_coordinates, count(*) FILTER (line_severity = 'hard') AS hard_line_coordinates, count(DISTINCT (file_id, line_no)) AS lines, count(DISTINCT file_id) AS files, min(value) AS low, max(value) AS high, round(max(amount), 6) AS most FROM {V.ISSUES}")
def coordinate_summary(spark, d):
    return stats.coordinate_summary(issues(spark, d)).withColumn("most", F.round("most", 6))


_IMAGES = f"(SELECT DISTINCT image_id, split, width, height FROM {V.POLYGONS})"


@query(f"SELECT count(*) AS images, min(width) AS min_width, max(width) AS max_width, median(width) AS median_width, min(height) AS min_height, max(height) AS max_height, median(height) AS median_height FROM {_IMAGES} WHERE width > 0 AND height > 0")
def dimension_summary(spark, d):
    return stats.dimension_summary(V.polygons(spark, d).select("image_id", "split", "width", "height").distinct())


@query("SELECT objects, coalesce(images, 0) AS images FROM (SELECT unnest(range(0, 7))::INTEGER AS objects) LEFT JOIN (SELECT least(coalesce(n, 0), 6)::INTEGER AS objects, count(*) AS images FROM (SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) GROUP BY 1) USING (objects)")
def objects_per_image(spark, d):
    orders = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return stats.objects_per_image(orders, V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


_EDGES = [0.0, 0.001, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5]


@query(f"SELECT bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 9))::INTEGER AS bin) LEFT JOIN (SELECT ({' + '.join(f'(mask_area_relative >= {e}::DOUBLE)::INTEGER' for e in _EDGES)}) AS bin, count(*) AS n FROM {GEOMETRY} GROUP BY 1) USING (bin)")
def mask_histogram(spark, d):
    return stats.histogram(geometry_rows(spark, d), F.col("mask_area_relative"), _EDGES)


@query(f"SELECT class_id, count(*) FILTER (size = 'small') AS small, count(*) FILTER (size = 'medium') AS medium, count(*) FILTER (size = 'large') AS large FROM {_SIZED} GROUP BY class_id")
def size_pivot(spark, d):
    return stats.size_pivot(geometry_rows(spark, d).where("width > 0"))


@query(f"SELECT error_type, count(*) AS n FROM (SELECT error_type FROM {V.VALIDATED} WHERE error_type IS NOT NULL UNION ALL SELECT 'missing_label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'orphan_label' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) GROUP BY 1")
def error_type_counts(spark, d):
    docs, labels = V.read(spark, d, "documents"), V.read(spark, d, "labels")
    return stats.error_type_counts(V.validated(spark, d).where("error_type is not null"), pairing.missing_labels(docs, labels, ["doc_id"]), pairing.orphan_labels(docs.where("lang = 'en'"), labels, ["doc_id"]))


_CHECK = f"""(SELECT file_id, CASE WHEN hard THEN 'remove' WHEN fl > 0 THEN 'fix' ELSE 'keep' END AS action, issues, CASE WHEN NOT hard AND fl > 0 THEN fl ELSE 0 END AS fixed_lines, CASE WHEN NOT hard AND fl > 0 THEN fp ELSE 0 END::BIGINT AS fixed_points, valid_lines
  FROM (SELECT file_id, bool_or(coalesce(error_type = 'polygon_coordinate_range', FALSE)) AS hard, count(error_type) AS issues, count(*) FILTER (error_type IS NULL AND soft_points > 0) AS fl, coalesce(sum(soft_points) FILTER (error_type IS NULL AND soft_points > 0), 0) AS fp, count(*) FILTER (error_type IS NULL) AS valid_lines FROM {V.VALIDATED} WHERE raw <> '' GROUP BY file_id))"""


def checked_files(spark, d) -> DataFrame:
    lines = V.validated(spark, d).where("raw <> ''").withColumn("hard_range", F.coalesce(F.col("error_type") == "polygon_coordinate_range", F.lit(False)))
    return stats.dataset_check(lines, auto_fix=True)


@query(f"SELECT action, count(*) AS files, sum(issues)::BIGINT AS issues, sum(fixed_lines)::BIGINT AS fixed_lines, sum(fixed_points)::BIGINT AS fixed_points, sum(valid_lines)::BIGINT AS valid_lines FROM {_CHECK} GROUP BY action")
def check_dataset(spark, d):
    return checked_files(spark, d).groupBy("action").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("issues", "fixed_lines", "fixed_points", "valid_lines")))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return dedup.content_hash(V.read(spark, d, "documents"), "text").select("doc_id", "sha256")


@query("SELECT doc_id, first_path, sha256(text) AS sha256 FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first_path FROM documents) WHERE doc_id <> first_path")
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(V.read(spark, d, "documents"), "text", "doc_id")


@query("SELECT sha256(string_agg(line, '' ORDER BY bucket)) AS digest, sum(n)::BIGINT AS files FROM (SELECT bucket, sha256(string_agg(doc_id::VARCHAR || ':' || sha256(text) || chr(10), '' ORDER BY doc_id::VARCHAR)) AS line, count(*) AS n FROM (SELECT doc_id, text, doc_id % 16 AS bucket FROM documents) GROUP BY bucket)")
def dataset_digest(spark, d):
    """Buckets here by id, as DuckDB has no CRC; the operator's own are by CRC of the path."""
    rows = V.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return dedup.dataset_digest(rows, "doc_id", "sha256", bucket=F.col("doc_id") % 16)


@query(f"""SELECT metric, before, after, after - before AS difference FROM (SELECT unnest(['lines', 'faulty']) AS metric, unnest([count(*)::DOUBLE, count(strict_error)::DOUBLE]) AS before, unnest([count(*)::DOUBLE, count(error_type)::DOUBLE]) AS after FROM {V.VALIDATED})""")
def change_summary(spark, d):
    lines = V.label_lines(spark, d)
    before = C.validate_lines(lines, V.CLASSES, "strict").agg(F.count("*").alias("lines"), F.count("error_type").alias("faulty"))
    after = V.validated(spark, d).agg(F.count("*").alias("lines"), F.count("error_type").alias("faulty"))
    return stats.change_summary(before, after)


_CASES = f"""(SELECT row_number() OVER (ORDER BY split, file_id::VARCHAR, line_no::VARCHAR) AS case_id, * FROM (SELECT split, file_id, line_no, count(*) AS hard_coordinate_count, round(max(amount), 6) AS max_overflow, string_agg(position, ';' ORDER BY point_index, axis, position) AS positions FROM {V.ISSUES} WHERE coordinate_severity = 'hard' GROUP BY ALL))"""


def cases(spark, d) -> DataFrame:
    exceptions = spark.range(0, 100, 7).select(F.col("id").alias("case_id"), F.lit("rejected").alias("review_decision"))
    return freeze.review_cases(issues(spark, d), exceptions, "repair_confirmed").withColumn("max_overflow", F.round("max_overflow", 6))


_DECISION = "CASE WHEN case_id < 100 AND case_id % 7 = 0 THEN 'rejected' ELSE 'repair_confirmed' END AS review_decision"


@query(f"SELECT *, {_DECISION} FROM {_CASES}")
def review_cases(spark, d):
    return cases(spark, d)


@query(f"SELECT case_id, (case_id - 1) // 12 + 1 AS sheet, ((case_id - 1) % 12) // 3 + 1 AS sheet_row, (case_id - 1) % 12 % 3 + 1 AS sheet_column FROM {_CASES}")
def review_pages(spark, d):
    return freeze.review_pages(cases(spark, d)).select("case_id", "sheet", "sheet_row", "sheet_column")


@query(f"SELECT review_decision, count(*) AS n FROM (SELECT {_DECISION} FROM {_CASES}) GROUP BY 1")
def review_tally(spark, d):
    return freeze.review_tally(cases(spark, d))


# --- runs and predictions ---------------------------------------------------------------------------------------------


@query("SELECT event_type AS run, (row_number() OVER (PARTITION BY event_type ORDER BY day))::INTEGER AS epoch, round(box + cls, 6) AS train_loss, round(v, 6) AS val_loss FROM (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS box, min(value) AS cls, max(value) AS v FROM events GROUP BY ALL)")
def loss_curves(spark, d):
    wide = V.read(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("train/box_loss"), F.min("value").alias("train/cls_loss"), F.max("value").alias("val/box_loss"))
    return evaluation.loss_curves(wide, "run", "day").select("run", "epoch", r6("train_loss"), r6("val_loss"))


@query("SELECT event_type || '_' || (user_id % 3)::VARCHAR AS key, sum(regexp_extract(props, '([0-9]+)', 1)::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def map_sum(spark, d):
    e = V.read(spark, d, "events")
    m = F.create_map(F.concat("event_type", F.lit("_"), (F.col("user_id") % 3).cast("string")), F.element_at(F.from_json("props", "map<string,long>"), "k"))
    return evaluation.map_sum(e.select(m.alias("m")), "m")


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:10], lambda x: x::DOUBLE)) / 10, 6) AS mean FROM embeddings")
def array_mean(spark, d):
    return V.read(spark, d, "embeddings").select("vec_id", F.round(C.mean_or_zero(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))), 6).alias("mean"))


@query(f"SELECT string_agg(class_id::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY class_id) AS counts FROM (SELECT class_id, count(*) AS n FROM {V.INSTANCES} WHERE class_id IS NOT NULL GROUP BY class_id)")
def class_count_map(spark, d):
    m = stats.class_count_map(V.instances(spark, d))
    return m.select(F.array_join(F.transform(F.map_entries("class_counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("counts"))


_RUNS = "(SELECT user_id, CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 4 = 1 THEN NULL ELSE 'run' || user_id::VARCHAR END AS experiment, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'model' || (user_id % 5)::VARCHAR END AS model, CASE WHEN user_id % 7 = 0 THEN 'failed' WHEN user_id % 2 = 0 THEN 'ok' END AS status, CASE WHEN user_id % 2 = 0 THEN max(value) END AS map50, max(value) / 2 AS map_alias FROM events GROUP BY user_id)"


def runs(spark, d) -> DataFrame:
    u = F.col("user_id")
    g = V.read(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("top"))
    return g.select("user_id", F.when(u % 4 == 0, "").when(u % 4 != 1, F.concat(F.lit("run"), u.cast("string"))).alias("experiment"), F.when(u % 3 != 0, F.concat(F.lit("model"), (u % 5).cast("string"))).alias("model"), F.when(u % 7 == 0, "failed").when(u % 2 == 0, "ok").alias("status"), F.when(u % 2 == 0, F.col("top")).alias("mAP50"), (F.col("top") / 2).alias("map50_alias"))


@query(f"SELECT coalesce(nullif(experiment, ''), nullif(model, ''), 'unknown') AS run, round(coalesce(map50, map_alias), 6) AS score FROM {_RUNS} WHERE coalesce(status, 'ok') = 'ok'")
def metric_summary(spark, d):
    return evaluation.metric_summary(runs(spark, d), {"score": ["mAP50", "map50_alias"]}).select("run", r6("score"))


@query("SELECT a.user_id, coalesce(b.v, a.v) AS v FROM (SELECT user_id, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1) a LEFT JOIN (SELECT user_id, max(value) AS v FROM events WHERE event_id % 97 = 1 GROUP BY 1) b USING (user_id) UNION ALL SELECT user_id, max(value) FROM events WHERE event_id % 97 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def overlay(spark, d):
    e = V.read(spark, d, "events")
    top = lambda w: e.where(w).groupBy("user_id").agg(F.max("value").alias("v"))
    return evaluation.overlay(top("event_id % 2 = 0"), top("event_id % 97 = 1"), ["user_id"], ["v"])


@query("SELECT NULL::BIGINT AS doc_id, item_id, NULL::VARCHAR AS lang, length(text)::BIGINT AS size FROM benchmark UNION ALL SELECT doc_id, NULL, lang, n_chars FROM documents")
def hetero_union(spark, d):
    return evaluation.hetero_union([V.read(spark, d, "benchmark").select("item_id", F.length("text").cast("long").alias("size")), V.read(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("size"))])


_TRUTH = "(SELECT DISTINCT user_id AS image, event_type AS class_name FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0)"
_FOUND = "(SELECT user_id AS image, event_type AS class_name, round_even(max(value / 1009), 4) AS confidence FROM events WHERE event_id % 2 = 1 AND value > 50 GROUP BY ALL)"


@query(f"SELECT image, class_name, CASE WHEN t.class_name IS NULL THEN 'false_positive' WHEN confidence IS NULL THEN 'false_negative' ELSE 'matched' END AS case_type, confidence FROM {_TRUTH} t FULL OUTER JOIN {_FOUND} f USING (image, class_name)")
def failure_cases(spark, d):
    truth, found = V.truth_and_predictions(spark, d)
    return evaluation.failure_cases(truth, found, ["image"], "class_name")


@query(f"SELECT image, array_to_string(list_sort(list_intersect(t, f)), ',') AS matched, array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(f, x))), ',') AS missed, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(t, x))), ',') AS surplus FROM (SELECT image, list(class_name) AS t FROM {_TRUTH} GROUP BY 1) JOIN (SELECT image, list(class_name) AS f FROM {_FOUND} GROUP BY 1) USING (image)")
def set_ops(spark, d):
    truth, found = V.truth_and_predictions(spark, d)
    t, f = (x.groupBy("image").agg(F.collect_set("class_name").alias(n)) for x, n in ((truth, "t"), (found, "f")))
    return t.join(f, "image").select("image", evaluation.set_outcome(F.col("t"), F.col("f")).alias("o")).select("image", *(F.array_join(f"o.{c}", ",").alias(c) for c in ("matched", "missed", "surplus")))


@query("SELECT image, string_agg(class_id::VARCHAR || ':' || confidence::VARCHAR, ' ' ORDER BY class_id, confidence) AS predictions FROM (SELECT vec_id AS image, k::INTEGER AS class_id, (vec_id * (k + 3)) % 100 AS confidence FROM embeddings, (SELECT unnest(range(0, 3)) AS k)) WHERE confidence >= 25 GROUP BY image UNION ALL SELECT vec_id, '' FROM embeddings WHERE (vec_id * 3) % 100 < 25 AND (vec_id * 4) % 100 < 25 AND (vec_id * 5) % 100 < 25")
def predictions(spark, d):
    import pandas as pd

    def factory():
        def model(batch):
            rows = [(i, k, (i * (k + 3)) % 100 / 100, 0.0, 0.0, 1.0, 1.0) for i in batch["image"] for k in range(3)]
            return pd.DataFrame(rows, columns=["image", "class_id", "confidence", "x1", "y1", "x2", "y2"])

        return model

    samples = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("image"))
    dim = names(spark, 2).withColumn("class_name", F.concat(F.lit("class"), F.col("class_id").cast("string")))
    out = evaluation.predict(samples, factory, "image long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double", dim)
    flat = F.array_sort(F.transform("predictions", lambda p: F.struct(p["class_id"].alias("c"), F.rint(p["confidence"] * 100).cast("int").alias("s"))))
    return out.select("image", F.array_join(F.transform(flat, lambda p: F.concat_ws(":", p["c"].cast("string"), p["s"].cast("string"))), " ").alias("predictions"))


# --- samples ----------------------------------------------------------------------------------------------------------

_ORDERED = "(SELECT *, md5('7:' || o_orderkey::VARCHAR) AS h, CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, o_orderkey % 7 <> 0 AS ok FROM orders)"


def order_items(spark, d) -> DataFrame:
    return V.read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "val").otherwise("train").alias("split"), (F.col("o_orderkey") % 7 != 0).alias("ok"))


@query(f"SELECT o_orderkey, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY h) AS r, count(*) OVER () AS n FROM {_ORDERED})")
def ratio_split(spark, d):
    return sampling.ratio_split(order_items(spark, d).drop("split", "ok"), "o_orderkey", (0.7, 0.2, 0.1), 7)


@query(f"SELECT o_orderkey, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h) AS r FROM {_ORDERED}) WHERE r <= CASE split WHEN 'train' THEN 200 ELSE 50 END")
def fixed_sample(spark, d):
    return sampling.sample_per_split(order_items(spark, d), "o_orderkey", {"train": 200, "val": 50}, 7).select("o_orderkey", "split")


@query(f"SELECT o_orderkey FROM (SELECT *, sum(ok::INTEGER) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) AS c FROM {_ORDERED}) WHERE ok AND c <= 300")
def backfill_sample(spark, d):
    return sampling.backfill_sample(order_items(spark, d), "o_orderkey", "ok", 300, 7)[0].select("o_orderkey")


@query(f"SELECT o_orderkey, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h) AS r FROM {_ORDERED}) WHERE r <= CASE split WHEN 'train' THEN 30 ELSE 31 END")
def balanced_sample(spark, d):
    return sampling.balanced_sample(order_items(spark, d), "o_orderkey", ["train", "val"], 61, 7).select("o_orderkey", "split")


@query(f"SELECT doc_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY filename, doc_id) AS r FROM {V.DOCUMENTS}) WHERE r <= 25")
def first_n_per_split(spark, d):
    return sampling.first_per_split(V.documents(spark, d), ["filename", "doc_id"], 25).select("doc_id", "split")


@query(f"""WITH RECURSIVE s AS (SELECT file_id, list_sort(list_distinct(list(class_id::INTEGER))) AS cs, bit_or(1::BIGINT << class_id::BIGINT) AS m FROM {V.INSTANCES} WHERE class_id IS NOT NULL GROUP BY file_id),
  k AS (SELECT m, min(file_id) AS file_id FROM s GROUP BY m),
  r AS (SELECT 0 AS step, NULL::BIGINT AS file_id, 0::BIGINT AS covered
    UNION ALL SELECT step, file_id, covered FROM (SELECT r.step + 1 AS step, k.file_id, r.covered | k.m AS covered, bit_count(k.m & ~r.covered) AS gain FROM r, k WHERE r.step < 12 ORDER BY gain DESC, k.file_id LIMIT 1) WHERE gain > 0),
  rest AS (SELECT file_id FROM s WHERE file_id NOT IN (SELECT file_id FROM r WHERE step > 0) ORDER BY file_id LIMIT (SELECT 12 - max(step) FROM r))
  SELECT file_id, array_to_string(cs, ',') AS classes FROM s WHERE file_id IN (SELECT file_id FROM r WHERE step > 0 UNION ALL SELECT file_id FROM rest)""")
def class_diverse(spark, d):
    sets = V.instances(spark, d).where("class_id is not null").groupBy("file_id").agg(F.array_sort(F.collect_set("class_id")).alias("classes"))
    return sampling.class_diverse(sets, "file_id", "classes", 12).select("file_id", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))


# --- the whole statistics, from one parse -----------------------------------------------------------------------------

_AL, _AF = V.ANALYZED_LINES, V.ANALYZED
_OFFSET = "list_max(list_transform({c}, lambda v: greatest(-v, v - 1.0::DOUBLE, 0.0::DOUBLE)))"


def _analyzed_distribution(what: str) -> str:
    return f"SELECT class_id, coalesce(train, 0) AS train, coalesce(val, 0) AS val, coalesce(train, 0) + coalesce(val, 0) AS total FROM {_CLASSES} LEFT JOIN (SELECT class_id, count({what}) FILTER (split = 'train') AS train, count({what}) FILTER (split = 'val') AS val FROM {_AL} WHERE class_id IS NOT NULL GROUP BY class_id) USING (class_id)"


@query(_analyzed_distribution("DISTINCT file_id"))
def analysis_class_images(spark, d):
    return V.analysis(spark, d).tables["class_image_distribution"]


@query(_analyzed_distribution("file_id"))
def analysis_class_instances(spark, d):
    return V.analysis(spark, d).tables["class_instance_distribution"]


_INVALID = f"""(SELECT split, file_id, line_no, class_id, 'polygon_coordinate_range' AS issue_type, 'soft' AS severity, coords AS c FROM {_AL} WHERE soft
  UNION ALL SELECT split, file_id, line_no, class_id, hard, 'hard', CASE hard WHEN 'polygon_coordinate_range' THEN coords WHEN 'polygon_geometry' THEN used END FROM {_AL} WHERE hard IS NOT NULL)"""


@query(f"SELECT split, file_id, line_no, class_id, issue_type, severity, list_min(c) AS min_coordinate, list_max(c) AS max_coordinate, round({_OFFSET.format(c='c')}, 9) AS max_offset FROM {_INVALID}")
def analysis_invalid_lines(spark, d):
    return V.analysis(spark, d).tables["invalid_annotations"].withColumn("max_offset", F.round("max_offset", 9))


_AC = f"(SELECT x.* FROM {V.ISSUES} x JOIN (SELECT DISTINCT file_id FROM {_AL}) USING (file_id))"
_COORDINATES = f"SELECT split, file_id, line_no, class_id, point_index, axis, position, value, boundary, direction, round(amount, 6) AS amount, coordinate_severity, line_severity, reset_value, action FROM {_AC}"


@query(_COORDINATES)
def analysis_coordinates(spark, d):
    return V.analysis(spark, d).tables["out_of_bounds_coordinates"].withColumn("amount", F.round("amount", 6))


@query(_COORDINATES + " WHERE line_severity = 'hard'")
def analysis_hard_coordinates(spark, d):
    return V.analysis(spark, d).tables["hard_error_coordinates"].withColumn("amount", F.round("amount", 6))


@query(f"""SELECT h.class_id, class_files, instances, files, lines, coordinates, low, high, round(most, 6) AS most, round(files / class_files::DOUBLE, 6) AS file_ratio FROM (SELECT class_id, count(DISTINCT file_id) AS files, count(DISTINCT (file_id, line_no)) AS lines, count(*) AS coordinates, min(value) AS low, max(value) AS high, max(amount) AS most FROM {_AC} WHERE line_severity = 'hard' GROUP BY class_id) h
  JOIN (SELECT class_id, count(DISTINCT file_id) AS class_files, count(*) AS instances FROM {_AL} WHERE class_id IS NOT NULL GROUP BY class_id) i ON h.class_id = i.class_id""")
def analysis_hard_by_class(spark, d):
    return V.analysis(spark, d).tables["hard_error_by_class"].withColumns({"most": F.round("most", 6), "file_ratio": F.round("file_ratio", 6)})


_AI = f"(SELECT a.split, a.file_id, a.width, a.height, coalesce(n, 0) AS instances, negative, l OR negative AS labelled, a.error FROM {_AF} a LEFT JOIN (SELECT file_id, count(class_id) AS n FROM {_AL} GROUP BY file_id) USING (file_id) WHERE i AND NOT dropped)"


@query(f"SELECT split, file_id, width, height, CASE WHEN height <> 0 THEN round(width / height::DOUBLE, 9) ELSE 0.0 END AS aspect_ratio, instances, negative AS is_negative, labelled AS has_effective_label, error FROM {_AI}")
def analysis_images(spark, d):
    return V.analysis(spark, d).tables["image_statistics"].withColumn("aspect_ratio", F.round("aspect_ratio", 9))


_AO = f"""(SELECT *, CASE WHEN bbox_area_px < 1024 THEN 'small' WHEN bbox_area_px < 9216 THEN 'medium' ELSE 'large' END AS size FROM (SELECT split, file_id, line_no, class_id, geometry_status, width, height, bw * width AS bbox_width_px, bh * height AS bbox_height_px, bw * width * (bh * height) AS bbox_area_px, bw * bh AS bbox_area_relative, mask * width * height AS mask_area_px, mask AS mask_area_relative
  FROM (SELECT *, list_max(xs) - list_min(xs) AS bw, list_max(ys) - list_min(ys) AS bh, abs({V.signed_sql('used')}) AS mask FROM (SELECT *, list_transform(range(0, len(used) // 2), lambda i: used[2 * i + 1]) AS xs, list_transform(range(0, len(used) // 2), lambda i: used[2 * i + 2]) AS ys FROM {_AL} WHERE geometry_status IS NOT NULL AND error IS NULL))))"""
_MEASURES = ("bbox_width_px", "bbox_height_px", "bbox_area_px", "bbox_area_relative", "mask_area_px", "mask_area_relative")


@query(f"SELECT split, file_id, line_no, class_id, 'group' || (class_id % 3)::VARCHAR || '--class' || class_id::VARCHAR AS class_name, 'group' || (class_id % 3)::VARCHAR AS class_group, geometry_status, width, height, {', '.join(f'round({c}, 6) AS {c}' for c in _MEASURES)}, size FROM {_AO}")
def analysis_objects(spark, d):
    return V.analysis(spark, d).tables["object_statistics"].withColumns({c: F.round(c, 6) for c in _MEASURES})


@query(f"""SELECT s.split, c.class_id, coalesce(objects, 0) AS objects, coalesce(small, 0) AS small, coalesce(medium, 0) AS medium, coalesce(large, 0) AS large, round(coalesce(mean_area_px, 0.0), 4) AS mean_area_px, round(coalesce(median_area_px, 0.0), 4) AS median_area_px, round(coalesce(mean_mask, 0.0), 6) AS mean_mask, round(coalesce(median_mask, 0.0), 6) AS median_mask,
  round(coalesce(small / objects::DOUBLE, 0.0), 6) AS small_ratio, round(coalesce(medium / objects::DOUBLE, 0.0), 6) AS medium_ratio, round(coalesce(large / objects::DOUBLE, 0.0), 6) AS large_ratio
  FROM {_CLASSES} c CROSS JOIN (SELECT unnest(['train', 'val', 'total']) AS split) s LEFT JOIN (SELECT CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split, class_id, count(*) AS objects, count(*) FILTER (size = 'small') AS small, count(*) FILTER (size = 'medium') AS medium, count(*) FILTER (size = 'large') AS large,
  avg(bbox_area_px) AS mean_area_px, median(bbox_area_px) AS median_area_px, avg(mask_area_relative) AS mean_mask, median(mask_area_relative) AS median_mask FROM {_AO} GROUP BY GROUPING SETS ((split, class_id), (class_id))) g ON g.split = s.split AND g.class_id = c.class_id""")
def analysis_object_sizes(spark, d):
    out = V.analysis(spark, d).tables["object_size_by_class"]
    return out.select("split", "class_id", "objects", "small", "medium", "large", *(F.round(c, 4).alias(c) for c in ("mean_area_px", "median_area_px")), *(r6(c) for c in ("mean_mask", "median_mask", "small_ratio", "medium_ratio", "large_ratio")))


@query(f"SELECT split, file_id, error AS reason FROM {_AF} WHERE i AND NOT dropped AND error IS NOT NULL")
def analysis_read_errors(spark, d):
    return V.analysis(spark, d).tables["image_read_errors"]


@query(f"SELECT split, file_id, action, issue, reason, decision_status FROM {_AF} WHERE i AND issue = 'missing_label'")
def analysis_corrupted(spark, d):
    return V.analysis(spark, d).tables["corrupted_images_by_filter"]


_BEYOND = "len(list_filter(coords, lambda v: NOT v BETWEEN 0.0::DOUBLE AND 1.0::DOUBLE))"


@query(f"""SELECT CASE WHEN grouping(a.split) = 1 THEN 'total' ELSE a.split END AS split, count(*) FILTER (i) AS raw_images, count(*) FILTER (l) AS raw_labels, count(*) FILTER (i AND NOT dropped) AS images, count(*) FILTER ((l AND NOT dropped) OR negative) AS labels, count(*) FILTER (paired) AS paired,
  count(*) FILTER (i AND NOT dropped AND NOT l AND NOT negative) AS missing_labels, count(*) FILTER (l AND NOT i) AS orphan_labels, count(*) FILTER (negative OR (paired AND coalesce(n, 0) = 0 AND coalesce(e, 0) = 0)) AS empty_labels, count(*) FILTER (negative AND NOT l) AS virtual_empty_labels,
  count(*) FILTER (action = 'exclude') AS excluded_by_filter, count(*) FILTER (action = 'review') AS review_by_filter, count(*) FILTER (negative) AS negative_by_filter, count(*) FILTER (i AND issue = 'missing_label') AS corrupted_by_filter,
  coalesce(sum(n), 0)::BIGINT AS instances, coalesce(sum(v), 0)::BIGINT AS usable_polygon_instances, coalesce(sum(s), 0)::BIGINT AS soft_clippable_instances, coalesce(sum(v + s), 0)::BIGINT AS geometry_instances, coalesce(sum(v + s) FILTER (error IS NULL), 0)::BIGINT AS sized_geometry_instances,
  coalesce(sum(h), 0)::BIGINT AS hard_invalid_lines, coalesce(sum(e), 0)::BIGINT AS invalid_lines, coalesce(sum(sc + hc), 0)::BIGINT AS out_of_bounds_coordinates, coalesce(sum(sc), 0)::BIGINT AS soft_reset_coordinates, coalesce(sum(hc), 0)::BIGINT AS hard_review_coordinates,
  count(*) FILTER (i AND NOT dropped AND error IS NOT NULL) AS image_read_errors
  FROM {_AF} a LEFT JOIN (SELECT file_id, count(class_id) AS n, count(*) FILTER (geometry_status = 'valid') AS v, count(*) FILTER (geometry_status = 'soft_clipped') AS s, count(hard) AS h, count(hard) + count(*) FILTER (soft) AS e,
  coalesce(sum({_BEYOND}) FILTER (soft), 0) AS sc, coalesce(sum({_BEYOND}) FILTER (hard = 'polygon_coordinate_range'), 0) AS hc FROM {_AL} GROUP BY file_id) USING (file_id) GROUP BY ROLLUP (a.split)""")
def analysis_splits(spark, d):
    return V.analysis(spark, d).tables["split_statistics"]


@query(f"""SELECT r.*, x.*, m.*, o.* FROM (SELECT count(*) FILTER (severity = 'soft') AS soft_lines, count(*) FILTER (severity = 'hard') AS hard_lines, count(DISTINCT file_id) AS affected_files, min(list_min(c)) AS minimum_coordinate, max(list_max(c)) AS maximum_coordinate, round(coalesce(max({_OFFSET.format(c='c')}), 0.0), 9) AS maximum_offset FROM {_INVALID} WHERE issue_type = 'polygon_coordinate_range') r,
  (SELECT count(*) FILTER (direction = 'below') AS below_zero, count(*) FILTER (direction = 'above') AS above_one, count(DISTINCT file_id) FILTER (line_severity = 'hard') AS hard_images, count(DISTINCT class_id) FILTER (line_severity = 'hard') AS hard_classes, round(max(amount) FILTER (line_severity = 'hard'), 9) AS hard_maximum_overflow FROM {_AC}) x,
  (SELECT count(*) FILTER (width > 0) AS readable_images, min(width) FILTER (width > 0) AS minimum_width, max(width) AS maximum_width, min(height) FILTER (width > 0) AS minimum_height, max(height) AS maximum_height, round(avg(instances), 9) AS mean_objects, max(instances) AS maximum_objects, count(*) FILTER (instances = 0) AS images_without_objects,
  median(width) FILTER (width > 0) AS median_width, median(height) FILTER (width > 0) AS median_height, median(instances) AS median_objects FROM {_AI}) m,
  (SELECT count(*) FILTER (size = 'small') AS small_objects, count(*) FILTER (size = 'medium') AS medium_objects, count(*) FILTER (size = 'large') AS large_objects FROM {_AO}) o""")
def analysis_summary(spark, d):
    return V.analysis(spark, d).summary().withColumns({c: F.round(c, 9) for c in ("maximum_offset", "hard_maximum_overflow", "mean_objects")})


# --- composites -------------------------------------------------------------------------------------------------------


def leak_prints(spark, d) -> DataFrame:
    p = V.prints(spark, d)
    i = F.col("id")
    return p.select(i.cast("string").alias("id"), "split", F.when(i % 9 != 0, F.concat(F.lit("c"), (i % 50).cast("string"))).otherwise("").alias("capture_key"), F.floor(i / 50).alias("frame"), F.concat(F.lit("b"), (i % 40).cast("string")).alias("part_key"), "hash", F.when(i % 101 == 0, "broken").alias("decode_error"))


_LEAK = f"(SELECT id::VARCHAR AS id, split, CASE WHEN id % 9 <> 0 THEN 'c' || (id % 50)::VARCHAR ELSE '' END AS capture_key, id // 50 AS frame, 'b' || (id % 40)::VARCHAR AS part_key, hash FROM {V.PRINTS} WHERE id % 101 <> 0)"
_LEAK_ADJ = f"(SELECT t.id AS train_id, v.id AS val_id FROM {_LEAK} t JOIN {_LEAK} v USING (capture_key) WHERE capture_key <> '' AND t.split = 'train' AND v.split = 'val' AND abs(t.frame - v.frame) <= 3)"
_LEAK_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY hash, split ORDER BY id) AS place FROM {_LEAK})"
_LEAK_SAME = f"(SELECT t.id AS train_id, v.id AS val_id FROM {_LEAK_RANKED} t JOIN {_LEAK_RANKED} v ON t.hash = v.hash WHERE t.split = 'train' AND v.split = 'val' AND t.place <= 10 AND v.place <= 10)"
_LEAK_CHUNKS = f"(SELECT id, split, hash, k, (hash >> (16 * k)) & 65535 AS c FROM {_LEAK}, (SELECT unnest(range(0, 4)) AS k))"
_LEAK_NEAR = f"""(SELECT DISTINCT t.id AS train_id, v.id AS val_id, bit_count(xor(t.hash, v.hash)) AS distance FROM {_LEAK_CHUNKS} t JOIN {_LEAK_CHUNKS} v ON t.k = v.k AND t.c = v.c JOIN (SELECT k, c FROM {_LEAK_CHUNKS} GROUP BY ALL HAVING count(*) FILTER (split = 'train') * count(*) FILTER (split = 'val') BETWEEN 1 AND 50000) s ON s.k = t.k AND s.c = t.c WHERE t.split = 'train' AND v.split = 'val' AND bit_count(xor(t.hash, v.hash)) <= 4)"""
_NOT_ADJ = f"(train_id, val_id) NOT IN (SELECT (train_id, val_id) FROM {_LEAK_ADJ})"


_REPORT = f"""SELECT 'full_decode_error' AS risk_type, count(*) AS n FROM documents WHERE doc_id % 101 = 0 UNION ALL SELECT 'cross_split_group', count(*) FROM (SELECT part_key FROM {_LEAK} GROUP BY 1 HAVING count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'val') > 0)
  UNION ALL SELECT 'adjacent_frame', count(*) FROM {_LEAK_ADJ} UNION ALL SELECT 'identical_hash', count(*) FROM {_LEAK_SAME} WHERE {_NOT_ADJ} UNION ALL SELECT 'near_duplicate', least(50000, count(*)) FROM {_LEAK_NEAR} WHERE {_NOT_ADJ}"""


@query(f"SELECT * FROM ({_REPORT}) WHERE n > 0")
def risk_counts(spark, d):
    """Within the reference's limits, as its SQL; ``risk_counts_whole`` has none."""
    return leakage.risk_counts(leakage.leakage_report(leak_prints(spark, d), capped=True))


_LEAK_PAIRS = f"(SELECT t.id AS train_id, v.id AS val_id, bit_count(xor(t.hash, v.hash))::INTEGER AS distance FROM {_LEAK} t JOIN {_LEAK} v ON bit_count(xor(t.hash, v.hash)) <= 4 WHERE t.split = 'train' AND v.split = 'val')"
_REPORT_WHOLE = f"""SELECT 'full_decode_error' AS risk_type, count(*) AS n FROM documents WHERE doc_id % 101 = 0 UNION ALL SELECT 'cross_split_group', count(*) FROM (SELECT part_key FROM {_LEAK} GROUP BY 1 HAVING count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'val') > 0)
  UNION ALL SELECT 'adjacent_frame', count(*) FROM {_LEAK_ADJ} UNION ALL SELECT 'identical_hash', count(*) FROM {_LEAK_SAME} WHERE {_NOT_ADJ} UNION ALL SELECT 'near_duplicate', count(*) FROM {_LEAK_PAIRS} WHERE {_NOT_ADJ}"""


@query(f"SELECT * FROM ({_REPORT_WHOLE}) WHERE n > 0")
def risk_counts_whole(spark, d):
    return leakage.risk_counts(leakage.leakage_report(leak_prints(spark, d)))


@query(f"SELECT 'identical_hash' AS risk_type, train_id AS train_image, val_id AS val_image, 0 AS dhash_distance FROM {_LEAK_SAME} WHERE {_NOT_ADJ} UNION ALL SELECT 'adjacent_frame', train_id, val_id, NULL FROM {_LEAK_ADJ}")
def leakage_report(spark, d):
    return leakage.leakage_report(leak_prints(spark, d)).where("risk_type in ('identical_hash', 'adjacent_frame')").select("risk_type", "train_image", "val_image", "dhash_distance")


_LEAK_COUNTED = f"(SELECT *, row_number() OVER (PARTITION BY hash, split ORDER BY id) AS place, count(*) OVER (PARTITION BY hash, split) AS n FROM {_LEAK})"


@query(f"""SELECT 'full_decode_error' AS risk_type, NULL::VARCHAR AS group_key, CASE WHEN split = 'train' THEN id::VARCHAR END AS train_image, CASE WHEN split = 'val' THEN id::VARCHAR END AS val_image, NULL::BIGINT AS frame_delta, NULL::INTEGER AS dhash_distance, NULL::BIGINT AS train_group_count, NULL::BIGINT AS val_group_count, 'broken' AS note FROM {V.PRINTS} WHERE id % 101 = 0
  UNION ALL SELECT 'cross_split_group', 'p' || (id::BIGINT % 39)::VARCHAR AS part, NULL, NULL, NULL, NULL, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b, NULL FROM {_LEAK} GROUP BY part HAVING a > 0 AND b > 0
  UNION ALL SELECT 'adjacent_frame', capture_key, t.id, v.id, abs(t.frame - v.frame), NULL, NULL, NULL, NULL FROM {_LEAK} t JOIN {_LEAK} v USING (capture_key) WHERE capture_key <> '' AND t.split = 'train' AND v.split = 'val' AND abs(t.frame - v.frame) <= 3
  UNION ALL SELECT 'identical_hash', lower(printf('%016x', t.hash)), t.id, v.id, NULL, 0, t.n, v.n, CASE WHEN greatest(t.n, v.n) > 10 THEN 'first 10 of a side' END FROM {_LEAK_COUNTED} t JOIN {_LEAK_COUNTED} v ON t.hash = v.hash WHERE t.split = 'train' AND v.split = 'val' AND t.place <= 10 AND v.place <= 10 AND (t.id, v.id) NOT IN (SELECT (train_id, val_id) FROM {_LEAK_ADJ})
  UNION ALL SELECT 'near_duplicate', NULL, train_id, val_id, NULL, distance, NULL, NULL, NULL FROM {_LEAK_PAIRS} WHERE {_NOT_ADJ}""")
def leakage_report_whole(spark, d):
    """All five risks with all their columns; ``leakage_report`` selects two of them. Parts by 39, as those by 40 never cross the splits."""
    part = F.concat(F.lit("p"), (F.col("id").cast("long") % 39).cast("string"))
    return leakage.leakage_report(leak_prints(spark, d).withColumn("part_key", part))


_LEAK_HASHES = f"(SELECT hash, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b, min(id) FILTER (split = 'train') AS train_id, min(id) FILTER (split = 'val') AS val_id FROM {_LEAK} GROUP BY hash)"


@query(f"""SELECT 'full_decode_error' AS risk_type, NULL::VARCHAR AS group_key, CASE WHEN split = 'train' THEN id::VARCHAR END AS train_image, CASE WHEN split = 'val' THEN id::VARCHAR END AS val_image, NULL::BIGINT AS frame_delta, NULL::INTEGER AS dhash_distance, NULL::BIGINT AS train_group_count, NULL::BIGINT AS val_group_count, 'broken' AS note FROM {V.PRINTS} WHERE id % 101 = 0
  UNION ALL SELECT 'cross_split_group', 'p' || (id::BIGINT % 39)::VARCHAR AS part, NULL, NULL, NULL, NULL, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b, NULL FROM {_LEAK} GROUP BY part HAVING a > 0 AND b > 0
  UNION ALL SELECT 'adjacent_frame', capture_key, t.id, v.id, abs(t.frame - v.frame), NULL, NULL, NULL, NULL FROM {_LEAK} t JOIN {_LEAK} v USING (capture_key) WHERE capture_key <> '' AND t.split = 'train' AND v.split = 'val' AND abs(t.frame - v.frame) <= 3
  UNION ALL SELECT 'identical_hash', lower(printf('%016x', hash)), train_id, val_id, NULL, 0, a, b, NULL FROM {_LEAK_HASHES} WHERE a > 0 AND b > 0
  UNION ALL SELECT 'near_duplicate', lower(printf('%016x', t.hash)) || '-' || lower(printf('%016x', v.hash)), t.train_id, v.val_id, NULL, bit_count(xor(t.hash, v.hash))::INTEGER, t.a, v.b, NULL FROM {_LEAK_HASHES} t JOIN {_LEAK_HASHES} v ON bit_count(xor(t.hash, v.hash)) BETWEEN 1 AND 4 WHERE t.a > 0 AND v.b > 0""")
def leakage_classes(spark, d):
    """All five risks, hashes as classes: nothing cut, no pairs of files."""
    part = F.concat(F.lit("p"), (F.col("id").cast("long") % 39).cast("string"))
    return leakage.leakage_report(leak_prints(spark, d).withColumn("part_key", part), classes=True)


@query(f"""SELECT split, count(*) AS lines, count(strict_error) AS faults, CASE WHEN split = 'val' THEN 0 ELSE (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) END::BIGINT AS missing, 0::BIGINT AS orphan, count(strict_error) = 0 AND split = 'val' AS passed FROM {V.VALIDATED} GROUP BY split""")
def gate(spark, d):
    lines = V.validated(spark, d, "strict").select("split", "error_type")
    docs, labels = V.read(spark, d, "documents").select("doc_id", F.lit("train").alias("split")), V.read(spark, d, "labels")
    out = freeze.gate(lines, pairing.missing_labels(docs, labels, ["doc_id"]), docs.limit(0))
    return lines.groupBy("split").agg(F.count("*").alias("lines")).join(out, "split")


@query(f"""SELECT *, faults + missing + orphan = 0 AS passed FROM (SELECT split, count(*) AS lines, count(strict_error) AS faults, CASE WHEN split = 'val' THEN 0 ELSE (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) END::BIGINT AS missing, CASE WHEN split = 'val' THEN 0 ELSE (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) END::BIGINT AS orphan FROM {V.VALIDATED} GROUP BY split)""")
def gate_orphans(spark, d):
    """The gate with orphans: labels without an English document, as in ``error_type_counts``, counted to train."""
    lines = V.validated(spark, d, "strict").select("split", "error_type")
    docs, labels = V.read(spark, d, "documents").withColumn("split", F.lit("train")), V.read(spark, d, "labels").withColumn("split", F.lit("train"))
    out = freeze.gate(lines, pairing.missing_labels(docs, labels, ["doc_id"]), pairing.orphan_labels(docs.where("lang = 'en'"), labels, ["doc_id"]))
    return lines.groupBy("split").agg(F.count("*").alias("lines")).join(out, "split")


@query(f"SELECT count(*) AS repaired, 0::BIGINT AS still_faulty FROM {_REPAIRED}")
def repair_then_strict(spark, d):
    fixed = V.validated(spark, d).where("fixed_line is not null").select(F.col("fixed_line").alias("raw"))
    return C.validate_lines(fixed, V.CLASSES, "strict").agg(F.count("*").alias("repaired"), F.count("error_type").alias("still_faulty"))


@query(f"SELECT split, file_id, line_no, error_type FROM {V.VALIDATED} WHERE error_type IS NOT NULL")
def repair_gate_faults(spark, d):
    """What stops the gate after soft repair: the hard and invalid lines."""
    return freeze.repair_gate(V.label_lines(spark, d), V.CLASSES)[1].select("split", "file_id", "line_no", "error_type")


@query(f"SELECT split, count(*) AS lines, count(*) FILTER (soft_points > 0) AS repaired, coalesce(sum(soft_points), 0)::BIGINT AS fixed_points FROM {V.VALIDATED} WHERE error_type IS NULL GROUP BY split")
def repair_gate_passed(spark, d):
    passed = freeze.repair_gate(V.label_lines(spark, d), V.CLASSES)[0]
    return passed.groupBy("split").agg(F.count("*").alias("lines"), F.count_if(F.col("fixed_points") > 0).alias("repaired"), F.sum("fixed_points").cast("long").alias("fixed_points"))


_FROZEN = f"""(SELECT file_id, line_no, CASE WHEN repaired THEN array_to_string(list_prepend(head, list_transform(range(1, len(rest) + 1), lambda i: CASE WHEN used[i] = 0 THEN '0' WHEN used[i] = 1 THEN '1' ELSE rest[i] END)), ' ') ELSE raw END AS text, repaired,
  CASE WHEN repaired THEN CASE WHEN {V.distinct_sql('used')} < 3 THEN 'polygon_geometry' END WHEN error_type = 'polygon_coordinate_range' THEN 'unconfirmed_hard_range' ELSE error_type END AS violation
  FROM (SELECT *, (error_type IS NULL AND soft_points > 0) OR (coalesce(error_type, '') = 'polygon_coordinate_range' AND file_id % 4 = 0) AS repaired FROM {V.VALIDATED} v WHERE raw <> '' AND file_id IN (SELECT file_id FROM {V.FILES} WHERE status = 'kept')))"""


def frozen(spark, d) -> DataFrame:
    found = issues(spark, d).where("coordinate_severity = 'hard' and file_id % 4 < 2")
    reviews = found.select("file_id", "line_no", F.when(F.col("file_id") % 2 == 0, "repair_confirmed").otherwise("rejected").alias("review_decision"))
    return freeze.frozen_lines(V.label_lines(spark, d).where("raw <> ''"), V.files(spark, d), reviews, V.CLASSES)


@query(f"SELECT * FROM {_FROZEN}")
def frozen_lines(spark, d):
    return frozen(spark, d)


@query(f"""SELECT file_id, split, coalesce(text, '') AS text, coalesce(lines, 0) AS lines, coalesce(repaired, 0) AS repaired, coalesce(violations, 0) AS violations, sha256(coalesce(text, '')) AS sha256 FROM {V.FILES}
  LEFT JOIN (SELECT file_id, string_agg(text, chr(10) ORDER BY line_no, text) FILTER (violation IS NULL) AS text, count(*) FILTER (violation IS NULL) AS lines, count(*) FILTER (repaired) AS repaired, count(violation) AS violations FROM {_FROZEN} GROUP BY file_id) USING (file_id) WHERE status IN ('kept', 'kept_negative')""")
def frozen_files(spark, d):
    """The freeze as a chain: decisions, reviewed repair, validation of what was repaired, one text and digest a file."""
    return freeze.frozen_files(V.files(spark, d), frozen(spark, d))


@query(f"""SELECT CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split, count(i) AS raw_images, count(l) AS raw_labels, count(*) FILTER (dropped) AS dropped_images, count(l) FILTER (dropped) AS dropped_labels, count(*) FILTER (negative) AS negatives, count(l) FILTER (negative) AS negatives_with_label,
  count(*) FILTER (negative AND l IS NULL) AS virtual_empty_labels, count(i) FILTER (NOT dropped) AS images, count(*) FILTER (negative OR (l IS NOT NULL AND NOT dropped)) AS labels, count(i) FILTER (NOT dropped AND (negative OR l IS NOT NULL)) AS paired,
  count(i) FILTER (NOT dropped AND NOT negative AND l IS NULL) AS missing, count(l) FILTER (i IS NULL) AS orphan FROM (SELECT split, i.file_id AS i, l.file_id AS l, coalesce(status = 'dropped', FALSE) AS dropped, coalesce(status = 'kept_negative', FALSE) AS negative
  FROM (SELECT * FROM {V.FILES} WHERE file_id % 6 <> 1) i FULL JOIN (SELECT * EXCLUDE (status) FROM {V.FILES} WHERE file_id % 5 <> 2) l USING (file_id, split)) GROUP BY ROLLUP (split)""")
def file_counters(spark, d):
    """Every sixth file has no image, every fifth no label."""
    files = V.files(spark, d)
    return stats.file_counters(files.where("file_id % 6 <> 1"), files.where("file_id % 5 <> 2"), "file_id")


@query(f"""SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM {V.INSTANCES} WHERE class_id IS NOT NULL) AS instances, (SELECT sha256(string_agg(doc_id::VARCHAR || ':' || sha256(text) || chr(10), '' ORDER BY doc_id::VARCHAR)) FROM documents) AS digest""")
def freeze_manifest(spark, d):
    files = V.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return freeze.manifest(files, V.instances(spark, d).where("class_id is not null"), "doc_id", stream=True).select("files", "instances", "digest")


def _tree_sql(files: str) -> str:
    """Nodes of the digest tree of ``files`` (path, sha)."""
    out = f"t4 AS (SELECT prefix, sha256(string_agg(path || ':' || sha || chr(10), '' ORDER BY path, sha)) AS digest, count(*) AS files FROM (SELECT sha256(path)[1:4] AS prefix, path, sha FROM {files}) GROUP BY prefix)"
    for k in (3, 2, 1, 0):
        out += f", t{k} AS (SELECT prefix[1:{k}] AS prefix, sha256(string_agg(prefix || ':' || digest || chr(10), '' ORDER BY prefix)) AS digest, sum(files)::BIGINT AS files FROM t{k + 1} GROUP BY prefix[1:{k}])"
    return out


_DOC_FILES = "(SELECT doc_id::VARCHAR AS path, sha256(text) AS sha FROM documents)"


def doc_files(spark, d) -> DataFrame:
    return V.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))


@query(f"WITH {_tree_sql(_DOC_FILES)} SELECT 4 AS level, * FROM t4 UNION ALL SELECT 3, * FROM t3 UNION ALL SELECT 2, * FROM t2 UNION ALL SELECT 1, * FROM t1 UNION ALL SELECT 0, * FROM t0")
def digest_tree(spark, d):
    return dedup.digest_tree(doc_files(spark, d), "path", "sha256")


@query(f"""WITH {_tree_sql(_DOC_FILES)} SELECT t0.files, i.instances, t0.digest, c.class_counts FROM t0, (SELECT count(*) AS instances FROM {V.INSTANCES} WHERE class_id IS NOT NULL) i,
  (SELECT string_agg(class_id || '=' || n, ',' ORDER BY class_id::VARCHAR) AS class_counts FROM (SELECT class_id, count(*) AS n FROM {V.INSTANCES} WHERE class_id IS NOT NULL GROUP BY class_id)) c""")
def freeze_record(spark, d):
    """The manifest with the digest of the tree and the counts of the classes."""
    made = freeze.manifest(doc_files(spark, d), V.instances(spark, d).where("class_id is not null"), "path")
    counts = F.transform(F.array_sort(F.map_entries("class_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return made.select("files", "instances", "digest", F.array_join(counts, ",").alias("class_counts"))


@query(f"""SELECT 'class_' || class_id AS total, (900 + class_id)::BIGINT AS expected, coalesce(n, 0)::BIGINT AS found FROM (SELECT unnest(range(0, {V.CLASSES})) AS class_id) LEFT JOIN (SELECT class_id, count(*) AS n FROM {V.INSTANCES} WHERE class_id IS NOT NULL GROUP BY class_id) USING (class_id) WHERE coalesce(n, 0) <> 900 + class_id
  UNION ALL SELECT 'files', 1000, count(*) FROM documents HAVING count(*) <> 1000""")
def unexpected_totals(spark, d):
    """The totals of a freeze against those that were agreed."""
    made = freeze.manifest(doc_files(spark, d), V.instances(spark, d).where("class_id is not null"), "path")
    return freeze.unexpected_totals(made, {"files": 1000}, {k: 900 + k for k in range(V.CLASSES)})


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 97 <> 1 THEN sha256(text) END AS before, CASE WHEN doc_id % 89 <> 2 THEN sha256(CASE WHEN doc_id % 83 = 3 THEN text || '.' ELSE text END) END AS after,
  CASE WHEN doc_id % 97 = 1 THEN 'added' WHEN doc_id % 89 = 2 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 97 = 1 OR doc_id % 89 = 2 OR doc_id % 83 = 3) AND NOT (doc_id % 97 = 1 AND doc_id % 89 = 2)""")
def changed_files(spark, d):
    """Two freezes of the documents, one without some, one without others and with some that were edited."""
    docs = V.read(spark, d, "documents")
    old = docs.where("doc_id % 97 <> 1").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    new = docs.where("doc_id % 89 <> 2").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.col("doc_id") % 83 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    trees = [dedup.digest_tree(x, "path", "sha256") for x in (old, new)]
    return dedup.changed_files(old, new, *trees, "path", "sha256")


@query(f"""SELECT split, class_id, count(*) AS instances, count(DISTINCT file_id) AS files, count(*) FILTER (geometry_status = 'valid') AS valid, count(*) FILTER (geometry_status = 'soft_clipped') AS soft_clipped, round(avg(abs({V.signed_sql('used')})) FILTER (geometry_status IS NOT NULL), 6) AS mean_mask, CASE WHEN action IN ('exclude', 'review') THEN 'dropped' WHEN action = 'keep_negative' THEN 'kept_negative' ELSE 'kept' END AS status
  FROM {V.INSTANCES} i LEFT JOIN (SELECT doc_id, action FROM {V.DOCUMENTS} d JOIN {V.DECISIONS} k ON lower(d.filename) = lower(k.filename)) k ON i.file_id = k.doc_id WHERE class_id IS NOT NULL GROUP BY split, class_id, 8""")
def dataset_report(spark, d):
    """Flagship: one parse of the lines, summed by file and class first, so that files are counted as rows and only sums meet the decisions."""
    named = pairing.apply_decisions(V.documents(spark, d), V.decisions(spark, d), "filename").where("action is not null").select(F.col("doc_id").alias("file_id"), "status")
    lines = V.instances(spark, d, mask="mask").where("class_id is not null")
    sums = {"instances": F.count("*"), "valid": F.count_if(F.col("geometry_status") == "valid"), "soft_clipped": F.count_if(F.col("geometry_status") == "soft_clipped"), "area": F.sum("mask"), "sized": F.count("mask")}
    by_file = lines.groupBy("split", "file_id", "class_id").agg(*(v.alias(k) for k, v in sums.items()))
    rows = by_file.join(named, "file_id", "left").withColumn("status", F.coalesce("status", F.lit("kept")))
    mean = F.round(F.sum("area") / F.when(F.sum("sized") > 0, F.sum("sized")), 6)
    return rows.groupBy("split", "class_id", "status").agg(F.sum("instances").alias("instances"), F.count("*").alias("files"), F.sum("valid").alias("valid"), F.sum("soft_clipped").alias("soft_clipped"), mean.alias("mean_mask"))
