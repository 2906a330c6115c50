"""Sources and sinks for image collections, label files, tables of decisions, and run records. Files are listed and read by Spark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import difference_hash, sample_key
from plumbline.sources.listing import list_files
from plumbline.sources.tables import bound_batches

# Suffixes of image files.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
DECISION_SCHEMA = "filename string, action string, issue string, reason string, status string"
PREDICTION_SCHEMA = "experiment_id string, samples array<struct<image_path: string, split: string, true_classes: array<int>, predicted_classes: array<int>, predictions: array<struct<class_id: int, class_name: string, confidence: double, bbox: array<double>>>>>"


def _keyed(files: DataFrame, root: str) -> DataFrame:
    inner = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace("file:", "").replace(".", r"\.") + "/", "")
    return files.withColumn("rel_path", inner).withColumn("split", F.when(F.instr("rel_path", "/") > 0, F.substring_index("rel_path", "/", 1))).withColumn("sample_key", sample_key(F.regexp_replace("rel_path", "^[^/]+/", ""))).withColumn("filename", F.regexp_extract("path", "([^/]*)$", 1))


def images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """``path, length, rel_path, split, sample_key, filename`` of image files below ``root/<split>/``; contents are not read, and folders are listed in tasks."""
    listed = list_files(spark, root).select("path", "length")
    return _keyed(listed.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)), root)


def labels(spark: SparkSession, root: str, bom: str = "keep") -> DataFrame:
    """Label files with their text; files without bytes, which the reader leaves out, have the empty text. ``bom='strip'`` drops a leading byte order mark."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").load(root)
    text = F.decode("content", "UTF-8")
    with_text = read.select("path", "length", (F.regexp_replace(text, "^\ufeff", "") if bom == "strip" else text).alias("text"))
    empty = list_files(spark, root).where((F.col("length") == 0) & F.lower("path").endswith(".txt")).select("path", "length", F.lit("").alias("text"))
    return _keyed(with_text.unionByName(empty), root)


def image_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``path, width, height, decode_error`` by decoding each image in the JVM; an image that can't be decoded has sizes 0 and an error."""
    read = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.origin", "image.width", "image.height")
    ok = F.col("width") > 0
    return read.select(F.col("origin").alias("path"), F.when(ok, F.col("width")).otherwise(0).alias("width"), F.when(ok, F.col("height")).otherwise(0).alias("height"), F.when(~ok, "undecodable").alias("decode_error"))


def grey_grids(spark: SparkSession, root: str, rows: int = 8, columns: int = 9) -> DataFrame:
    """``path, grid``: a grey image shrunk to ``rows`` x ``columns`` by a triangle filter, for difference hashes; null for an image that can't be decoded. Images of one size in an Arrow
    batch are shrunk together (``resampling.shrink``). A decoder's own reduction while reading a JPEG is not imitated."""
    import pyarrow as pa

    from plumbline.functions.resampling import grids

    bound_batches(spark, 64 << 20)

    def run(batches):
        for batch in batches:
            made = grids(*(batch.column(c) for c in ("width", "height", "nChannels", "data")), rows, columns)
            yield pa.RecordBatch.from_arrays([batch.column("origin"), made], ["path", "grid"])

    return spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.*").mapInArrow(run, "path string, grid array<int>")


def image_hashes(spark: SparkSession, root: str) -> DataFrame:
    """``path, hash, decode_error``: the difference hash of each image; an image that can't be decoded has none and an error."""
    return grey_grids(spark, root).select("path", F.when(F.col("grid").isNotNull(), difference_hash(F.col("grid"))).alias("hash"), F.when(F.col("grid").isNull(), "undecodable").alias("decode_error"))


def sample_list(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Paths of a sample list, blank lines skipped, relative ones below ``root``."""
    p = F.trim("value")
    return spark.read.text(path).where(p != "").select(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(p, r"^\./", ""))).alias("path"))


def summary_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; one without rows is an error."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def run_csvs(spark: SparkSession, glob: str) -> DataFrame:
    """Per-run CSV files with trimmed headers and the name of their folder as ``run``."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(glob)
    named = df.withColumn("_run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1))
    return named.toDF(*[c.strip() for c in df.columns], "run")


def json_records(spark: SparkSession, glob: str, schema) -> DataFrame:
    """One record for each JSON file; ``experiment_id`` defaults to the folder's name."""
    df = spark.read.schema(schema).json(glob, multiLine=True).withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1))
    return df.withColumn("experiment_id", F.coalesce("experiment_id", "_folder")).drop("_folder") if "experiment_id" in df.columns else df.withColumnRenamed("_folder", "experiment_id")


def _yaml(spark: SparkSession, path: str) -> dict:
    """A short configuration that people write, read through Spark from wherever the data is."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return yaml.safe_load(text[0].removeprefix("\ufeff")) or {} if text else {}


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed decision list from YAML."""
    data = _yaml(spark, path)
    rows = [tuple(None if x.get(k) is None else str(x.get(k)) for k in ("filename", "action", "issue", "reason", "status")) for x in data.get("images", data.get("decisions", []))]
    return spark.createDataFrame(rows, DECISION_SCHEMA)


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """``class_id, name`` from the ``names`` of a dataset configuration, a map or a list; ids must be 0 to n-1, each once."""
    names = _yaml(spark, path).get("names") or {}
    rows = [(int(k), str(v)) for k, v in (enumerate(names) if isinstance(names, list) else names.items())]
    if not rows or sorted(k for k, _ in rows) != list(range(len(rows))):
        raise ValueError(f"{path}: class ids must be 0 to n-1, got {sorted(k for k, _ in rows)}")
    return spark.createDataFrame(rows, "class_id int, name string")


def hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """``key, name, class_id``: the ids of each coarse group of a hierarchy file, one row for each. A group without a name or ids is an error; coverage is
    checked by ``pairing.hierarchy_violations``."""
    rows = []
    for key, group in (_yaml(spark, path).get("groups") or {}).items():
        name = (group or {}).get("name") or next((v for k, v in (group or {}).items() if k.startswith("name")), None)
        ids = (group or {}).get("class_ids")
        if not name or ids is None:
            raise ValueError(f"{path}: group {key} is incomplete")
        rows += [(key, str(name), int(i)) for i in ids]
    return spark.createDataFrame(rows, "key string, name string, class_id int")


def split_roots(spark: SparkSession, path: str) -> dict[str, str]:
    """The folders of the splits that a dataset configuration names: relative ones below its ``path``, and that below the configuration's own folder."""
    config = _yaml(spark, path)

    def below(root: str, part: str) -> str:
        return part if part.startswith("/") or "://" in part else os.path.normpath(f"{root}/{part}") if "://" not in root else f"{root.rstrip('/')}/{part.removeprefix('./')}"

    root = below(path.rpartition("/")[0] or ".", str(config.get("path") or "."))
    return {split: below(root, str(config[split])) for split in ("train", "val", "test") if config.get(split) is not None}


def write_csv(df: DataFrame, path: str, fields: list[str], overwrite: bool = False, bom: bool = True) -> None:
    """A CSV with a header and the fields in this order; each file begins with a byte order mark, as part of its header."""
    named = df.select(*(F.col(f).alias(f"\ufeff{f}" if bom and k == 0 else f) for k, f in enumerate(fields)))
    named.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_sample_lists(df: DataFrame, path: str, path_col: str = "rel_path", overwrite: bool = False) -> None:
    """Sorted relative paths, one folder for each split."""
    rows = df.select("split", F.col(path_col).alias("value")).repartitionByRange("split", "value").sortWithinPartitions("split", "value")
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").text(path)


def write_labels(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Repaired label texts as a new table by split; the source is never touched."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").parquet(path)


def append_missing(df: DataFrame, existing: DataFrame, keys: list[str], path: str) -> None:
    """Resume: write only the rows whose key is not there yet."""
    df.join(existing.select(*keys), keys, "left_anti").write.mode("append").parquet(path)


def copy_manifest(pairs: DataFrame, target: str) -> DataFrame:
    """What a copy of a subset would write: ``src_image, dst_image, label_text``, with the empty text for negatives."""
    return pairs.select(F.col("path").alias("src_image"), F.concat(F.lit(target.rstrip("/") + "/images/"), "split", F.lit("/"), "filename").alias("dst_image"), F.when(F.col("status") == "kept_negative", "").otherwise(F.coalesce("text", F.lit(""))).alias("label_text"))
