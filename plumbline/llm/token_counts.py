"""Token counts with a digest cache.

The count of a text depends on its normalised content and on the tokenizer's version alone, so counts are stored under
the pair of digests. A run joins its distinct digests to the stored counts, encodes one text for each digest that
is missing, and appends those counts to the cache for later runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.bloom import bloom
from plumbline.llm.encoders import encoder
from plumbline.llm.textbytes import slices, take_rows

CACHE_SCHEMA = "content_digest binary, tokenizer_version string, n_tokens long"


#: Rises when counts could differ from those that older code has stored.
REVISION = 2


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of what reads it: a changed vocabulary or library never meets counts of the old one."""
    import sentencepiece
    import tokenizers

    reader = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{reader}|{REVISION}".encode()).hexdigest()


def cache_path_for(spark: SparkSession, tokenizer_path: str) -> str:
    """The lasting cache of a tokenizer in the shared folder."""
    return f"{store.shared_dir(spark)}/plumbline/token-cache-{tokenizer_version(tokenizer_path)[:32]}"


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored counts; an absent path is an empty cache."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    Normalised content: the text's UTF-8 bytes, null as empty (any other change could change the count). Empty texts count 0
    tokens. Repeated texts and repeated ids each keep their row. Other columns are left out. Very long texts are encoded whole. An empty table gives no rows.
    ``cache_path``: a Parquet folder that grows by the misses; without one, the lasting one of the tokenizer in the shared folder.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or cache_path_for(spark, tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = store.keep(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("content_digest")), "digests")

    # one row for each digest; the row that is encoded is named by its id, so that the texts need not be sorted
    stored = open_cache(spark, cache_path).where(F.col("tokenizer_version") == version).select("content_digest").distinct()
    missing = store.keep(digests.groupBy("content_digest").agg(F.min("id").alias("id")).join(stored, "content_digest", "left_anti"), "missing")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.test(batch.column(2).to_numpy().view(np.uint64)))).select([0, 1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer_path, ids=False)
        for batch in batches:
            for start, stop, data, at in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([take_rows(batch, "content_digest", start, stop), pa.array(np.asarray(count(data, at)), pa.int64())], names=["content_digest", "n_tokens"])

    if not missing.isEmpty():
        wanted = bloom(missing.select(F.xxhash64("id").alias("key")), "key")  # texts that surely miss nothing are not shuffled
        kind = dict(docs.dtypes)[id_col]
        texts = docs.select(F.col(id_col).alias("doc"), text.alias("text"), F.xxhash64(id_col).alias("key")).mapInArrow(inside, f"doc {kind}, text string")
        # a null id is met through null-safe equality; a repeated id may bring another text, whose digest then differs
        texts = texts.join(missing.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("id")), "inner").where(F.unhex(F.sha2(F.col("text"), 256)) == F.col("content_digest")).select("content_digest", "text")
        counted = texts.mapInArrow(encode, "content_digest binary, n_tokens long")
        counted.select("content_digest", F.lit(version).alias("tokenizer_version"), "n_tokens").write.mode("append").parquet(cache_path)

    # two runs at once may both store a count. As a table of its own it joins through plain shuffles, which Spark parts where one text is very common
    counts = store.keep(open_cache(spark, cache_path).where(F.col("tokenizer_version") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return digests.join(counts, "content_digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
