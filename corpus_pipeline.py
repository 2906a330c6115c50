"""The corpus pipeline: five stages over ``documents``, each a thin call of an operator.

Each stage takes (spark, docs, sf_dir) and returns all that it kept; ``docs`` is stored data, and its result is to be stored before the next stage
is called, as ``run`` does. All but the last return the columns of ``documents``. ``run`` deletes the helper tables of a stage once its result is stored; those of stages called alone stay.

Rows are told apart by their place in the stored input, never by ``doc_id``: ids may be null or repeat. A null text is a text without words: it is not toxic by more than its score says, has no lines to lose, no near copy and
no benchmark item, and is packed as one closing token. An empty table passes every stage as an empty table (the first learns nothing then). Further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import store
from plumbline.llm.decontaminate import benchmark_hits
from plumbline.llm.linededup import dedup_lines
from plumbline.llm.minhash import near_duplicates
from plumbline.llm.packing import pack_documents
from plumbline.llm.queries import table, vocabulary
from plumbline.llm.toxicity import toxicity as score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, by the threshold of their language."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; one that had text and loses all of it goes."""
    out = dedup_lines(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, the place of a row in the stored table: the same at each read."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest id, null ids after all others, and of equal ids the first row."""
    rows = numbered(docs)
    placed = rows.withColumn("_place", F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    gone = near_duplicates(placed, width=5, threshold=80, id_col="_place").where(~F.col("kept")).select(F.col("_place.row").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark within its edit budget."""
    rows = numbered(docs)
    hits = benchmark_hits(rows, table(spark, sf_dir, "benchmark"), id_col="_row").select("_row").distinct()
    return rows.join(hits, "_row", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=2048)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: A trained classifier and an iterated packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with store.collecting() as made:
            result = stage(spark, docs, sf_dir)
        docs = store.keep(result, f"stage-{name}")
        for path in made:
            store.delete(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
