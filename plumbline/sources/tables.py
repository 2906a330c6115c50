"""Tables kept between the jobs of one operator, as Parquet in the folder that the whole cluster shares: computed once, lineage cut, safe when executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and give it back as a table without its lineage."""
    path = f"{shared_dir(df.sparkSession)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: int) -> None:
    """Arrow batches of ``most`` bytes at most in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not 0 < (int(now) if now and now.lstrip("-").isdigit() else 0) <= most:
        spark.conf.set(key, str(most))
