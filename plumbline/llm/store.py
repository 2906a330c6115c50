"""Tables kept between the jobs of one operator, in the folder that the whole cluster shares.

A kept table is plain Parquet below ``spark.checkpoint.dir``: it cuts the lineage, is computed once, and
survives the loss of any executor.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to or from Python: what a task holds beside its arrays stays small.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most in this session; a smaller setting stays."""
    now = spark.conf.get(_BATCH, None)
    now = int(now) if now and now.lstrip("-").isdigit() else 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and give it back as a table without its lineage."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of the tables that are kept meanwhile, so that their owner can delete them once what was made of them is stored. Each owner has its own list; outside of any, tables stay."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
