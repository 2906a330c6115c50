"""Writing in batches that are committed one by one, so that a run that died half-way repeats nothing that is done and doubles nothing.

A batch is written to a folder of its own, and counts from the moment its commit record exists: a file named like the batch, made only if it is not there, that names the folder. Of two runs
that write the same batch one makes the record; the other's folder is never read. Readers read the folders that records name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """Batch and folder of what was committed below ``path``: one short record a batch."""
    fs, at = _file_system(spark, f"{path}/commits")
    if not fs.exists(at) or not fs.listStatus(at):
        return {}
    rows = spark.read.text(f"{path}/commits", wholetext=True).select(F.split("value", "\n")).collect()
    return {r[0][0]: r[0][1] for r in rows}


def commit(spark: SparkSession, path: str, batch: str, folder: str) -> bool:
    """Whether this call made the record of ``batch``; false if another run did before."""
    fs, at = _file_system(spark, f"{path}/commits/{batch}")
    try:
        out = fs.create(at, False)
    except Exception as error:  # an exception of the store, as Py4J wraps it
        if fs.exists(at):
            return False
        raise error
    out.write(f"{batch}\n{folder}".encode())
    out.close()
    return True


def write_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Write and commit one batch; false if it was committed by another run meanwhile."""
    folder = f"data/{batch}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return commit(df.sparkSession, path, batch, folder)


def write_resumably(df: DataFrame, path: str, key: Column, batches: int = 64) -> int:
    """Write ``df`` in ``batches`` shares by the hash of ``key``, but for those that are committed already; the number written. The same ``df``, key and number of batches are
    to be given again after a run died. Null keys make one share."""
    done = committed(df.sparkSession, path)
    share = F.pmod(F.xxhash64(key), F.lit(batches))
    left = [k for k in range(batches) if f"{k:06d}-of-{batches}" not in done]
    return sum(write_batch(df.where(share == k), path, f"{k:06d}-of-{batches}") for k in left)


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of committed batches; no rows where there are none."""
    folders = sorted(committed(spark, path).values())
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)
