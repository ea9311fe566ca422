"""Python workers that can import this package, and get their rows in batches of bounded size."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Put the package's folder on the path of Python workers, wherever the driver was started. Batches get a bound in
    bytes where the session has set none."""
    if spark.conf.get(BATCH_BYTES, None) in (None, str((1 << 31) - 1), f"{(1 << 31) - 1}b"):
        spark.conf.set(BATCH_BYTES, "4m")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


@cache
def _local_dir() -> str:
    d = tempfile.mkdtemp(prefix="foliant-store-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    return "file://" + d


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path where all executors see it: below ``spark.checkpoint.dir``; only a local session that names none
    gets a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(d or _local_dir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table that is computed here, once, and read again from the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
