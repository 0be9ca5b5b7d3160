"""Folder for intermediate tables that every executor must be able to reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Frees a query's shuffle files as soon as it has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# Bytes that go to Python at once where rows hold whole texts. Ten thousand of them, the
# default number of rows, are held several times in buffers of the JVM and of Python.
TEXT_BATCH = 4 << 20


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder
    of this machine; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="pulseplan-")
    return f"{base.rstrip('/')}/pulseplan/{purpose}-{uuid.uuid4().hex}"


def stored(
    df: DataFrame, purpose: str, batch_bytes: int | None = None, codec: str | None = None
) -> DataFrame:
    """``df`` written as parquet to a new shared folder, and read from there.

    For a table that several parts of one plan read: it is computed once, its
    readers prune columns, and no executor has to stay alive for it. ``batch_bytes``:
    about how much goes to Python at once while ``df`` is computed. ``codec``: how the
    files are compressed, if not as the session says.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    # Once written, the table no longer needs what was shuffled for it.
    own = {_FREE_SHUFFLES: "true"}
    if batch_bytes:
        own[_BATCH_BYTES] = str(batch_bytes)
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path, compression=codec)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
