"""Lineage cuts that survive lost executors: tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode where the session names no folder, as in tests.
LOCAL_DIR = "file:/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = LOCAL_DIR
    return named.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and return a scan of it.

    A later stage that loses an executor rereads the files instead of running
    the stages before. The scan's path is kept in ``staged_path`` for drop_staged.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/aerolith/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    for made in _RECORDS:
        made.append(out)
    return out


_RECORDS: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that are staged meanwhile, for whoever knows when nothing reads them any more."""
    made: list[DataFrame] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of one Arrow batch on its way to Python, where the session sets no other bound.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: ten thousand very long rows are otherwise one batch.

    The bound stays set in the session, as plans run after they are made; a
    smaller one that is set already is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b") or 0) > 256 << 20:
        spark.conf.set(key, str(BATCH_BYTES))
