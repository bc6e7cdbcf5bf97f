"""Read-only files for tasks: written to the shared folder, fetched once by each executor."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from aerolith.plans.staging import shared_dir


def share_file(spark: SparkSession, content: bytes, name: str) -> str:
    """Make content a file on every executor; returns the name to give SparkFiles.get there."""
    unique = f"{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/aerolith/{unique}")
    out = path.getFileSystem(conf).create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return unique
