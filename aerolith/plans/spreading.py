"""Rows over enough tasks: for work that is large beside the bytes read, and for sorts that do not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by columns, in at least two parts for each core: a small file is one task's to read, whatever Python makes of its rows."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *by)


#: Rows that one task gets to sort, about, where no key has more.
SORTED_ROWS = 1 << 18


def in_parts(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by columns in as many parts as their count asks for, which is taken first: the session's number of partitions does not follow the table."""
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SORTED_ROWS))
    return df.repartition(tasks, *by)
