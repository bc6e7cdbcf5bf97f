"""Named sources on the Spark catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceExists(ValueError):
    pass


class Sources:
    """Sources by id, kept as temporary views; strict refuses an id that is taken, else the new source replaces it."""

    def __init__(self, spark: SparkSession, strict: bool = False, prefix: str = "source_") -> None:
        self._spark, self._strict, self._prefix = spark, strict, prefix
        self._ids: list[str] = []

    def register(self, source_id: str, rows: DataFrame) -> None:
        if self._strict and source_id in self._ids:
            raise SourceExists(source_id)
        rows.createOrReplaceTempView(self._prefix + source_id)
        if source_id not in self._ids:
            self._ids.append(source_id)

    def get(self, source_id: str) -> DataFrame | None:
        return self._spark.table(self._prefix + source_id) if source_id in self._ids else None

    def drop(self, source_id: str) -> bool:
        if source_id not in self._ids:
            return False
        self._ids.remove(source_id)
        return self._spark.catalog.dropTempView(self._prefix + source_id)

    def sizes(self) -> DataFrame:
        """source_id and rows of each source."""
        empty = self._spark.createDataFrame([], "source_id string, rows long")
        for i in self._ids:
            empty = empty.unionByName(self.get(i).agg(F.count("*").alias("rows")).select(F.lit(i).alias("source_id"), "rows"))
        return empty

    def total_size(self) -> DataFrame:
        return self.sizes().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))

    def clear(self) -> None:
        """Give back what Spark has cached of the sources; the sources stay registered."""
        for i in list(self._ids):
            self._spark.catalog.uncacheTable(self._prefix + i)
