"""Running values over very long sequences: a group may hold any share of the rows and is still read by many tasks.

Rows are dealt out in sorted ranges and staged with the number of their range, so a
group that is longer than a range spans several. Within a range values run by a
window; what all earlier ranges of a group come to is one row for each group and range,
and joined back. That is a scan on two levels: only short rows of ranges are in one
task for a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.plans.staging import stage_table

PART = "__part"


def dealt(rows: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows, staged in sorted ranges of group and order, with the number of the range.

    Rows that are equal in both are in one range. Without ``parts`` there are as many
    ranges as the session has shuffle partitions.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage_table(rows.repartitionByRange(n, *group, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _joined(rows: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the columns that parts have for their group and range."""
    other = parts.select(*(F.col(c).alias(f"__of_{c}") for c in [*group, PART]), *(c for c in parts.columns if c not in (*group, PART)))
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(other[f"__of_{c}"]) for c in [*group, PART]])
    return rows.join(other, same).drop(*(f"__of_{c}" for c in [*group, PART]))


def _ranges(group: list[str]) -> Window:
    return Window.partitionBy(*group).orderBy(PART)


def running_max(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Dealt rows with the largest value so far, the row's own included, in each group; nulls count as nothing."""
    own = rows.withColumn("__v", value)
    within = F.max("__v").over(Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = own.groupBy(*group, PART).agg(F.max("__v").alias("__v"))
    before = ends.withColumn("__before", F.max("__v").over(_ranges(group).rowsBetween(Window.unboundedPreceding, -1))).drop("__v")
    out = _joined(own.withColumn("__within", within), before, group)
    return out.withColumn(name, F.coalesce(F.greatest("__within", "__before"), "__within", "__before")).drop("__v", "__within", "__before")


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Dealt rows with the sum of the values before each, the row's own not included, in each group; nulls count as 0."""
    own = rows.withColumn("__v", F.coalesce(value, F.lit(0.0)))
    within = F.sum("__v").over(Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ends = own.groupBy(*group, PART).agg(F.sum("__v").alias("__v"))
    before = ends.withColumn("__before", F.sum("__v").over(_ranges(group).rowsBetween(Window.unboundedPreceding, -1))).drop("__v")
    out = _joined(own.withColumn("__within", within), before, group)
    return out.withColumn(name, F.coalesce("__before", F.lit(0.0)) + F.coalesce("__within", F.lit(0.0))).drop("__v", "__within", "__before")


def following(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Dealt rows with a value of the row after each in its group, over the edges of ranges; null for the last."""
    own = rows.withColumn("__v", F.struct(value.alias("v")))
    w = Window.partitionBy(*group, PART).orderBy(*order)
    heads = own.groupBy(*group, PART).agg(F.min_by("__v", F.struct(*order)).alias("__head"))
    after = heads.withColumn("__after", F.lead("__head").over(_ranges(group))).drop("__head")
    out = _joined(own.withColumn("__within", F.lead("__v").over(w)), after, group)
    return out.withColumn("__v", F.coalesce("__within", "__after")["v"]).drop("__within", "__after").withColumnRenamed("__v", name)


def largest(rows: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """Dealt rows with the largest value of their whole group."""
    ends = rows.withColumn("__v", value).groupBy(*group, PART).agg(F.max("__v").alias("__v"))
    return _joined(rows, ends.withColumn(name, F.max("__v").over(Window.partitionBy(*group))).drop("__v"), group)
