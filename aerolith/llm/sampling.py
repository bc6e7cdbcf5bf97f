"""Shares of a table by hash of a column: the same rows each time, spread over all of the table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spot(column: Column) -> Column:
    """A place in [0, 1) that hangs on the value alone; fine enough for shares of one in 10**15."""
    return F.shiftrightunsigned(F.xxhash64(column), 11) / F.lit(float(1 << 53))
