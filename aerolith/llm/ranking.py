"""The first k rows of each group by radix select, whatever share of the rows a group has.

Values are looked at a few bits at a time, from the top. Each round counts the
candidates of all groups by their next bits (a histogram of 2**BITS bins for each
group, aggregated before it is shuffled), finds the bin in which the kth largest
value lies, and goes on with that bin alone; after the last bits the kth
value of each group is known. Where more rows have exactly that value than are
wanted, those with the least items in the order of UTF-8 bytes stay: the same
search over bytes, ascending, which jumps over what all candidates of a bin begin
with. Only the k rows of each group are sorted, or at most BOUNDED candidates.

What is held for a group is one row. Thresholds of up to BROADCAST_GROUPS groups
are broadcast to the rows; those of more are joined by a shuffle.

Defined cases: null values are not ranked; a null item is an empty one; a null in
a group's columns is a value like others; a group of fewer than k rows is ranked
whole; repeated rows are rows of their own, next to each other in the ranking; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.plans.staging import stage_table

BITS = 10
#: Candidates of a group that are sorted rather than searched further.
BOUNDED = 1024
BROADCAST_GROUPS = 50_000


def _with(rows: DataFrame, state: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """Rows with their group's state, whose columns other than the keys have names of their own."""
    other = state.select(*(F.col(c).alias(f"__of_{c}") if c in keys else c for c in state.columns))
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(other[f"__of_{c}"]) for c in keys])
    return rows.join(F.broadcast(other) if broadcast else other, same).drop(*(f"__of_{c}" for c in keys))


def _kth_values(rows: DataFrame, keys: list[str], k: int, low: int, high: int, broadcast: bool) -> DataFrame:
    """keys, kth (the value of the kth row, or the least one), need (how many rows with it are wanted) and ties (how many there are)."""
    width = 1 + max(low.bit_length(), high.bit_length())  # and the sign
    state, before = None, 0
    for shift in range((width - 1) // BITS * BITS, -1, -BITS):
        some = rows.withColumn("need", F.lit(k).cast("long"))
        if state is not None:
            some = _with(rows, state.select(*keys, "kth", "need"), keys, broadcast).where(F.shiftright("value", before) == F.col("kth"))
        bins = some.groupBy(*keys, "need", F.shiftright("value", shift).alias("kth")).agg(F.count("*").alias("ties"))
        above = F.sum("ties").over(Window.partitionBy(*keys).orderBy(F.desc("kth")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties")
        cut = bins.withColumn("need", F.col("need") - above).where("need > 0")
        state = cut.groupBy(*keys).agg(F.min_by(F.struct("kth", "need", "ties"), "kth").alias("s")).select(*keys, "s.*")
        before = shift
    return state


def _shared(a: Column, b: Column) -> Column:
    """The bytes with which two binaries begin alike."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    apart = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, F.substr(a, F.lit(1), F.lit(0))).otherwise(F.substr(a, F.lit(1), F.coalesce(F.get(apart, F.lit(0)) - 1, n)))


def _last_items(ties: DataFrame, open_: DataFrame, keys: list[str], bounded: int, broadcast: bool) -> DataFrame:
    """keys and last: the last item, in ascending order of bytes, that is wanted of a group's ties."""
    spark = ties.sparkSession
    state = open_.select(*keys, "need", "ties", F.encode(F.lit(""), "UTF-8").alias("head"), F.lit(False).alias("equal"))

    def candidates(state: DataFrame) -> DataFrame:
        own = _with(ties, state.select(*keys, "need", "head"), keys, broadcast).withColumn("bytes", F.encode("item", "UTF-8"))
        return own.where(F.substr("bytes", F.lit(1), F.octet_length("head")) == F.col("head"))

    done = None
    while True:
        ready = (F.col("ties") <= bounded) | F.col("equal")
        done = state.where(ready) if done is None else done.unionByName(state.where(ready))
        state = state.where(~ready)
        if state.isEmpty():
            break
        byte = F.substr("bytes", F.octet_length("head") + 1, F.lit(1))
        bins = candidates(state).groupBy(*keys, "need", byte.alias("byte")).agg(F.count("*").alias("ties"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))
        below = F.sum("ties").over(Window.partitionBy(*keys).orderBy("byte").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties")
        cut = bins.withColumn("need", F.col("need") - below).where("need > 0")
        cut = cut.groupBy(*keys).agg(F.max_by(F.struct("need", "ties", "least", "most"), "byte").alias("s")).select(*keys, "s.*")
        state = stage_table(cut.select(*keys, "need", "ties", _shared(F.col("least"), F.col("most")).alias("head"), (F.col("least") == F.col("most")).alias("equal")), "tie-heads")
    known = done.where("equal").select(*keys, F.decode("head", "UTF-8").alias("last"))
    some = candidates(done.where(~F.col("equal")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("item"))
    found = some.withColumn("place", place).where(F.col("place") == F.col("need")).select(*keys, F.col("item").alias("last"))
    return found.unionByName(known)


def top_k(rows: DataFrame, group: list[str], value: str, item: str, k: int, bounded: int = BOUNDED) -> DataFrame:
    """group, item, value and rank (int, from 1) of the k rows with the largest values of each group; ties go to the least item in bytes."""
    keys = [f"g{i}" for i in range(len(group))]
    named = [F.col(c).alias(g) for c, g in zip(group, keys, strict=True)]
    own = rows.where(F.col(value).isNotNull()).select(*named, F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(value).cast("long").alias("value"))
    own = stage_table(own, "ranked-values")
    back = [*(F.col(g).alias(c) for c, g in zip(group, keys, strict=True)), F.col("item").alias(item), F.col("value").alias(value), "rank"]
    reach = own.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    if reach.low is None:
        return own.withColumn("rank", F.lit(0)).select(*back)
    state = stage_table(_kth_values(own, keys, k, reach.low, reach.high, own.select(*keys).distinct().count() <= BROADCAST_GROUPS), "kth-values")
    broadcast = state.count() <= BROADCAST_GROUPS
    open_ = state.where("ties > need")
    above = _with(own, state, keys, broadcast)
    some = above.where((F.col("value") > F.col("kth")) | ((F.col("value") == F.col("kth")) & (F.col("ties") <= F.col("need")))).select(*keys, "item", "value")
    if not open_.isEmpty():
        ties = _with(own, open_.select(*keys, "kth"), keys, broadcast).where(F.col("value") == F.col("kth")).select(*keys, "item", "value")
        last = stage_table(_last_items(ties.drop("value"), open_, keys, bounded, broadcast), "last-items")
        some = some.unionByName(_with(ties, last, keys, broadcast).where(F.col("item") <= F.col("last")).select(*keys, "item", "value"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select(*back)
