"""Connected components of a table of links, as Spark joins and aggregates.

Each task first joins the links of its own partition, so that what is left are
stars; two star operations then alternate until nothing changes. Every edge of a
hub is one row, and a hub's rows are aggregated before they are shuffled.

Defined cases: an end that is null has no link; repeated links, links in both
directions and links of a node with itself change nothing; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from aerolith.plans.staging import drop_staged, stage_table
from aerolith.plans.workers import tidy

#: Nodes that a task holds before it gives on what it has joined.
HELD_NODES = 500_000


class Labels(dict):
    """Nodes of a union; each class is named by its least node."""

    def find(self, x: int) -> int:
        up = self.setdefault(x, x)
        while up != x:
            self[x] = self[up]
            x, up = up, self[up]
        return x

    def join(self, x: int, y: int) -> bool:
        """Join the classes of two nodes; false if they were one."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y

    def stars(self) -> tuple[list[int], list[int]]:
        """Every node that is not the least of its class, and that least one."""
        own = [(x, r) for x in list(self) if (r := self.find(x)) != x]
        return [x for x, _ in own], [r for _, r in own]


def _join_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels = Labels()

    def give() -> pa.RecordBatch:
        u, v = labels.stars()
        labels.clear()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            labels.join(x, y)
        if len(labels) > HELD_NODES:
            yield give()
    yield give()


def _stars(edges: DataFrame) -> DataFrame:
    """One round on edges (u, v), u > v: v becomes the least neighbour below it, then all below a node are linked to the least of them.

    Both steps keep components; repeating them ends in one star for each.
    """
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    nearer = edges.join(least, F.col("v") == F.col("n"), "left").select("u", F.coalesce("m", "v").alias("v"))
    own = nearer.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    moved = nearer.join(own, F.col("u") == F.col("n")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(own.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every node of links (a, b) that is not its component's least: component_id is the least node."""
    pairs = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges, before = stage_table(pairs.mapInArrow(tidy(_join_own), "u long, v long"), "links"), None
    while True:  # nodes only come nearer to the least one of their component, so this ends
        seen = Observation()
        state = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        after = stage_table(_stars(edges).observe(seen, F.count(F.lit(1)).alias("n"), state.alias("state")), "stars")
        drop_staged(edges)
        edges, now = after, seen.get
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        before = now
