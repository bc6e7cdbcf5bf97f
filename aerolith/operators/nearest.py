"""The nearest point of a table for each place of another, by a quadtree that Spark builds and searches level by level.

Points are counted by cells of a grid whose edge is divided by four from level to level; a cell
with more than ``leaf`` points is divided further, so dense regions are deep and empty ones
have no cells. A cell keeps the box of its points. A place first looks up the smallest
cell that it is in: somewhere in that cell's box there is a point, which bounds how far
the nearest one can be. The cells of a level whose edge is beyond that bound, in a ring of nine around
the place, are all that can hold it. Of those, cells whose box is farther than the
best bound are dropped, and the others are replaced by their parts until only
leaves are left, whose points are measured.

Points, and places, that coincide count once, so a spot may hold any share of the rows.
What a place meets is some dozens of cells and points, whatever the tables' sizes; joins
are on cell keys, and tables are staged between levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.plans.staging import stage_table

#: Bits of a cell's number at the deepest level, bits from level to level, and points that are not divided further.
DEPTH, STEP, LEAF = 24, 2, 32
#: Cells that are broadcast when points are dealt to the next level; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def _far(x: Column, y: Column, most: bool) -> Column:
    """Distance of a place to the nearest, or at most to the farthest, spot of a cell's box."""
    side = lambda v, lo, hi: F.greatest(F.abs(v - F.col(lo)), F.abs(v - F.col(hi))) if most else F.greatest(F.col(lo) - v, v - F.col(hi), F.lit(0.0))
    dx, dy = side(x, "x0", "x1"), side(y, "y0", "y1")
    return F.sqrt(dx * dx + dy * dy)


def _cell(v: str, low: float, edge: float, level: int | Column) -> Column:
    """The number of the cell of a level that a coordinate is in, also outside the grid."""
    return F.floor((F.col(v) - low) / edge * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level))


def _finite(rows: DataFrame) -> DataFrame:
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.where(good("x") & good("y"))


def _nodes(points: DataFrame, by: list[str], low: tuple[float, float], edge: float, leaf: int) -> tuple[DataFrame, int]:
    """Cells of all levels: by, level, cx, cy, n, x0, x1, y0, y1 and leaf; and the deepest level."""
    levels, level, inside = [], 0, points
    while True:
        at = {"cx": _cell("x", low[0], edge, level), "cy": _cell("y", low[1], edge, level)}
        box = [f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))]
        cells = inside.withColumns(at).groupBy(*by, "cx", "cy").agg(F.count("*").alias("n"), *box)
        last = level + STEP > DEPTH
        cells = stage_table(cells.withColumns({"level": F.lit(level), "leaf": F.lit(last) | (F.col("n") <= leaf)}), "cells")
        levels.append(cells)
        split = cells.where(~F.col("leaf")).select(*by, "cx", "cy")
        n = split.count()
        if not n:
            return reduce(DataFrame.unionByName, levels), level
        inside = points.withColumns(at).join(F.broadcast(split) if n <= BROADCAST_CELLS else split, [*by, "cx", "cy"], "left_semi")
        level += STEP


def nearest(places: DataFrame, points: DataFrame, within: float | None = None, by: tuple[str, ...] = (), leaf: int = LEAF) -> DataFrame:
    """Places (their columns, x and y among them) with id and distance of the nearest point (id, x, y); the least id of equally near ones.

    With ``by`` only points of the same group count, and with ``within`` those nearer than it.
    A place without such a point has no row, nor has one without finite coordinates or with a null group; repeated places come back as often as they occur.
    """
    groups = list(by)
    own = stage_table(_finite(points.select(*groups, "id", F.col("x").cast("double"), F.col("y").cast("double"))).groupBy(*groups, "x", "y").agg(F.min("id").alias("id")), "points")
    spots = _finite(places.select(*groups, F.col("x").cast("double"), F.col("y").cast("double"))).distinct()
    ends = own.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None:
        none = own.select("id", F.lit(0.0).alias("distance")).limit(0)
        return places.where(F.lit(False)).join(none, F.lit(True)).select(*places.columns, "id", "distance")
    low, edge = (ends[0], ends[2]), max(ends[1] - ends[0], ends[3] - ends[2], 1e-9) * (1 + 1e-9)
    nodes, deepest = _nodes(own, groups, low, edge, leaf)
    nodes = stage_table(nodes, "quadtree")
    key = [*groups, "level", "cx", "cy"]
    spot = [*groups, "px", "py"]
    x, y = F.col("px"), F.col("py")
    spots = spots.withColumnsRenamed({"x": "px", "y": "py"})
    # the smallest cell that a place is in, places beyond the grid being moved to its edge
    clipped = lambda v, k, level: F.greatest(F.lit(0).cast("long"), F.least(F.pow(F.lit(2.0), level).cast("long") - 1, _cell(v, low[k], edge, level)))
    every = F.explode(F.array(*(F.lit(k) for k in range(0, deepest + 1, STEP))))
    chain = spots.withColumn("level", every).withColumns({"cx": clipped("px", 0, F.col("level")), "cy": clipped("py", 1, F.col("level"))})
    bound = chain.join(nodes, key).groupBy(*spot).agg(F.min(_far(x, y, most=True)).alias("best"))
    if within is not None:
        bound = bound.withColumn("best", F.least("best", F.lit(float(within))))
    # the ring of nine cells of the finest level with an edge beyond the bound; cells that are not there are part of a leaf, or empty
    fits = F.floor(F.log2(F.lit(edge) / (F.greatest(F.col("best"), F.lit(edge * 2.0**-DEPTH)) * 1.001)) / STEP) * STEP
    ring = bound.withColumn("ring", F.least(fits, F.lit(deepest)).cast("int"))
    near = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    inner = ring.where("ring >= 0").withColumn("d", near).withColumns({"rx": _cell("px", low[0], edge, F.col("ring")) + F.col("d.dx"), "ry": _cell("py", low[1], edge, F.col("ring")) + F.col("d.dy")})
    inner = inner.withColumn("level", every).where("level <= ring")
    up = F.pow(F.lit(2.0), F.col("ring") - F.col("level"))
    inner = inner.withColumns({"cx": F.floor(F.col("rx") / up), "cy": F.floor(F.col("ry") / up)}).select(*key, "px", "py", "best", "ring").distinct()
    outer = ring.where("ring < 0").select(*groups, F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), "px", "py", "best", F.lit(0).alias("ring"))
    front = inner.unionByName(outer).join(nodes, key).where(F.col("leaf") | (F.col("level") == F.col("ring")))
    keep = [*key, "px", "py", "best", "leaf"]
    leaves = None
    while True:
        tight = F.least(F.min(_far(x, y, most=True)).over(Window.partitionBy(*spot)), F.col("best"))
        front = front.withColumn("best", tight).where(_far(x, y, most=False) <= F.col("best"))
        front = stage_table(front.select(*keep), "places-in-cells")
        done = front.where("leaf")
        leaves = done if leaves is None else leaves.unionByName(done)
        rest = front.where(~F.col("leaf"))
        if rest.isEmpty():
            break
        parts = nodes.withColumns({"up": F.col("level") - STEP, "ux": F.floor(F.col("cx") / 2**STEP), "uy": F.floor(F.col("cy") / 2**STEP)})
        above = rest.select(*groups, F.col("level").alias("up"), F.col("cx").alias("ux"), F.col("cy").alias("uy"), "px", "py", "best")
        front = above.join(parts, [*groups, "up", "ux", "uy"])
    leaves = stage_table(leaves.select(*key, "px", "py"), "places-in-leaves")
    found = None
    for level in range(0, deepest + 1, STEP):
        some = own.withColumns({"cx": _cell("x", low[0], edge, level), "cy": _cell("y", low[1], edge, level)})
        met = leaves.where(F.col("level") == level).drop("level").join(some, [*groups, "cx", "cy"])
        met = met.select(*spot, "id", F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).alias("distance"))
        found = met if found is None else found.unionByName(met)
    if within is not None:
        found = found.where(F.col("distance") < within)
    best = found.groupBy(*spot).agg(F.min_by(F.struct("id", "distance"), F.struct("distance", "id")).alias("b")).select(*spot, "b.id", "b.distance")
    back = best.select(*(F.col(c).alias(f"__{c}") for c in spot), F.col("id").alias("__id"), F.col("distance").alias("__distance"))
    same = reduce(lambda a, b: a & b, [places[c] == back[f"__{c}"] for c in groups] + [places["x"].cast("double") == back["__px"], places["y"].cast("double") == back["__py"]])
    return places.join(back, same).select(*(places[c] for c in places.columns), F.col("__id").alias("id"), F.col("__distance").alias("distance"))
