"""Tracked targets in batch form: the latest state of each, dead reckoning and display values.

Pings have id, seq (order of arrival), lat, lon (radians), height, speed_mps,
track_heading_rad, vertical_rate_mps and last_ping_time (seconds).
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions.ellipsoid import FEET_PER_METRE, KNOTS_PER_MPS, WGS84
from aerolith.functions.geodesy import Haversine, Vincenty, _c, _struct
from aerolith.operators import sequences

STALE_SECONDS = 30.0
STATE = ("seq", "lat", "lon", "height", "speed_mps", "track_heading_rad", "vertical_rate_mps", "last_ping_time")


def is_valid(speed="speed_mps", heading="track_heading_rad") -> Column:
    """Speed not negative and heading in [0, 2 pi], both ends included; NaN is invalid."""
    speed, heading = _c(speed), _c(heading)
    return F.coalesce((speed >= 0) & ~F.isnan(speed) & heading.between(0.0, 2 * pi), F.lit(False))


def split_invalid(pings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pings that may update a target, and those that are refused."""
    return pings.where(is_valid()), pings.where(~is_valid())


def latest_state(pings: DataFrame, by: str = "seq") -> DataFrame:
    """One row for each id: the valid ping that arrived last, whatever its time says; by='last_ping_time' takes event time.

    max_by aggregates before the shuffle, so a target may have any share of the pings.
    """
    last = F.max_by(F.struct(*STATE), F.struct(by, "seq"))
    return split_invalid(pings)[0].groupBy("id").agg(last.alias("s")).select("id", "s.*")


def state_at(pings: DataFrame, time: float, by: str = "seq") -> DataFrame:
    """The latest state among pings that were known at a time."""
    return latest_state(pings.where(F.col("last_ping_time") <= time), by)


def states_as_of(pings: DataFrame, times: DataFrame, by: str = "last_ping_time", parts: int | None = None) -> DataFrame:
    """The state of a target at each row of a table (id, time and whatever else): its columns with those of STATE.

    Pings known by a time are those with last_ping_time up to it; of them the last by
    event time counts, or with by='seq' the one that arrived last. Rows before a
    target's first ping are left out. Pings and times are one sorted sequence in
    ranges, so a target may have any share of either.
    """
    state = F.struct(*dict.fromkeys([by, "seq", *STATE]))
    known = split_invalid(pings)[0].where(F.col("last_ping_time").isNotNull()).select("id", F.col("last_ping_time").alias("__at"), F.lit(0).alias("__asks"), state.alias("__state"))
    asked = times.select("id", F.col("time").cast("double").alias("__at"), F.lit(1).alias("__asks"), F.struct(*times.columns).alias("__row"))
    rows = sequences.dealt(known.unionByName(asked, allowMissingColumns=True), ["id"], ["__at", "__asks"], parts)
    found = sequences.running_max(rows, ["id"], ["__at", "__asks"], F.col("__state"), "__last").where((F.col("__asks") == 1) & F.col("__last").isNotNull())
    return found.select("__row.*", *(F.col("__last")[c].alias(c) for c in STATE))


def remove(states: DataFrame, ids: DataFrame) -> DataFrame:
    """States without the targets in ids."""
    return states.join(ids.select("id").distinct(), "id", "left_anti")


def _fresh(dt: Column, stale: float) -> Column:
    return (dt >= 0) & (dt <= stale)


def dead_reckon(states: DataFrame, time, stale_seconds: float = STALE_SECONDS, solver: type = Vincenty, keep: tuple[str, ...] = ()) -> DataFrame:
    """Where each target is at a time (a number or a column): id, lat, lon, height, heading_rad, dt and the columns of keep.

    States from the future and states older than stale_seconds have no row; a
    state of exactly that age has. Only moving targets go through the solver.
    """
    live = states.withColumn("dt", _c(time) - F.col("last_ping_time")).where(_fresh(F.col("dt"), stale_seconds))
    climbed = F.col("height") + F.col("vertical_rate_mps") * F.col("dt")
    run = F.col("speed_mps") * F.col("dt")
    # the solver gets no distance for a still target, and stops at once
    live = live.withColumns({"climbed": climbed, "__run": F.when(run > 0, run)})
    live = solver.direct_onto(live, "lat", "lon", "height", "track_heading_rad", "__run", "p")
    gone = run > 0
    return live.select(
        "id", F.when(gone, F.col("p.lat")).otherwise(F.col("lat")).alias("lat"), F.when(gone, F.col("p.lon")).otherwise(F.col("lon")).alias("lon"),
        F.col("climbed").alias("height"), F.col("track_heading_rad").alias("heading_rad"), "dt", *keep,
    )


def flat_advance(lat, lon, heading, speed, seconds) -> Column:
    """Position after some seconds on a flat Earth: short steps of simulated targets and tips of velocity vectors."""
    lat, lon, heading, run = _c(lat), _c(lon), _c(heading), _c(speed) * _c(seconds)
    return _struct(lat=lat + run * F.cos(heading) / WGS84.a, lon=lon + F.try_divide(run * F.sin(heading), WGS84.a * F.cos(lat)))


def velocity_vectors(targets: DataFrame, seconds: float = 60.0, least_mps: float = 0.5) -> DataFrame:
    """Tip of the velocity vector of each target that moves: columns tip_lat and tip_lon."""
    tip = flat_advance("lat", "lon", "heading_rad", "speed_mps", seconds)
    moving = targets.where(F.col("speed_mps") > least_mps).withColumn("tip", tip)
    return moving.withColumns({"tip_lat": F.col("tip.lat"), "tip_lon": F.col("tip.lon")}).drop("tip")


def with_speed(targets: DataFrame, speeds: DataFrame, default: float = 0.0) -> DataFrame:
    """Targets with speed_mps of a table (id, speed_mps), or a default."""
    own = speeds.groupBy("id").agg(F.max("speed_mps").alias("__speed"))
    return targets.drop("speed_mps").join(own, "id", "left").withColumn("speed_mps", F.coalesce("__speed", F.lit(default))).drop("__speed")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def data_block(height, speed, rounded: bool = True) -> Column:
    """Text such as FL350 480KT: flight level and knots, rounded or cut off."""
    feet, knots = _c(height) * FEET_PER_METRE, _c(speed) * KNOTS_PER_MPS
    level = _half_up(_half_up(feet) / 100.0) if rounded else F.try_divide(feet, F.lit(100.0)).cast("long")
    knots = _half_up(knots) if rounded else knots.cast("long")
    shown = F.when(F.length(level.cast("string")) >= 3, level.cast("string")).otherwise(F.lpad(level.cast("string"), 3, "0"))
    return F.concat(F.lit("FL"), shown, F.lit(" "), knots.cast("string"), F.lit("KT"))


def moving_average(frames: DataFrame, order: str, value: str, by: str, rows: int = 60) -> DataFrame:
    """Mean of the last rows values in order, in each group of by: a view, session or target."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - rows, 0)
    return frames.withColumn("moving_avg", F.avg(value).over(w))


#: Frames a second while someone acts and else, and how long after an action.
ACTIVE_FPS, IDLE_FPS, ACTIVE_SECONDS = 60, 15, 1.0


def frame_rate(log: DataFrame, by: str, time: str, acts: str) -> DataFrame:
    """Target frames a second at each row of a log: ACTIVE_FPS up to ACTIVE_SECONDS after the last row on which acts holds, else IDLE_FPS."""
    w = Window.partitionBy(by).orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col(acts), F.col(time))).over(w)
    active = F.coalesce(F.col(time) - last <= ACTIVE_SECONDS, F.lit(False))
    return log.withColumn("target_fps", F.when(active, ACTIVE_FPS).otherwise(IDLE_FPS))


def without_nul(targets: DataFrame, key: str = "id") -> DataFrame:
    """Targets whose id a C string can hold: none with a NUL character."""
    return targets.where(~F.contains(F.col(key), F.lit("\0")))


#: What made-up targets are called and where, how high and how fast they fly.
MADE_CALLS, MADE_RADIUS_M, MADE_HEIGHT_M, MADE_SPEED = ("TAM", "GLO", "AZU", "COP", "HEL", "ARG", "TAP", "AAL", "KLM", "DLH"), (15e3, 80e3), (1000.0, 6000.0), (180.0, 70.0)


def made_targets(spark: SparkSession, n: int, lat: float, lon: float, seed: int = 0) -> DataFrame:
    """n made-up targets about a place, by hash of their number: the same ones each time, on any number of tasks."""
    part = lambda k: F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11) / F.lit(float(1 << 53))
    call = F.get(F.array(*(F.lit(c) for c in MADE_CALLS)), F.floor(part(0) * len(MADE_CALLS)).cast("int"))
    out, angle = (MADE_RADIUS_M[0] + part(2) * MADE_RADIUS_M[1]) / WGS84.a, part(3) * (2 * pi)
    return spark.range(n).select(
        F.concat(call, F.floor(100 + part(1) * 900).cast("string")).alias("id"), (lat + out * F.cos(angle)).alias("lat"), (lon + out * F.sin(angle)).alias("lon"),
        (MADE_HEIGHT_M[0] + part(4) * MADE_HEIGHT_M[1]).alias("height"), (MADE_SPEED[0] + part(5) * MADE_SPEED[1]).alias("speed_mps"),
        (part(6) * (2 * pi)).alias("track_heading_rad"), F.lit(0.0).alias("vertical_rate_mps"),
    )


def bucket_rate(frames: DataFrame, time: str, seconds: float = 0.5) -> DataFrame:
    """Frames of each bucket of time and how many a second that is: bucket (seconds), frames, fps."""
    bucket = F.floor(F.col(time) / seconds) * seconds
    return frames.groupBy(bucket.cast("double").alias("bucket")).agg(F.count("*").alias("frames")).withColumn("fps", F.col("frames") / F.lit(seconds))
