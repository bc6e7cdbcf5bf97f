"""Targets: state, dead reckoning, display values, frame statistics. Holds the flagship query."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.geodesy import Haversine, Vincenty
from aerolith.functions.projections import WebMercator
from aerolith.functions.symbols import callsign_symbol
from aerolith.operators import tiles, tracking
from aerolith.queries.common import A, PINGS, direct_sql, pings, rnd, rsql, table
from aerolith.queries.geodesy import vincenty_direct_sql

#: The stale threshold of the queries: pings of the test tables are hours apart.
STALE, ZOOM = 21_600.0, 6
#: Seconds since 1970 from which on orders ask for states.
ASKED_FROM = 1_704_067_000


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the latest time of any valid ping."""
    return tracking.split_invalid(pings(spark, sf_dir))[0].agg(F.max("last_ping_time").alias("now"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.latest_state(pings(spark, sf_dir)).crossJoin(F.broadcast(_now(spark, sf_dir)))  # one row


def track_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: targets dead reckoned to now, projected and counted by map tile."""
    at = tracking.dead_reckon(_states(spark, sf_dir), "now", STALE, Haversine)
    xy = at.withColumn("p", WebMercator().project("lat", "lon")).withColumn("t", tiles.tile_of("lat", "lon", ZOOM))
    return xy.groupBy("t.x", "t.y").agg(F.count("*").alias("targets"), rnd(F.avg("p.x"), 0).alias("mean_x"), rnd(F.max("height"), 2).alias("top"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tracking.latest_state(pings(spark, sf_dir))
    return r.select("id", "seq", rnd("lat", 9).alias("lat"), rnd("lon", 9).alias("lon"), "height", "speed_mps", rnd("last_ping_time", 3).alias("t"))


def reject_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.split_invalid(pings(spark, sf_dir))[1].select("seq", "id", "speed_mps", rnd("track_heading_rad", 8).alias("heading"))


def dead_reckon(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tracking.dead_reckon(_states(spark, sf_dir), "now", STALE, Haversine)
    return r.select("id", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), rnd("height", 2).alias("height"), rnd("heading_rad", 8).alias("heading_rad"))


def dead_reckon_vincenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tracking.dead_reckon(_states(spark, sf_dir), "now", STALE, Vincenty)
    return r.select("id", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), rnd("height", 2).alias("height"))


def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each target at the middle of the log."""
    p = pings(spark, sf_dir)
    mid = tracking.split_invalid(p)[0].agg(((F.min("last_ping_time") + F.max("last_ping_time")) / 2).alias("mid"))
    known = p.crossJoin(F.broadcast(mid)).where("last_ping_time <= mid")  # one row
    return tracking.latest_state(known).select("id", "seq", "height")


def states_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a target at the time of each order; a third of the orders ask for one target."""
    k = F.col("o_orderkey")
    asks = table(spark, sf_dir, "orders").select(k.alias("ask"), F.when(k % 3 == 0, "3").otherwise((F.col("o_custkey") % 200).cast("string")).alias("id"), (ASKED_FROM + k * 7919 % 2_600_000).alias("time"))
    return tracking.states_as_of(pings(spark, sf_dir), asks).select("ask", "id", "seq", "height")


def states_as_of_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each customer, of the pings known by then the one that arrived last, when arrival runs against time."""
    k = F.col("c_custkey")
    asks = table(spark, sf_dir, "customer").select(k.alias("ask"), (k % 50).cast("string").alias("id"), (ASKED_FROM + k * 104_729 % 2_600_000).alias("time"))
    back = pings(spark, sf_dir).withColumn("seq", F.col("seq") * 7919 % 1_000_003)
    return tracking.states_as_of(back, asks, by="seq").select("ask", "seq", "height")


def remove_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "events").where(F.col("event_type") == "error").select((F.col("user_id") * 2).cast("string").alias("id"))
    return tracking.remove(tracking.latest_state(pings(spark, sf_dir)), gone).select("id", "seq")


def velocity_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracking.latest_state(pings(spark, sf_dir)).withColumnRenamed("track_heading_rad", "heading_rad")
    return tracking.velocity_vectors(t).select("id", rnd("tip_lat", 8).alias("tip_lat"), rnd("tip_lon", 8).alias("tip_lon"))


def sim_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pings(spark, sf_dir).withColumn("q", tracking.flat_advance("lat", "lon", "track_heading_rad", "speed_mps", 0.5))
    return p.select("seq", rnd("q.lat", 8).alias("lat"), rnd("q.lon", 8).alias("lon"))


def speed_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    targets = e.select((F.col("user_id") * 2).cast("string").alias("id")).distinct()
    return tracking.with_speed(targets, pings(spark, sf_dir).select("id", "speed_mps"), 180.0)


def datablock_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings(spark, sf_dir).select("seq", tracking.data_block("height", "speed_mps").alias("label"))


def datablock_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings(spark, sf_dir).where("speed_mps >= 0").select("seq", tracking.data_block("height", "speed_mps", rounded=False).alias("label"))


def moving_avg_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return tracking.moving_average(e, "event_id", "value", by="user_id").select("event_id", rnd("moving_avg", 9).alias("moving_avg"))


def fps_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pings(spark, sf_dir).select("last_ping_time")
    return tracking.bucket_rate(e, "last_ping_time", 3600.0).select("bucket", "frames", rnd("fps", 9).alias("fps"))


def callsigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("TAM", "GLO", "AZU", "COP", "HEL", "PPX")))
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.get(names, (F.col("event_id") % 6).cast("int")), F.col("user_id").cast("string")).alias("callsign"))
    return e.select("event_id", "callsign", callsign_symbol("callsign").alias("symbol"))


def frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rates of each user's log, whose clicks are actions and whose seconds are hours."""
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).alias("t"), (F.col("event_type") == "click").alias("acts"))
    return tracking.frame_rate(e, "user_id", "t", "acts").select("event_id", "target_fps")


def without_nul(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("T"), F.when(F.col("event_id") % 7 == 0, F.lit("\0")).otherwise("")).alias("id"))
    return tracking.without_nul(e).select("event_id")


QUERIES = {
    f.__name__: f
    for f in (
        track_density, latest_state, reject_invalid, dead_reckon, dead_reckon_vincenty, state_as_of, states_as_of, states_as_of_arrival, remove_targets, velocity_vector, sim_advance,
        speed_default, datablock_rounded, datablock_truncated, moving_avg_60, fps_bucket, callsigns, frame_rate, without_nul,
    )
}

_LIVE = f"""{PINGS}, now AS (SELECT max(t) AS now FROM valid),
live AS (SELECT id, lat, lon, height + climb*(now-t) AS height, heading, speed*(now-t) AS distance FROM latest, now WHERE now-t BETWEEN 0 AND {STALE!r})"""
_D = direct_sql("lat", "lon", "heading", "distance")
_MOVED = f"{_LIVE}, moved AS (SELECT id, CASE WHEN distance > 0 THEN {_D[0]} ELSE lat END AS lat, CASE WHEN distance > 0 THEN {_D[1]} ELSE lon END AS lon, height, heading FROM live)"
_CLAMP = f"greatest(-radians(85.05112878e0), least(radians(85.05112878e0), lat))"
_N = float(2**ZOOM)
_TX = f"greatest(0, least({_N - 1}, floor((degrees(lon)+180)/360*{_N})))::INT"
_TY = f"greatest(0, least({_N - 1}, floor((1-ln(abs(tan(lat)+1/cos(lat)))/pi())/2*{_N})))::INT"
_SHIFT = "lat+{v}*cos({h})/" + A, "lon+{v}*sin({h})/(" + A + "*cos(lat))"


def _block(round_: bool) -> str:
    level = "floor(floor(height*3.28084e0+0.5e0)/100e0+0.5e0)::BIGINT" if round_ else "trunc(height*3.28084e0/100e0)::BIGINT"
    knots = "floor(speed*1.94384e0+0.5e0)::BIGINT" if round_ else "trunc(speed*1.94384e0)::BIGINT"
    return f"'FL' || CASE WHEN length(({level})::VARCHAR) >= 3 THEN ({level})::VARCHAR ELSE lpad(({level})::VARCHAR, 3, '0') END || ' ' || ({knots})::VARCHAR || 'KT'"


ORACLE_SQL = {
    "track_density": f"""WITH {_MOVED} SELECT {_TX} AS x, {_TY} AS y, count(*)::BIGINT AS targets, {rsql(f'avg({A}*lon)', 0)} AS mean_x, {rsql('max(height)', 2)} AS top
        FROM moved GROUP BY 1, 2""",
    "latest_state": f"WITH {PINGS} SELECT id, seq, {rsql('lat', 9)} AS lat, {rsql('lon', 9)} AS lon, height, speed AS speed_mps, {rsql('t', 3)} AS t FROM latest",
    "reject_invalid": f"WITH {PINGS} SELECT seq, id, speed AS speed_mps, {rsql('heading', 8)} AS heading FROM pings WHERE NOT (speed >= 0 AND heading >= 0 AND heading <= {2 * pi!r})",
    "dead_reckon": f"""WITH {_MOVED} SELECT id, {rsql('lat', 7)} AS lat, {rsql('lon', 7)} AS lon, {rsql('height', 2)} AS height, {rsql('heading', 8)} AS heading_rad FROM moved""",
    "dead_reckon_vincenty": f"""WITH RECURSIVE {vincenty_direct_sql(_LIVE + ', d0 AS (SELECT id, lat, lon, heading AS bearing, distance FROM live)')}
        SELECT m.id, {rsql('m.lat', 7)} AS lat, {rsql('m.lon', 7)} AS lon, {rsql('l.height', 2)} AS height FROM moved m JOIN live l USING (id)""",
    "state_as_of": f"""WITH {PINGS}, mid AS (SELECT (min(t)+max(t))/2 AS mid FROM valid)
        SELECT id, seq, height FROM valid, mid WHERE t <= mid QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""",
    "states_as_of": f"""WITH {PINGS}, asks AS (SELECT o_orderkey AS ask, CASE WHEN o_orderkey % 3 = 0 THEN '3' ELSE (o_custkey % 200)::VARCHAR END AS id, {ASKED_FROM} + o_orderkey*7919 % 2600000 AS time FROM orders)
        SELECT a.ask, a.id, v.seq, v.height FROM asks a ASOF JOIN valid v ON a.id = v.id AND a.time::DOUBLE >= v.t""",
    "states_as_of_arrival": f"""WITH {PINGS}, asks AS (SELECT c_custkey AS ask, (c_custkey % 50)::VARCHAR AS id, {ASKED_FROM} + c_custkey*104729 % 2600000 AS time FROM customer)
        SELECT a.ask, v.seq*7919 % 1000003 AS seq, v.height FROM asks a JOIN valid v ON a.id = v.id AND a.time::DOUBLE >= v.t QUALIFY row_number() OVER (PARTITION BY a.ask ORDER BY v.seq*7919 % 1000003 DESC) = 1""",
    "remove_targets": f"WITH {PINGS} SELECT id, seq FROM latest WHERE id NOT IN (SELECT (user_id*2)::VARCHAR FROM events WHERE event_type = 'error')",
    "velocity_vector": f"""WITH {PINGS} SELECT id, {rsql(_SHIFT[0].format(v='speed*60', h='heading'), 8)} AS tip_lat, {rsql(_SHIFT[1].format(v='speed*60', h='heading'), 8)} AS tip_lon
        FROM latest WHERE speed > 0.5""",
    "sim_advance": f"""WITH {PINGS} SELECT seq, {rsql(_SHIFT[0].format(v='speed*0.5e0', h='heading'), 8)} AS lat, {rsql(_SHIFT[1].format(v='speed*0.5e0', h='heading'), 8)} AS lon FROM pings""",
    "speed_default": f"""WITH {PINGS}, t AS (SELECT DISTINCT (user_id*2)::VARCHAR AS id FROM events)
        SELECT t.id, coalesce(max(p.speed), 180e0) AS speed_mps FROM t LEFT JOIN pings p USING (id) GROUP BY t.id""",
    "datablock_rounded": f"WITH {PINGS} SELECT seq, {_block(True)} AS label FROM pings",
    "datablock_truncated": f"WITH {PINGS} SELECT seq, {_block(False)} AS label FROM pings WHERE speed >= 0",
    "moving_avg_60": f"SELECT event_id, {rsql('avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 59 PRECEDING)', 9)} AS moving_avg FROM events",
    "fps_bucket": f"""WITH {PINGS} SELECT floor(t/3600e0)*3600e0 AS bucket, count(*)::BIGINT AS frames, {rsql('count(*)/3600e0', 9)} AS fps FROM pings GROUP BY 1""",
    "frame_rate": """WITH e AS (SELECT event_id, user_id, epoch_us(ts)/3.6e9 AS t, event_type = 'click' AS acts FROM events),
        l AS (SELECT event_id, t, max(CASE WHEN acts THEN t END) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS last FROM e)
        SELECT event_id, (CASE WHEN coalesce(t-last <= 1, false) THEN 60 ELSE 15 END)::INT AS target_fps FROM l""",
    "without_nul": "SELECT event_id FROM events WHERE event_id % 7 <> 0",
    "callsigns": """WITH c AS (SELECT event_id, ['TAM','GLO','AZU','COP','HEL','PPX'][(event_id % 6)::INT + 1] || user_id::VARCHAR AS callsign FROM events)
        SELECT event_id, callsign, CASE WHEN callsign LIKE 'AZU%' THEN 'mil:fighter' WHEN callsign LIKE 'COP%' OR callsign LIKE 'HEL%' THEN 'custom:helicopter'
        ELSE 'civil:plane' END AS symbol FROM c""",
}
