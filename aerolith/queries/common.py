"""Tables of points, pairs, pings and routes that are derived from the driver's tables by integer arithmetic, in Spark and in SQL."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(x, n: int) -> Column:
    """Rounded as the last step, with no negative zero."""
    return F.round(x if isinstance(x, Column) else F.col(x), n) + F.lit(0.0)


def rsql(x: str, n: int) -> str:
    return f"round({x}, {n}) + 0e0"


def wrap_sql(x: str, low: str = "0e0") -> str:
    """x modulo 2 pi, from low on."""
    return f"(({x}) - {low} - 2*pi()*floor((({x}) - {low})/(2*pi())) + {low})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.radians((k * 37 % 17000) / F.lit(100.0) - 85.0).alias("lat"), F.radians((k * 91 % 36000) / F.lit(100.0) - 180.0).alias("lon"),
        (k * 13 % 12000).cast("double").alias("height"),
    )


POINTS = """points AS (SELECT c_custkey AS id, radians((c_custkey*37 % 17000)/100e0 - 85e0) AS lat, radians((c_custkey*91 % 36000)/100e0 - 180e0) AS lon,
    (c_custkey*13 % 12000)::DOUBLE AS height FROM customer)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return points(spark, sf_dir).select(
        "id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.radians(((k * 53 + 11) % 17000) / F.lit(100.0) - 85.0).alias("lat2"),
        F.radians(((k * 171 + 7) % 36000) / F.lit(100.0) - 180.0).alias("lon2"), "height",
        F.radians((k * 29 % 360).cast("double")).alias("bearing"), (k * 997 % 4_000_000).cast("double").alias("distance"),
    )


PAIRS = f"""{POINTS}, pairs AS (SELECT id, lat AS lat1, lon AS lon1, radians(((id*53+11) % 17000)/100e0 - 85e0) AS lat2,
    radians(((id*171+7) % 36000)/100e0 - 180e0) AS lon2, height, radians((id*29 % 360)::DOUBLE) AS bearing, (id*997 % 4000000)::DOUBLE AS distance FROM points)"""


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings_of(table(spark, sf_dir, "events"))


def pings_of(events: DataFrame) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    return events.select(
        u.cast("string").alias("id"), e.alias("seq"), F.radians(((u * 37 + e) % 120 - 60).cast("double")).alias("lat"),
        F.radians(((u * 91 + e * 7) % 360 - 180).cast("double")).alias("lon"), (1000 + e * 13 % 11000).cast("double").alias("height"),
        (e % 260 - 10).cast("double").alias("speed_mps"), F.radians((e * 7 % 365).cast("double")).alias("track_heading_rad"),
        (e % 21 - 10).cast("double").alias("vertical_rate_mps"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("last_ping_time"),
    )


PINGS = f"""pings AS (SELECT user_id::VARCHAR AS id, event_id AS seq, radians(((user_id*37+event_id) % 120 - 60)::DOUBLE) AS lat,
    radians(((user_id*91+event_id*7) % 360 - 180)::DOUBLE) AS lon, (1000 + event_id*13 % 11000)::DOUBLE AS height, (event_id % 260 - 10)::DOUBLE AS speed,
    radians((event_id*7 % 365)::DOUBLE) AS heading, (event_id % 21 - 10)::DOUBLE AS climb, epoch_us(ts)/1e6 AS t FROM events),
valid AS (SELECT * FROM pings WHERE speed >= 0 AND heading >= 0 AND heading <= {2 * pi!r}),
latest AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points for each order."""
    k = F.col("o_orderkey")
    seq = table(spark, sf_dir, "orders").select(k.alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"))
    k, s = F.col("route_id"), F.col("seq")
    lat = (k * 37 % 12000) / F.lit(100.0) - 60.0 + s * (k % 3 - 1) * 0.05
    lon = (k * 91 % 35000) / F.lit(100.0) - 175.0 + s * 0.07
    return seq.select("route_id", "seq", F.radians(lat).alias("lat"), F.radians(lon).alias("lon"), (1000 + k % 900 + s * 100).cast("double").alias("height"))


ROUTES = """routes AS (SELECT o_orderkey AS route_id, s AS seq, radians((o_orderkey*37 % 12000)/100e0 - 60e0 + s*(o_orderkey % 3 - 1)*0.05e0) AS lat,
    radians((o_orderkey*91 % 35000)/100e0 - 175e0 + s*0.07e0) AS lon, (1000 + o_orderkey % 900 + s*100)::DOUBLE AS height
    FROM orders, (SELECT unnest(range(3)) AS s))"""

#: Constants of WGS84 as SQL literals.
A, F_, E2, EP2, R1 = "6378137e0", "(1e0/298.257223563e0)", "0.0066943799901413165e0", "0.006739496742276434e0", "6371008.771415059e0"
B = f"({A}*(1e0-{F_}))"


def ecef_sql(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    n = f"({A}/sqrt(1-{E2}*sin({lat})*sin({lat})))"
    return f"({n}+{h})*cos({lat})*cos({lon})", f"({n}+{h})*cos({lat})*sin({lon})", f"({n}*(1-{E2})+{h})*sin({lat})"


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"({R1}*2*asin(sqrt(pow(sin(({lat2}-{lat1})/2),2)+cos({lat1})*cos({lat2})*pow(sin(({lon2}-{lon1})/2),2))))"


def bearing_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"atan2(sin({lon2}-{lon1})*cos({lat2}), cos({lat1})*sin({lat2})-sin({lat1})*cos({lat2})*cos({lon2}-{lon1}))"


def direct_sql(lat: str, lon: str, bearing: str, dist: str) -> tuple[str, str]:
    d = f"({dist}/{R1})"
    lat2 = f"asin(sin({lat})*cos({d})+cos({lat})*sin({d})*cos({bearing}))"
    lon2 = f"({lon}+atan2(sin({bearing})*sin({d})*cos({lat}), cos({d})-sin({lat})*sin({lat2})))"
    return lat2, wrap_sql(lon2, "(-pi())")
