"""Elevation, profiles and clearance over tiles whose cells are a linear ramp, so SQL can work them out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.geodesy import Haversine, Vincenty
from aerolith.operators import terrain
from aerolith.plans.staging import shared_dir
from aerolith.queries.common import A, POINTS, ROUTES, bearing_sql, direct_sql, hav_sql, points, rnd, routes, rsql, table
from aerolith.queries.geodesy import vincenty_direct_sql, vincenty_inverse_sql
from aerolith.sources import dted, tile_files

CELLS, STEP = 13, 2000.0
#: Step along routes ahead, whose legs are of about terrain.ROUTE_STEP: with that as the step most legs would have no sample.
AHEAD_STEP = 600.0


def _tiles(rows: DataFrame) -> DataFrame:
    """Ramp tiles below points, but for those with an odd sum of degrees."""
    keys = rows.select(terrain.tile_floor(F.degrees("lat")).alias("lat_deg"), terrain.tile_floor(F.degrees("lon")).alias("lon_deg")).distinct()
    return dted.analytic_tiles(keys.where((F.col("lat_deg") + F.col("lon_deg")) % 2 == 0), CELLS, CELLS)


def elevation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return terrain.elevation(p, _tiles(p)).select("id", rnd("elevation", 3).alias("elevation"))


def elevation_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return terrain.elevation(p, _tiles(p)).where("elevation is null").select("id")


def null_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of voids: all points on them are at 0."""
    p = points(spark, sf_dir)
    void = _tiles(p).withColumn("elevations", F.transform("elevations", lambda _: F.lit(-32767).cast("smallint")))
    return terrain.elevation(p, void).where("elevation is not null").select("id", "elevation")


def tile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(points(spark, sf_dir)).select("lat_deg", "lon_deg", F.size("elevations").alias("cells"))


def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = terrain.samples(routes(spark, sf_dir), STEP, Haversine)
    return r.select("route_id", rnd("distance_meters", 2).alias("distance_meters"), rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), rnd("height", 2).alias("height"))


def profile_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = terrain.legs(routes(spark, sf_dir), Haversine)
    return r.select("route_id", "seq", rnd("length", 2).alias("length"), rnd("before", 2).alias("before"), rnd("bearing", 7).alias("bearing"))


def long_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of one route through all customers' points, in ranges."""
    r = points(spark, sf_dir).select(F.lit(1).alias("route_id"), F.col("id").alias("seq"), "lat", "lon", "height")
    return terrain.long_legs(r, Haversine).select("seq", rnd("length", 2).alias("length"), rnd("before", 1).alias("before"), "last")


def profile_vincenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes(spark, sf_dir)
    p = terrain.profile(r, _tiles(r), STEP, Vincenty)
    return p.select("route_id", rnd("distance_meters", 2).alias("distance_meters"), rnd("ground_elevation", 2).alias("ground_elevation"), "complete")


def clearance_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("height", F.col("height") / 20.0)
    r = terrain.clearance(p, _tiles(p))
    return r.select("id", rnd("clearance", 3).alias("clearance"), "hazard")


def _haversine_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes(spark, sf_dir)
    return terrain.profile(r, _tiles(r), STEP, Haversine)


def clearance_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = terrain.clearance_ahead(_haversine_profile(spark, sf_dir), 7000.0)
    return best.select("route_id", rnd("distance_meters", 2).alias("distance_meters"), rnd("clearance", 2).alias("clearance"))


def chart_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = _haversine_profile(spark, sf_dir).withColumn("ground_elevation", F.col("ground_elevation") * 3.0)  # above some routes
    return terrain.chart_top(high).select("route_id", rnd("top", 2).alias("top"))


def profile_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a profile in degrees, of routes laid through the customers' points; each leg has samples at its start and beyond."""
    t = points(spark, sf_dir).withColumn("heading_rad", F.radians((F.col("id") % 360).cast("double")))
    r = terrain.route_ahead(t)
    d = terrain.in_degrees(terrain.profile(r, _tiles(r), AHEAD_STEP, Haversine))
    return d.select("route_id", rnd("elevation", 2).alias("elevation"), rnd("lat_deg", 6).alias("lat_deg"), rnd("lon_deg", 6).alias("lon_deg"), "height")


def route_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = points(spark, sf_dir).withColumn("heading_rad", F.radians((F.col("id") % 360).cast("double")))
    return terrain.route_ahead(t).select("route_id", "seq", rnd("lat", 9).alias("lat"), rnd("lon", 9).alias("lon"), "height")


def elevation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup with points shuffled to blocks of cells, as it is for tiles too large to broadcast."""
    p = points(spark, sf_dir)
    t = dted.analytic_tiles(_tiles(p).select("lat_deg", "lon_deg"), 70, 67)
    return terrain.elevation(p, t, most_bytes=0).select("id", rnd("elevation", 3).alias("elevation"))


def _supplier_tiles(spark: SparkSession, sf_dir: str, lat: Column, lon: Column) -> DataFrame:
    """A small ramp tile for each supplier k, raised by k % 100."""
    k = F.col("k")
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    t = t.select("k", F.concat(F.lit("t"), k).alias("path"), lat.cast("int").alias("lat_deg"), lon.cast("int").alias("lon_deg"), (k % 4 + 2).cast("int").alias("num_rows"), (k % 5 + 3).cast("int").alias("num_cols"))
    cell = F.sequence(F.lit(0), F.col("num_rows") * F.col("num_cols") - 1)
    return t.withColumn("elevations", F.transform(cell, lambda i: (F.floor(i / F.col("num_rows")) * 10 + i % F.col("num_rows") + k % 100).cast("smallint")))


def _cells(tiles: DataFrame) -> list[Column]:
    """Facts of a tile's cells: their sum and the last one."""
    return [F.aggregate("elevations", F.lit(0).cast("long"), lambda s, v: s + v).alias("cells"), F.element_at("elevations", -1).cast("int").alias("last_cell")]


def dted_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, encoded and decoded again; every thirteenth is cut off in its header, every seventeenth behind it."""
    k = F.col("k")
    t = _supplier_tiles(spark, sf_dir, k * 37 % 170 - 85, k * 91 % 360 - 180)
    files = dted.encode_tiles(t).withColumn("k", F.substring("path", 2, 20).cast("long"))
    cut = F.when(k % 13 == 0, F.substring("content", 1, 100)).when(k % 17 == 0, F.substring("content", 1, dted.HEADER + 5)).otherwise(F.col("content"))
    d = dted.decode_tiles(files.select("path", cut.alias("content")))
    return d.select("path", "lat_deg", "lon_deg", "num_rows", "num_cols", "error", *_cells(d))


def dted_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which many are for one place, so that the last counts, and some are no tiles; those at the nations' places are unloaded again."""
    k = F.col("k")
    files = dted.encode_tiles(_supplier_tiles(spark, sf_dir, k % 20 - 10, k % 30 - 15)).withColumn("k", F.substring("path", 2, 20).cast("long"))
    loaded = dted.decode_tiles(files.select("path", F.when(k % 13 != 0, F.col("content")).otherwise(F.substring("content", 1, 100)).alias("content")))
    n = F.col("n_nationkey")
    gone = table(spark, sf_dir, "nation").select((n % 20 - 10).alias("lat_deg"), (n % 30 - 15).alias("lon_deg"))
    left = dted.unload(dted.register(loaded.withColumn("k", F.substring("path", 2, 20).cast("long")), "k"), gone)
    return left.select("lat_deg", "lon_deg", "path", *_cells(left))


def dted_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that are written to a folder and read back from it with filters that the scan takes over."""
    k = F.col("k")
    tile_files.register(spark)
    folder = f"{shared_dir(spark)}/aerolith/dted-{uuid.uuid4().hex}"
    t = _supplier_tiles(spark, sf_dir, k * 37 % 170 - 85, k * 91 % 360 - 180).withColumn("error", F.lit(None).cast("string"))
    dted.register(t, "k").write.format("dted").mode("append").save(folder)
    d = spark.read.format("dted").load(folder).where("lat_deg >= -30 and lat_deg < 55 and lon_deg > 0")
    return d.select("lat_deg", "lon_deg", "num_rows", "num_cols", *_cells(d))


def terrain_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", terrain.tile_floor(F.degrees("lat")).alias("lat_deg"), terrain.tile_floor(F.degrees("lon")).alias("lon_deg"))
    return p.select("id", dted.tile_url("http://host/{latStr}{lonStr}.dt0?at={lat},{lon}", "lat_deg", "lon_deg").alias("url"))


QUERIES = {
    f.__name__: f
    for f in (
        elevation_lookup, elevation_missing, null_sentinel, tile_keys, profile_samples, profile_distance, long_route, profile_vincenty, clearance_alert,
        clearance_nearest, chart_top, dted_decode, profile_degrees, route_ahead, elevation_blocks, dted_register, dted_source, terrain_urls,
    )
}

_FLOOR = "CASE WHEN abs(x-round(x)) < 1e-12 THEN round(x) ELSE floor(x) END"
_KEYS = f"""{POINTS}, deg AS (SELECT *, degrees(lat) AS y, degrees(lon) AS x FROM points),
keyed AS (SELECT *, ({_FLOOR.replace('x', 'y')})::INT AS ky, ({_FLOOR})::INT AS kx FROM deg),
ground AS (SELECT id, height, CASE WHEN (ky+kx) % 2 = 0 THEN ({CELLS}-1)*(10*greatest(0, least(1, x-kx)) + greatest(0, least(1, y-ky))) END AS e FROM keyed)"""


def _legs_sql(source: str) -> str:
    return f"""nxt AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(height) OVER w AS h2 FROM {source} WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
len AS (SELECT *, {hav_sql('lat', 'lon', 'lat2', 'lon2')} AS length, {bearing_sql('lat', 'lon', 'lat2', 'lon2')} AS brg FROM nxt WHERE lat2 IS NOT NULL),
legs AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM len)"""


_LEGS = f"{ROUTES}, {_legs_sql('routes')}"
_D = direct_sql("lat", "lon", "brg", "d")


def _sampled(step: float) -> str:
    return f"""cuts AS (SELECT *, unnest(range(floor(length/{step})::BIGINT))*{step} AS d FROM legs),
samples AS (SELECT route_id, before+d AS distance_meters, CASE WHEN abs(d) < 1e-12 THEN lat ELSE {_D[0]} END AS lat, CASE WHEN abs(d) < 1e-12 THEN lon ELSE {_D[1]} END AS lon,
    height+(h2-height)*d/length AS height FROM cuts
    UNION ALL SELECT route_id, before+length, lat2, lon2, h2 FROM legs QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY seq DESC) = 1)"""


_SAMPLES = f"{_LEGS}, {_sampled(STEP)}"


def _ground(source: str, under: str) -> str:
    """CTEs that add the ramp's elevation e to a table with lat and lon: ground. There are tiles below the points of another table."""
    keys = lambda t: f"SELECT *, ({_FLOOR.replace('x', 'y')})::INT AS ky, ({_FLOOR})::INT AS kx FROM (SELECT *, degrees(lat) AS y, degrees(lon) AS x FROM {t})"
    return f"""tiles AS (SELECT DISTINCT ky, kx FROM ({keys(under)}) WHERE (ky+kx) % 2 = 0),
ground AS (SELECT g.*, CASE WHEN t.ky IS NOT NULL THEN ({CELLS}-1)*(10*greatest(0, least(1, x-g.kx)) + greatest(0, least(1, y-g.ky))) END AS e
    FROM ({keys(source)}) g LEFT JOIN tiles t ON g.ky = t.ky AND g.kx = t.kx)"""


#: Tiles of suppliers; {lat} and {lon} are their places.
_TILES = """rows AS (SELECT s_suppkey AS k, 't' || s_suppkey AS path, (s_suppkey % 4 + 2)::INT AS r, (s_suppkey % 5 + 3)::INT AS c, s_suppkey % 100 AS up FROM supplier),
tiles AS (SELECT k, path, ({lat})::INT AS lat_deg, ({lon})::INT AS lon_deg, r AS num_rows, c AS num_cols,
    (10*r*(c*(c-1)//2) + c*(r*(r-1)//2) + c*r*up)::BIGINT AS cells, (10*(c-1) + r-1 + up)::INT AS last_cell FROM rows)"""

_AHEAD = f"""ahead AS (SELECT id AS route_id, k AS seq, lat+m*cos(h)/{A} AS lat, lon+m*sin(h)/({A}*cos(lat)) AS lon, height
    FROM (SELECT *, radians((id % 360)::DOUBLE) AS h, k*2000-30000 AS m FROM points, (SELECT unnest(range(41)) AS k)))"""

ORACLE_SQL = {
    "elevation_lookup": f"WITH {_KEYS} SELECT id, {rsql('e', 3)} AS elevation FROM ground",
    "elevation_missing": f"WITH {_KEYS} SELECT id FROM ground WHERE e IS NULL",
    "null_sentinel": f"WITH {_KEYS} SELECT id, 0e0 AS elevation FROM ground WHERE e IS NOT NULL",
    "tile_keys": f"WITH {_KEYS} SELECT DISTINCT ky AS lat_deg, kx AS lon_deg, {CELLS * CELLS}::INT AS cells FROM keyed WHERE (ky+kx) % 2 = 0",
    "profile_samples": f"""WITH {_SAMPLES} SELECT route_id, {rsql('distance_meters', 2)} AS distance_meters, {rsql('lat', 7)} AS lat, {rsql('lon', 7)} AS lon, {rsql('height', 2)} AS height FROM samples""",
    "profile_distance": f"""WITH {_LEGS} SELECT route_id, seq::INT AS seq, {rsql('length', 2)} AS length, {rsql('before', 2)} AS before,
        {rsql('brg - 2*pi()*floor(brg/(2*pi()))', 7)} AS bearing FROM legs""",
    "long_route": f"""WITH {POINTS}, one AS (SELECT 1 AS route_id, id AS seq, lat, lon, height FROM points), {_legs_sql('one')}
        SELECT seq, {rsql('length', 2)} AS length, {rsql('before', 1)} AS before, lead(seq) OVER (ORDER BY seq) IS NULL AS last FROM legs""",
    "clearance_alert": f"WITH {_KEYS} SELECT id, {rsql('height/20-coalesce(e,0)', 3)} AS clearance, height/20-coalesce(e,0) < 300 AS hazard FROM ground",
    "clearance_nearest": f"""WITH {_SAMPLES}, {_ground('samples', 'routes')} SELECT route_id, {rsql('distance_meters', 2)} AS distance_meters, {rsql('height-e', 2)} AS clearance FROM ground
        QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY abs(distance_meters-7000), distance_meters) = 1""",
    "chart_top": f"WITH {_SAMPLES}, {_ground('samples', 'routes')} SELECT route_id, {rsql('greatest(1000, coalesce(max(e)*3, 0), max(height))*1.2e0', 2)} AS top FROM ground GROUP BY route_id",
    "profile_vincenty": f"""WITH RECURSIVE {ROUTES}, nxt AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM routes WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
        {vincenty_inverse_sql('pairs AS (SELECT route_id*10+seq AS id, lat AS lat1, lon AS lon1, lat2, lon2 FROM nxt WHERE lat2 IS NOT NULL)')},
        legs AS (SELECT n.*, g.d AS length, g.b1 AS brg, coalesce(sum(g.d) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            lead(seq) OVER (PARTITION BY route_id ORDER BY seq) IS NULL AS final FROM nxt n JOIN geo g ON g.id = route_id*10+seq),
        cuts AS (SELECT *, unnest(range(floor(length/{STEP})::BIGINT)) AS k FROM legs),
        {vincenty_direct_sql(f'd0 AS (SELECT (route_id*10+seq)*1000+k AS id, lat, lon, brg AS bearing, k*{STEP} AS distance FROM cuts)')},
        samples AS (SELECT route_id, before+k*{STEP} AS distance_meters, m.lat, m.lon FROM cuts c JOIN moved m ON m.id = (route_id*10+seq)*1000+k
            UNION ALL SELECT route_id, before+length, lat2, lon2 FROM legs WHERE final), {_ground('samples', 'routes')}
        SELECT route_id, {rsql('distance_meters', 2)} AS distance_meters, {rsql('e', 2)} AS ground_elevation, bool_and(e IS NOT NULL) OVER (PARTITION BY route_id) AS complete FROM ground""",
    "profile_degrees": f"""WITH {POINTS}, {_AHEAD}, {_legs_sql('ahead')}, {_sampled(AHEAD_STEP)}, {_ground('samples', 'ahead')}
        SELECT route_id, {rsql('e', 2)} AS elevation, {rsql('degrees(lat)', 6)} AS lat_deg, {rsql('degrees(lon)', 6)} AS lon_deg, height FROM ground""",
    "route_ahead": f"WITH {POINTS}, {_AHEAD} SELECT route_id, seq::INT AS seq, {rsql('lat', 9)} AS lat, {rsql('lon', 9)} AS lon, height FROM ahead",
    "elevation_blocks": f"""WITH {_KEYS}, fine AS (SELECT id, CASE WHEN (ky+kx) % 2 = 0 THEN 69*10*greatest(0, least(1, x-kx)) + 66*greatest(0, least(1, y-ky)) END AS e FROM keyed)
        SELECT id, {rsql('e', 3)} AS elevation FROM fine""",
    "dted_register": f"""WITH {_TILES.format(lat='k % 20 - 10', lon='k % 30 - 15')},
        last AS (SELECT * FROM tiles WHERE k % 13 <> 0 QUALIFY row_number() OVER (PARTITION BY lat_deg, lon_deg ORDER BY k DESC) = 1)
        SELECT lat_deg, lon_deg, path, cells, last_cell FROM last WHERE (lat_deg, lon_deg) NOT IN (SELECT (n_nationkey % 20 - 10, n_nationkey % 30 - 15) FROM nation)""",
    "dted_source": f"""WITH {_TILES.format(lat='k*37 % 170 - 85', lon='k*91 % 360 - 180')}
        SELECT lat_deg, lon_deg, num_rows, num_cols, cells, last_cell FROM tiles WHERE lat_deg >= -30 AND lat_deg < 55 AND lon_deg > 0
        QUALIFY row_number() OVER (PARTITION BY lat_deg, lon_deg ORDER BY k DESC) = 1""",
    "terrain_urls": f"""WITH {_KEYS} SELECT id, 'http://host/' || lpad(abs(ky)::VARCHAR, 2, '0') || '0000' || CASE WHEN ky >= 0 THEN 'N' ELSE 'S' END || lpad(abs(kx)::VARCHAR, 3, '0') || '0000'
        || CASE WHEN kx >= 0 THEN 'E' ELSE 'W' END || '.dt0?at=' || ky || ',' || kx AS url FROM keyed""",
    "dted_decode": f"""WITH {_TILES.format(lat='k*37 % 170 - 85', lon='k*91 % 360 - 180')}, state AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'InvalidHeader' WHEN k % 17 = 0 THEN 'MalformedData' END AS error FROM tiles)
        SELECT path, error, {', '.join(f'CASE WHEN error IS NULL THEN {c} END AS {c}' for c in ('lat_deg', 'lon_deg', 'num_rows', 'num_cols', 'cells', 'last_cell'))} FROM state""",
}
