"""Tile grids, covers, meshes, graticules, joins of tile sets and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.projections import Stereographic, WebMercator
from aerolith.operators import tiles
from aerolith.queries.common import A, E2, POINTS, ecef_sql, points, rnd, rsql, table, wrap_sql
from aerolith.queries.geodesy import CHI

Z = 7
N = float(2**Z)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("t", tiles.tile_of("lat", "lon", Z)).select("id", F.lit(Z).alias("z"), "t.x", "t.y")


def tile_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", tiles.tile_x("lon", Z).alias("x"), tiles.tile_y("lat", Z).alias("y"))


def tile_xy_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("id", "x", "y", tiles.tile_key(F.col("z"), F.col("x"), F.col("y")).alias("key"))


def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _keyed(spark, sf_dir).withColumn("b", tiles.tile_bounds("x", "y", Z))
    return r.select("id", *(rnd(f"b.{c}", 8).alias(c) for c in ("south", "west", "north", "east")))


def tile_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    zoom, width = (k % 977 + 1) / F.lit(50.0), (k % 9973 + 1) * F.lit(1000.0)
    return table(spark, sf_dir, "customer").select("c_custkey", tiles.camera_zoom(zoom).alias("camera"), tiles.ideal_zoom(width).alias("ideal"))


def wms_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _keyed(spark, sf_dir).withColumn("b", tiles.web_bbox("x", "y", Z))
    return r.select("id", *(rnd(f"b.{c}", 3).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def tms_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("id", "y", tiles.flip_row("y", Z).alias("y_tms"))


def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers of the boxes of the nations' customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("view"))
    corners = points(spark, sf_dir).join(c, "id").select("view", "lat", "lon")
    return tiles.cover(corners, 4)


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("z", "x", "y").distinct()


def tile_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meshes of the tiles that have customers."""
    m = tiles.mesh(_tiles(spark, sf_dir), WebMercator())
    return m.select("x", "y", "row", "col", "u", "v", rnd("px", 1).alias("px"), rnd("py", 1).alias("py"))


def mesh_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One buffer for the meshes of all suppliers' tiles, each behind the vertices of those before it."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"))
    return tiles.index_buffer(own, "n")


def _lines(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """Graticule lines next to customers: kind and deg."""
    p = points(spark, sf_dir)
    near = lambda c: F.rint(F.degrees(c) / step).cast("int") * step
    return p.select(F.lit("parallel").alias("kind"), near("lat").alias("deg")).union(p.select(F.lit("meridian"), near("lon"))).distinct()


def graticule_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices on the globe of the lines next to customers."""
    g = tiles.graticule(spark).join(_lines(spark, sf_dir, 10), ["kind", "deg"], "left_semi")
    return g.select("kind", "deg", "segment", "end", *(rnd(c, 2).alias(c) for c in "xyz"))


def graticule_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tiles.graticule(spark, WebMercator()).join(_lines(spark, sf_dir, 5), ["kind", "deg"], "left_semi")
    return g.select("kind", "deg", "segment", "end", rnd("x", 1).alias("x"), rnd("y", 1).alias("y"))


def semi_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keyed(spark, sf_dir).where(F.col("id") % 3 == 0)
    return tiles.visible(_keyed(spark, sf_dir), keys).select("id", "x", "y")


def anti_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed(spark, sf_dir)
    return tiles.wanted(k, k.where(F.col("id") % 3 == 0), k.where(F.col("id") % 3 == 1))


def lru_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    return tiles.evict(e, "user_id", "event_id", 9, by="event_type")


def fifo_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    return tiles.evict(e, "user_id", "event_id", 9, "fifo", by="event_type")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view for each customer: centres, zooms, turns, and every fifth one on the globe."""
    k = F.col("id")
    return points(spark, sf_dir).select(
        k.alias("view"), "lat", "lon", ((k % 13 + 1) * 0.01).alias("zoom"), F.radians((k % 90).cast("double")).alias("rotation"), F.lit(100_000.0).alias("viewport_base_meters"),
        F.lit(1.5).alias("aspect_ratio"), F.when(k % 5 == 0, "3D").otherwise("2D").alias("mode"),
    )


def view_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.visible_bounds(_views(spark, sf_dir), WebMercator())


def view_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tiles_within(tiles.visible_bounds(_views(spark, sf_dir), WebMercator(), F.lit(3)))


def view_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tiles.visible_keys(_views(spark, sf_dir), WebMercator())
    return keys.groupBy("view", "z").agg(F.count("*").alias("tiles"), *(f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))))


def pan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("view")
    v = _views(spark, sf_dir).withColumns({"dx_px": (k % 31 - 15).cast("double"), "dy_px": (k % 17 - 8).cast("double"), "canvas_width": F.lit(800.0)})
    return tiles.panned(v, WebMercator()).select("view", rnd("lat", 8).alias("lat"), rnd("lon", 8).alias("lon"))


def tile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed(spark, sf_dir)
    return k.select("id", tiles.wmts_url("http://host/wmts", "base", "z", "x", "y").alias("wmts"), tiles.wmts_url("http://host/wmts?map=a", "base", "z", "x", "y").alias("more"), tiles.xyz_url("http://host/{z}/{x}/{y}.png", "z", "x", "y").alias("xyz"))


def resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses from a resolver: hosts take turns, and a row is counted from the bottom."""
    host = lambda x, y: F.when((x + y) % 2 == 0, "http://a").otherwise("http://b")
    address = lambda z, x, y: F.concat_ws("/", host(x, y), z, x, F.lit(2**Z - 1) - y)
    return _keyed(spark, sf_dir).select("id", tiles.xyz_url(address, "z", "x", "y").alias("url"))


def key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed(spark, sf_dir).select("id", tiles.tile_key(F.col("z"), F.col("x"), F.col("y")).alias("key"))
    return k.select("id", tiles.parse_key("key").alias("p")).select("id", "p.z", "p.x", "p.y")


def tile_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the customers' tiles and of four about the centre, under a projection whose antipode is a corner of the grid: that one has no image and is at 0, 0."""
    about = _keyed(spark, sf_dir).where("id < 4").select("z", (F.col("id") % 2 * 2 ** (Z - 1)).alias("x"), (F.lit(2 ** (Z - 1)) - F.floor(F.col("id") / 2)).alias("y"))
    c = tiles.tile_corners(_tiles(spark, sf_dir).union(about).distinct(), Stereographic(0.0, 0.0))
    return c.select("x", "y", "row", "col", rnd("px", 0).alias("px"), rnd("py", 0).alias("py"))


def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.prune(_keyed(spark, sf_dir), Z, (10, 60, 40, 90), most=100).select("id", "x", "y")


QUERIES = {
    f.__name__: f
    for f in (
        tile_xy, tile_xy_clamped, tile_bounds, tile_zoom, wms_bbox, tms_flip, tile_cover, tile_mesh, mesh_indices, graticule_3d, graticule_2d, semi_visible,
        anti_pending, lru_cache, fifo_cache, view_bounds, view_tiles, view_keys, pan_view, tile_urls, resolved_urls, key_parts, tile_corners, cache_prune,
    )
}


def _row(lat: str, n: float = N) -> str:
    return f"(1-ln(abs(tan({lat})+1/cos({lat})))/pi())/2*{n}"


_CLAMPED = "greatest(-radians(85.0511e0), least(radians(85.0511e0), lat))"
_KEYED = f"""{POINTS}, keyed AS (SELECT id, greatest(0, least({N - 1}, floor((degrees(lon)+180)/360*{N})))::INT AS x, greatest(0, least({N - 1}, floor({_row('lat')})))::INT AS y FROM points)"""
_HALF = f"({A}*pi())"
_EDGE = f"(2*{_HALF}/{N})"
_LAT = lambda y, n="%s" % N: f"atan(sinh(pi()*(1-2*({y})/{n})))"
_CACHE = """WITH u AS (SELECT event_type, user_id, {f}(event_id) AS used FROM events GROUP BY 1, 2)
    SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY used DESC, user_id) <= 9"""

_VIEWS = f"""{POINTS}, views AS (SELECT id AS view, lat, lon, (id % 13 + 1)*0.01e0 AS zoom, radians((id % 90)::DOUBLE) AS turn, id % 5 = 0 AS globe FROM points),
sized AS (SELECT *, 100000e0/zoom AS w, 100000e0/zoom/1.5e0 AS h, {A}*lon AS cx, {A}*ln(tan(pi()/4+greatest(-radians(85.05112878e0), least(radians(85.05112878e0), lat))/2)) AS cy FROM views)"""
_back = lambda x, y: (f"greatest(-radians(85.05112878e0), least(radians(85.05112878e0), 2*atan(exp(({y})/{A}))-pi()/2))", wrap_sql(f"({x})/{A}", "(-pi())"))
_wide = lambda lon: f"floor((degrees({lon})+180)/360*pow(2,z))"
_tall = lambda lat: f"floor((1-ln(abs(tan({lat})+1/cos({lat})))/pi())/2*pow(2,z))"
_safe = lambda lat: f"greatest(-radians(85.0511e0), least(radians(85.0511e0), {lat}))"
_in = lambda v: f"greatest(0, least(pow(2,z)-1, {v}))"


def _bounds_sql(z: str) -> str:
    lat, lon = _back("cx+ox*w*cos(turn)-oy*h*sin(turn)", "cy+ox*w*sin(turn)+oy*h*cos(turn)")
    return f"""{_VIEWS}, zoomed AS (SELECT *, {z} AS z FROM sized),
seen AS (SELECT *, {lat} AS plat, {lon} AS plon FROM zoomed, (VALUES (-0.5e0, -0.5e0), (0.5e0, -0.5e0), (-0.5e0, 0.5e0), (0.5e0, 0.5e0)) AS o(ox, oy)),
box AS (SELECT view, z::INT AS z, any_value(globe) AS globe, {_wide('any_value(lon)')} AS tx, {_tall(_safe('any_value(lat)'))} AS ty,
    min({_wide('plon')}) AS x0, max({_wide('plon')}) AS x1, min({_tall(_safe('plat'))}) AS y0, max({_tall(_safe('plat'))}) AS y1 FROM seen GROUP BY view, z),
bounds AS (SELECT view, z, greatest(0, CASE WHEN globe THEN tx-2 ELSE x0-1 END)::INT AS min_x, least(pow(2,z)-1, CASE WHEN globe THEN tx+2 ELSE x1+1 END)::INT AS max_x,
    greatest(0, CASE WHEN globe THEN ty-2 ELSE y0-1 END)::INT AS min_y, least(pow(2,z)-1, CASE WHEN globe THEN ty+2 ELSE y1+1 END)::INT AS max_y FROM box)"""


def _keys_sql() -> str:
    lat, lon = _back("cx+ox*w*cos(turn)-oy*h*sin(turn)", "cy+ox*w*sin(turn)+oy*h*cos(turn)")
    probes = ", ".join(f"({x}e0, {y}e0)" for x in (-0.5, 0.0, 0.5) for y in (-0.5, 0.0, 0.5))
    up, side = "least(90e0, h/111000e0)", "least(180e0, w/(111000e0*greatest(abs(cos(lat)), 0.01e0)))"
    return f"""WITH {_VIEWS}, zoomed AS (SELECT *, least(18, greatest(0, round(log2(6*40075016e0/w)))) AS z FROM sized),
seen AS (SELECT view, z, {lat} AS plat, {lon} AS plon FROM zoomed, (VALUES {probes}) AS o(ox, oy) WHERE NOT globe
    UNION ALL SELECT view, z, radians(degrees(lat)+k*{up}), radians(degrees(lon)+k*{side}) FROM zoomed, (VALUES (-1e0), (1e0)) AS o(k) WHERE globe),
box AS (SELECT view, min({_in(_wide('plon'))}) AS x0, max({_in(_wide('plon'))}) AS x1, min({_in(_tall('plat'))}) AS y0, max({_in(_tall('plat'))}) AS y1 FROM seen GROUP BY view),
own AS (SELECT view, z, {_in(_wide('lon'))} AS tx, {_in(_tall('lat'))} AS ty, x0, x1, y0, y1 FROM zoomed JOIN box USING (view)),
cut AS (SELECT view, z, tx, ty, greatest(x0, tx-8) AS x0, least(x1, tx+8) AS x1, greatest(y0, ty-8) AS y0, least(y1, ty+8) AS y1 FROM own),
picked AS (SELECT view, z, CASE WHEN x0 <= x1 AND y0 <= y1 THEN x0 ELSE tx END AS a, CASE WHEN x0 <= x1 AND y0 <= y1 THEN x1 ELSE tx END AS b,
    CASE WHEN x0 <= x1 AND y0 <= y1 THEN y0 ELSE ty END AS c, CASE WHEN x0 <= x1 AND y0 <= y1 THEN y1 ELSE ty END AS d FROM cut)
SELECT view, z::INT AS z, ((b-a+1)*(d-c+1))::BIGINT AS tiles, a::INT AS min_x, b::INT AS max_x, c::INT AS min_y, d::INT AS max_y FROM picked"""



def _graticule_sql(step: int, segments: int, reach: int, first: int) -> str:
    """CTEs of the vertices of lines next to customers: v(kind, deg, segment, end, lat, lon)."""
    return f"""{POINTS}, lines AS (SELECT DISTINCT 'parallel' AS kind, round_even(degrees(lat)/{step}, 0)::BIGINT*{step} AS deg FROM points
        UNION SELECT 'meridian', round_even(degrees(lon)/{step}, 0)::BIGINT*{step} FROM points),
    ends AS (SELECT kind, deg, s::INT AS segment, e::INT AS "end", (s+e)/{float(segments)!r} AS part FROM lines, (SELECT unnest(range({segments})) AS s), (SELECT unnest(range(2)) AS e)
        WHERE kind = 'meridian' OR abs(deg) <= {first}),
    v AS (SELECT *, radians(CASE WHEN kind = 'parallel' THEN deg ELSE part*{2.0 * reach!r}-{reach} END) AS lat, radians(CASE WHEN kind = 'parallel' THEN part*360-180 ELSE deg END) AS lon FROM ends)"""


_PAN = _back("cx-(dx*cos(-turn)-dy*sin(-turn))*w/800", "cy+(dx*sin(-turn)+dy*cos(-turn))*w/800")
_WMTS = "service=WMTS&request=GetTile&version=1.0.0&layer=base&style=&tilematrixset=EPSG:900913&TileMatrix=EPSG:900913:7&TileRow=' || y || '&TileCol=' || x || '&format=image/png'"

ORACLE_SQL = {
    "view_bounds": f"WITH {_bounds_sql('least(18, greatest(1, floor(log2(zoom)+11.5)))')} SELECT * FROM bounds",
    "view_tiles": f"""WITH {_bounds_sql('3')} SELECT view, z, x, y FROM (SELECT *, unnest(range(min_x, max_x+1))::INT AS x FROM bounds), LATERAL (SELECT unnest(range(min_y, max_y+1))::INT AS y)""",
    "view_keys": _keys_sql(),
    "pan_view": f"""WITH {_VIEWS}, drags AS (SELECT *, (view % 31 - 15)::DOUBLE AS dx, (view % 17 - 8)::DOUBLE AS dy FROM sized)
        SELECT view, {rsql(_PAN[0], 8)} AS lat, {rsql(_PAN[1], 8)} AS lon FROM drags""",
    "tile_urls": f"WITH {_KEYED} SELECT id, 'http://host/wmts?{_WMTS} AS wmts, 'http://host/wmts?map=a&{_WMTS} AS more, 'http://host/7/' || x || '/' || y || '.png' AS xyz FROM keyed",
    "resolved_urls": f"WITH {_KEYED} SELECT id, CASE WHEN (x+y) % 2 = 0 THEN 'http://a/' ELSE 'http://b/' END || '{Z}/' || x || '/' || ({2**Z - 1}-y) AS url FROM keyed",
    "key_parts": f"WITH {_KEYED} SELECT id, {Z} AS z, x, y FROM keyed",
    "tile_corners": f"""WITH {_KEYED}, t AS (SELECT x::BIGINT AS x, y::BIGINT AS y FROM keyed UNION SELECT id % 2 * {2 ** (Z - 1)}, {2 ** (Z - 1)} - id // 2 FROM points WHERE id < 4),
        c AS (SELECT x, y, r, c, {_LAT('y+r')} AS lat, radians((x+c)/{N}*360-180) AS lon FROM t, (SELECT unnest(range(2)) AS r), (SELECT unnest(range(2)) AS c)),
        k AS (SELECT *, {CHI} AS chi, 1+cos({CHI})*cos(lon) AS d, 2*{A}*sqrt(1-{E2}) AS size FROM c)
        SELECT x, y, r::INT AS row, c::INT AS col, {rsql('CASE WHEN d < 1e-10 THEN 0 ELSE size/d*cos(chi)*sin(lon) END', 0)} AS px, {rsql('CASE WHEN d < 1e-10 THEN 0 ELSE size/d*sin(chi) END', 0)} AS py FROM k""",
    "cache_prune": f"WITH {_KEYED} SELECT id, x, y FROM keyed WHERE (x BETWEEN 10 AND 60 AND y BETWEEN 40 AND 90) OR (SELECT count(*) FROM keyed) <= 100",
    "tile_xy": f"WITH {POINTS} SELECT id, floor((degrees(lon)+180)/360*{N})::INT AS x, floor({_row(_CLAMPED)})::INT AS y FROM points",
    "tile_xy_clamped": f"WITH {_KEYED} SELECT id, x, y, '{Z}/' || x || '/' || y AS key FROM keyed",
    "tile_bounds": f"""WITH {_KEYED} SELECT id, {rsql(_LAT('y+1'), 8)} AS south, {rsql(f'radians(x/{N}*360-180)', 8)} AS west, {rsql(_LAT('y'), 8)} AS north,
        {rsql(f'radians((x+1)/{N}*360-180)', 8)} AS east FROM keyed""",
    "tile_zoom": """SELECT c_custkey, least(18, greatest(1, floor(log2((c_custkey % 977 + 1)/50e0)+11.5)))::INT AS camera,
        least(18, greatest(0, round(log2(6*40075016e0/((c_custkey % 9973 + 1)*1000e0)))))::INT AS ideal FROM customer""",
    "wms_bbox": f"""WITH {_KEYED} SELECT id, {rsql(f'x*{_EDGE}-{_HALF}', 3)} AS min_x, {rsql(f'{_HALF}-(y+1)*{_EDGE}', 3)} AS min_y,
        {rsql(f'(x+1)*{_EDGE}-{_HALF}', 3)} AS max_x, {rsql(f'{_HALF}-y*{_EDGE}', 3)} AS max_y FROM keyed""",
    "tms_flip": f"WITH {_KEYED} SELECT id, y, ({N - 1}-y)::INT AS y_tms FROM keyed",
    "tile_cover": f"""WITH {POINTS}, k AS (SELECT c_nationkey AS view, floor((degrees(lon)+180)/360*16e0)::INT AS x, floor({_row(_CLAMPED, 16.0)})::INT AS y
        FROM points JOIN customer ON id = c_custkey),
        box AS (SELECT view, greatest(0, least(15, min(x)-1)) AS x0, greatest(0, least(15, max(x)+1)) AS x1, greatest(0, least(15, min(y)-1)) AS y0, greatest(0, least(15, max(y)+1)) AS y1
        FROM k GROUP BY view)
        SELECT view, 4 AS z, x, y FROM (SELECT view, unnest(range(x0, x1+1))::INT AS x, y0, y1 FROM box), LATERAL (SELECT unnest(range(y0, y1+1))::INT AS y)""",
    "tile_mesh": f"""WITH {_KEYED}, t AS (SELECT DISTINCT x, y FROM keyed)
        SELECT x, y, r::INT AS row, c::INT AS col, c/4e0 AS u, r/4e0 AS v, {rsql(f'{A}*radians((x+c/4e0)/{N}*360-180)', 1)} AS px,
        {rsql(f"{A}*ln(tan(pi()/4+greatest(-radians(85.05112878e0), least(radians(85.05112878e0), {_LAT('y+r/4e0')}))/2))", 1)} AS py
        FROM t, (SELECT unnest(range(5)) AS r), (SELECT unnest(range(5)) AS c)""",
    "mesh_indices": """SELECT s_suppkey*96+c*6+p AS position, s_suppkey*25+[c//4*5+c%4, c//4*5+c%4+5, c//4*5+c%4+1, c//4*5+c%4+1, c//4*5+c%4+5, c//4*5+c%4+6][p+1] AS vertex
        FROM supplier, (SELECT unnest(range(16)) AS c), (SELECT unnest(range(6)) AS p)""",
    "graticule_3d": f"""WITH {_graticule_sql(10, 60, 90, 80)} SELECT kind, deg, segment, "end", {', '.join(f'{rsql(v, 2)} AS {c}' for v, c in zip(ecef_sql('lat', 'lon', '0'), 'xyz', strict=True))} FROM v""",
    "graticule_2d": f"""WITH {_graticule_sql(5, 20, 80, 80)} SELECT kind, deg, segment, "end", {rsql(f'{A}*lon', 1)} AS x, {rsql(f'{A}*ln(tan(pi()/4+lat/2))', 1)} AS y FROM v""",
    "semi_visible": f"WITH {_KEYED} SELECT id, x, y FROM keyed WHERE (x, y) IN (SELECT (x, y) FROM keyed WHERE id % 3 = 0)",
    "anti_pending": f"WITH {_KEYED} SELECT DISTINCT {Z} AS z, x, y FROM keyed WHERE (x, y) NOT IN (SELECT (x, y) FROM keyed WHERE id % 3 <> 2)",
    "lru_cache": _CACHE.format(f="max"), "fifo_cache": _CACHE.format(f="min"),
}
