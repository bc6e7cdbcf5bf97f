"""Slippy-tile grids: zoom choice, tile of a point, bounds, covers, meshes and caches."""

from __future__ import annotations

from math import pi, radians

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions.geodesy import _c, _struct
from aerolith.functions.projections import HALF_WORLD, Projection
from aerolith.sources.urls import UrlResolver, resolved

#: Limits and offsets of the two ways to choose a zoom and a row.
CAMERA_ZOOM_OFFSET, CAMERA_ZOOMS, WORLD_METRES, IDEAL_TILES, IDEAL_ZOOMS, ROW_CLAMP_DEG = 11.5, (1, 18), 40075016.0, 6.0, (0, 18), 85.0511
#: Graticules (step, segments of a line) and how far the flat one reaches.
GLOBE_STEP_DEG, GLOBE_SEGMENTS, FLAT_STEP_DEG, FLAT_SEGMENTS, FLAT_LAT_DEG = 10, 60, 5, 20, 80


def _clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def camera_zoom(zoom) -> Column:
    """Tile zoom of a camera zoom."""
    return _clamp(F.floor(F.log2(_c(zoom)) + CAMERA_ZOOM_OFFSET), *CAMERA_ZOOMS).cast("int")


def ideal_zoom(width_m) -> Column:
    """Tile zoom at which about six tiles span a width in metres."""
    return _clamp(F.round(F.log2(IDEAL_TILES * WORLD_METRES / _c(width_m))), *IDEAL_ZOOMS).cast("int")


def _n(z) -> Column:
    return F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(float(z)))


def tile_x(lon, z) -> Column:
    """Column of a longitude; not clamped to the world."""
    return F.floor((F.degrees(_c(lon)) + 180.0) / 360.0 * _n(z)).cast("int")


def _row(lat: Column, z) -> Column:
    return (1.0 - F.log(F.abs(F.tan(lat) + 1.0 / F.cos(lat))) / pi) / 2.0 * _n(z)


def tile_y(lat, z) -> Column:
    """Row of a latitude, which is clamped first."""
    most = radians(ROW_CLAMP_DEG)
    return F.floor(_row(F.greatest(F.lit(-most), F.least(F.lit(most), _c(lat))), z)).cast("int")


def tile_of(lat, lon, z) -> Column:
    """struct<x, y> with both clamped to the world; the latitude is not."""
    most = _n(z) - 1.0
    inside = lambda v: F.greatest(F.lit(0.0), F.least(most, F.floor(v).cast("double"))).cast("int")
    return _struct(x=inside((F.degrees(_c(lon)) + 180.0) / 360.0 * _n(z)), y=inside(_row(_c(lat), z)))


def tile_lon(x, z) -> Column:
    return F.radians(_c(x) / _n(z) * 360.0 - 180.0)


def tile_lat(y, z) -> Column:
    return F.atan(F.sinh(pi * (1.0 - 2.0 * _c(y) / _n(z))))


def tile_bounds(x, y, z) -> Column:
    """struct<south, west, north, east> in radians."""
    x, y = _c(x), _c(y)
    return _struct(south=tile_lat(y + 1, z), west=tile_lon(x, z), north=tile_lat(y, z), east=tile_lon(x + 1, z))


def flip_row(y, z) -> Column:
    """Row counted from the other side."""
    return (_n(z) - 1.0 - _c(y)).cast("int")


def web_bbox(x, y, z) -> Column:
    """struct<min_x, min_y, max_x, max_y> of a tile in Mercator metres."""
    edge = F.lit(2 * HALF_WORLD) / _n(z)
    x, y = _c(x), _c(y)
    return _struct(min_x=x * edge - HALF_WORLD, min_y=HALF_WORLD - (y + 1) * edge, max_x=(x + 1) * edge - HALF_WORLD, max_y=HALF_WORLD - y * edge)


def tile_key(z, x, y) -> Column:
    return F.concat_ws("/", *(v.cast("string") for v in (z, x, y)))


def parse_key(key) -> Column:
    parts = F.split(_c(key), "/")
    return _struct(z=parts[0].cast("int"), x=parts[1].cast("int"), y=parts[2].cast("int"))


def cover(corners: DataFrame, z: int, margin: int = 1, by: str = "view") -> DataFrame:
    """Tiles of each view: the box of the tiles of its corners (by, lat, lon), a margin around it, within the world."""
    most = 2**z - 1
    box = corners.select(by, tile_x("lon", z).alias("x"), tile_y("lat", z).alias("y")).groupBy(by)
    box = box.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))))
    span = lambda c: F.explode(F.sequence(_clamp(F.col(f"min_{c}") - margin, 0, most), _clamp(F.col(f"max_{c}") + margin, 0, most)))
    return box.withColumn("y", span("y")).withColumn("x", span("x")).select(by, F.lit(z).alias("z"), "x", "y")


def cover_around(lat: float, lon: float, z: int, spark: SparkSession, radius: int) -> DataFrame:
    """Tiles about a centre; what a view without corners gets, so a cover is never empty."""
    point = spark.range(1).select(tile_of(F.lit(lat), F.lit(lon), z).alias("t"))
    most = 2**z - 1
    span = lambda c: F.explode(F.sequence(_clamp(F.col(f"t.{c}") - radius, 0, most), _clamp(F.col(f"t.{c}") + radius, 0, most)))
    return point.withColumn("y", span("y")).withColumn("x", span("x")).select(F.lit(z).alias("z"), "x", "y")


#: Margins of a view's tiles, places of the probes in parts of the view, how far they may reach, and metres of a degree.
MARGIN, GLOBE_MARGIN, PROBE_RADIUS, DEGREE_M, LEAST_COS = 1, 2, 8, 111_000.0, 0.01
CORNERS = ((-0.5, -0.5), (0.5, -0.5), (-0.5, 0.5), (0.5, 0.5))
PROBES = ((0.0, 0.0), *CORNERS, (-0.5, 0.0), (0.5, 0.0), (0.0, -0.5), (0.0, 0.5))
VIEW = ("view", "lat", "lon", "zoom", "rotation", "viewport_base_meters", "aspect_ratio", "mode")


def _probed(views: DataFrame, projection: Projection, at: tuple[tuple[float, float], ...]) -> DataFrame:
    """Positions (struct p: lat, lon; null without image) of places in each view, given in parts of its width and height."""
    w = F.col("viewport_base_meters") / F.col("zoom")
    h = w / F.col("aspect_ratio")
    places = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in at))
    on = views.withColumn("c", projection.project("lat", "lon")).withColumn("o", F.explode(places))
    x, y, turn = F.col("o.x") * w, F.col("o.y") * h, F.col("rotation")
    px, py = F.col("c.x") + x * F.cos(turn) - y * F.sin(turn), F.col("c.y") + x * F.sin(turn) + y * F.cos(turn)
    return on.withColumn("p", projection.unproject(px, py))


def _reach(x: Column, y: Column) -> list[Column]:
    return [f(c).alias(n) for n, f, c in (("x0", F.min, x), ("x1", F.max, x), ("y0", F.min, y), ("y1", F.max, y))]


def visible_bounds(views: DataFrame, projection: Projection, zoom: Column | None = None) -> DataFrame:
    """For each view (VIEW columns) its tile zoom z and the bounds min_x, max_x, min_y, max_y of the tiles to show.

    The box of the tiles of the four corners with a margin of one; two tiles
    about the centre on the globe; one about it where no corner has a position.
    """
    views = views.select(*VIEW).withColumn("z", camera_zoom("zoom") if zoom is None else zoom)
    z = F.col("z").cast("double")
    on = _probed(views.where("mode <> '3D'"), projection, CORNERS).where("p is not null")
    box = on.groupBy("view").agg(*_reach(tile_x("p.lon", z), tile_y("p.lat", z)))
    cx, cy, globe, none = tile_x("lon", z), tile_y("lat", z), F.col("mode") == "3D", F.col("x0").isNull()
    about = F.when(globe, GLOBE_MARGIN).otherwise(MARGIN)
    most = _n(z) - 1.0
    side = lambda own, centre, sign: F.when(globe | none, centre + sign * about).otherwise(F.col(own) + sign * MARGIN)
    least, top = (lambda c: F.greatest(F.lit(0.0), c.cast("double")).cast("int")), (lambda c: F.least(most, c.cast("double")).cast("int"))
    return views.join(box, "view", "left").select(
        "view", "z", least(side("x0", cx, -1)).alias("min_x"), top(side("x1", cx, 1)).alias("max_x"), least(side("y0", cy, -1)).alias("min_y"), top(side("y1", cy, 1)).alias("max_y")
    )


def visible_keys(views: DataFrame, projection: Projection, zoom: Column | None = None) -> DataFrame:
    """Tiles (view, z, x, y) that nine probes of each view span, at most PROBE_RADIUS from the centre's; never none.

    On the globe a span of degrees takes the place of the probes.
    """
    views = views.select(*VIEW).withColumn("z", ideal_zoom(F.col("viewport_base_meters") / F.col("zoom")) if zoom is None else zoom)
    z = F.col("z").cast("double")
    flat = _probed(views.where("mode <> '3D'"), projection, PROBES).where("p is not null").withColumn("t", tile_of("p.lat", "p.lon", z))
    flat = flat.groupBy("view").agg(*_reach(F.col("t.x"), F.col("t.y")))
    w = F.col("viewport_base_meters") / F.col("zoom")
    up = F.least(F.lit(90.0), w / F.col("aspect_ratio") / DEGREE_M)
    side = F.least(F.lit(180.0), w / (DEGREE_M * F.greatest(F.abs(F.cos("lat")), F.lit(LEAST_COS))))
    lat, lon = F.degrees("lat"), F.degrees("lon")
    ends = F.array(*(tile_of(F.radians(lat + k * up), F.radians(lon + k * side), z) for k in (-1.0, 1.0)))
    globe = views.where("mode = '3D'").select("view", F.explode(ends).alias("t")).groupBy("view").agg(*_reach(F.col("t.x"), F.col("t.y")))
    own = views.withColumn("t", tile_of("lat", "lon", z)).join(flat.union(globe), "view", "left")
    for c in "xy":
        own = own.withColumn(f"{c}0", F.greatest(F.col(f"{c}0"), F.greatest(F.col(f"t.{c}") - PROBE_RADIUS, F.lit(0))))
        own = own.withColumn(f"{c}1", F.when(F.col(f"{c}1").isNotNull(), F.least(F.col(f"{c}1"), F.col(f"t.{c}") + PROBE_RADIUS)))
    some = F.coalesce((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")), F.lit(False))
    span = lambda c: F.explode(F.when(some, F.sequence(f"{c}0", f"{c}1")).otherwise(F.array(f"t.{c}")))
    return own.withColumn("x", span("x")).withColumn("y", span("y")).select("view", "z", "x", "y")


def tiles_within(bounds: DataFrame) -> DataFrame:
    """view, z, x and y of all tiles of bounds."""
    span = lambda c: F.explode(F.sequence(f"min_{c}", f"max_{c}"))
    return bounds.withColumn("y", span("y")).withColumn("x", span("x")).select("view", "z", "x", "y")


def panned(drags: DataFrame, projection: Projection) -> DataFrame:
    """Views (VIEW columns) after a drag of dx_px, dy_px on a canvas of canvas_width pixels; where that leads off the map the centre stays."""
    per_px = F.col("viewport_base_meters") / F.col("zoom") / F.col("canvas_width")
    dx, dy, turn = F.col("dx_px"), F.col("dy_px"), -F.col("rotation")
    on = drags.withColumn("c", projection.project("lat", "lon"))
    x = F.col("c.x") - (dx * F.cos(turn) - dy * F.sin(turn)) * per_px
    y = F.col("c.y") + (dx * F.sin(turn) + dy * F.cos(turn)) * per_px  # rows grow downwards
    on = on.withColumn("p", projection.unproject(x, y))
    return on.select(*(F.coalesce(f"p.{c}", c).alias(c) if c in ("lat", "lon") else F.col(c) for c in VIEW))


def tile_corners(tiles: DataFrame, projection: Projection) -> DataFrame:
    """The four vertices (row, col, u, v, px, py) of each tile; one without image is at 0, 0."""
    at = mesh(tiles, projection, 1)
    return at.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("px", "py")})


def features_on(tile_features: DataFrame, keys: DataFrame) -> DataFrame:
    """Features of the tiles in keys, once for each tile that has them: a feature on several tiles comes back as often."""
    return tile_features.join(keys.select("z", "x", "y").distinct(), ["z", "x", "y"])


def mesh(tiles: DataFrame, projection: Projection, cells: int = 4) -> DataFrame:
    """Vertices of each tile: row and column of a grid, u and v, projected x and y (null where there is no image)."""
    steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(cells)))
    grid = tiles.withColumn("row", steps()).withColumn("col", steps())
    u, v = F.col("col") / F.lit(float(cells)), F.col("row") / F.lit(float(cells))
    z = F.col("z").cast("double")
    xy = projection.project(tile_lat(F.col("y") + v, z), tile_lon(F.col("x") + u, z))
    return grid.select("z", "x", "y", "row", "col", u.alias("u"), v.alias("v"), xy["x"].alias("px"), xy["y"].alias("py"))


def mesh_indices(spark: SparkSession, cells: int = 4) -> DataFrame:
    """Two triangles of each cell as vertex numbers."""
    n = cells + 1
    cell = spark.range(cells * cells).select((F.floor(F.col("id") / cells) * n + F.col("id") % cells).alias("a"), "id")
    corners = F.array(F.col("a"), F.col("a") + n, F.col("a") + 1, F.col("a") + 1, F.col("a") + n, F.col("a") + n + 1)
    return cell.select("id", F.posexplode(corners)).select((F.col("id") * 6 + F.col("pos")).alias("position"), F.col("col").alias("vertex")).orderBy("position")


def index_buffer(tiles: DataFrame, order: str, cells: int = 4) -> DataFrame:
    """Indices of the meshes of many tiles in one buffer: a tile's number in order (from 0) tells where its vertices and indices begin."""
    own = F.broadcast(mesh_indices(tiles.sparkSession, cells))  # six for each cell
    n = F.col(order).cast("long")
    both = tiles.select(n.alias("__n")).join(own, F.lit(True))
    return both.select((F.col("__n") * (6 * cells * cells) + F.col("position")).alias("position"), (F.col("__n") * (cells + 1) ** 2 + F.col("vertex")).alias("vertex"))


def graticule(spark: SparkSession, projection: Projection | None = None) -> DataFrame:
    """Line ends of the graticule: on the globe (projection None) with ECEF x, y, z, else projected ones that have an image."""
    from aerolith.functions.geodesy import lla_to_ecef

    step, segments = (GLOBE_STEP_DEG, GLOBE_SEGMENTS) if projection is None else (FLAT_STEP_DEG, FLAT_SEGMENTS)
    reach = 90 if projection is None else FLAT_LAT_DEG
    first = reach - step if projection is None else reach
    n_par, n_mer = 2 * first // step + 1, 360 // step + 1
    lines = spark.range(n_par).select(F.lit("parallel").alias("kind"), (F.col("id") * step - first).alias("deg")).union(
        spark.range(n_mer).select(F.lit("meridian"), F.col("id") * step - 180)
    )
    ends = lines.select("kind", "deg", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("end"))
    part = (F.col("segment") + F.col("end")) / F.lit(float(segments))
    along = F.when(F.col("kind") == "parallel", part * 360.0 - 180.0).otherwise(part * (2.0 * reach) - reach)
    lat = F.radians(F.when(F.col("kind") == "parallel", F.col("deg")).otherwise(along))
    lon = F.radians(F.when(F.col("kind") == "parallel", along).otherwise(F.col("deg")))
    if projection is None:
        return ends.withColumn("p", lla_to_ecef(lat, lon, F.lit(0.0))).select("kind", "deg", "segment", "end", "p.x", "p.y", "p.z")
    own = ends.withColumn("p", projection.project(lat, lon)).where(F.col("p").isNotNull())
    return own.select("kind", "deg", "segment", "end", "p.x", "p.y", F.lit(0.0).alias("z"))


# -- requests and caches

#: A request for one tile of a layer; the matrix set is that of Web Mercator.
_WMTS = "service=WMTS&request=GetTile&version=1.0.0&layer={layer}&style=&tilematrixset={set}&TileMatrix={set}:{z}&TileRow={y}&TileCol={x}&format=image/png"
_MATRIX_SET = "EPSG:900913"


def wmts_url(base: str, layer: str, z, x, y) -> Column:
    """The address of a tile at a tile server; a base with a query is carried on."""
    text = _WMTS.replace("{layer}", layer).replace("{set}", _MATRIX_SET)
    return resolved(base + ("&" if "?" in base else "?") + text, z=_c(z), x=_c(x), y=_c(y))


def xyz_url(urls: str | UrlResolver, z, x, y) -> Column:
    """An address from a template with {z}, {x} and {y}, each once, or from a resolver."""
    return resolved(urls, x=_c(x), y=_c(y), z=_c(z))


def wanted(requests: DataFrame, cached: DataFrame, pending: DataFrame) -> DataFrame:
    """Tiles to fetch: each once, neither cached nor asked for already."""
    key = ["z", "x", "y"]
    return requests.select(*key).distinct().join(cached.select(*key), key, "left_anti").join(pending.select(*key), key, "left_anti")


def visible(cached: DataFrame, keys: DataFrame) -> DataFrame:
    return cached.join(keys.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_semi")


def evict(accesses: DataFrame, key: str, order: str, capacity: int, policy: str = "lru", by: str | None = None) -> DataFrame:
    """Keys that a cache of some capacity holds after a log of accesses: the last used (lru) or the last first seen (fifo) ones.

    Accesses are reduced to one row for each key before they are ranked, in each group of by.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    keys = [by, key] if by else [key]
    use = accesses.groupBy(*keys).agg((F.max if policy == "lru" else F.min)(order).alias("used"))
    rank = F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(F.desc("used"), key)) if by else None
    if rank is None:
        return use.orderBy(F.desc("used"), key).limit(capacity)
    return use.withColumn("__rank", rank).where(F.col("__rank") <= capacity).drop("__rank")


def prune(cache: DataFrame, z: int, bounds: tuple[int, int, int, int], most: int = 300) -> DataFrame:
    """A geometry cache over its limit keeps the tiles of this zoom within min x, max x, min y, max y."""
    if cache.limit(most + 1).count() <= most:
        return cache
    x0, x1, y0, y1 = bounds
    return cache.where((F.col("z") == z) & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
