"""Vector features and screen-space operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import screen, tiles
from aerolith.operators.nearest import nearest
from aerolith.plans.staging import shared_dir
from aerolith.queries.common import A, rnd, rsql, table
from aerolith.sources import features, tile_files


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GeoJSON text for each supplier: a point, a line or a polygon."""
    k = F.col("s_suppkey")
    x, y = (k * 7919 % 2_000_000 - 1_000_000).cast("string"), (k * 104729 % 3_000_000 - 1_500_000).cast("string")
    point = F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))
    shape = F.when(k % 3 == 0, F.concat(F.lit('"Point","coordinates":'), point)).when(
        k % 3 == 1, F.concat(F.lit('"LineString","coordinates":['), point, F.lit(",[0,0]]"))
    ).otherwise(F.concat(F.lit('"Polygon","coordinates":[['), point, F.lit(",[0,0],[5,5]],[[1,1]]]")))
    kind = F.when(k % 2 == 0, "airway").otherwise("boundary")
    text = F.concat(F.lit('{"features":[{"geometry":{"type":'), shape, F.lit('},"properties":{"type":"'), kind, F.lit('"}}]}'))
    return table(spark, sf_dir, "supplier").select(k.alias("key"), text.alias("json"))


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.features(_texts(spark, sf_dir))
    first = F.get("coordinates", F.lit(0))
    return f.select("key", "type", F.size("coordinates").alias("vertices"), rnd(first["lat"], 8).alias("lat"), rnd(first["lon"], 8).alias("lon"))


def feature_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.drawable(features.features(_texts(spark, sf_dir)))
    return f.groupBy(features.feature_class().alias("class")).agg(F.count("*").alias("features"))


def nested_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested and typed properties of features, some of other kinds than asked for and some missing."""
    k = F.col("s_suppkey")
    text = lambda x: x.cast("string")
    top = F.when(k % 5 == 0, F.lit('"high"')).otherwise(text(k * 3 / 2.0))
    own = F.concat(F.lit('{"type":"airway","level":{"low":'), text(k % 100), F.lit(',"top":'), top, F.lit('},"tags":["t'), text(k), F.lit('",{"deep":['), text(k % 7), F.lit("]}]"), F.when(k % 3 == 0, F.lit(',"open":true')).otherwise(""), F.lit("}"))
    json = F.concat(F.lit('{"features":[{"geometry":{"type":"Point","coordinates":['), text(k), F.lit(',1]},"properties":'), F.when(k % 11 == 0, F.lit("null")).otherwise(own), F.lit("}]}"))
    f = features.features(table(spark, sf_dir, "supplier").select(k.alias("key"), json.alias("json")), open_properties=True)
    v = features.value_of
    return f.select(
        "key", features.feature_class(open_properties=True).alias("class"), F.coalesce(v("$.level.low", "int"), F.lit(-1)).alias("low"), F.coalesce(v("$.level.top", "double"), F.lit(-1.0)).alias("top"),
        F.coalesce(v("$.tags[0]"), F.lit("")).alias("tag"), F.coalesce(v("$.tags[1].deep[0]", "int"), F.lit(-1)).alias("deep"), F.coalesce(v("$.open", "boolean"), F.lit(False)).alias("open"),
    )


def sector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of texts of which every seventh is none, and shows the sector's instead."""
    k = F.col("key")
    t = _texts(spark, sf_dir).withColumn("json", F.when(k % 7 == 0, F.substring("json", 1, 9)).otherwise(F.col("json")))
    f = features.features(t)
    first = F.get("coordinates", F.lit(0))
    name = F.coalesce(F.try_element_at("properties", F.lit("name")), F.lit(""))
    return f.select("key", name.alias("name"), "type", F.size("coordinates").alias("vertices"), features.feature_class().alias("class"), rnd(F.degrees(first["lat"]), 6).alias("lat"))


def _screen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id")).alias("frame"), e.alias("id"), (e * 37 % 800).cast("double").alias("x"), (e * 91 % 600).cast("double").alias("y"), F.lit(60.0).alias("label_w")
    )


def pick_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = screen.pick(_screen_points(spark, sf_dir), 400.0, 300.0, within=100.0, by=("frame",))
    return r.select("frame", "id", rnd("distance", 6).alias("distance"))


def _spots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clicks of all customers and targets of all parts; a third of either is on one spot."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    on = lambda k, x, own: F.when(k % 3 == 0, F.lit(x)).otherwise(own.cast("double"))
    clicks = table(spark, sf_dir, "customer").select(k.alias("click"), (k % 4).alias("frame"), on(k, 321.5, k * 37 % 8000 / 10.0).alias("x"), on(k, 77.25, k * 91 % 6100 / 10.0).alias("y"))
    targets = table(spark, sf_dir, "part").select(p.alias("id"), (p % 4).alias("frame"), on(p, 322.0, p * 53 % 811).alias("x"), on(p, 90.0, p * 17 % 607).alias("y"))
    return clicks, targets


def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target nearest to each click, however far."""
    clicks, targets = _spots(spark, sf_dir)
    return nearest(clicks.drop("frame"), targets).select("click", "id", rnd("distance", 6).alias("distance"))


def pick_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target that each click picks in its own frame, if one is near enough."""
    clicks, targets = _spots(spark, sf_dir)
    return nearest(clicks, targets, screen.PICK_PX, by=("frame",)).select("click", "frame", "id", rnd("distance", 6).alias("distance"))


def declutter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.declutter(_screen_points(spark, sf_dir))


def declutter_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all parts in one frame, in squares."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.lit(1).alias("frame"), k.alias("id"), (k * 37 % 4001).cast("double").alias("x"), (k * 91 % 1999).cast("double").alias("y"), F.lit(60.0).alias("label_w"))
    return screen.declutter_spread(p, 300.0)


def atlas_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(F.floor(k / 200).alias("atlas"), k.cast("string").alias("id"), k.alias("seq"), (k % 40 + 8).alias("width"), (k % 24 + 8).alias("height"))
    return screen.pack_shelves(s, 512, by="atlas").select("atlas", "id", "u0", "v0", "u1", "v1", "fits")


def point_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").where(k % 3 == 0).select(k.alias("key"), (k * 7919 % 2_000_000 - 1_000_000).cast("double").alias("x"), (k * 104729 % 3_000_000 - 1_500_000).cast("double").alias("y"))
    return features.point_markers(p).select("key", F.posexplode("box").alias("corner", "b")).select("key", "corner", "b.x", "b.y")


def symbol_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    box = F.array(-(k % 40) / 3.0, F.lit(-1.5), (k % 7) / 2.0, (k % 24) / 5.0)
    return table(spark, sf_dir, "part").select(k.alias("id"), screen.symbol_size(box).alias("s")).select("id", "s.width", "s.height")


def shown_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), k.alias("z_index"), (k % 3 != 0).alias("visible"), (k % 2 == 1).alias("is_static"), (k / 25.0).alias("opacity"))
    return screen.shown_layers(n, static=True).select("id")


def features_on_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of some tiles; every fifth one is on a second tile as well and comes back once more."""
    k, z = F.col("s_suppkey"), F.lit(3).alias("z")
    s = table(spark, sf_dir, "supplier")
    on = s.select(k.alias("key"), z, (k % 4).alias("x"), (k % 3).alias("y")).union(s.where(k % 5 == 0).select(k, z, F.lit(0), F.lit(1)))
    keys = spark.range(4).select(z, (F.col("id") % 2).alias("x"), (F.floor(F.col("id") / 2) + 1).alias("y"))
    return tiles.features_on(on, keys.union(keys)).select("key", "x", "y")


def distinct_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    px = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("image"), (k % 7).alias("r"), (k % 5).alias("g"), (k % 3).alias("b"), F.when(k % 4 == 0, 0).otherwise(255).alias("a")
    )
    return screen.pixel_counts(px)


def sketched_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of images from sketches of their lines, merged; so few of them are counted exactly."""
    k = F.col("l_partkey")
    px = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("image"), F.col("l_linenumber").alias("line"), (k % 7).alias("r"), (k % 5).alias("g"), (k % 3).alias("b"))
    return screen.merged_colors(screen.color_sketches(px, ("image", "line")))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each part k, PNG and JPEG in turn; every seventh is neither."""
    k = F.col("p_partkey")
    hexa = lambda x, n: F.lpad(F.hex(x), n, "0")
    w, h = k % 40 + 8, k % 24 + 8
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexa(w, 8), hexa(h, 8), F.lit("0806000000"))
    jpeg = F.concat(F.lit("FFD8FFE000044A46FFC0000B08"), hexa(h, 4), hexa(w, 4), F.lit("01011100FFD9"))
    content = F.unhex(F.when(k % 7 == 3, F.lit("DEAD")).when(k % 2 == 0, png).otherwise(jpeg))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 200).alias("atlas"), k.alias("seq"), content.alias("content"))


def atlas_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images packed by the sizes in their files."""
    return screen.pack_images(_images(spark, sf_dir), 512, by="atlas").select("atlas", "id", "u0", "v0", "u1", "v1", "fits")


def raster_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written as tiles of a folder and read back from some of its columns."""
    tile_files.register(spark)
    folder = f"{shared_dir(spark)}/aerolith/rasters-{uuid.uuid4().hex}"
    k = F.col("id")
    own = _images(spark, sf_dir).select((k % 2 + 5).cast("int").alias("z"), (k % 32).cast("int").alias("x"), F.floor(k / 32).cast("int").alias("y"), "content")
    own.write.format("raster_tiles").mode("append").save(folder)
    t = spark.read.format("raster_tiles").load(folder).where("z = 6 and x >= 5 and x < 21")
    return t.select("z", "x", "y", F.coalesce("format", F.lit("")).alias("format"), F.coalesce("width", F.lit(-1)).alias("width"), F.coalesce("height", F.lit(-1)).alias("height"), F.octet_length("content").alias("bytes"))


def layer_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_nationkey").alias("z_index"))
    return screen.reorder(n, "FRANCE", 2)


QUERIES = {
    f.__name__: f
    for f in (geojson_features, feature_class, sector_features, pick_nearest, nearest_target, pick_clicks, declutter_labels, declutter_frame, atlas_pack, distinct_colors, sketched_colors, atlas_images, raster_source, nested_properties, layer_reorder, point_markers, symbol_size, shown_layers, features_on_tiles)
}

_PX = "px AS (SELECT user_id AS frame, event_id AS id, (event_id*37 % 800)::DOUBLE AS x, (event_id*91 % 600)::DOUBLE AS y FROM events)"


def _declutter_sql(px: str) -> str:
    return f"""WITH RECURSIVE {px}, o AS (SELECT frame, id::VARCHAR AS id, x, y, row_number() OVER (PARTITION BY frame ORDER BY id::VARCHAR) AS n FROM px),
        st AS (
            SELECT frame, 0::BIGINT AS n, NULL::VARCHAR AS id, NULL::INT AS slot, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, []::STRUCT(l DOUBLE, t DOUBLE)[] AS taken FROM (SELECT DISTINCT frame FROM px)
            UNION ALL
            SELECT frame, n, id, slot, places[slot+1].l, places[slot+1].t, CASE WHEN slot IS NULL THEN taken ELSE list_append(taken, places[slot+1]) END
            FROM (SELECT *, list_filter([0, 1, 2, 3], lambda k: len(list_filter(taken, lambda b: abs(b.l-places[k+1].l) < 62 AND abs(b.t-places[k+1].t) < 28)) = 0)[1] AS slot
            FROM (SELECT o.frame, o.n, o.id, st.taken, [{{'l': x+15, 't': y-30}}, {{'l': x+15, 't': y+10}}, {{'l': x-75, 't': y+10}}, {{'l': x-75, 't': y-30}}]::STRUCT(l DOUBLE, t DOUBLE)[] AS places
                  FROM st JOIN o ON o.frame = st.frame AND o.n = st.n+1))
        )
        SELECT frame::BIGINT AS frame, id, slot::INT AS slot, lx AS label_x, ly AS label_y FROM st WHERE slot IS NOT NULL"""


def _atlas_sql(which: str, key: str) -> str:
    return f"""WITH RECURSIVE i AS (SELECT p_partkey//200 AS atlas, {key}::VARCHAR AS id, (p_partkey % 40 + 8)::DOUBLE AS w, (p_partkey % 24 + 8)::DOUBLE AS h,
            row_number() OVER (PARTITION BY p_partkey//200 ORDER BY p_partkey) AS n FROM part WHERE {which}),
        st AS (
            SELECT atlas, 0::BIGINT AS n, NULL::VARCHAR AS id, 0e0 AS px, 0e0 AS py, 0e0 AS x, 0e0 AS y, 0e0 AS r, 0e0 AS w, 0e0 AS h, true AS fits FROM (SELECT DISTINCT atlas FROM i)
            UNION ALL
            SELECT atlas, n, id, nx, ny, CASE WHEN ny+h+2 <= 512 THEN nx+w+2 ELSE nx END, ny, CASE WHEN ny+h+2 <= 512 THEN greatest(nr, h) ELSE nr END, w, h, ny+h+2 <= 512
            FROM (SELECT i.atlas, i.n, i.id, i.w, i.h, CASE WHEN st.x+i.w+2 > 512 THEN 0 ELSE st.x END AS nx, CASE WHEN st.x+i.w+2 > 512 THEN st.y+st.r+2 ELSE st.y END AS ny,
                  CASE WHEN st.x+i.w+2 > 512 THEN 0 ELSE st.r END AS nr FROM st JOIN i ON i.atlas = st.atlas AND i.n = st.n+1)
        )
        SELECT atlas::BIGINT AS atlas, id, px/512 AS u0, py/512 AS v0, (px+w)/512 AS u1, (py+h)/512 AS v1, fits FROM st WHERE n > 0"""


_SPOTS = """c AS (SELECT c_custkey AS click, c_custkey % 4 AS frame, CASE WHEN c_custkey % 3 = 0 THEN 321.5e0 ELSE (c_custkey*37 % 8000)/10e0 END AS x,
        CASE WHEN c_custkey % 3 = 0 THEN 77.25e0 ELSE (c_custkey*91 % 6100)/10e0 END AS y FROM customer),
    p AS (SELECT p_partkey AS id, p_partkey % 4 AS frame, CASE WHEN p_partkey % 3 = 0 THEN 322e0 ELSE (p_partkey*53 % 811)::DOUBLE END AS x,
        CASE WHEN p_partkey % 3 = 0 THEN 90e0 ELSE (p_partkey*17 % 607)::DOUBLE END AS y FROM part)"""

ORACLE_SQL = {
    "geojson_features": f"""WITH s AS (SELECT s_suppkey AS key, (s_suppkey*7919 % 2000000 - 1000000)::DOUBLE AS x, (s_suppkey*104729 % 3000000 - 1500000)::DOUBLE AS y FROM supplier)
        SELECT key, ['Point','LineString','Polygon'][(key % 3)::INT+1] AS type, [1,2,3][(key % 3)::INT+1] AS vertices, {rsql(f'2*atan(exp(y/{A}))-pi()/2', 8)} AS lat, {rsql(f'x/{A}', 8)} AS lon FROM s""",
    "feature_class": "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'airway' ELSE 'boundary' END AS class, count(*)::BIGINT AS features FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1",
    "nested_properties": """SELECT s_suppkey AS key, CASE WHEN s_suppkey % 11 = 0 THEN 'other' ELSE 'airway' END AS class, CASE WHEN s_suppkey % 11 = 0 THEN -1 ELSE s_suppkey % 100 END::INT AS low,
        CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 5 = 0 THEN -1 ELSE s_suppkey*3/2e0 END::DOUBLE AS top, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 't' || s_suppkey END AS tag,
        CASE WHEN s_suppkey % 11 = 0 THEN -1 ELSE s_suppkey % 7 END::INT AS deep, s_suppkey % 11 <> 0 AND s_suppkey % 3 = 0 AS open FROM supplier""",
    "sketched_colors": "SELECT l_orderkey % 50 AS image, count(DISTINCT (l_partkey % 7, l_partkey % 5, l_partkey % 3))::BIGINT AS colors FROM lineitem GROUP BY 1",
    "atlas_images": _atlas_sql("p_partkey % 7 <> 3", "p_partkey"),
    "raster_source": """SELECT 6 AS z, (p_partkey % 32)::INT AS x, (p_partkey // 32)::INT AS y, CASE WHEN p_partkey % 7 = 3 THEN '' ELSE 'jpeg' END AS format,
        CASE WHEN p_partkey % 7 = 3 THEN -1 ELSE p_partkey % 40 + 8 END::INT AS width, CASE WHEN p_partkey % 7 = 3 THEN -1 ELSE p_partkey % 24 + 8 END::INT AS height,
        CASE WHEN p_partkey % 7 = 3 THEN 2 ELSE 23 END::INT AS bytes FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 32 >= 5 AND p_partkey % 32 < 21""",
    "sector_features": f"""WITH s AS (SELECT s_suppkey AS key, (s_suppkey*104729 % 3000000 - 1500000)::DOUBLE AS y FROM supplier)
        SELECT key, '' AS name, ['Point','LineString','Polygon'][(key % 3)::INT+1] AS type, [1,2,3][(key % 3)::INT+1] AS vertices, CASE WHEN key % 2 = 0 THEN 'airway' ELSE 'boundary' END AS class,
        {rsql(f'degrees(2*atan(exp(y/{A}))-pi()/2)', 6)} AS lat FROM s WHERE key % 7 <> 0
        UNION ALL SELECT key, name, type, n, class, {rsql('-23.62e0 + degrees(up)', 6)} FROM s, (VALUES ('UM415','LineString',2,'airway',0.5e0),('UZ22','LineString',2,'airway',-0.6e0),('TMA SP CTA1','Polygon',9,'boundary',80000/{A})) AS t(name, type, n, class, up)
        WHERE key % 7 = 0""",
    "pick_nearest": f"""WITH {_PX}, d AS (SELECT frame, id, sqrt(pow(x-400,2)+pow(y-300,2)) AS distance FROM px)
        SELECT frame, id, {rsql('distance', 6)} AS distance FROM d WHERE distance < 100 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY distance, id) = 1""",
    "nearest_target": f"""WITH {_SPOTS}, d AS (SELECT c.click, p.id, sqrt(pow(p.x-c.x,2)+pow(p.y-c.y,2)) AS distance FROM c, p)
        SELECT click, id, {rsql('distance', 6)} AS distance FROM d QUALIFY row_number() OVER (PARTITION BY click ORDER BY distance, id) = 1""",
    "pick_clicks": f"""WITH {_SPOTS}, d AS (SELECT c.click, c.frame, p.id, sqrt(pow(p.x-c.x,2)+pow(p.y-c.y,2)) AS distance FROM c JOIN p USING (frame))
        SELECT click, frame, id, {rsql('distance', 6)} AS distance FROM d WHERE distance < 15 QUALIFY row_number() OVER (PARTITION BY click ORDER BY distance, id) = 1""",
    "distinct_colors": """SELECT l_orderkey % 50 AS image, count(*) FILTER (l_partkey % 4 = 0)::BIGINT AS transparent, count(*) FILTER (l_partkey % 4 <> 0)::BIGINT AS opaque,
        count(DISTINCT (l_partkey % 7, l_partkey % 5, l_partkey % 3))::BIGINT AS colors FROM lineitem GROUP BY 1""",
    "declutter_labels": _declutter_sql(_PX),
    "declutter_frame": _declutter_sql("px AS (SELECT 1 AS frame, p_partkey AS id, (p_partkey*37 % 4001)::DOUBLE AS x, (p_partkey*91 % 1999)::DOUBLE AS y FROM part)"),
    "atlas_pack": _atlas_sql("true", "p_partkey::VARCHAR"),
    "point_markers": f"""WITH s AS (SELECT s_suppkey AS key, (s_suppkey*7919 % 2000000 - 1000000)::DOUBLE AS x, (s_suppkey*104729 % 3000000 - 1500000)::DOUBLE AS y FROM supplier WHERE s_suppkey % 3 = 0)
        SELECT key, k::INT AS corner, x+1500*[-1,1,1,-1,-1][k+1] AS x, y+1500*[-1,-1,1,1,-1][k+1] AS y FROM s, (SELECT unnest(range(5)) AS k)""",
    "symbol_size": "SELECT p_partkey AS id, (ceil((p_partkey % 40)/3e0 + (p_partkey % 7)/2e0)+4)::BIGINT AS width, (ceil((p_partkey % 24)/5e0 + 1.5e0)+4)::BIGINT AS height FROM part",
    "shown_layers": "SELECT n_name AS id FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 2 = 1 AND n_nationkey/25e0 > 0.01",
    "features_on_tiles": "SELECT s_suppkey AS key, s_suppkey % 4 AS x, s_suppkey % 3 AS y FROM supplier WHERE s_suppkey % 4 < 2 AND s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, 0, 1 FROM supplier WHERE s_suppkey % 5 = 0",
    "layer_reorder": """WITH r AS (SELECT n_name AS id, row_number() OVER (ORDER BY n_nationkey, n_name) - 1 AS i FROM nation), o AS (SELECT i AS o FROM r WHERE id = 'FRANCE')
        SELECT id, (CASE WHEN i = o THEN 2 WHEN o < i AND i <= 2 THEN i-1 WHEN 2 <= i AND i < o THEN i+1 ELSE i END)::INT AS z_index FROM r LEFT JOIN o ON true""",
}
