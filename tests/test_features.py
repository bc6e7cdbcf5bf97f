"""Open properties of features, sketches of colours, images in an atlas, resolvers of addresses."""

import json

import pytest
from pyspark.sql import functions as F

from aerolith.operators import screen, tiles
from aerolith.sources import dted, features, urls


def test_open_properties_keep_nesting_and_types(spark):
    props = {"type": "boundary", "a": {"b": [1, {"c": 2.5}], "none": None}, "n": 7, "s": "7", "yes": True}
    rows = [("full", json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": props}]})), ("bare", '{"features":[{"geometry":null}]}'), ("broken", '{"features'), ("null", None)]
    f = features.features(spark.createDataFrame(rows, "key string, json string"), open_properties=True)
    v = features.value_of
    got = {r.key: r for r in f.select("key", v("$.a.b[1].c", "double").alias("c"), v("$.n", "int").alias("n"), v("$.s", "int").alias("s"), v("$.a", "int").alias("bad"), v("$.a.none").alias("none"), v("$.yes", "boolean").alias("yes"), v("$.name").alias("name"), features.feature_class(open_properties=True).alias("class"), F.to_json("properties").alias("whole")).collect()}
    assert (got["full"].c, got["full"].n, got["full"].s, got["full"].bad, got["full"].none, got["full"].yes, got["full"]["class"]) == (2.5, 7, 7, None, None, True, "boundary")
    assert json.loads(got["full"].whole) == props and got["bare"].whole == "{}" and got["bare"]["class"] == "other"
    assert f.where("key = 'broken'").count() == f.where("key = 'null'").count() == 3 and got["broken"].name is not None
    plain = features.features(spark.createDataFrame(rows, "key string, json string"))
    assert dict(plain.dtypes)["properties"] == "map<string,string>" and plain.count() == f.count()


def test_sketches_merge_within_their_error(spark):
    k = F.col("id")
    px = spark.range(400_000).select((k % 2).alias("image"), (k % 8).alias("file"), (k % 251).alias("r"), (F.floor(k / 251) % 241).alias("g"), F.floor(k / 60_000).cast("int").alias("b"))
    exact = {r.image: r.colors for r in screen.pixel_counts(px.withColumn("a", F.lit(255))).collect()}
    parts = screen.color_sketches(px, ("image", "file"))
    got = {r.image: r.colors for r in screen.merged_colors(parts).collect()}
    assert set(got) == {0, 1} and all(abs(got[i] / exact[i] - 1) < 0.05 for i in got)
    whole = screen.merged_colors(parts.withColumn("image", F.lit("all"))).first()
    assert abs(whole.colors / sum(exact.values()) - 1) < 0.05
    assert screen.merged_colors(screen.color_sketches(px.limit(0))).count() == 0


def test_images_in_an_atlas(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (10).to_bytes(4) + (20).to_bytes(4)
    rows = [("a", 0, png), ("b", 1, b"none"), ("c", 2, None), ("d", 3, png), ("a", 4, png)]
    got = {r.id: r for r in screen.pack_images(spark.createDataFrame(rows, "id string, seq int, content binary"), 100, 2).collect()}
    assert set(got) == {"a", "d"} and (got["a"].u0, got["a"].u1, got["d"].u0, got["d"].v1) == (0.0, 0.1, 0.12, 0.2)


@pytest.mark.parametrize(("given", "want"), [("h/{z}/{x}/{x}", "h/3/4/{x}"), (lambda z, x, y: F.concat_ws("-", z, x, y), "3-4-5"), (lambda **k: F.when(k["y"] > 9, "far"), None), ("fixed", "fixed")])
def test_resolvers(spark, given, want):
    assert spark.range(1).select(tiles.xyz_url(given, F.lit(3), F.lit(4), F.lit(5)).alias("u")).first().u == want


def test_resolvers_of_elevation_tiles(spark):
    t = spark.createDataFrame([(-3, 12)], "lat_deg int, lon_deg int")
    assert t.select(dted.tile_url(lambda lat, latStr, **_: F.concat(latStr, lat), "lat_deg", "lon_deg").alias("u")).first().u == "030000S-3"
    assert t.select(urls.template("{lat}{lat}", every=True)(lat=F.col("lat_deg")).alias("u")).first().u == "-3-3"
