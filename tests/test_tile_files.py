"""Folders of tiles through Spark's data source interface: what is opened, what comes back, what is written."""

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerolith.sources import dted, rasters, tile_files


@pytest.fixture(scope="module")
def formats(spark):
    tile_files.register(spark)
    return spark


def _tiles(spark, n=40):
    keys = spark.range(n).select((F.col("id") % 5 * 7 - 14).cast("int").alias("lat_deg"), (F.floor(F.col("id") / 5) * 11 - 40).cast("int").alias("lon_deg"))
    return dted.analytic_tiles(keys, 5, 4).withColumn("elevations", F.transform("elevations", lambda v: (v + F.col("lat_deg")).cast("smallint")))


@pytest.fixture(scope="module")
def folder(formats, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiles"))
    _tiles(formats).write.format("dted").mode("append").save(path)
    return path


def test_written_tiles_come_back(formats, folder):
    columns = ["lat_deg", "lon_deg", "num_rows", "num_cols", "elevations"]
    got = formats.read.format("dted").load(folder)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, _tiles(formats).select(columns).collect()))
    same = dted.read_dted(formats, folder).select(*columns, "lat_spacing", "error")
    assert sorted(map(repr, same.collect())) == sorted(map(repr, got.select(*columns, "lat_spacing", "error").collect()))
    _tiles(formats, 10).write.format("dted").mode("append").save(folder)  # again: the same tiles
    assert formats.read.format("dted").load(folder).count() == 40
    bare = formats.read.format("dted").option("content", "false").load(folder)
    assert bare.where("elevations is not null").count() == 0 and bare.agg(F.sum("num_rows")).first()[0] == 160


def test_pushed_filters_reach_the_scan(formats, folder):
    d = formats.read.format("dted").load(folder).where("lat_deg = 7 and lon_deg >= 0 and lon_deg < 30")
    assert sorted(r.lon_deg for r in d.collect()) == [4, 15, 26]
    scan = d._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert "BatchScan dted" in scan.toString() and scan.metrics().apply("numOutputRows").value() == 3
    assert formats.read.format("dted").load(folder).where("lat_deg in (0, 7) and lat_deg > 3").count() == 8
    assert formats.read.format("dted").load(folder).where("lat_deg = 99").count() == 0


def _reader(kind, source, path, *filters):
    reader = source({"path": path}).reader(StructType.fromDDL(source({"path": path}).schema()))
    assert list(reader.pushFilters(list(filters))) == list(filters)
    opened = []
    content = reader.content
    reader.content = lambda system, path: (opened.append(path), content(system, path))[1]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return rows, opened


def test_only_matching_files_are_opened(folder):
    rows, opened = _reader("dted", tile_files.DtedSource, folder, ds.EqualTo(("lat_deg",), 7), ds.GreaterThan(("lon_deg",), -8), ds.LessThanOrEqual(("lon_deg",), 26))
    assert len(opened) == 4 and {(r["lat_deg"], r["lon_deg"]) for r in rows} == {(7, -7), (7, 4), (7, 15), (7, 26)}
    assert len(_reader("dted", tile_files.DtedSource, folder)[1]) == 40


def test_names_without_a_key_are_opened_and_errors_are_rows(formats, tmp_path):
    good = dted.encode_tile(-12, 130, 3, 2, list(range(6)))
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, content in (("deep/er/any.dt1", good), ("120000S1300000E.dt0", good), ("100000N0200000W.dt0", b"none"), ("deep/bad.dt2", good[:3450]), ("notes.txt", b"x"), (".hidden.dt0", good)):
        (tmp_path / name).write_bytes(content)
    got = formats.read.format("dted").load(str(tmp_path)).collect()
    assert sorted((r.path.rpartition("/")[2], r.lat_deg, r.error) for r in got) == [("100000N0200000W.dt0", None, "InvalidHeader"), ("120000S1300000E.dt0", -12, None), ("any.dt1", -12, None), ("bad.dt2", None, "MalformedData")]
    rows, opened = _reader("dted", tile_files.DtedSource, str(tmp_path), ds.EqualTo(("lat_deg",), -12))
    assert len(opened) == 3 and [r["elevations"] for r in rows if r["lat_deg"] == -12] == [list(range(6))] * 2
    empty = tmp_path / "deep" / "none"
    empty.mkdir()
    assert formats.read.format("dted").load(str(empty)).count() == 0


def _png(w, h):
    return bytes.fromhex("89504E470D0A1A0A0000000D49484452") + w.to_bytes(4) + h.to_bytes(4) + b"rest"


def _jpeg(w, h, note=b""):
    return b"\xff\xd8" + (b"\xff\xfe" + (len(note) + 2).to_bytes(2) + note if note else b"") + b"\xff\xff\xc2\x00\x0b\x08" + h.to_bytes(2) + w.to_bytes(2) + b"\x01rest"


def test_rasters(formats, tmp_path):
    path, images = str(tmp_path / "maps"), [_png(256, 300), _jpeg(512, 400), _jpeg(7, 9, b"n" * 60_000), b"\x89nothing", b""]
    rows = [(z, x, y, images[(z + x + y) % 5]) for z in (3, 4) for x in range(4) for y in range(3)]
    made = formats.createDataFrame([(*r, "more") for r in rows], "z int, x int, y int, content binary, other string")
    made.write.format("raster_tiles").mode("append").save(path)
    got = formats.read.format("raster_tiles").load(path).collect()
    assert sorted((r.z, r.x, r.y, bytes(r.content)) for r in got) == sorted(rows)
    sizes = {images[0]: ("png", 256, 300), images[1]: ("jpeg", 512, 400), images[2]: ("jpeg", 7, 9)}
    assert all((r.format, r.width, r.height) == sizes.get(bytes(r.content), (None, None, None)) for r in got)
    own, opened = _reader("raster_tiles", tile_files.RasterSource, path, ds.EqualTo(("z",), 4), ds.In(("x",), (1, 3)), ds.LessThan(("y",), 2))
    assert len(opened) == len(own) == 4
    bare = formats.read.format("raster_tiles").option("content", "false").load(path).where("z = 3 and x = 0")
    assert sorted(map(repr, bare.select("y", "width").collect())) == sorted(map(repr, formats.read.format("raster_tiles").load(path).where("z = 3 and x = 0").select("y", "width").collect()))
    files = rasters.read_rasters(formats, path)
    assert sorted((r.z, r.x, r.y, r.width) for r in files.collect() if r.width) == sorted((r.z, r.x, r.y, r.width) for r in got if r.width)


def test_sizes_of_odd_images():
    assert rasters.image_size(_jpeg(3, 4)[:8]) is None and rasters.image_size(b"\xff\xd8\xff\xd0\xff\xd9" + b"\0" * 20) is None
    assert rasters.image_size(_png(1, 2)[:20]) is None and np.iinfo(np.int32).max > 0


def test_overwriting_is_refused(formats, folder):
    with pytest.raises(Exception, match="appended"):
        _tiles(formats, 1).write.format("dted").mode("overwrite").save(folder)
