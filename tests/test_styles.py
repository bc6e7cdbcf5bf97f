import pytest
from pyspark.sql import functions as F

from aerolith.functions import colors, symbols
from aerolith.operators import screen, tiles
from aerolith.sources import features, styles


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()


COAST = """<Styles xmlns:k="urn:k"><NamedLayer><Name> coast </Name><k:Rule><k:Name>shore</k:Name><LineSymbolizer><Stroke><SvgParameter name="stroke">#1A7</SvgParameter>
<SvgParameter name="stroke-dasharray">3 1.5,2</SvgParameter></Stroke></LineSymbolizer><MaxScaleDenominator>820</MaxScaleDenominator></k:Rule>
<k:Rule><MinScaleDenominator>640</MinScaleDenominator><PolygonSymbolizer><Fill><CssParameter name="fill-opacity">0.3</CssParameter></Fill></PolygonSymbolizer></k:Rule></NamedLayer></Styles>"""


def test_styles_parse():
    rules = styles.parse_styles(COAST)
    assert [(layer, i, r["name"], r["min_scale"], r["max_scale"]) for layer, i, r in rules] == [("coast", 0, "shore", None, 820.0), ("coast", 1, "", 640.0, None)]
    assert rules[0][2]["stroke"] == {"color": "#1A7", "width": 1.0, "dash_array": [3.0, 1.5, 2.0]} and rules[0][2]["fill"] is None and rules[1][2]["fill"] == {"color": "#000000", "opacity": 0.3}
    assert styles.parse_styles("") == [] and styles.parse_styles('<?xml version="1.0"?>') == []


@pytest.mark.parametrize(
    "xml,error",
    [
        ("<a><b>", "XmlError"), ('<!DOCTYPE x [<!ENTITY e "v">]><a>&e;</a>', "XmlError"),
        ("<NamedLayer><Name>n</Name><Rule><MinScaleDenominator>x</MinScaleDenominator></Rule></NamedLayer>", "InvalidValue"),
        ('<NamedLayer><Rule><LineSymbolizer><Stroke><CssParameter name="stroke-dasharray">a,b</CssParameter></Stroke></LineSymbolizer></Rule></NamedLayer>', "InvalidValue"),
    ],
)
def test_style_errors(xml, error):
    with pytest.raises(styles.StyleError, match=error):
        styles.parse_styles(xml)


def test_style_defaults_and_lost_rules():
    xml = "<S><NamedLayer><Rule/></NamedLayer><NamedLayer><Name>l</Name><Rule/><Rule><PointSymbolizer/><TextSymbolizer/></Rule></NamedLayer></S>"
    rules = styles.parse_styles(xml)
    assert [(layer, i) for layer, i, _ in rules] == [("l", 0), ("l", 1)] and rules[0][2]["name"] == ""
    assert rules[1][2]["point"]["size"] == 6.0 and rules[1][2]["text"]["font_family"] == "sans-serif"


def test_scale_bounds_are_inclusive(spark):
    rules = styles.style_rules(spark.createDataFrame([("d", COAST)], "doc_id string, xml string"))
    found = lambda s: [r.rule_idx for r in styles.at_scale(rules, F.lit(float(s))).orderBy("rule_idx").collect()]
    assert [found(x) for x in (0, 639.9, 640, 820, 820.1, 1e12)] == [[0], [0], [0, 1], [0, 1], [1], [1]]


@pytest.mark.parametrize("code,n", [("mil:neutral:ship", 2), ("nato:enemy:satellite", 3), ("mil:S0AAQWERTYUIOPA", 2), ("nato:QSXBQWERTYUIOPA", 3), ("icao:a VOR", 2), ("icao:VOR_DME", 3), ("icao:vor_tac", 3), ("icao:NDB-7", 2), ("icao:tacan 9", 2), ("icao:ad:XX", 2), ("icao:heli pad", 2), ("icao:wpt", 1), ("icao:threshold", 1), ("icao:x dme", 1)])
def test_primitive_counts(spark, code, n):
    r = symbols.resolve(spark.createDataFrame([(code,)], "code string"), [symbols.Military(), symbols.Navigation()]).first()
    assert len(r.symbol.primitives) == n and r.status == "ok"


def test_unknown_codes(spark):
    r = symbols.resolve(spark.createDataFrame([("NATO:neutral",), ("icao:void",), (None,)], "code string"), [symbols.Military(), symbols.Navigation()])
    assert [x.status for x in r.collect()] == ["ProviderNotFound"] * 3


def test_subsurface_is_surface(spark):
    assert one(spark, d=symbols.dimension(F.lit("mil:the subsurface of x")), e=symbols.dimension(F.lit("mil:a submarine"))) == ("Surface", "Subsurface")


@pytest.mark.parametrize("text", ["#1b9", "#1B9c", "40E0D0", "#40e0d07f", "#GGG", "#12345"])
def test_hex(spark, text):
    c, digits = one(spark, c=symbols.hex_color(F.lit(text))).c, text.lstrip("#")
    parts = [x * 2 for x in digits] if len(digits) < 5 else [digits[k : k + 2] for k in range(0, len(digits), 2)]
    try:
        want = tuple(int(x, 16) for x in [*parts, "ff"][:4]) if len(digits) in (3, 4, 6, 8) else None
    except ValueError:
        want = None
    assert (tuple(c) if c else None) == want


def test_css_and_dashes(spark):
    r = one(spark, a=colors.css_color(F.lit("rgba(1,2,3,0.5)")), b=colors.css_color(F.lit("none")), c=colors.css_color(F.lit(" Orange ")), d=colors.dash_array(F.lit("5, 2")), e=colors.dash_array(F.lit("5,x")), f=colors.number_prefix(F.lit("3.5px")), g=colors.number_prefix(F.lit("px"), 2.0))
    assert tuple(r.a) == (1, 2, 3, 128) and r.b is None and tuple(r.c)[:3] == (255, 165, 0) and r.d == [5, 2] and r.e is None and (r.f, r.g) == (3.5, 2.0)


def restyled(spark, stroke=None, fill=None):
    lib = styles.library(spark.createDataFrame([('{"library_name":"l","symbols":{"s":{"bbox":[0,0,1,1],"anchor":[0,0],"primitives":[{"type":"Path","commands":"M 0,0","fill":{"r":1,"g":1,"b":1,"a":255},"stroke":{"color":{"r":2,"g":2,"b":2,"a":255},"width":1}},{"type":"Circle","cx":0,"cy":0,"r":1},{"type":"Text","content":"T","color":{"r":3,"g":3,"b":3,"a":255}}]}}}',)], "json string"))
    rule = spark.createDataFrame([([{"name": "r", "stroke": s, "fill": f} for s, f in zip(stroke, fill, strict=True)],)], f"rules array<{styles.RULE}>")
    return lib.crossJoin(rule).select(symbols.restyle("symbol", "rules").alias("s")).first().s.primitives


def test_restyle(spark):
    a, b = {"color": "#FF0000", "width": 4.5, "dash_array": [10.0, 5.0]}, {"color": "#00FF00", "width": 2.0, "dash_array": None}
    path, circle, text = restyled(spark, [a], [{"color": "#0000FF", "opacity": 0.5}])
    assert tuple(path.fill) == (0, 0, 255, 127) and path.stroke.width == 4.5 and path.stroke.dash_array == [10, 5]
    assert circle.fill is None and circle.stroke is None and tuple(text.fill) == (3, 3, 3, 255)
    assert restyled(spark, [a, b], [None, None])[0].stroke.width == 2.0
    bad = restyled(spark, [{"color": "zz", "width": 9.0, "dash_array": None}], [None])[0]
    assert bad.stroke.width == 1 and tuple(bad.stroke.color)[:3] == (2, 2, 2)


def test_svg():
    p = styles.compile_svg('<svg><g stroke="red" stroke-width="2"><circle r="3"/><path d="M 0 0"/></g><text>lost</text><text x="1">kept</text></svg>')
    assert [x["type"] for x in p] == ["Circle", "Path", "Text"] and all(x["stroke"]["width"] == 2 for x in p[:2]) and p[2]["content"] == "kept"
    assert styles.compile_svg('<svg><circle r="0"/><path/></svg>') == []


def test_library_round_trip(spark, tmp_path):
    config = spark.createDataFrame([("s", "a.svg", [0.0, 0.0, 1.0, 1.0], None)], "symbol_id string, file string, bbox array<double>, anchor array<double>")
    made = styles.compile_library(config, spark.createDataFrame([("a.svg", '<svg><path d="M 0,0 L 3,-4 Z" fill="#fff"/></svg>')], "file string, svg string"))
    styles.write_library(made, str(tmp_path / "lib"))
    back = spark.read.schema(made.schema).json(str(tmp_path / "lib")).first()
    assert back.symbol.primitives[0].commands == "M 0,0 L 3,-4 Z" and back.symbol.anchor == [0, 0]
    assert [(p.x, p.y) for p in one(spark, p=styles.path_points(F.lit("M 0,0 L 3,-4 Z"))).p] == [(0, 0), (3, -4)]


def test_features_fall_back(spark):
    rows = features.features(spark.createDataFrame([(1, '{"features":[{"geometry":{"type":"Point","coordinates":[0,0]},"properties":{}}]}'), (2, "\x1abinary"), (3, None)], "key int, json string")).collect()
    point = [r for r in rows if r.key == 1]
    assert len(point) == 1 and point[0].type == "Point" and tuple(point[0].coordinates[0]) == (0.0, 0.0)
    assert sum(r.key == 2 for r in rows) == 3 and sum(r.key == 3 for r in rows) == 3


def test_declutter_against_plain_loop(spark):
    import random

    rnd = random.Random(3)
    rows = [(f, f"{k:03}", rnd.uniform(0, 300), rnd.uniform(0, 200), 50.0) for f in range(3) for k in range(60)]
    got = {(r.frame, r.id): r.slot for r in screen.declutter(spark.createDataFrame(rows, "frame long, id string, x double, y double, label_w double")).collect()}
    want = {}
    for f in range(3):
        taken = []
        for _, k, x, y, w in sorted(r for r in rows if r[0] == f):
            for slot, (dx, dy) in enumerate(((15, -30), (15, 10), (-w - 15, 10), (-w - 15, -30))):
                c = (x + dx - 2, y + dy - 2, w + 4, 30)
                if not any(c[0] < t[0] + t[2] and c[0] + c[2] > t[0] and c[1] < t[1] + t[3] and c[1] + c[3] > t[1] for t in taken):
                    taken.append((x + dx, y + dy, w, 26))
                    want[f, k] = slot
                    break
    assert got == want


def test_atlas(spark):
    s = spark.createDataFrame([("a", 1, 30, 10), ("b", 2, 30, 20), ("c", 3, 30, 5), ("a", 4, 9, 9), ("d", 5, 10, 60)], "id string, seq int, width int, height int")
    got = {r.id: r for r in screen.pack_shelves(s, 64).collect()}
    assert set(got) == {"a", "b", "c", "d"} and (got["b"].u0, got["b"].v0) == (32 / 64, 0) and (got["c"].u0, got["c"].v0) == (0, 22 / 64)
    assert not got["d"].fits


def test_raster_files(spark, tmp_path):
    from aerolith.sources import rasters

    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (300).to_bytes(4, "big") + (257).to_bytes(4, "big") + b"rest"
    for name, content in (("5/17/9.png", png), ("5/17/10.jpg", b"no png"), ("readme.txt", b"x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {(r.z, r.x, r.y): (r.width, r.height) for r in rasters.read_rasters(spark, str(tmp_path)).collect()}
    assert got == {(5, 17, 9): (300, 257), (5, 17, 10): (None, None)}


def test_addresses(spark):
    r = spark.range(1).select(tiles.xyz_url("h/{z}/{x}/{y}/{x}", F.lit(3), F.lit(4), F.lit(5)).alias("u"), tiles.wmts_url("h?a=b", "l", F.lit(3), F.lit(4), F.lit(5)).alias("w")).first()
    assert r.u == "h/3/4/5/{x}" and r.w.startswith("h?a=b&service=WMTS&") and "TileMatrix=EPSG:900913:3&TileRow=5&TileCol=4" in r.w


def test_views_without_image(spark):
    """Under a projection that cannot reach the centre a view falls back on tiles about it, and keys on its own tile; a drag off the map changes nothing."""
    from math import pi

    from aerolith.functions.projections import Stereographic

    away = Stereographic(0.0, 0.0)
    v = spark.createDataFrame([(1, 0.0, pi, 1.0, 0.0, 1000.0, 1.0, "2D")], "view int, lat double, lon double, zoom double, rotation double, viewport_base_meters double, aspect_ratio double, mode string")
    b = tiles.visible_bounds(v, away, F.lit(4)).first()
    assert (b.min_x, b.max_x, b.min_y, b.max_y) == (15, 15, 7, 9)
    assert [(k.x, k.y) for k in tiles.visible_keys(v, away, F.lit(4)).collect()] == [(15, 8)]
    moved = tiles.panned(v.withColumns({"dx_px": F.lit(5.0), "dy_px": F.lit(5.0), "canvas_width": F.lit(100.0)}), away).first()
    assert (moved.lat, moved.lon) == (0.0, pi)


def test_layers(spark):
    rows = spark.createDataFrame([("A", 0, True, True), ("B", 1, True, False), ("C", 2, False, True)], "id string, z_index int, visible boolean, is_static boolean")
    assert [r.id for r in screen.reorder(rows, "B", 0).orderBy("z_index").collect()] == ["B", "A", "C"]
    assert [r.id for r in screen.shown_layers(rows, static=True).collect()] == ["A"]


def test_caches(spark):
    log = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "k string, t int")
    held = lambda policy: {r.k for r in tiles.evict(log, "k", "t", 2, policy).collect()}
    assert held("lru") == {"a", "c"} and held("fifo") == {"b", "c"}
    with pytest.raises(ValueError):
        tiles.evict(log, "k", "t", 0)


def test_registry(spark):
    from aerolith.sources.registry import SourceExists, Sources

    s = Sources(spark, strict=True)
    s.register("a", spark.range(3))
    with pytest.raises(SourceExists):
        s.register("a", spark.range(1))
    assert s.total_size().first().rows == 3 and s.get("b") is None and s.drop("a") and not s.drop("a")


def test_documents_of_one_small_file_are_parsed_by_many_tasks(spark):
    from aerolith.queries import symbols as q

    for made in (q.sld_rules, q.sld_rules_at_scale, q.style_override, q.svg_compile):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [p_partkey" in plan, made.__name__
    assert q._documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_large_libraries_are_not_broadcast(spark, monkeypatch):
    from aerolith.queries import symbols as q

    sf = "/root/testdata/sf0.001"
    assert "RepartitionByExpression [p_partkey" in q._library(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    small = q.resolve_chain(spark, sf)
    monkeypatch.setattr(symbols, "BROADCAST_SYMBOLS", 100)
    large = q.resolve_chain(spark, sf)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (small, large)]
    assert ["BroadcastExchange" in p for p in plans] == [True, False] and "SortMergeJoin" in plans[1]
    assert sorted(small.collect()) == sorted(large.collect())
