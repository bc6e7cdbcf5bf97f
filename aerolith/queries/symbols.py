"""Codes, colours, style rules and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import colors, symbols
from aerolith.plans.spreading import spread
from aerolith.queries.common import rnd, table
from aerolith.sources import styles
from aerolith.sources.registry import Sources

#: Sample codes, and what is expected of each: side and kind (None: the kind follows from the word after the code).
_SIDE_ROWS = {
    "friendly": ("Friend", None), "Hostile": ("Hostile", None), "the enemy": ("Hostile", None), "neutral": ("Neutral", None), "unknown": ("Unknown", None), "pending": ("Pending", None),
    "SSGAQWERTYUIOPA": ("Hostile", "Ground"), "QASAQWERTYUIOPA": ("AssumedFriend", "Land"), "Q36BQWERTYUIOPA": ("Neutral", "Subsurface"), "s1zQQWERTYUIOPA": ("Unknown", "Space"),
    "SX4QQWERTYUIOPA": ("Other", "Ground"), "other": ("Other", "Other"),
}
_KIND_ROWS = {"bomber": "Air", "infantry": "Ground", "naval": "Surface", "the subsurface": "Surface", "submarine": "Subsurface", "space": "Space", "-": None}
_AID_ROWS = {
    "vor ": ("Vor", 2), "VOR_DME": ("VorDme", 3), "VorTac": ("VorTac", 3), "TACAN": ("Tacan", 2), "dme": ("Dme", 1), "a ndb": ("Ndb", 2), "heliport": ("Heliport", 2), "aerodrome": ("Airport", 2),
    "waypoint": ("Waypoint", 1), "intersection": ("Intersection", 1), "runway": ("RunwayThreshold", 1), "other": ("none", 0),
}
_HEX_ROWS = {"#2C7": (34, 204, 119, 255), "#2C7D": (34, 204, 119, 221), "2E8B57": (46, 139, 87, 255), "#2E8B5740": (46, 139, 87, 64), "#34": (-1,) * 4, "quux": (-1,) * 4, "": (-1,) * 4}
_CSS_ROWS = {
    "#9ce": (153, 204, 238, 128), "rgb(7,  8,9)": (7, 8, 9, 128), "rgba(0,128,64,0.25)": (0, 128, 64, 32), "none": (-1,) * 4, "Blue": (0, 0, 255, 128), "mud": (-1,) * 4,
    "transparent": (-1,) * 4, "grey": (128, 128, 128, 128),
}
_DASH_ROWS = {"8,3,2": (3, 13), "6 1": (2, 7), "y": (-1, -1), "": (-1, -1), "2.25": (1, 2.25)}
_SIDES, _KINDS, _AIDS, _HEX, _CSS, _DASH = (tuple(rows) for rows in (_SIDE_ROWS, _KIND_ROWS, _AID_ROWS, _HEX_ROWS, _CSS_ROWS, _DASH_ROWS))

#: Widths, heights of bands and other numbers of the style documents that are made from parts.
BAND, STEP = 900, 650
_OPACITIES = (0.25, 0.5, 0.75, 1.0)


def _hex(k: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex((k % 16_777_216).cast("long")), 6, "0"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style document for each part k: layer Lk with 1 to 3 rules of overlapping scales, lines and areas in turn; some are broken, some empty."""
    k = F.col("p_partkey")
    text = lambda tag, v: F.concat(F.lit(f"<{tag}>"), v.cast("string"), F.lit(f"</{tag}>"))
    own = lambda tag, name, v: F.concat(F.lit(f'<{tag} name="{name}">'), v.cast("string"), F.lit(f"</{tag}>"))

    def rule(j: Column) -> Column:
        ink, low = _hex(k * 7919 + j * 104_729), j * STEP + k % 90
        line = F.concat(F.lit("<LineSymbolizer><Stroke>"), own("CssParameter", "stroke", ink), own("SvgParameter", "stroke-width", (k % 9 + j + 1) / 2.0), F.lit("</Stroke></LineSymbolizer>"))
        area = F.concat(F.lit("<q:PolygonSymbolizer><Fill>"), own("CssParameter", "fill", ink), own("CssParameter", "fill-opacity", F.get(F.array(*map(F.lit, _OPACITIES)), (k % 4).cast("int"))), F.lit("</Fill></q:PolygonSymbolizer>"))
        bounds = F.concat(F.when(j > 0, text("MinScaleDenominator", low)).otherwise(""), text("MaxScaleDenominator", low + BAND))
        return F.concat(F.lit("<q:Rule>"), text("q:Name", F.concat(F.lit("rule"), j)), bounds, F.when(j % 2 == 0, line).otherwise(area), F.lit("</q:Rule>"))

    rules = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 3), rule), "\n")
    whole = F.concat(F.lit('<?xml version="1.0"?>\n<Styles xmlns:q="urn:q"><NamedLayer>'), text("Name", F.concat(F.lit("L"), k)), rules, F.lit("</NamedLayer></Styles>"))
    xml = F.when(k % 11 == 5, F.concat(F.lit("<Styles><NamedLayer>"), k.cast("string"))).when(k % 13 == 6, "").otherwise(whole)
    return spread(table(spark, sf_dir, "part").select(k), "p_partkey").select(k.cast("string").alias("doc_id"), xml.alias("xml"))


def _pick(values: tuple[str, ...], by: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (by % len(values)).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat(F.lit("nato:"), _pick(_SIDES, k), F.lit(":"), _pick(_KINDS, F.floor(k / 3))).alias("nato"),
        F.concat(F.lit("nato:"), _pick(_SIDES, k)).alias("short"), F.concat(F.lit("icao:"), _pick(_AIDS, k)).alias("icao"),
        _pick(_HEX, k).alias("hex"), _pick(_CSS, k).alias("css"), _pick(_DASH, k).alias("dash"),
    )


def nato_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("id", *(f(c).alias(f"{c}_{n}") for c in ("nato", "short") for n, f in (("side", symbols.affiliation), ("kind", symbols.dimension))))


def icao_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("id", "icao", F.coalesce(symbols.navaid("icao"), F.lit("none")).alias("navaid"))


def hex_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).withColumn("c", symbols.hex_color("hex")).select("id", *(F.coalesce(F.col(f"c.{k}").cast("int"), F.lit(-1)).alias(k) for k in "rgba"))


def css_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).withColumn("c", colors.css_color("css", 0.5)).select("id", *(F.coalesce(F.col(f"c.{k}").cast("int"), F.lit(-1)).alias(k) for k in "rgba"))


def dash_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parts(spark, sf_dir).withColumn("d", colors.dash_array("dash"))
    return d.select("id", F.coalesce(F.size("d"), F.lit(-1)).alias("n"), rnd(F.coalesce(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), F.lit(-1.0)), 3).alias("total"))


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of one symbol for each part: a path, drawn and filled in colours of its own, and a text."""
    k = F.col("p_partkey")
    paint = F.format_string('{"r":%d,"g":%d,"b":%d,"a":255}', (k % 251).cast("int"), (k % 13).cast("int"), (k % 7).cast("int"))
    shapes = F.concat(F.lit('[{"type":"Path","commands":"M 0,0 L 3,4 Z","fill":'), paint, F.lit(',"stroke":{"width":0.75,"color":'), paint, F.lit('}},{"type":"Text","content":"T","offset_x":1,"offset_y":2,"font_size":7,"color":'), paint, F.lit("}]"))
    text = F.concat(F.lit('{"library_name":"parts","symbols":{"own:'), k.cast("string"), F.lit('":{"bbox":[-4,-4,4,4],"anchor":[1,0],"primitives":'), shapes, F.lit("}}}"))
    return styles.library(spread(table(spark, sf_dir, "part").select(k), "p_partkey").select(text.alias("json")))


def resolve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of three kinds and unknown ones, through the providers in order."""
    p = _parts(spark, sf_dir)
    kind = F.col("id") % 4
    code = F.when(kind == 0, F.col("nato")).when(kind == 1, F.col("icao")).when(kind == 2, F.concat(F.lit("own:"), F.col("id"))).otherwise("other:thing")
    r = symbols.resolve(p.select("id", code.alias("code")), [symbols.Declared(_library(spark, sf_dir)), symbols.Military(), symbols.Navigation()])
    return r.select("id", "code", F.coalesce("provider", F.lit("")).alias("provider"), "status", F.coalesce(F.size("symbol.primitives"), F.lit(0)).alias("primitives"))


def sld_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = styles.style_rules(_documents(spark, sf_dir))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c.rpartition(".")[2])
    word = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    return r.select(
        "doc_id", word("layer", "layer"), F.coalesce("rule_idx", F.lit(-1)).alias("rule_idx"), word("rule.name", "name"), number("rule.min_scale"), number("rule.max_scale"),
        word("rule.stroke.color", "ink"), number("rule.stroke.width"), word("rule.fill.color", "paint"), number("rule.fill.opacity"), word("error", "error"),
    )


def sld_rules_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each part's document that apply at a scale of its own."""
    rules = styles.style_rules(_documents(spark, sf_dir)).where("error is null")
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("id"), (k * 37 % 2400).cast("double").alias("scale"), k.cast("string").alias("doc_id"))
    return styles.at_scale(parts.join(rules, "doc_id"), "scale").select("id", "scale", F.col("rule.name").alias("name"))


def style_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols restyled by the rules of the layer that has their number."""
    rules = styles.rules_by_layer(styles.style_rules(_documents(spark, sf_dir)))
    s = _library(spark, sf_dir).withColumn("layer", F.concat(F.lit("L"), F.substring("symbol_id", 5, 20))).join(rules, "layer", "left")
    s = s.select("symbol_id", F.posexplode(symbols.restyle("symbol", "rules")["primitives"]).alias("i", "p"))
    return s.select("symbol_id", "i", *(F.col(f"p.fill.{c}").cast("int").alias(f"fill_{c}") for c in "rgba"), F.coalesce(F.col("p.stroke.color.g").cast("int"), F.lit(-1)).alias("ink_g"), F.coalesce(F.col("p.stroke.width").cast("double"), F.lit(-1.0)).alias("width"))


def svg_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing for each part: a group that hands its style down, a path, a circle (none without radius) and, in every third, a text in a nested group."""
    k = F.col("p_partkey")
    part = lambda x: x.cast("string")
    head = F.concat(F.lit('<svg><g stroke="'), _hex(k * 7919), F.lit('" stroke-width="'), part((k % 5 + 1) / 2.0), F.lit('" opacity="'), part(F.get(F.array(*map(F.lit, _OPACITIES)), (k % 4).cast("int"))), F.lit('">'))
    path = F.concat(F.lit('<path d="M 0 0 L '), part(k % 50), F.lit(' 1" fill="none"/>'))
    circle = F.concat(F.lit('<circle cx="'), part(k % 7), F.lit('" cy="2" r="'), part(k % 6), F.lit('" fill="rgb(0,9,'), part(k % 256), F.lit(')"/>'))
    label = F.when(k % 3 == 0, F.concat(F.lit('<g opacity="0.5"><text x="4" font-size="'), part(k % 20 + 5), F.lit('">N'), part(k), F.lit("</text></g>"))).otherwise("")
    drawn = spread(table(spark, sf_dir, "part").select(k), "p_partkey").select(k.alias("id"), F.concat(head, path, circle, label, F.lit("</g></svg>")).alias("svg"))
    r = drawn.select("id", F.posexplode(styles.svg_primitives("svg")).alias("i", "p"))
    return r.select(
        "id", "i", "p.type", F.coalesce(F.col("p.fill.b").cast("int"), F.lit(-1)).alias("fill_b"), F.coalesce(F.col("p.stroke.color.a").cast("int"), F.lit(-1)).alias("ink_a"),
        F.coalesce(F.col("p.stroke.width").cast("double"), F.lit(-1.0)).alias("width"), F.coalesce("p.content", F.lit("")).alias("content"),
    )


def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("M "), (k % 31).cast("string"), F.lit(",-"), (k % 17).cast("string"), F.lit(" L "), (k % 13).cast("string"), F.lit(".5,"), (k % 7).cast("string"), F.lit(" Z"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.posexplode(styles.path_points(text)).alias("i", "p")).select("id", "i", rnd("p.x", 3).alias("x"), rnd("p.y", 3).alias("y"))


def number_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "px").otherwise(F.concat((k % 97).cast("string"), F.lit(".5px")))
    return table(spark, sf_dir, "part").select(k.alias("id"), colors.number_prefix(text, 2.0).alias("number"))


def source_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources, one replaced and one dropped."""
    s = Sources(spark)
    for name, rows in (("a", "nation"), ("b", "region"), ("a", "supplier"), ("c", "part")):
        s.register(name, table(spark, sf_dir, rows))
    s.drop("c")
    return s.sizes()


QUERIES = {
    f.__name__: f
    for f in (nato_classify, icao_classify, hex_color, css_color, dash_array, resolve_chain, sld_rules, sld_rules_at_scale, style_override, svg_compile, path_points, number_prefix, source_sizes)
}

# -- SQL


def _list(values: tuple[str, ...], by: str) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + f"][(({by}) % {len(values)})::INT + 1]"


_PARTS = f"""parts AS (SELECT p_partkey AS id, 'nato:' || {_list(_SIDES, 'p_partkey')} || ':' || {_list(_KINDS, 'p_partkey//3')} AS nato,
    'nato:' || {_list(_SIDES, 'p_partkey')} AS short, 'icao:' || {_list(_AIDS, 'p_partkey')} AS icao,
    {_list(_SIDES, 'p_partkey')} AS a, {_list(_KINDS, 'p_partkey//3')} AS b, {_list(_AIDS, 'p_partkey')} AS c, {_list(_HEX, 'p_partkey')} AS hex, {_list(_CSS, 'p_partkey')} AS css, {_list(_DASH, 'p_partkey')} AS dash FROM part)"""


def _values(table_: dict[str, tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "(VALUES " + ",".join("(" + ",".join(map(one, (k, *v))) + ")" for k, v in table_.items()) + f") AS t({names})"


#: Kinds of a code: the word after it counts, else its third letter; without word and letter there is none.
_EXPECTED = f"""sides AS (SELECT * FROM {_values(_SIDE_ROWS, 'a, side, letter')}), kinds AS (SELECT * FROM {_values({k: (v,) for k, v in _KIND_ROWS.items()}, 'b, word')}),
aids AS (SELECT * FROM {_values(_AID_ROWS, 'c, aid, n')}),
told AS (SELECT p.*, s.side, coalesce(k.word, s.letter, 'Other') AS kind, coalesce(s.letter, 'Other') AS bare, a.aid, a.n FROM parts p JOIN sides s ON p.a = s.a JOIN kinds k ON p.b = k.b JOIN aids a ON p.c = a.c)"""


_RULES = f"""rules AS (SELECT *, p_partkey AS k, p_partkey::VARCHAR AS doc_id, 'L' || p_partkey AS layer, j*{STEP} + p_partkey % 90 AS low, (p_partkey*7919 + j*104729) % 16777216 AS rgb,
    '#' || lpad(printf('%X', (p_partkey*7919 + j*104729) % 16777216), 6, '0') AS ink, (p_partkey % 9 + j + 1)/2e0 AS width, [0.25e0, 0.5e0, 0.75e0, 1e0][(p_partkey % 4)::INT+1] AS opacity
    FROM part, LATERAL (SELECT unnest(range(p_partkey % 3 + 1)) AS j) WHERE p_partkey % 11 <> 5 AND p_partkey % 13 <> 6)"""

ORACLE_SQL = {
    "nato_classify": f"WITH {_PARTS}, {_EXPECTED} SELECT id, side AS nato_side, kind AS nato_kind, side AS short_side, bare AS short_kind FROM told",
    "icao_classify": f"WITH {_PARTS}, {_EXPECTED} SELECT id, icao, aid AS navaid FROM told",
    "hex_color": f"WITH {_PARTS} SELECT id, r, g, b_ AS b, a_ AS a FROM parts JOIN {_values(_HEX_ROWS, 'k, r, g, b_, a_')} ON hex = k",
    "css_color": f"WITH {_PARTS} SELECT id, r, g, b_ AS b, a_ AS a FROM parts JOIN {_values(_CSS_ROWS, 'k, r, g, b_, a_')} ON css = k",
    "dash_array": f"WITH {_PARTS} SELECT id, n::INT AS n, total::DOUBLE AS total FROM parts JOIN {_values(_DASH_ROWS, 'k, n, total')} ON dash = k",
    "resolve_chain": f"""WITH {_PARTS}, {_EXPECTED}, t AS (SELECT *, CASE id % 4 WHEN 0 THEN nato WHEN 1 THEN icao WHEN 2 THEN 'own:' || id ELSE 'other:thing' END AS code FROM told)
        SELECT id, code, CASE WHEN id % 4 = 0 THEN 'NATO' WHEN id % 4 = 2 THEN 'Declarative' WHEN id % 4 = 1 AND aid <> 'none' THEN 'ICAO' ELSE '' END AS provider,
        CASE WHEN id % 4 = 3 OR (id % 4 = 1 AND aid = 'none') THEN 'ProviderNotFound' ELSE 'ok' END AS status,
        (CASE id % 4 WHEN 0 THEN 2 + (side = 'Hostile')::INT WHEN 1 THEN n WHEN 2 THEN 2 ELSE 0 END)::INT AS primitives FROM t""",
    "path_points": """SELECT p_partkey AS id, i::INT AS i, [p_partkey % 31, p_partkey % 13 + 0.5e0][i+1]::DOUBLE AS x, [-(p_partkey % 17), p_partkey % 7][i+1]::DOUBLE + 0e0 AS y
        FROM part, (SELECT unnest(range(2)) AS i)""",
    "number_prefix": "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 2e0 ELSE p_partkey % 97 + 0.5e0 END AS number FROM part",
    "source_sizes": "SELECT 'a' AS source_id, count(*)::BIGINT AS rows FROM supplier UNION ALL SELECT 'b', count(*)::BIGINT FROM region",
    "sld_rules": f"""WITH {_RULES} SELECT doc_id, layer, j::INT AS rule_idx, 'rule' || j AS name, CASE WHEN j > 0 THEN low ELSE -1 END::DOUBLE AS min_scale, (low+{BAND})::DOUBLE AS max_scale,
        CASE WHEN j % 2 = 0 THEN ink ELSE '' END AS ink, CASE WHEN j % 2 = 0 THEN width ELSE -1 END::DOUBLE AS width, CASE WHEN j % 2 = 1 THEN ink ELSE '' END AS paint,
        CASE WHEN j % 2 = 1 THEN opacity ELSE -1 END::DOUBLE AS opacity, '' AS error FROM rules
        UNION ALL SELECT p_partkey::VARCHAR, '', -1, '', -1, -1, '', -1, '', -1, 'XmlError' FROM part WHERE p_partkey % 11 = 5""",
    "sld_rules_at_scale": f"""WITH {_RULES} SELECT k AS id, (k*37 % 2400)::DOUBLE AS scale, 'rule' || j AS name FROM rules WHERE (j = 0 OR k*37 % 2400 >= low) AND k*37 % 2400 <= low+{BAND}""",
    "style_override": f"""WITH {_RULES}, s AS (SELECT p_partkey AS k, p_partkey % 251 AS r, p_partkey % 13 AS g, p_partkey % 7 AS b FROM part),
        area AS (SELECT * FROM rules WHERE j = 1), line AS (SELECT * FROM rules WHERE j % 2 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY j DESC) = 1),
        styled AS (SELECT s.*, a.rgb AS paint, a.opacity, l.rgb AS ink, l.width FROM s LEFT JOIN area a ON a.k = s.k LEFT JOIN line l ON l.k = s.k)
        SELECT 'own:' || k AS symbol_id, 0 AS i, coalesce(paint // 65536, r)::INT AS fill_r, coalesce(paint // 256 % 256, g)::INT AS fill_g, coalesce(paint % 256, b)::INT AS fill_b,
        coalesce(floor(opacity*255), 255)::INT AS fill_a, coalesce(ink // 256 % 256, g)::INT AS ink_g, coalesce(width, 0.75e0)::DOUBLE AS width FROM styled
        UNION ALL SELECT 'own:' || k, 1, r::INT, g::INT, b::INT, 255, -1, -1 FROM s""",
    "svg_compile": """WITH s AS (SELECT p_partkey AS k, [64, 128, 191, 255][(p_partkey % 4)::INT+1] AS ink, (p_partkey % 5 + 1)/2e0 AS width FROM part)
        SELECT k AS id, 0 AS i, 'Path' AS type, -1 AS fill_b, ink AS ink_a, width, '' AS content FROM s
        UNION ALL SELECT k, 1, 'Circle', (k % 256)::INT, ink, width, '' FROM s WHERE k % 6 > 0
        UNION ALL SELECT k, CASE WHEN k % 6 > 0 THEN 2 ELSE 1 END, 'Text', 0, -1, -1, 'N' || k FROM s WHERE k % 3 = 0""",
}
