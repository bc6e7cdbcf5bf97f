"""Symbols of military and navigation codes, the chain of providers, and style overrides, all as columns."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.colors import COLOR, color, hex_color
from aerolith.functions.geodesy import _c

STROKE = f"struct<color:{COLOR},width:float,dash_array:array<float>>"
PRIMITIVE = (
    f"struct<type:string,commands:string,cx:double,cy:double,r:double,content:string,offset_x:double,offset_y:double,font_size:double,fill:{COLOR},stroke:{STROKE}>"
)
SYMBOL = f"struct<primitives:array<{PRIMITIVE}>,bbox:array<double>,anchor:array<double>>"

#: Words of a code and letters of a 15-character identifier that give affiliation and dimension; the first match in order counts.
AFFILIATION_WORDS = (
    ("Friend", ("friend",)), ("Hostile", ("hostile", "enemy")), ("Neutral", ("neutral",)), ("Unknown", ("unknown",)), ("Pending", ("pending",)),
)
AFFILIATION_LETTERS = {"Pending": "0P", "Unknown": "1U", "Friend": "2F", "Neutral": "3N", "Other": "4X", "Hostile": "5HS", "AssumedFriend": "6A"}
DIMENSION_WORDS = (
    ("Air", ("air", "fighter", "bomber")), ("Ground", ("ground", "armor", "infantry")), ("Surface", ("surface", "ship", "naval")),
    ("Subsurface", ("subsurface", "submarine")), ("Space", ("space", "satellite")),
)
DIMENSION_LETTERS = {"Space": "0Z", "Air": "1A", "Ground": "24GX", "Land": "3S", "Surface": "5N", "Subsurface": "6U"}
NAVAID_WORDS = (
    ("VorTac", ("vortac", "vor_tac")), ("VorDme", ("vordme", "vor_dme")), ("Vor", ("vor",)), ("Tacan", ("tacan",)), ("Dme", ("dme",)), ("Ndb", ("ndb",)),
    ("Heliport", ("heliport", "heli")), ("Airport", ("airport", "aerodrome", "ad:")), ("Waypoint", ("waypoint", "wpt")),
    ("Intersection", ("intersection", "int:")), ("RunwayThreshold", ("runway", "threshold")),
)
SIDC_BYTES, FILL_ALPHA = 15, 80

#: Colours, outlines and icons.
AFFILIATION_COLORS = {
    "Friend": (0, 100, 255), "AssumedFriend": (0, 100, 255), "Hostile": (255, 0, 0), "Neutral": (0, 200, 0), "Unknown": (255, 220, 0),
    "Pending": (255, 220, 0), "Other": (128, 128, 128),
}
_BOX = ("M -15,-10 L 15,-10 L 15,10 L -15,10 Z", (-15, -10, 15, 10))
_ROUND = ("M 0,-15 A 15,15 0 1 1 0,15 A 15,15 0 1 1 0,-15 Z", (-15, -15, 15, 15))
FRAMES = {
    "Friend": _BOX, "AssumedFriend": _BOX, "Other": _BOX, "Unknown": _ROUND, "Pending": _ROUND,
    "Hostile": ("M 0,-16 L 16,0 L 0,16 L -16,0 Z", (-16, -16, 16, 16)), "Neutral": ("M -14,-14 L 14,-14 L 14,14 L -14,14 Z", (-14, -14, 14, 14)),
}
_LAND = ("M -8,0 A 8,5 0 1 0 8,0 A 8,5 0 1 0 -8,0 Z", True)
ICONS = {
    "Air": ("M 0,-8 L 8,6 L 0,3 L -8,6 Z", True), "Ground": _LAND, "Land": _LAND,
    "Surface": ("M -8,2 A 8,8 0 0 1 8,2 M 0,2 L 0,-6 M -4,-6 L 4,-6", False), "Subsurface": ("M -9,2 A 9,5 0 1 0 9,2 M -2,2 L -2,-4 L 2,-4 L 2,2", False),
    "Space": ("M -6,-4 L 6,-4 L 6,4 L -6,4 Z M -10,-2 L -6,-2 M -10,2 L -6,2 M 6,-2 L 10,-2 M 6,2 L 10,2", False), "Other": ("M -6,0 L 6,0 M 0,-6 L 0,6", False),
}
HOSTILE_LINE = "M 0,16 L 0,22"
_MAGENTA, _BLUE, _BLACK, _WHITE = (180, 0, 180), (0, 80, 200), (0, 0, 0), (255, 255, 255)
_HEXAGON = "M 0,-14 L 12,-7 L 12,7 L 0,14 L -12,7 L -12,-7 Z"


def _lit(v, kind: str) -> Column:
    return F.lit(v).cast(kind)


def _color(rgb: tuple[int, ...] | None) -> Column:
    return color(*rgb) if rgb else F.lit(None).cast(COLOR)


def _stroke(rgb: tuple[int, ...] | None, width: float | None) -> Column:
    if rgb is None:
        return F.lit(None).cast(STROKE)
    return F.struct(_color(rgb).alias("color"), _lit(width, "float").alias("width"), _lit(None, "array<float>").alias("dash_array"))


def _primitive(kind: str, fill=None, stroke=None, width=None, **fields) -> Column:
    text, number = ("commands", "content"), ("cx", "cy", "r", "offset_x", "offset_y", "font_size")
    own = {k: _lit(fields.get(k), "string") for k in text} | {k: _lit(fields.get(k), "double") for k in number}
    order = ("commands", "cx", "cy", "r", "content", "offset_x", "offset_y", "font_size")
    return F.struct(F.lit(kind).alias("type"), *(own[k].alias(k) for k in order), _color(fill).alias("fill"), _stroke(stroke, width).alias("stroke"))


def _path(commands: str, fill=None, stroke=None, width=None) -> Column:
    return _primitive("Path", fill, stroke, width, commands=commands)


def _circle(r: float, fill=None, stroke=None, width=None) -> Column:
    return _primitive("Circle", fill, stroke, width, cx=0.0, cy=0.0, r=r)


def _symbol(primitives: Sequence[Column], bbox: Sequence[float]) -> Column:
    return F.struct(
        F.array(*primitives).alias("primitives"), F.array(*(F.lit(float(v)) for v in bbox)).alias("bbox"), F.array(F.lit(0.0), F.lit(0.0)).alias("anchor")
    )


#: What each navaid is drawn with, and its box.
def _navaids() -> dict[str, Column]:
    vor = [_path(_HEXAGON, _WHITE, _BLUE, 2.0), _circle(2.0, _BLUE)]
    fix = _symbol([_path("M 0,-10 L 9,6 L -9,6 Z", None, _BLACK, 1.5)], (-9, -10, 9, 6))
    field = _circle(12.0, _WHITE, _BLACK, 2.0)
    return {
        "Vor": _symbol(vor, (-12, -14, 12, 14)),
        "VorDme": _symbol([*vor, _path("M 14,-12 L 20,-12 L 20,-6 L 14,-6 Z", _WHITE, _BLUE, 1.5)], (-12, -14, 20, 14)),
        "VorTac": _symbol([*vor, _path("M 14,-12 L 20,-12 L 17,-6 Z", _WHITE, _BLUE, 1.5)], (-12, -14, 20, 14)),
        "Dme": _symbol([_path("M -8,-6 L 8,-6 L 8,6 L -8,6 Z", _WHITE, _BLUE, 2.0)], (-8, -6, 8, 6)),
        "Ndb": _symbol([_circle(10.0, _WHITE, _MAGENTA, 2.0), _circle(1.5, _MAGENTA)], (-10, -10, 10, 10)),
        "Tacan": _symbol([_circle(12.0, _WHITE, _BLUE, 2.0), _path("M 0,-7 L 6,4 L -6,4 Z", None, _BLUE, 1.5)], (-12, -12, 12, 12)),
        "Airport": _symbol([field, _path("M -8,-1 L 8,-1 L 8,1 L -8,1 Z", _BLACK)], (-12, -12, 12, 12)),
        "Heliport": _symbol([field, _primitive("Text", _BLACK, content="H", offset_x=-4.0, offset_y=4.0, font_size=12.0)], (-12, -12, 12, 12)),
        "Waypoint": fix,
        "Intersection": fix,
        "RunwayThreshold": _symbol([_path("M -8,-10 L 8,-10 L 0,10 Z", _WHITE, _BLACK, 2.0)], (-8, -10, 8, 10)),
    }


def _by_words(code: Column, words) -> Column | None:
    out = None
    low = F.lower(code)
    for name, any_of in words:
        hit = low.contains(any_of[0])
        for w in any_of[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _by_letter(letter: Column, letters: dict[str, str]) -> Column:
    out = F.when(F.lit(False), "")
    for name, those in letters.items():
        out = out.when(F.upper(letter).isin(*those), name)
    return out.otherwise("Other")


def _identifier(code: Column) -> Column:
    return F.regexp_replace(code, "^(?i)(nato:|mil:)", "")


def affiliation(code) -> Column:
    """By words anywhere in the code, else by the second letter of an identifier of 15 bytes or more."""
    code = _c(code)
    rest = _identifier(code)
    return F.coalesce(_by_words(code, AFFILIATION_WORDS), F.when(F.octet_length(rest) >= SIDC_BYTES, _by_letter(F.substring(rest, 2, 1), AFFILIATION_LETTERS)), F.lit("Other"))


def dimension(code) -> Column:
    """By words, else by the third letter. 'subsurface' holds 'surface', which is looked for first."""
    code = _c(code)
    rest = _identifier(code)
    return F.coalesce(_by_words(code, DIMENSION_WORDS), F.when(F.octet_length(rest) >= SIDC_BYTES, _by_letter(F.substring(rest, 3, 1), DIMENSION_LETTERS)), F.lit("Other"))


def navaid(code) -> Column:
    """Kind of navaid that a code names, or null."""
    return _by_words(_c(code), NAVAID_WORDS)


def _lookup(key: Column, table: dict[str, Column]) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


class Provider(ABC):
    """Gives a symbol for the codes that it knows; null for all others."""

    name: str

    @abstractmethod
    def condition(self, code: Column) -> Column: ...

    @abstractmethod
    def symbol(self, code: Column) -> Column: ...


class Military(Provider):
    name = "NATO"

    def condition(self, code: Column) -> Column:
        return code.startswith("nato:") | code.startswith("mil:")

    def symbol(self, code: Column) -> Column:
        side = affiliation(code)
        frames = {}
        for name, (path, bbox) in FRAMES.items():
            rgb = AFFILIATION_COLORS[name]
            frames[name] = _symbol([_path(path, (*rgb, FILL_ALPHA), rgb, 2.0)], bbox)
        icons = {k: _path(p, _WHITE if filled else None, _BLACK, 1.5) for k, (p, filled) in ICONS.items()}
        frame, icon = _lookup(side, frames), _lookup(dimension(code), icons)
        line = F.when(side == "Hostile", F.array(_path(HOSTILE_LINE, None, AFFILIATION_COLORS["Hostile"], 1.5))).otherwise(F.array().cast(f"array<{PRIMITIVE}>"))
        return F.struct(F.concat(frame["primitives"], F.array(icon), line).alias("primitives"), frame["bbox"].alias("bbox"), frame["anchor"].alias("anchor"))


class Navigation(Provider):
    name = "ICAO"

    def condition(self, code: Column) -> Column:
        return code.startswith("icao:") & navaid(code).isNotNull()

    def symbol(self, code: Column) -> Column:
        return _lookup(navaid(code), _navaids())


class Declared(Provider):
    """Symbols of a library; the column of its symbols is joined in by resolve()."""

    def __init__(self, library: DataFrame, name: str = "Declarative") -> None:
        """library: symbol_id and symbol (SYMBOL)."""
        self.library, self.name, self.column = library, name, f"__library_{name}"

    def condition(self, code: Column) -> Column:
        return F.col(self.column).isNotNull()

    def symbol(self, code: Column) -> Column:
        return F.col(self.column)


#: Symbols of a library, copies included, up to which it is broadcast; beyond it codes and symbols are shuffled, as file sizes tell little of what is made of them.
BROADCAST_SYMBOLS = 10_000


def resolve(codes: DataFrame, providers: Sequence[Provider], code: str = "code") -> DataFrame:
    """Codes with provider (the first in order that knows the code), symbol and status (ok or ProviderNotFound).

    A library of more than BROADCAST_SYMBOLS symbols is joined by sorted parts, which spill.
    """
    out = codes
    for p in providers:
        if isinstance(p, Declared):
            own = p.library.groupBy("symbol_id").agg(F.first("symbol").alias(p.column)).withColumnRenamed("symbol_id", "__id")
            small = len(p.library.select(F.lit(1)).take(BROADCAST_SYMBOLS + 1)) <= BROADCAST_SYMBOLS
            own = F.broadcast(own) if small else own.hint("merge")
            out = out.join(own, F.col(code) == F.col("__id"), "left").drop("__id")
    c = F.col(code)
    pick = lambda value: F.coalesce(*(F.when(p.condition(c), value(p)) for p in providers))
    out = out.withColumns({"provider": pick(lambda p: F.lit(p.name)), "symbol": pick(lambda p: p.symbol(c).cast(SYMBOL))})
    out = out.withColumn("status", F.when(F.col("provider").isNotNull(), "ok").otherwise("ProviderNotFound"))
    return out.drop(*(p.column for p in providers if isinstance(p, Declared)))


def restyle(symbol, rules) -> Column:
    """A symbol after its rules (an array of style rules, in order; the last wins).

    A rule's stroke and fill replace those of paths and circles that have them
    already; texts stay as they are, and so does a colour that cannot be read.
    """
    symbol, rules = _c(symbol), _c(rules)

    def apply(p: Column, rule: Column) -> Column:
        drawn = p["type"].isin("Path", "Circle")
        line, area = rule["stroke"], rule["fill"]
        ink, paint = hex_color(line["color"]), hex_color(area["color"])
        stroke = F.when(
            drawn & p["stroke"].isNotNull() & line.isNotNull() & ink.isNotNull(),
            F.struct(ink.alias("color"), line["width"].alias("width"), line["dash_array"].alias("dash_array")),
        ).otherwise(p["stroke"])
        seen = color(paint["r"], paint["g"], paint["b"], F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), area["opacity"].cast("double"))) * 255.0))
        fill = F.when(drawn & p["fill"].isNotNull() & area.isNotNull() & paint.isNotNull(), seen).otherwise(p["fill"])
        return p.withField("fill", fill).withField("stroke", stroke)

    whole = F.aggregate(F.coalesce(rules, F.array()), symbol["primitives"], lambda ps, rule: F.transform(ps, lambda p: apply(p, rule)))
    return F.when(F.size(F.coalesce(rules, F.array())) > 0, symbol.withField("primitives", whole)).otherwise(symbol)


#: Symbols of callsign prefixes, and of all other callsigns.
CALLSIGNS = (("TAM", "civil:plane"), ("GLO", "civil:plane"), ("AZU", "mil:fighter"), ("COP", "custom:helicopter"), ("HEL", "custom:helicopter"))
OTHER_CALLSIGN = "civil:plane"


def callsign_symbol(callsign) -> Column:
    c = _c(callsign)
    out = F.when(F.lit(False), "")
    for prefix, name in CALLSIGNS:
        out = out.when(c.startswith(prefix), name)
    return out.otherwise(OTHER_CALLSIGN)
