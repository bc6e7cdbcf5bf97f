"""Style and symbol files: style documents (XML), symbol libraries (JSON) and drawings (SVG)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.colors import COLOR, NAMED
from aerolith.functions.geodesy import _c
from aerolith.functions.symbols import PRIMITIVE, SYMBOL

RULE = (
    "struct<name:string,min_scale:double,max_scale:double,stroke:struct<color:string,width:float,dash_array:array<float>>,"
    "fill:struct<color:string,opacity:float>,text:struct<label_expression:string,font_family:string,font_size:float,fill_color:string>,"
    "point:struct<well_known_name:string,size:float,fill_color:string,stroke_color:string,stroke_width:float>>"
)
RULES = "layer string, rule_idx int, rule " + RULE

#: What a symbolizer is before its parameters are read.
DEFAULTS = {
    "LineSymbolizer": ("stroke", {"color": "#000000", "width": 1.0, "dash_array": None}),
    "PolygonSymbolizer": ("fill", {"color": "#000000", "opacity": 1.0}),
    "TextSymbolizer": ("text", {"label_expression": "", "font_family": "sans-serif", "font_size": 10.0, "fill_color": "#000000"}),
    "PointSymbolizer": ("point", {"well_known_name": "circle", "size": 6.0, "fill_color": None, "stroke_color": None, "stroke_width": None}),
}
#: Path of an element (its end; the last part may be a parameter's name) and the field that its text sets.
_PARAMETERS = {
    ("LineSymbolizer", "Stroke", "stroke"): ("stroke", "color", str), ("LineSymbolizer", "Stroke", "stroke-width"): ("stroke", "width", float),
    ("LineSymbolizer", "Stroke", "stroke-dasharray"): ("stroke", "dash_array", "dash"), ("PolygonSymbolizer", "Fill", "fill"): ("fill", "color", str),
    ("PolygonSymbolizer", "Fill", "fill-opacity"): ("fill", "opacity", float), ("TextSymbolizer", "Font", "font-family"): ("text", "font_family", str),
    ("TextSymbolizer", "Font", "font-size"): ("text", "font_size", float), ("TextSymbolizer", "Fill", "fill"): ("text", "fill_color", str),
    ("Graphic", "Mark", "Fill", "fill"): ("point", "fill_color", str), ("Graphic", "Mark", "Stroke", "stroke"): ("point", "stroke_color", str),
    ("Graphic", "Mark", "Stroke", "stroke-width"): ("point", "stroke_width", float),
}
_ELEMENTS = {
    ("TextSymbolizer", "Label", "PropertyName"): ("text", "label_expression", str),
    ("PointSymbolizer", "Graphic", "Mark", "WellKnownName"): ("point", "well_known_name", str), ("PointSymbolizer", "Graphic", "Size"): ("point", "size", float),
}
_PARAMETER_TAGS = ("CssParameter", "SvgParameter")


class StyleError(ValueError):
    """XmlError or InvalidValue."""


def _value(text: str, kind):
    try:
        if kind == "dash":
            values = [float(v) for v in re.split("[ ,]", text) if v]
            if not values:
                raise ValueError
            return values
        return kind(text)
    except ValueError:
        raise StyleError("InvalidValue") from None


def _root(xml: str) -> ET.Element | None:
    """The document's root; None if it has none. Documents that declare entities are refused."""
    body = re.sub(r"^\s*<\?xml[^>]*\?>", "", xml).strip()
    if not body:
        return None
    if "<!DOCTYPE" in body or "<!ENTITY" in body:
        raise StyleError("XmlError")
    try:
        return ET.fromstring(re.sub(r"<(/?)[\w.-]+:", r"<\1", re.sub(r"\s(?:xmlns(?::[\w.-]+)?|[\w.-]+:[\w.-]+)=(\"[^\"]*\"|'[^']*')", "", body)))
    except ET.ParseError:
        raise StyleError("XmlError") from None


def parse_styles(xml: str) -> list[tuple[str, int, dict]]:
    """(layer, index, rule) of a style document. A layer that comes again replaces the first; rules of a layer without name are lost."""
    layers: dict[str, list[dict]] = {}
    name: list[str | None] = [None]
    rules: list[dict] = []
    rule: list[dict | None] = [None]

    def visit(e: ET.Element, path: tuple[str, ...]) -> None:
        path = (*path, e.tag)
        if e.tag == "NamedLayer":
            name[0] = None
            rules.clear()
        elif e.tag == "Rule":
            rule[0] = {"name": "", "min_scale": None, "max_scale": None, "stroke": None, "fill": None, "text": None, "point": None}
        elif e.tag in DEFAULTS and rule[0] is not None:
            field, start = DEFAULTS[e.tag]
            rule[0][field] = dict(start)
        read(e, path)
        for child in e:
            visit(child, path)
        if e.tag == "Rule" and rule[0] is not None:
            rules.append(rule[0])
            rule[0] = None
        elif e.tag == "NamedLayer" and name[0] is not None:
            layers[name[0]] = list(rules)

    def read(e: ET.Element, path: tuple[str, ...]) -> None:
        for text in [e.text, *(c.tail for c in e)]:
            text = (text or "").strip()
            if not text:
                continue
            if path[-2:] == ("NamedLayer", "Name"):
                name[0] = text
            elif rule[0] is None:
                continue
            elif path[-2:] == ("Rule", "Name"):
                rule[0]["name"] = text
            elif path[-2:-1] == ("Rule",) and path[-1] in ("MinScaleDenominator", "MaxScaleDenominator"):
                rule[0][path[-1][:3].lower() + "_scale"] = _value(text, float)
            else:
                own = path[:-1] + (e.get("name", ""),) if path[-1] in _PARAMETER_TAGS else None
                table, at = (_PARAMETERS, own) if own else (_ELEMENTS, path)
                for end, (part, field, kind) in table.items():
                    if at[-len(end) :] == end and rule[0][part] is not None:
                        rule[0][part][field] = _value(text, kind)

    root = _root(xml)
    if root is not None:
        visit(root, ())
    return [(layer, i, r) for layer, own in layers.items() for i, r in enumerate(own)]


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, xml in zip(b["doc_id"], b["xml"], strict=True):
            try:
                rows += [(doc, layer, i, r, None) for layer, i, r in parse_styles(xml or "")]
            except StyleError as e:
                rows.append((doc, None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["doc_id", "layer", "rule_idx", "rule", "error"]).astype({"rule_idx": "Int32"})


def style_rules(documents: DataFrame) -> DataFrame:
    """Rules (doc_id, layer, rule_idx, rule, error) of a table of style documents (doc_id, xml)."""
    return documents.select("doc_id", "xml").mapInPandas(_rules, f"doc_id string, {RULES}, error string")


def at_scale(rules: DataFrame, scale) -> DataFrame:
    """Rules that apply at a scale denominator: bounds are part of their range, a missing bound is open."""
    s = _c(scale)
    low, high = F.col("rule.min_scale"), F.col("rule.max_scale")
    return rules.where((low.isNull() | (s >= low)) & (high.isNull() | (s <= high)))


def rules_by_layer(rules: DataFrame) -> DataFrame:
    """layer and its rules in order, as restyle() takes them."""
    own = rules.where(F.col("error").isNull()) if "error" in rules.columns else rules
    return own.groupBy("layer").agg(F.transform(F.sort_array(F.collect_list(F.struct("rule_idx", "rule"))), lambda x: x["rule"]).alias("rules"))


# -- symbol libraries


def library(texts: DataFrame) -> DataFrame:
    """symbol_id and symbol of JSON libraries (json: library_name, symbols by id); a text that is no library fails the query."""
    colour = "struct<r:smallint,g:smallint,b:smallint,a:smallint>"
    shape = (
        f"struct<type:string,commands:string,cx:double,cy:double,r:double,content:string,offset_x:double,offset_y:double,font_size:double,"
        f"fill:{colour},color:{colour},stroke:struct<color:{colour},width:float,dash_array:array<float>>>"
    )
    schema = f"library_name string, symbols map<string,struct<bbox:array<double>,anchor:array<double>,primitives:array<{shape}>>>"
    rows = texts.select(F.explode(F.from_json("json", schema, {"mode": "FAILFAST"})["symbols"]).alias("symbol_id", "s"))
    whole = F.transform("s.primitives", lambda p: p.withField("fill", F.coalesce(p["fill"], p["color"])).dropFields("color").cast(PRIMITIVE))
    made = F.struct(whole.alias("primitives"), F.col("s.bbox").alias("bbox"), F.coalesce(F.col("s.anchor"), F.array(F.lit(0.0), F.lit(0.0))).alias("anchor"))
    return rows.select("symbol_id", made.cast(SYMBOL).alias("symbol"))


# -- drawings

_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_RGB = re.compile(r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*([\d.]+)\s*)?\)")
_STYLE = ("fill", "stroke", "stroke-width", "stroke-dasharray")


def _float(text: str | None, fallback: float) -> float:
    m = _NUMBER.match(text or "")
    return float(m[0]) if m else fallback


def _css(text: str | None, opacity: float) -> dict | None:
    t = (text or "").strip().lower()
    rgba = None
    if t.startswith("#") and re.fullmatch("#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", t):
        body = "".join(c * 2 for c in t[1:]) if len(t) <= 5 else t[1:]
        rgba = [*bytes.fromhex(body), 255][:4]
    elif m := _RGB.fullmatch(t):
        rgba = [*(int(m[k]) for k in (1, 2, 3)), 255 if m[4] is None else floor(float(m[4]) * 255 + 0.5)]
    elif t in NAMED:
        rgba = [*NAMED[t], 255]
    return dict(zip("rgba", [*rgba[:3], floor(rgba[3] * opacity + 0.5)], strict=True)) if rgba else None


def compile_svg(svg: str) -> list[dict]:
    """Primitives of a drawing with the styles that they inherit; of each element first its paths, circles and texts by tag, then its groups."""
    root = _root(svg)
    out: list[dict] = []

    def styled(e: ET.Element, inherited: dict) -> dict:
        return {k: e.get(k, inherited.get(k)) for k in _STYLE} | {"opacity": inherited["opacity"] * _float(e.get("opacity"), 1.0)}

    def draw(e: ET.Element, style: dict, kind: str, **own) -> None:
        fill = _css(style["fill"], style["opacity"] * _float(e.get("fill-opacity"), 1.0))
        ink = _css(style["stroke"], style["opacity"] * _float(e.get("stroke-opacity"), 1.0))
        dash = [float(v) for v in re.split("[ ,]+", style["stroke-dasharray"] or "") if _NUMBER.fullmatch(v)] or None
        stroke = {"color": ink, "width": _float(style["stroke-width"], 1.0), "dash_array": dash} if ink else None
        if kind == "Text":
            fill, stroke = fill or {"r": 0, "g": 0, "b": 0, "a": 255}, None
        names = ("commands", "cx", "cy", "r", "content", "offset_x", "offset_y", "font_size")
        out.append({"type": kind, **{n: own.get(n) for n in names}, "fill": fill, "stroke": stroke})

    def walk(e: ET.Element, inherited: dict) -> None:
        own = styled(e, inherited)
        tags = list(dict.fromkeys(c.tag for c in e))
        for tag in tags:
            for c in (c for c in e if c.tag == tag):
                style = styled(c, own)
                if tag == "path":
                    if c.get("d"):
                        draw(c, style, "Path", commands=c.get("d"))
                elif tag == "circle":
                    if (r := _float(c.get("r"), 0.0)) > 0:
                        draw(c, style, "Circle", cx=_float(c.get("cx"), 0.0), cy=_float(c.get("cy"), 0.0), r=r)
                elif tag == "text":
                    text = (c.text or "").strip()
                    if text and c.attrib:
                        draw(c, style, "Text", content=text, offset_x=_float(c.get("x"), 0.0), offset_y=_float(c.get("y"), 0.0), font_size=_float(c.get("font-size"), 12.0))
                else:
                    walk(c, own)

    if root is not None:
        walk(root, {"opacity": 1.0})
    return out


def _compile(svg: pd.Series) -> pd.Series:
    return svg.map(lambda s: compile_svg(s) if s is not None else None)


def svg_primitives(svg) -> Column:
    """Primitives of drawings."""
    return F.pandas_udf(_compile, f"array<{PRIMITIVE}>")(_c(svg))


def compile_library(config: DataFrame, drawings: DataFrame) -> DataFrame:
    """A library from its table of contents (symbol_id, file, bbox, anchor) and drawings (file, svg): symbol_id and symbol."""
    joined = config.join(drawings.select("file", svg_primitives("svg").alias("p")), "file")
    anchor = F.coalesce("anchor", F.array(F.lit(0.0), F.lit(0.0)))
    return joined.select("symbol_id", F.struct(F.col("p").alias("primitives"), "bbox", anchor.alias("anchor")).cast(SYMBOL).alias("symbol"))


def write_library(symbols: DataFrame, path: str) -> None:
    """A library as JSON lines, a symbol each."""
    symbols.write.mode("overwrite").json(path)


def path_points(commands) -> Column:
    """Numbers of the M and L commands of a path, in order, as array<struct<x, y>>; other commands are passed over."""
    part = F.regexp_extract_all(_c(commands), F.lit(r"[ML]\s*(-?[0-9.]+\s*[, ]\s*-?[0-9.]+)"), F.lit(1))
    return F.transform(part, lambda p: F.struct(F.split(p, "[, ]+")[0].cast("double").alias("x"), F.split(p, "[, ]+")[1].cast("double").alias("y")))


__all__ = ["COLOR", "RULE", "StyleError", "at_scale", "compile_library", "compile_svg", "library", "parse_styles", "path_points", "rules_by_layer", "style_rules", "svg_primitives", "write_library"]
