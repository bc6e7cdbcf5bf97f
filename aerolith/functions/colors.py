"""Colours and dash patterns from text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.functions.geodesy import _c

COLOR = "struct<r:smallint,g:smallint,b:smallint,a:smallint>"

#: Named colours of style sheets that are understood.
NAMED = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0),
    "cyan": (0, 255, 255), "magenta": (255, 0, 255), "gray": (128, 128, 128), "grey": (128, 128, 128), "orange": (255, 165, 0), "purple": (128, 0, 128),
    "brown": (165, 42, 42), "pink": (255, 192, 203), "lime": (0, 255, 0),
}


def color(r, g, b, a=255) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("smallint").alias(k) for k, v in zip("rgba", (r, g, b, a), strict=True)))


def hex_color(text, opacity: float | None = None) -> Column:
    """#RGB, #RGBA, #RRGGBB or #RRGGBBAA, the mark optional; null for any other text."""
    body = F.regexp_extract(_c(text), r"^#?([0-9A-Fa-f]{3}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$", 1)
    short = F.length(body) <= 4
    part = lambda k: F.when(short, F.repeat(F.substring(body, k + 1, 1), 2)).otherwise(F.substring(body, 2 * k + 1, 2))
    value = lambda k: F.conv(part(k), 16, 10).cast("int")
    alpha = F.when(F.length(body).isin(4, 8), value(3)).otherwise(255)
    if opacity is not None:
        alpha = F.floor(alpha * opacity + 0.5)
    return F.when(F.length(body) > 0, color(value(0), value(1), value(2), alpha))


def css_color(text, opacity: float = 1.0) -> Column:
    """Hex, rgb(), rgba() or a name; none and transparent are null, and so is what is not understood."""
    t = F.lower(F.trim(_c(text)))
    pattern = r"^rgba?\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*(?:,\s*([0-9.]+)\s*)?\)$"
    group = lambda k: F.regexp_extract(t, pattern, k)
    number = lambda k: F.least(F.lit(255), F.try_to_number(group(k), F.lit("999999")).cast("int"))
    alpha = F.when(group(4) == "", 1.0).otherwise(F.expr("1.0") * group(4).try_cast("double"))
    byte = lambda x: F.floor(F.least(F.lit(1.0), x) * 255.0 * opacity + 0.5)
    names = F.create_map(*(x for k, v in NAMED.items() for x in (F.lit(k), color(*v))))
    named = F.try_element_at(names, t)
    return (
        F.when(t.isin("none", "transparent") | (t == ""), F.lit(None).cast(COLOR))
        .when(t.startswith("#"), hex_color(t, opacity))
        .when(t.rlike(pattern), color(number(1), number(2), number(3), byte(alpha)))
        .when(named.isNotNull(), color(named["r"], named["g"], named["b"], F.floor(F.lit(255.0 * opacity + 0.5))))
    )


def dash_array(text) -> Column:
    """Numbers between spaces and commas; null if one of them is no number or there is none."""
    parts = F.filter(F.split(_c(text), "[ ,]"), lambda x: x != "")
    values = F.transform(parts, lambda x: x.try_cast("float"))
    return F.when((F.size(values) > 0) & ~F.exists(values, lambda x: x.isNull()), values)


def number_prefix(text, fallback: float = 0.0) -> Column:
    """The number that a text begins with."""
    found = F.regexp_extract(_c(text), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.coalesce(F.when(found != "", found.try_cast("double")), F.lit(fallback))
