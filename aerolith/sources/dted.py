"""Elevation tiles: DTED files as rows (lat_deg, lon_deg, num_rows, num_cols, elevations), and their registry."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, pi, sin, cos

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.sources.urls import UrlResolver, resolved

TILE = "path string, lat_deg int, lon_deg int, num_rows int, num_cols int, lat_spacing int, lon_spacing int, elevations array<smallint>, error string"

#: Places of fields in the header, its length, and the layout of a column of elevations.
HEADER, MAGIC, SENTINEL, COLUMN_HEAD, COLUMN_EXTRA = 3428, b"UHL1", 0xAA, 7, 11
LON, LAT, LAT_SPACING, LON_SPACING, COLS, ROWS = (4, 12), (12, 20), (20, 24), (24, 28), (47, 51), (51, 55)


class DtedError(ValueError):
    pass


def _number(field: bytes) -> int:
    digits = field.lstrip(b" ").split(b" ")[0]
    if not digits.isdigit():
        raise DtedError("InvalidHeader")
    return int(digits)


def _angle(field: bytes, degree_digits: int) -> float:
    """Degrees of a packed or decimal angle; W and S are negative, any other letter is not."""
    text = field.strip(b" \0").decode("ascii", "replace")
    sign = -1.0 if text[-1:] in "WwSs" and text else 1.0
    body = text.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    try:
        if "." in body:
            return sign * float(body)
        if len(body) >= degree_digits + 4:
            d, m, s = body[:degree_digits], body[degree_digits : degree_digits + 2], body[degree_digits + 2 : degree_digits + 4]
            return sign * (int(d) + int(m) / 60 + int(s) / 3600)
        if len(body) >= 3:
            return sign * float(int(body))
    except ValueError:
        pass
    raise DtedError("InvalidHeader")


def decode(content: bytes, cells: bool = True) -> dict:
    """Header and elevations (column after column) of one file; without cells the header alone is looked at."""
    if len(content) < HEADER or content[:4] != MAGIC:
        raise DtedError("InvalidHeader")
    part = lambda at: content[at[0] : at[1]]
    lon, lat = _angle(part(LON), 3), _angle(part(LAT), 2)
    cols, rows = _number(part(COLS)), _number(part(ROWS))
    size = COLUMN_EXTRA + 2 * rows
    header = {"lat_deg": floor(lat), "lon_deg": floor(lon), "num_rows": rows, "num_cols": cols, "lat_spacing": _number(part(LAT_SPACING)), "lon_spacing": _number(part(LON_SPACING)), "error": None}
    if not cells:
        return header | {"elevations": None}
    if len(content) < HEADER + cols * size:
        raise DtedError("MalformedData")
    block = np.frombuffer(content, np.uint8, cols * size, HEADER).reshape(cols, size)
    if cols and (block[:, 0] != SENTINEL).any():
        raise DtedError("MalformedData")
    values = np.ascontiguousarray(block[:, COLUMN_HEAD : COLUMN_HEAD + 2 * rows]).view(">i2").astype(np.int16)
    return header | {"elevations": values.ravel()}


def _decode_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in TILE.split(", ")]
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"], strict=True):
            try:
                rows.append({"path": path} | decode(bytes(content)))
            except DtedError as e:
                rows.append(dict.fromkeys(names) | {"path": path, "error": str(e)})
        yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in names[1:7]})


def decode_tiles(files: DataFrame) -> DataFrame:
    """Tiles of files (path, content); a file that is no tile has a row with its error."""
    return files.select("path", "content").mapInPandas(_decode_all, TILE)


def read_dted(spark: SparkSession, path: str, pattern: str = "*.dt?") -> DataFrame:
    """Tiles of all matching files below a path."""
    return decode_tiles(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def register(tiles: DataFrame, order: str) -> DataFrame:
    """One tile for each key, the one loaded last; files with errors are no tiles."""
    fields = [c for c in tiles.columns if c not in ("lat_deg", "lon_deg")]
    last = tiles.where(F.col("error").isNull()).groupBy("lat_deg", "lon_deg").agg(F.max_by(F.struct(*fields), F.col(order)).alias("t"))
    return last.select("lat_deg", "lon_deg", "t.*")


def unload(tiles: DataFrame, keys: DataFrame) -> DataFrame:
    return tiles.join(keys.select("lat_deg", "lon_deg").distinct(), ["lat_deg", "lon_deg"], "left_anti")


def tile_url(urls: str | UrlResolver, lat_deg: str, lon_deg: str) -> Column:
    """A URL from a template with {lat}, {lon}, {latStr} and {lonStr}, or from a resolver that takes them."""
    lat, lon = F.col(lat_deg), F.col(lon_deg)
    lat_text = F.concat(F.lpad(F.abs(lat).cast("string"), 2, "0"), F.lit("0000"), F.when(lat >= 0, "N").otherwise("S"))
    lon_text = F.concat(F.lpad(F.abs(lon).cast("string"), 3, "0"), F.lit("0000"), F.when(lon >= 0, "E").otherwise("W"))
    return resolved(urls, every=True, latStr=lat_text, lonStr=lon_text, lat=lat, lon=lon)


# -- synthetic tiles


def encode(lat: str, lon: str, values: np.ndarray) -> bytes:
    """A file with a tile of values [col, row] whose origin is written lat, lon."""
    cols, rows = values.shape
    head = bytearray(b" " * HEADER)
    for at, text in ((0, "UHL1"), (LON[0], lon.ljust(8)), (LAT[0], lat.ljust(8)), (LAT_SPACING[0], "0300"), (LON_SPACING[0], "0300"), (COLS[0], f"{cols:04}"), (ROWS[0], f"{rows:04}")):
        head[at : at + len(text)] = text.encode()
    body = b"".join(bytes([SENTINEL, 0, 0, c & 255, 0, 0, 0]) + values[c].astype(">i2").tobytes() + bytes(4) for c in range(cols))
    return bytes(head) + body


def encode_tile(lat_deg: int, lon_deg: int, cols: int, rows: int, elevations) -> bytes:
    """A file with a tile whose elevations come column after column."""
    lat, lon = f"{abs(lat_deg):02}0000{'S' if lat_deg < 0 else 'N'}", f"{abs(lon_deg):03}0000{'W' if lon_deg < 0 else 'E'}"
    return encode(lat, lon, np.asarray(elevations, np.int16).reshape(cols, rows))


def _encode_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        files = [encode_tile(*r) for r in b[["lat_deg", "lon_deg", "num_cols", "num_rows", "elevations"]].itertuples(index=False)]
        yield pd.DataFrame({"path": b["path"], "content": files})


def encode_tiles(tiles: DataFrame) -> DataFrame:
    """Files (path, content) of tiles (path, lat_deg, lon_deg, num_rows, num_cols, elevations)."""
    own = tiles.select("path", "lat_deg", "lon_deg", "num_cols", "num_rows", "elevations")
    return own.mapInPandas(_encode_all, "path string, content binary")


def ramp(cols: int = 121, rows: int = 121) -> np.ndarray:
    """Elevation c * 10 + r."""
    return np.add.outer(np.arange(cols) * 10, np.arange(rows)).astype(np.int16)


def waves(cols: int = 100, rows: int = 100) -> np.ndarray:
    """500 m with waves of 400 m, rounded half up."""
    z = [[floor(500 + 400 * sin(4 * pi * r / rows) * cos(4 * pi * c / cols) + 0.5) for r in range(rows)] for c in range(cols)]
    return np.array(z, np.int16)


def analytic_tiles(keys: DataFrame, cols: int = 121, rows: int = 121) -> DataFrame:
    """Ramp tiles for a table of lat_deg and lon_deg, made by Spark."""
    cell = F.sequence(F.lit(0), F.lit(cols * rows - 1))
    values = F.transform(cell, lambda k: (F.floor(k / rows) * 10 + k % rows).cast("smallint"))
    return keys.select(
        F.col("lat_deg").cast("int"), F.col("lon_deg").cast("int"), F.lit(rows).alias("num_rows"), F.lit(cols).alias("num_cols"), values.alias("elevations")
    )
