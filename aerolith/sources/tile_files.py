"""Folders of tiles as Spark data sources: spark.read.format("dted") and format("raster_tiles"), and the same for writing.

    register(spark)
    spark.read.format("dted").load(path).where("lat_deg between 40 and 50")
    tiles.write.format("dted").mode("append").save(path)

A tile's key stands in its path: e008/n47.dt0 or 470000N0080000E.dt0 for elevations,
z/x/y.png for rasters. Filters on keys are pushed into the scan, which then neither
lists folders nor opens files of other keys. Folders are listed by the tasks that read
them; the driver knows the folders at the top alone. A file whose name tells no key
is opened, and its rows are filtered by Spark; names are trusted for what they leave
out. Paths are those that pyarrow.fs opens: local ones, hdfs, s3 and gcs.
For other stores there are the readers on Spark's binaryFile (dted.read_dted, rasters.read_rasters).

A written tile goes to a file of its own beside its place and is then moved there, so a
task that runs again leaves the same tile; of tiles with one key the last moved stays.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import Row, StructType

from aerolith.sources import dted
from aerolith.sources.rasters import HEAD_BYTES, image_size

#: Bytes of files that are read by one task, folders that are listed by one task, and rows of a batch.
PARTITION_BYTES, FOLDERS_A_TASK, BATCH_BYTES = 32 << 20, 16, 4 << 20


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


@dataclass
class Keys:
    """What pushed filters leave of key columns: bounds and sets, each by column."""

    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)
    sets: dict[str, frozenset] = field(default_factory=dict)

    def add(self, f: ds.Filter, columns: tuple[str, ...]) -> None:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        value = getattr(f, "value", None)
        if name not in columns or value is None:
            return
        if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
            self._within(name, [value])
        elif isinstance(f, ds.In):
            self._within(name, value)
        elif isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
            self.least[name] = max(self.least.get(name, value), value + isinstance(f, ds.GreaterThan))
        elif isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
            self.most[name] = min(self.most.get(name, value), value - isinstance(f, ds.LessThan))

    def _within(self, name: str, values: Iterable) -> None:
        own = frozenset(values)
        self.sets[name] = self.sets[name] & own if name in self.sets else own

    def admit(self, key: dict[str, int]) -> bool:
        """Whether a key, or what is known of it, may be wanted."""
        return all(
            self.least.get(c, v) <= v <= self.most.get(c, v) and v in self.sets.get(c, (v,)) for c, v in key.items()
        )


@dataclass
class Share(ds.InputPartition):
    """What one task reads: files with their keys, and folders to list."""

    files: list[tuple[str, dict[str, int]]]
    folders: list[tuple[str, dict[str, int]]]

    def __post_init__(self) -> None:
        self.value = None


class TileReader(ds.DataSourceReader):
    """Lists and reads a folder of tiles; a kind of tile has its own columns, names and decoder."""

    columns: tuple[str, ...] = ()

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.keys = options["path"], Keys()
        self.whole = str(options.get("content", "true")).lower() != "false"
        self.schema = schema

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            self.keys.add(f, self.columns)
            yield f  # names may be wrong, so Spark looks at the rows as well

    def folder_key(self, name: str, above: dict[str, int]) -> dict[str, int]:
        """What the name of a folder tells of keys, beside what those above it tell."""
        raise NotImplementedError

    def file_key(self, name: str, above: dict[str, int]) -> dict[str, int] | None:
        """What a file's name tells, or None if it is no tile."""
        raise NotImplementedError

    def row(self, path: str, key: dict[str, int], content: bytes) -> tuple:
        raise NotImplementedError

    def head(self) -> int:
        """Bytes that are enough where the content is not asked for."""
        raise NotImplementedError

    def _listed(self, system: pafs.FileSystem, path: str, above: dict[str, int]) -> tuple[list, list]:
        """Wanted files (path, key, size) and folders (path, what is known of keys) in a folder."""
        files, folders = [], []
        for i in sorted(system.get_file_info(pafs.FileSelector(path)), key=lambda i: i.path):
            name = i.path.rpartition("/")[2]
            if name[:1] in "._":
                continue
            if i.type == pafs.FileType.Directory:
                key = self.folder_key(name, above)
                if self.keys.admit(key):
                    folders.append((i.path, key))
            elif (key := self.file_key(name, above)) is not None and self.keys.admit(key):
                files.append((i.path, key, i.size))
        return files, folders

    def partitions(self) -> list[ds.InputPartition]:
        system, root = open_path(self.path)
        files, folders = self._listed(system, root, {})
        while 0 < len(folders) < FOLDERS_A_TASK and not files:  # few folders at the top, as of zooms: their folders are dealt out
            deeper = [self._listed(system, p, key) for p, key in folders]
            if not any(d for _, d in deeper):
                break
            files, folders = [f for own, _ in deeper for f in own], [d for _, own in deeper for d in own]
        shares, own, size = [], [], 0
        for path, key, n in files:
            if own and size + n > PARTITION_BYTES:
                shares.append(Share(own, []))
                own, size = [], 0
            own.append((path, key))
            size += n
        if own:
            shares.append(Share(own, []))
        step = max(1, min(FOLDERS_A_TASK, len(folders) // 64))
        return shares + [Share([], folders[k : k + step]) for k in range(0, len(folders), step)] or [Share([], [])]

    def _files(self, system: pafs.FileSystem, share: Share) -> Iterator[tuple[str, dict[str, int]]]:
        yield from share.files
        folders = list(share.folders)
        while folders:
            files, below = self._listed(system, *folders.pop())
            yield from ((path, key) for path, key, _ in files)
            folders += below

    def content(self, system: pafs.FileSystem, path: str) -> bytes:
        with system.open_input_file(path) as f:
            return f.read() if self.whole else f.read(self.head())

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = open_path(self.path)
        schema, rows, size = to_arrow_schema(self.schema), [], 0
        for path, key in self._files(system, partition):
            content = self.content(system, path)
            rows.append(self.row(path, key, content))
            size += len(content)
            if size > BATCH_BYTES:
                yield _batch(rows, schema)
                rows, size = [], 0
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


@dataclass
class Written(ds.WriterCommitMessage):
    paths: list[str]


class TileWriter(ds.DataSourceWriter):
    """Writes each row to the file of its key; ``place`` and ``body`` are of a kind of tile."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        if overwrite:
            raise ValueError("tiles are appended; those of the same place are replaced")
        self.path, self.options = options["path"], options

    def place(self, row: Row) -> str:
        raise NotImplementedError

    def body(self, row: Row) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = open_path(self.path)
        paths, made = [], set()
        for row in iterator:
            path = f"{root.rstrip('/')}/{self.place(row)}"
            folder, _, name = path.rpartition("/")
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(beside) as f:
                f.write(self.body(row))
            system.move(beside, path)
            paths.append(path)
        return Written(paths)

    def abort(self, messages: list[Written | None]) -> None:
        """Tiles of tasks that ended stay, as those of a task that runs again replace them."""


# -- elevations

_LON_FOLDER, _NAMED, _LONG_NAME, _TILE = re.compile(r"([ewEW])(\d{3})"), re.compile(r"([nsNS])(\d{2})\.dt\d"), re.compile(r"(\d{2})\d{4}([NS])(\d{3})\d{4}([EW])\.dt\d"), re.compile(r".*\.dt\d")
_signed = lambda letter, digits: -int(digits) if letter in "swSW" else int(digits)
DTED_SCHEMA = dted.TILE


class DtedReader(TileReader):
    columns = ("lat_deg", "lon_deg")

    def folder_key(self, name: str, above: dict[str, int]) -> dict[str, int]:
        m = _LON_FOLDER.fullmatch(name)
        return above | {"lon_deg": _signed(*m.groups())} if m else above

    def file_key(self, name: str, above: dict[str, int]) -> dict[str, int] | None:
        if m := _NAMED.fullmatch(name):
            return above | {"lat_deg": _signed(*m.groups())}
        if m := _LONG_NAME.fullmatch(name):
            return {"lat_deg": _signed(m[2], m[1]), "lon_deg": _signed(m[4], m[3])}
        return above if _TILE.fullmatch(name) else None

    def head(self) -> int:
        return dted.HEADER

    def row(self, path: str, key: dict[str, int], content: bytes) -> tuple:
        try:
            t = dted.decode(content, cells=self.whole)
        except dted.DtedError as e:
            return (path, *[None] * (len(self.schema) - 2), str(e))
        return (path, *(t[f.name] for f in self.schema.fields[1:]))


class DtedWriter(TileWriter):
    def place(self, row: Row) -> str:
        lat, lon = row["lat_deg"], row["lon_deg"]
        return f"{'w' if lon < 0 else 'e'}{abs(lon):03}/{'s' if lat < 0 else 'n'}{abs(lat):02}.dt{self.options.get('level', '0')}"

    def body(self, row: Row) -> bytes:
        return dted.encode_tile(row["lat_deg"], row["lon_deg"], row["num_cols"], row["num_rows"], row["elevations"])


class DtedSource(ds.DataSource):
    """Elevation tiles: path, lat_deg, lon_deg, num_rows, num_cols, spacings, elevations (column after column) and error (of a file that is no tile).

    Option content=false reads headers alone, without elevations.
    """

    @classmethod
    def name(cls) -> str:
        return "dted"

    def schema(self) -> str:
        return DTED_SCHEMA

    def reader(self, schema: StructType) -> DtedReader:
        return DtedReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DtedWriter:
        return DtedWriter(self.options, overwrite)


# -- rasters

RASTER_SCHEMA = "z int, x int, y int, width int, height int, format string, content binary"
_NUMBER, _IMAGE = re.compile(r"\d+"), re.compile(r"(\d+)\.(png|jpg|jpeg)", re.IGNORECASE)


class RasterReader(TileReader):
    columns = ("z", "x", "y")

    def folder_key(self, name: str, above: dict[str, int]) -> dict[str, int]:
        unknown = [c for c in ("z", "x") if c not in above]
        return above | {unknown[0]: int(name)} if unknown and _NUMBER.fullmatch(name) else above

    def file_key(self, name: str, above: dict[str, int]) -> dict[str, int] | None:
        m = _IMAGE.fullmatch(name)
        return above | {"y": int(m[1])} if m and len(above) == 2 else None

    def head(self) -> int:
        return HEAD_BYTES

    def row(self, path: str, key: dict[str, int], content: bytes) -> tuple:
        kind, width, height = image_size(content) or (None, None, None)
        return key["z"], key["x"], key["y"], width, height, kind, content if self.whole else None


class RasterWriter(TileWriter):
    def place(self, row: Row) -> str:
        kind = (image_size(row["content"]) or ("png",))[0]
        return f"{row['z']}/{row['x']}/{row['y']}.{'jpg' if kind == 'jpeg' else kind}"

    def body(self, row: Row) -> bytes:
        return bytes(row["content"])


class RasterSource(ds.DataSource):
    """Raster tiles: z, x, y, width, height, format (png, jpeg or null) and content; pixels are not decoded. Option content=false leaves the content out."""

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> str:
        return RASTER_SCHEMA

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (DtedSource, RasterSource):
        spark.dataSource.register(source)
