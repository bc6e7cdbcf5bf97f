"""A feed of made-up traffic as a stream source: spark.readStream.format("target_feed").

Targets are rows of a Parquet folder (id, lat, lon, height, speed_mps, track_heading_rad,
vertical_rate_mps). Tick k of the feed is due at start + k / per_second, and has a ping of
each target, flown on since the start on a flat Earth. An offset is a number of ticks, and
a tick's pings depend on nothing else, so a stream that starts again from its checkpoint gives
each tick once; there is nothing to keep back, and nothing to release on a commit.

A task reads some row groups of the targets, for some ticks; what the driver holds is the list of
files. Paths are those that pyarrow.fs opens. Options: path, start (seconds since 1970,
needed, as it has to be the same after a restart), per_second (1), ticks (no end), row_groups
(row groups a task, 4), ticks_a_task (64).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from aerolith.functions.ellipsoid import WGS84
from aerolith.sources.tile_files import open_path

PING_SCHEMA = "id string, seq long, lat double, lon double, height double, speed_mps double, track_heading_rad double, vertical_rate_mps double, last_ping_time double"
TARGET = ("id", "lat", "lon", "height", "speed_mps", "track_heading_rad", "vertical_rate_mps")


@dataclass
class Flight(ds.InputPartition):
    """Row groups of a file of targets, and ticks from first up to last."""

    path: str
    groups: list[int]
    first: int
    last: int

    def __post_init__(self) -> None:
        self.value = None


class FeedReader(ds.DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        if "start" not in options:
            raise ValueError("the feed needs its start, in seconds since 1970")
        self.path, self.start, self.rate = options["path"], float(options["start"]), float(options.get("per_second", 1))
        self.ticks = int(options["ticks"]) if "ticks" in options else None
        self.groups, self.span = int(options.get("row_groups", 4)), int(options.get("ticks_a_task", 64))

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        due = max(0, floor((time.time() - self.start) * self.rate) + 1)
        return {"tick": due if self.ticks is None else min(due, self.ticks)}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        system, root = open_path(self.path)
        out = []
        for f in pads.dataset(root, filesystem=system, format="parquet").get_fragments():
            groups = [g.id for g in f.row_groups]
            for k in range(0, len(groups), self.groups):
                out += [Flight(f.path, groups[k : k + self.groups], t, min(t + self.span, end["tick"])) for t in range(start["tick"], end["tick"], self.span)]
        return out

    def read(self, partition: Flight) -> Iterator[pa.RecordBatch]:
        system, _ = open_path(self.path)
        fragment = pads.ParquetFileFormat().make_fragment(partition.path, system, row_groups=partition.groups)
        for b in fragment.to_batches(columns=list(TARGET)):
            lat, lon, height, speed, heading, climb = (b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in TARGET[1:])
            ids = b.column("id").cast(pa.string())
            for tick in range(partition.first, partition.last):
                gone = tick / self.rate
                run = speed * gone
                values = (lat + run * np.cos(heading) / WGS84.a, lon + run * np.sin(heading) / (WGS84.a * np.cos(lat)), height + climb * gone, speed, heading, climb)
                n = b.num_rows
                columns = [ids, pa.array(np.full(n, tick)), *(pa.array(v, from_pandas=True) for v in values), pa.array(np.full(n, self.start + gone))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PING_SCHEMA.split(", ")])

    def commit(self, end: dict) -> None:
        pass


class FeedSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "target_feed"

    def schema(self) -> str:
        return PING_SCHEMA

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options)


def feed(spark: SparkSession, path: str, start: float, per_second: float = 1.0, ticks: int | None = None, **options: int) -> DataFrame:
    """A stream of pings of the targets in a Parquet folder; it ends after some ticks, if they are given."""
    spark.dataSource.register(FeedSource)
    reader = spark.readStream.format("target_feed").option("start", repr(float(start))).option("per_second", repr(float(per_second))).options(**options)
    return (reader if ticks is None else reader.option("ticks", ticks)).load(path)
