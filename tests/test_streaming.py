"""Streams: the feed over restarts, event time against sorted input, late pings, and frames against the batch operators."""

import random
import time
from math import pi, radians

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith.functions.geodesy import Haversine
from aerolith.operators import tracking
from aerolith.streaming import targets
from aerolith.streaming.feed import FeedReader, feed

SCHEMA = "id string, seq long, lat double, lon double, height double, speed_mps double, track_heading_rad double, vertical_rate_mps double, last_ping_time double, remove boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def _rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def ping(i, seq, t, height=0.0, speed=100.0, remove=False):
    return (i, seq, radians(47), radians(8), height, None if remove else speed, 1.0, 2.0, float(t), remove)


class Run:
    """A stream over batches that are files, one a micro-batch, on one checkpoint."""

    def __init__(self, spark, tmp_path, make, schema=SCHEMA):
        self.spark, self.at, self.make, self.schema, self.n = spark, tmp_path, make, schema, 0

    def __call__(self, *batches):
        for rows in batches:
            self.n += 1
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.at / "in"))
        stream = self.make(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.at / "in")))
        q = stream.writeStream.format("parquet").option("path", str(self.at / "out")).option("checkpointLocation", str(self.at / "cp")).outputMode("append").trigger(availableNow=True)
        return self._end(q.start())

    def _end(self, q):
        assert q.awaitTermination(120)
        self.dropped = sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)
        return self.spark.read.parquet(str(self.at / "out"))


class Updates(Run):
    """The same for streams of updates: each batch is appended to a table."""

    def __call__(self, *batches):
        out = str(self.at / "out")
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.at / "in"))
        stream = self.make(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.at / "in")))
        q = stream.writeStream.foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", str(self.at / "cp")).trigger(availableNow=True)
        return self._end(q.start())


def test_feed_gives_each_tick_once_over_restarts(spark, tmp_path):
    path, start = str(tmp_path / "targets"), time.time() - 1000
    made = tracking.made_targets(spark, 30, radians(47), radians(8))
    made.repartition(3).write.option("parquet.block.size", 1024).parquet(path)
    for ticks in (4, 4, 11):  # a stream that ends, one that finds nothing new, one that goes on
        q = feed(spark, path, start, 2.0, ticks, ticks_a_task=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 11 * 30 and got.select("id", "seq").distinct().count() == 11 * made.select("id").distinct().count()
    p = made.withColumn("p", tracking.flat_advance("lat", "lon", "track_heading_rad", "speed_mps", 5.0)).select("id", "p.lat", "p.lon")
    far = got.where("seq = 10").join(p.withColumnsRenamed({"lat": "y", "lon": "x"}), "id").agg(F.max(F.abs(F.col("lat") - F.col("y")) + F.abs(F.col("lon") - F.col("x")))).first()[0]
    assert far < 1e-12 and got.where(f"abs(last_ping_time - {start!r} - seq / 2.0) > 1e-6").count() == 0


def test_feed_goes_by_the_clock():
    reader = FeedReader({"path": "x", "start": str(time.time() + 60), "per_second": "1"})
    assert reader.initialOffset() == reader.latestOffset() == {"tick": 0}
    assert FeedReader({"path": "x", "start": str(time.time() - 9.5)}).latestOffset() == {"tick": 10}
    with pytest.raises(ValueError, match="start"):
        FeedReader({"path": "x"})


def test_event_time_order(spark, tmp_path):
    """Shuffled pings end in the state of sorted ones; those beyond the watermark are dropped and counted."""
    rng = random.Random(4)
    rows = [ping(f"t{k % 4}", k, 1000 + 10 * rng.randrange(60), height=float(k)) for k in range(120)]
    rng.shuffle(rows)
    run = Updates(spark, tmp_path, lambda s: targets.latest_stream(targets.with_event_time(s, "20 minutes"), by="last_ping_time"))
    got = run(rows[:50], rows[50:], [ping("t0", 500, 9000)])
    last = {r.id: r.height for r in got.where("last_ping_time < 9000").groupBy("id").agg(F.max_by("height", F.struct("last_ping_time", "seq")).alias("height")).collect()}
    want = {r.id: r.height for r in tracking.latest_state(spark.createDataFrame(rows, SCHEMA), by="last_ping_time").collect()}
    assert last == want and run.dropped == 0
    got = run([ping("t1", 900, 1500, height=77.0), ping("t2", 901, 9001, height=88.0)])
    assert run.dropped == 1 and got.where("height = 77").count() == 0 and got.where("height = 88").count() == 1


def test_time_to_live_goes_by_arrival(spark):
    with pytest.raises(ValueError, match="wall clock"):
        targets.latest_stream(spark.createDataFrame([], SCHEMA), by="last_ping_time", ttl_seconds=5.0)


def test_frames_of_event_time(spark, tmp_path):
    """Positions at all ticks are those of the batch operators as of each tick: late pings, stale targets that come back, removals."""
    rows = [ping("a", 1, 1001), ping("b", 2, 1003, speed=0.0), ping("a", 4, 1012, height=9.0), ping("c", 3, 1006), ping("c", 5, 1014, remove=True), ping("d", 6, 1010)]
    late = [ping("a", 7, 1008, height=5.0), ping("b", 8, 1049), ping("c", 9, 1041, height=1.0), ping("x", 10, 1045, speed=-1.0), ping("d", 11, 1010, height=3.0)]
    run = Run(spark, tmp_path, lambda s: targets.frames(targets.with_event_time(s, "20 seconds"), 5.0, "event", 12.0, solver=Haversine))
    run(rows)
    run(late)
    run([ping("z", 12, 1095)])
    got = run([ping("z", 13, 1095.5)])
    every = spark.createDataFrame(rows + late + [ping("z", 12, 1095)], SCHEMA)
    want = []
    for tick in range(1000, 1076, 5):
        known = every.where(f"last_ping_time <= {tick} and (remove or (speed_mps >= 0))")
        state = known.groupBy("id").agg(F.max_by(F.struct("*"), F.struct("last_ping_time", "seq")).alias("s")).select("s.*").where("not remove")
        want += [(r.id, float(tick), r.lat, r.lon, r.height, r.dt) for r in tracking.dead_reckon(state, float(tick), 12.0, Haversine).collect()]
    assert sorted((r.id, r.frame, r.lat, r.lon, r.height, r.dt) for r in got.collect()) == sorted(want)
    assert len({w[1] for w in want}) >= 8 and {w[0] for w in want} == set("abcd")


def test_frames_of_the_wall_clock(spark, tmp_path):
    """Ticks give what dead reckoning gives at their times; a stale target is left out and comes back with its next ping."""
    now = time.time()
    (tmp_path / "in").mkdir()
    first = [ping("a", 1, now), ping("old", 2, now - 100), ping("b", 3, now, remove=True)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = targets.frames(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 1.0, "wall", 30.0, solver=Haversine)
    q = s.writeStream.format("memory").queryName("wall").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    def wait(condition):
        end = time.time() + 60
        while spark.table("wall").where(condition).select("frame").distinct().count() < 3 and time.time() < end:
            time.sleep(0.3)

    wait("id = 'a'")
    spark.createDataFrame([ping("old", 4, now, height=50.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    wait("id = 'old'")
    q.stop()
    got = spark.table("wall").collect()
    state = {r[0]: r for r in [first[0], ping("old", 4, now, height=50.0)]}
    assert {r.id for r in got} == {"a", "old"} and len({r.frame for r in got}) >= 3 and all(r.frame == int(r.frame) for r in got)
    for r in got:
        w = tracking.dead_reckon(spark.createDataFrame([state[r.id]], SCHEMA), r.frame, 30.0, Haversine).first()
        assert (r.lat, r.lon, r.height) == pytest.approx((w.lat, w.lon, w.height), abs=1e-12)
    assert 0 <= pi


class Held:
    """A value or list of state, and the timers of a handle, in memory."""

    def __init__(self):
        self.rows, self.timers = [], []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows) if self.many else self.rows[0]

    def update(self, row):
        self.rows = [row]

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []

    def state(self, many):
        own = Held()
        own.many = many
        return own

    def getValueState(self, *_):
        return self.state(False)

    def getListState(self, *_):
        return self.state(True)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_waiting_pings_are_packed():
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    pings = [ping("a", 2**60 + k, 1000 - k, height=float(k)) for k in range(500)] + [ping("a", 2**61, 1000.5, remove=True)]
    pings[0] = (*pings[0][:7], None, *pings[0][8:])
    frames = targets.EventFrames(10_000, 5_000, None)
    handle = Held()
    frames.init(handle)
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.now})()
    clock.now = 0
    table = pd.DataFrame(pings, columns=columns)
    list(frames.handleInputRows(("a",), iter([table[:300], table[300:]]), clock))
    assert len(frames._waiting.rows) == 2 and handle.timers == [510_000]
    for now, until in ((704_000, 700), (2_000_000, 1000)):
        clock.now, at = now, handle.timers.pop()
        expired = type("Expired", (), {"getExpiryTimeInMs": lambda self, at=at: at})()
        (out,) = frames.handleExpiredTimer(("a",), clock, expired)
        first = 510 if until == 700 else 710
        assert out["frame"].tolist() == [float(t) for t in range(first, until + 1, 10)]
        assert out["seq"].tolist() == [2**60 + 1000 - t for t in range(first, until + 1, 10)] and out["height"].tolist() == [1000.0 - t for t in range(first, until + 1, 10)]
    assert pd.isna(out["vertical_rate_mps"].iloc[-1]) and not out["vertical_rate_mps"].iloc[:-1].isna().any()
    assert not frames._waiting.rows and not handle.timers and frames._last.rows[0] == (2**61, None, None, None, None, None, None, 1000.5, True)
