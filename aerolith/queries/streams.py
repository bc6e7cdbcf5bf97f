"""Streams run over a table to their end, so that their results can be compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.geodesy import Haversine
from aerolith.operators import tracking
from aerolith.plans.staging import shared_dir
from aerolith.queries.common import A, PINGS, direct_sql, pings_of, rnd, rsql, table
from aerolith.streaming import targets
from aerolith.streaming.feed import feed

EVERY, STALE, DELAY = 14_400.0, 21_600.0, 3_600.0
FEED_START, FEED_TICKS, FEED_RATE = 1_700_000_000.0, 6, 2.0


def _finished(stream: DataFrame, at: str) -> DataFrame:
    """The rows of a stream that has read all there is, from a sink that has each row once."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream; of a table that is one file, the folder is watched for that file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    files = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return files.parquet(f"{sf_dir}/events.parquet")
    return files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/aerolith/{name}-{uuid.uuid4().hex}"


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all targets that are fresh at every fourth hour, from the log as a stream by event time."""
    log = tracking.split_invalid(pings_of(_events(spark, sf_dir)))[0]
    at = targets.frames(targets.with_event_time(log, f"{DELAY:.0f} seconds"), EVERY, "event", STALE, solver=Haversine)
    r = _finished(at, _folder(spark, "frames"))
    return r.select("id", "frame", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), rnd("height", 2).alias("height"))


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last update of each target from the log as a stream by event time."""
    updates = targets.latest_stream(targets.with_event_time(pings_of(_events(spark, sf_dir)), "1 day"), by="last_ping_time")
    folder = _folder(spark, "latest")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = updates.writeStream.foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/rows/{k}")).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(updates.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    last = rows.groupBy("id").agg(F.max_by(F.struct("seq", "height"), "batch").alias("s"))
    return last.select("id", "s.seq", "s.height")


def feed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ticks of a feed of the suppliers as targets, stopped and started again from its checkpoint in between."""
    k = F.col("s_suppkey")
    folder = _folder(spark, "feed")
    table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("id"), F.radians((k * 37 % 120 - 60).cast("double")).alias("lat"), F.radians((k * 91 % 360 - 180).cast("double")).alias("lon"), (k * 13 % 9000).cast("double").alias("height"),
        (k % 250).cast("double").alias("speed_mps"), F.radians((k * 7 % 360).cast("double")).alias("track_heading_rad"), (k % 21 - 10).cast("double").alias("vertical_rate_mps"),
    ).write.parquet(f"{folder}/targets")
    for ticks in (FEED_TICKS // 2, FEED_TICKS):
        r = _finished(feed(spark, f"{folder}/targets", FEED_START, FEED_RATE, ticks), folder)
    return r.select("id", "seq", rnd("lat", 8).alias("lat"), rnd("lon", 8).alias("lon"), "height", "last_ping_time")


QUERIES = {f.__name__: f for f in (stream_frames, stream_latest, feed_ticks)}

_D = direct_sql("lat", "lon", "heading", "distance")

ORACLE_SQL = {
    "stream_frames": f"""WITH {PINGS}, stop AS (SELECT max(t) - {DELAY!r} AS stop FROM valid),
        spans AS (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY t, seq) AS until FROM valid),
        ticks AS (SELECT s.*, k*{EVERY!r} AS frame FROM spans s, LATERAL (SELECT unnest(range(ceil(t/{EVERY!r})::BIGINT, floor((t+{STALE!r})/{EVERY!r})::BIGINT + 1)) AS k)),
        placed AS (SELECT *, speed*(frame-t) AS distance FROM ticks, stop WHERE frame <= stop AND (until IS NULL OR frame < until))
        SELECT id, frame, {rsql(f'CASE WHEN distance > 0 THEN {_D[0]} ELSE lat END', 7)} AS lat, {rsql(f'CASE WHEN distance > 0 THEN {_D[1]} ELSE lon END', 7)} AS lon, {rsql('height + climb*(frame-t)', 2)} AS height FROM placed""",
    "stream_latest": f"WITH {PINGS} SELECT id, seq, height FROM valid QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC, seq DESC) = 1",
    "feed_ticks": f"""WITH s AS (SELECT s_suppkey AS k, radians((s_suppkey*37 % 120 - 60)::DOUBLE) AS lat, radians((s_suppkey*91 % 360 - 180)::DOUBLE) AS lon, radians((s_suppkey*7 % 360)::DOUBLE) AS h FROM supplier),
        t AS (SELECT *, n/{FEED_RATE!r} AS gone FROM s, (SELECT unnest(range({FEED_TICKS})) AS n))
        SELECT k::VARCHAR AS id, n AS seq, {rsql(f'lat + (k % 250)*gone*cos(h)/{A}', 8)} AS lat, {rsql(f'lon + (k % 250)*gone*sin(h)/({A}*cos(lat))', 8)} AS lon,
        (k*13 % 9000)::DOUBLE + (k % 21 - 10)*gone AS height, {FEED_START!r} + gone AS last_ping_time FROM t""",
}
