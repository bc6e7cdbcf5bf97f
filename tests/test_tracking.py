from math import hypot, pi, radians, sin
import pytest
from pyspark.sql import functions as F

from aerolith.functions.geodesy import Haversine, Vincenty
from aerolith.operators import tracking

SCHEMA = "id string, seq long, lat double, lon double, height double, speed_mps double, track_heading_rad double, vertical_rate_mps double, last_ping_time double"


LAT, LON = radians(47.25), radians(8.5)


def pings(spark, *rows):
    full = [(i, s, LAT, LON, h, v, c, vr, t) for i, s, h, v, c, vr, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_validation(spark):
    p = pings(spark, ("a", 1, 0.0, -1.0, 0.0, 0.0, 0.0), ("b", 2, 0.0, 1.0, -0.1, 0.0, 0.0), ("c", 3, 0.0, 1.0, 2 * pi + 0.01, 0.0, 0.0), ("d", 4, 0.0, 1.0, 2 * pi, 0.0, 0.0), ("e", 5, 0.0, None, 0.0, 0.0, 0.0), ("f", 6, 0.0, float("nan"), 0.0, 0.0, 0.0))
    good, bad = tracking.split_invalid(p)
    assert {r.id for r in good.collect()} == {"d"} and {r.id for r in bad.collect()} == {"a", "b", "c", "e", "f"}


def test_arrival_wins(spark):
    p = pings(spark, ("a", 1, 1.0, 1.0, 0.0, 0.0, 50.0), ("a", 2, 2.0, 1.0, 0.0, 0.0, 10.0))
    assert tracking.latest_state(p).first().height == 2.0
    assert tracking.latest_state(p, by="last_ping_time").first().height == 1.0


@pytest.mark.parametrize("solver", [Vincenty, Haversine])
def test_dead_reckoning(spark, solver):
    """A target flown due north by a plain arc of the meridian, one that only sinks, and the ages that count."""
    p = tracking.latest_state(pings(spark, ("north", 1, 2000.0, 120.0, 0.0, -2.0, 40.0), ("sink", 2, 900.0, 0.0, 0.0, -4.0, 41.5), ("old", 3, 0.0, 1.0, 0.0, 0.0, 20.0), ("edge", 4, 0.0, 1.0, 0.0, 0.0, 25.0), ("future", 5, 0.0, 1.0, 0.0, 0.0, 50.5)))
    got = {r.id: r for r in tracking.dead_reckon(p, 50.0, 25.0, solver).collect()}
    assert set(got) == {"north", "sink", "edge"}
    a, e2 = 6378137.0, 0.0066943799901413165
    radius = 6371008.771415059 if solver is Haversine else a * (1 - e2) / (1 - e2 * sin(LAT) ** 2) ** 1.5
    assert got["north"].lat == pytest.approx(LAT + 120.0 * 10.0 / radius, abs=1e-9) and got["north"].lon == pytest.approx(LON) and got["north"].height == 1980.0
    assert got["sink"].height == 900.0 - 4.0 * 8.5 and got["sink"].lat == LAT and got["sink"].lon == LON and got["sink"].dt == 8.5


def test_empty(spark):
    assert tracking.dead_reckon(tracking.latest_state(spark.createDataFrame([], SCHEMA)), 1.0).count() == 0


def test_made_targets(spark):
    rows = tracking.made_targets(spark, 500, LAT, LON).collect()
    assert rows == tracking.made_targets(spark, 500, LAT, LON).collect() != tracking.made_targets(spark, 500, LAT, LON, seed=1).collect()
    assert all(1000 <= r.height < 7000 and 180 <= r.speed_mps < 250 and 0 <= r.track_heading_rad < 2 * pi and len(r.id) == 6 for r in rows)
    far = [hypot(r.lat - LAT, r.lon - LON) * 6378137.0 for r in rows]
    assert min(far) >= 15e3 - 1e-3 and max(far) < 95e3


def test_antipodes(spark):
    one = spark.range(1).select(Haversine.inverse(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(pi)).alias("h"), Vincenty.inverse(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(pi)).alias("v"), Haversine.inverse(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(pi)).alias("n")).first()
    assert one.h.distance == pytest.approx(pi * 6371008.771415059) and one.v.distance > 1.9e7 and one.n.distance is None


def _streamed(spark, tmp_path, batches, name):
    from aerolith.streaming.targets import latest_stream

    for b in batches:
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = latest_stream(spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_forgets_targets(spark, tmp_path):
    """A removal without speed arrives, gives a row, and outlives pings from before it; a later ping brings the target back."""
    more = lambda df, gone=False: df.withColumn("remove", F.lit(gone)).withColumn("speed_mps", F.when(F.lit(not gone), F.col("speed_mps")))
    first = more(pings(spark, ("a", 1, 10.0, 1.0, 0.0, 0.0, 1.0), ("b", 2, 20.0, 1.0, 0.0, 0.0, 1.0), ("c", 3, 30.0, 1.0, 0.0, 0.0, 1.0)))
    gone = more(pings(spark, ("a", 7, 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0, 0.0, 0.0), ("c", 7, 0.0, 0.0, 0.0, 0.0, 0.0)), gone=True)
    late = more(pings(spark, ("a", 5, 11.0, 1.0, 0.0, 0.0, 9.0), ("c", 9, 33.0, 1.0, 0.0, 0.0, 0.5)))
    rows = _streamed(spark, tmp_path, [first, gone, late], "forgotten").collect()
    last = {r.id: r for r in sorted(rows, key=lambda r: r.seq)}
    assert last["a"].removed and last["a"].height is None and not last["b"].removed and last["b"].height == 20.0 and last["c"].height == 33.0 and not last["c"].removed
    assert len(rows) == 6


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"t{k % 5}", k, float(k), float(k % 7 - 1), 0.5, 0.0, float(1000 - k)) for k in range(40)]
    p = pings(spark, *rows)
    _streamed(spark, tmp_path, [p.where("seq < 15"), p.where("seq >= 15")], "targets")
    last = {r.id: r.height for r in spark.sql("select id, max_by(height, seq) as height from targets group by id").collect()}
    assert last == {r.id: r.height for r in tracking.latest_state(p).collect()}


def test_labels_of_data_blocks(spark):
    r = spark.createDataFrame([(9144.0, 205.8), (60.0, 0.0), (400_000.0, 1.6)], "h double, v double")
    assert [x[0] for x in r.select(tracking.data_block("h", "v")).collect()] == ["FL300 400KT", "FL002 0KT", "FL13123 3KT"]
    assert [x[0] for x in r.select(tracking.data_block("h", "v", rounded=False)).collect()] == ["FL300 400KT", "FL001 0KT", "FL13123 3KT"]
