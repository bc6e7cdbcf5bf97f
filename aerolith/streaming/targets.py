"""Tracked targets as a stream: the latest valid ping of each id is state, and frames read it out by dead reckoning.

    latest_stream   updates, each time a target's latest ping changes, by arrival or by event time
    frames          where all fresh targets are at the ticks of a clock, of event time or of the wall

Pings have id, the columns of STATE, and may have remove = true, which forgets the
target. By event time they need a watermark, on a column event_time (with_event_time):
pings that are older than it are dropped by Spark, which counts them in its progress.
State is a row for each target, and by event time its pings since the last frame, those
of a batch packed into one value, as each value costs a call and its conversion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aerolith.functions.geodesy import Vincenty
from aerolith.operators.tracking import STALE_SECONDS, STATE, dead_reckon, is_valid

_TYPES = {"seq": "long"}
STATE_SCHEMA = ", ".join(f"{c} {_TYPES.get(c, 'double')}" for c in STATE)
_TIME = STATE.index("last_ping_time")
#: A ping among others in bytes, NaN for null; and pings in one value at most.
_PING = np.dtype([*((c, "<i8" if _TYPES.get(c) == "long" else "<f8") for c in STATE), ("removed", "?")])
PACK = 10_000


def with_event_time(pings: DataFrame, delay: str) -> DataFrame:
    """Pings with event_time, of last_ping_time, and a watermark that is late by a delay such as '10 minutes'."""
    return pings.withColumn("event_time", F.timestamp_micros((F.col("last_ping_time") * 1_000_000).cast("long"))).withWatermark("event_time", delay)


def _rows(batch: pd.DataFrame) -> Iterator[tuple]:
    """STATE and removed of each ping; a removal keeps its time and number alone."""
    for r in batch[[*STATE, "remove"]].itertuples(index=False):
        gone = bool(r[-1])
        own = [None if (gone and k != _TIME) or pd.isna(v) else float(v) for k, v in enumerate(r[1:-1], 1)]
        yield int(r[0]), *own, gone


def _array(batch: pd.DataFrame) -> np.ndarray:
    """What _rows gives of pings that have a time, as an array."""
    batch = batch[batch["last_ping_time"].notna().to_numpy()]
    out = np.empty(len(batch), _PING)
    out["removed"] = batch["remove"].to_numpy(bool)
    for c in STATE:
        out[c] = batch[c].to_numpy()
        if c not in ("seq", "last_ping_time"):
            out[c][out["removed"]] = np.nan
    return out


def _packs(pings: np.ndarray) -> list[tuple[bytes]]:
    return [(pings[i : i + PACK].tobytes(),) for i in range(0, len(pings), PACK)]


def _unpacked(values: Iterator[tuple[bytes]]) -> np.ndarray:
    """Pings in order of event time, then arrival."""
    pings = np.frombuffer(b"".join(bytes(v[0]) for v in values), _PING)
    return pings[np.lexsort((pings["seq"], pings["last_ping_time"]))]


def _tuples(pings: np.ndarray) -> list[tuple]:
    return [tuple(None if v != v else v for v in r) for r in pings.tolist()]


def _by_arrival(row: tuple) -> tuple:
    return (row[0],)


def _by_event(row: tuple) -> tuple:
    return float("-inf") if row[_TIME] is None else row[_TIME], row[0]


ORDERS = {"seq": _by_arrival, "last_ping_time": _by_event}


class LatestPing(StatefulProcessor):
    """Keeps one ping for each id: the last to arrive (largest seq), or the last by event time, then arrival.

    A ping with remove = true, whatever else it holds, forgets the target: a row
    with removed = true tells sinks so, and pings before it in the order count no more.
    With a time to live, a target that sends nothing for so long is forgotten in silence.
    """

    def __init__(self, by: str = "seq", ttl_ms: int | None = None) -> None:
        self._by, self._ttl = by, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("latest", f"{STATE_SCHEMA}, removed boolean", self._ttl)
        self._place = ORDERS[self._by]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self._state.get()) if self._state.exists() else None
        fresh = max((r for b in rows for r in _rows(b)), key=self._place, default=None)
        if fresh is None or (best is not None and self._place(fresh) <= self._place(best)):
            return
        self._state.update(fresh)
        yield pd.DataFrame([(key[0], *fresh)], columns=["id", *STATE, "removed"])

    def close(self) -> None:
        pass


def _usable(pings: DataFrame) -> DataFrame:
    """Invalid pings never reach state, removals always do."""
    remove = F.coalesce(F.col("remove"), F.lit(False)) if "remove" in pings.columns else F.lit(False)
    return pings.withColumn("remove", remove).where(F.col("remove") | is_valid())


def latest_stream(pings: DataFrame, by: str = "seq", ttl_seconds: float | None = None) -> DataFrame:
    """A stream of updates (id, STATE, removed) from a stream of pings.

    by='seq' takes what arrived last, whatever its time says; by='last_ping_time' takes
    event time and wants a watermark. ttl_seconds (by arrival alone) forgets targets.
    """
    if by != "seq" and ttl_seconds:
        raise ValueError("a time to live goes by the wall clock, as arrival does")
    mode = "EventTime" if by != "seq" else "ProcessingTime" if ttl_seconds else "None"
    ttl = round(ttl_seconds * 1000) if ttl_seconds else None
    return _usable(pings).groupBy("id").transformWithStateInPandas(
        statefulProcessor=LatestPing(by, ttl), outputStructType=f"id string, {STATE_SCHEMA}, removed boolean", outputMode="Update", timeMode=mode
    )


class EventFrames(StatefulProcessor):
    """The state of a target as of each multiple of a period of event time, once the watermark has passed it.

    Pings wait until a frame has passed them, so those that come late, but within the
    watermark, are in their place. Frames are made while the state is not stale; then
    no timer is set, and the state stays until a ping brings the target back, or for
    ``forget_ms`` if that is given.
    """

    def __init__(self, every_ms: int, stale_ms: int, forget_ms: int | None) -> None:
        self._every, self._stale, self._forget = every_ms, stale_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = f"{STATE_SCHEMA}, removed boolean"
        self._handle, self._last, self._waiting, self._timer = handle, handle.getValueState("last", row), handle.getListState("waiting", "pings binary"), handle.getValueState("timer", "at long")

    def _frame_from(self, time: float) -> int:
        """The first frame at or after a ping's time, in milliseconds."""
        return -(-round(time * 1000) // self._every) * self._every

    def _set(self, at: int | None) -> None:
        held = self._timer.get()[0] if self._timer.exists() else None
        if held == at:
            return
        if held is not None:
            self._handle.deleteTimer(held)
            self._timer.clear()
        if at is not None:
            self._handle.registerTimer(at)
            self._timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [a for a in map(_array, rows) if len(a)]
        if new:
            self._waiting.appendList([pack for a in new for pack in _packs(a)])
            first = self._frame_from(min(float(a["last_ping_time"].min()) for a in new))
            held = self._timer.get()[0] if self._timer.exists() else None
            self._set(max(first, timerValues.getCurrentWatermarkInMs() + 1) if held is None else min(held, first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = timerValues.getCurrentWatermarkInMs(), -(-expiredTimerInfo.getExpiryTimeInMs() // self._every) * self._every
        last = tuple(self._last.get()) if self._last.exists() else None
        held = _unpacked(self._waiting.get())
        waiting, out = _tuples(held), []
        self._timer.clear()
        k = 0
        while at <= now:
            while k < len(waiting) and waiting[k][_TIME] * 1000 <= at:
                last = waiting[k] if last is None or _by_event(waiting[k]) > _by_event(last) else last
                k += 1
            age = at - last[_TIME] * 1000 if last else None
            fresh = last is not None and not last[-1] and age <= self._stale
            if fresh:
                out.append((key[0], at / 1000, *last[:-1]))
            if fresh or k == len(waiting):
                at += self._every
                if not fresh:
                    break
            else:
                at = max(at + self._every, self._frame_from(waiting[k][_TIME]))  # nothing to show before the next ping
        if last is not None and self._forget is not None and k == len(waiting) and now - last[_TIME] * 1000 > self._forget:
            last = None
        if last is None:
            self._last.clear()
        else:
            self._last.update(last)
        if k:
            self._waiting.put(_packs(held[k:])) if k < len(waiting) else self._waiting.clear()
        live = last is not None and not last[-1] and at - last[_TIME] * 1000 <= self._stale
        if live:
            self._set(at)
        elif k < len(waiting):
            self._set(max(now + 1, self._frame_from(waiting[k][_TIME])))
        elif last is not None and self._forget is not None:
            self._set(max(now + 1, round(last[_TIME] * 1000) + self._forget + 1))
        if out:
            yield pd.DataFrame(out, columns=["id", "frame", *STATE])

    def close(self) -> None:
        pass


class WallFrames(StatefulProcessor):
    """The latest ping of a target at ticks of the wall clock: each tick that finds it fresh gives a row.

    A tick that the stream was too busy for is left out, as a display would. A stale
    target has no timer; its state stays and its next ping sets one.
    """

    def __init__(self, every_ms: int, stale_ms: int) -> None:
        self._every, self._stale = every_ms, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._last, self._timer = handle, handle.getValueState("last", f"{STATE_SCHEMA}, removed boolean"), handle.getValueState("timer", "at long")

    def _next(self, now: int) -> None:
        at = now // self._every * self._every + self._every
        self._handle.registerTimer(at)
        self._timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = max((r for b in rows for r in _rows(b)), key=_by_arrival, default=None)
        if fresh is not None and not (self._last.exists() and _by_arrival(fresh) <= _by_arrival(tuple(self._last.get()))):
            self._last.update(fresh)
            if not self._timer.exists():
                self._next(timerValues.getCurrentProcessingTimeInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, last = expiredTimerInfo.getExpiryTimeInMs(), tuple(self._last.get())
        self._timer.clear()
        age = None if last[-1] or last[_TIME] is None else at - last[_TIME] * 1000
        if age is not None and age <= self._stale:
            self._next(timerValues.getCurrentProcessingTimeInMs())
            if age >= 0:  # a ping from the future waits
                yield pd.DataFrame([(key[0], at / 1000, *last[:-1])], columns=["id", "frame", *STATE])

    def close(self) -> None:
        pass


def frames(pings: DataFrame, every_seconds: float, clock: str = "event", stale_seconds: float = STALE_SECONDS, forget_seconds: float | None = None, solver: type = Vincenty) -> DataFrame:
    """A stream of positions (id, frame, lat, lon, height, heading_rad, dt): of every fresh target at every frame.

    Frames are multiples of every_seconds. clock='event' (pings with a watermark) shows
    the state by event time as of the frame, however pings came; clock='wall' the ping
    that arrived last, at ticks of processing time.
    """
    every, stale = round(every_seconds * 1000), round(stale_seconds * 1000)
    if clock == "event":
        processor, mode = EventFrames(every, stale, None if forget_seconds is None else round(forget_seconds * 1000)), "EventTime"
    else:
        processor, mode = WallFrames(every, stale), "ProcessingTime"
    states = _usable(pings).groupBy("id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"id string, frame double, {STATE_SCHEMA}", outputMode="Update", timeMode=mode
    )
    return dead_reckon(states, "frame", stale_seconds, solver, keep=("frame",))
