"""Streams that must see rows in order of event time: state and timers per stream, and rows that come late but not too late.

Rows wait in a list state until the watermark has passed their time; then they are taken in order, so results don't depend
on the order in which files arrive, and a restart goes on from the checkpointed state. Rows later than the watermark are
dropped by Spark. The session needs RocksDB as state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import kernels


class InOrder(StatefulProcessor):
    """Rows (with ts) of a key in order of event time. What is kept between triggers is a JSON value and the waiting rows."""

    #: columns that order rows, and the output's columns
    order: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def __init__(self, schema: StructType):
        self.names, self.ddl = schema.fieldNames(), schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ddl)
        self.memory = handle.getValueState("memory", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for p in rows:
            # the key's columns aren't part of the rows that wait
            self.waiting.appendList([tuple(r) for r in p[self.names].astype(object).where(p[self.names].notna(), None).itertuples(index=False)])
            times |= set(p["ts"].map(lambda t: int(t.timestamp() * 1000)))
        for t in times:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        known = json.loads(self.memory.get()[0]) if self.memory.exists() else self.first()
        held = [dict(zip(self.names, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        due = [r for r in held if int(pd.Timestamp(r["ts"]).timestamp() * 1000) <= passed]
        out = []
        if due:
            later = [tuple(r[n] for n in self.names) for r in held if int(pd.Timestamp(r["ts"]).timestamp() * 1000) > passed]
            self.waiting.put(later) if later else self.waiting.clear()
            for r in sorted(due, key=lambda r: tuple(r[c] for c in self.order)):
                out += self.take(key, known, r)
        out += self.rest(key, known, passed)
        self.memory.update((json.dumps(known),))
        if out:
            yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass

    def first(self) -> dict:
        return {}

    def take(self, key, known: dict, row: dict) -> list[tuple]:
        raise NotImplementedError

    def rest(self, key, known: dict, passed: int) -> list[tuple]:
        """What ends because no row came up to this time."""
        return []


def _related(a: str, b: str) -> float:
    return 1.0 if a == b else 0.7 if (a, b) in text.RELATED_TYPES or (b, a) in text.RELATED_TYPES else 0.0


def _targets_alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    words = lambda t: {"".join(c for c in w) for w in "".join(c if c.isalnum() else "\0" for c in t.lower()).split("\0")}
    x, y = words(a), words(b)
    return len(x & y) / len(x | y) if x | y else 0.0


class Sessions(InOrder):
    """Sessions that close after a gap, at the event limit, and where the context changes: number, first and last time, ids."""

    order = ("us", "event_id")
    columns = ("stream", "session", "start_us", "end_us", "event_ids")

    def __init__(self, schema: StructType, gap_us: int, most: int, threshold: float):
        super().__init__(schema)
        self.gap_us, self.most, self.threshold = gap_us, most, threshold

    def first(self) -> dict:
        return {"session": 0, "open": None, "in_group": 0}

    def _closed(self, key, known: dict) -> list[tuple]:
        o, known["open"] = known["open"], None
        return [(key[0], known["session"], o["start"], o["us"], o["ids"])] if o else []

    def take(self, key, known: dict, row: dict) -> list[tuple]:
        out, last = [], known["open"]
        group_ends = last is None or row["us"] - last["us"] > self.gap_us or known["in_group"] >= self.most
        if group_ends or self._likeness(last, row) < self.threshold:
            out = self._closed(key, known)
            known["session"] += 1
            known["open"] = {"start": row["us"], "ids": []}
            known["in_group"] = 0 if group_ends else known["in_group"]
        o = known["open"]
        o.update(us=row["us"], type=row["type"], app=row["app_name"], target=row["target"])
        o["ids"].append(row["event_id"])
        known["in_group"] += 1
        self.handle.registerTimer((row["us"] + self.gap_us) // 1000 + 1)
        return out

    def _likeness(self, last: dict, row: dict) -> float:
        parts = [_related(last["type"], row["type"]), _targets_alike(last["target"], row["target"]), max(0.0, 1 - (row["us"] - last["us"]) / self.gap_us)]
        if last["app"] is not None and row["app_name"] is not None:
            parts.append(1.0 if last["app"] == row["app_name"] else 0.0)
        return sum(parts) / len(parts)

    def rest(self, key, known: dict, passed: int) -> list[tuple]:
        o = known["open"]
        if o is None or passed * 1000 <= o["us"] + self.gap_us:
            return []
        # what comes later opens a new one in any case
        return self._closed(key, known)


def sessions(events: DataFrame, gap_us: int = 300_000_000, most: int = 50, threshold: float = 0.7, late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream of events (stream, event_id, us, ts, type, target, app_name), each once it has ended."""
    rows = events.select("stream", "event_id", "us", "ts", "type", "target", "app_name").withWatermark("ts", late)
    out = "stream long, session long, start_us long, end_us long, event_ids array<long>"
    return rows.groupBy("stream").transformWithStateInPandas(Sessions(rows.drop("stream").schema, gap_us, most, threshold), out, "append", "EventTime")


class Patterns(InOrder):
    """Events weighed by what the last frames held, as kernels.temporal_patterns: the frames kept are the state."""

    order = ("frame", "idx")
    columns = tuple(kernels.PATTERN_NAMES)

    def __init__(self, schema: StructType, history: int, least: float):
        super().__init__(schema)
        self.history, self.least = history, least

    def first(self) -> dict:
        return {"frame": None, "past": [], "kept": []}

    def take(self, key, known: dict, row: dict) -> list[tuple]:
        if known["frame"] is not None and row["frame"] != known["frame"]:
            known["past"], known["kept"] = [*known["past"], known["kept"]][-self.history :], []
        known["frame"] = row["frame"]
        past = [{tuple(p) for p in f} for f in known["past"]]
        pair = (row["type"], row["target"])
        share, sure = kernels.weighed(past, pair, row["confidence"])
        if sure < self.least:
            return []
        if list(pair) not in known["kept"]:
            known["kept"].append(list(pair))
        return [(key[0], row["frame"], row["idx"], *pair, round(sure, 6), share)]


def patterns(events: DataFrame, history: int = 5, least: float = 0.6, late: str = "10 minutes") -> DataFrame:
    """Frames' events (stream, frame, ts, idx, type, target, confidence) with their confidence after the last frames'."""
    rows = events.select("stream", "frame", "idx", "ts", "type", "target", "confidence").withWatermark("ts", late)
    out = "stream string, frame long, idx long, type string, target string, confidence double, share double"
    return rows.groupBy("stream").transformWithStateInPandas(Patterns(rows.drop("stream").schema, history, least), out, "append", "EventTime")


class FramePairs(InOrder):
    """Regions of each frame with the frame's number, and once more as those before the next frame."""

    order = ("frame", "idx")

    def __init__(self, schema: StructType):
        super().__init__(schema)
        self.kept = [n for n in self.names if n != "ts"]
        self.columns = ("stream", "seq", "now", *self.kept)

    def first(self) -> dict:
        return {"seq": 0, "frame": None, "rows": []}

    def take(self, key, known: dict, row: dict) -> list[tuple]:
        out = []
        if row["frame"] != known["frame"]:
            known["seq"] += 1
            out = [(key[0], known["seq"], False, *r) for r in known["rows"]]
            known["frame"], known["rows"] = row["frame"], []
        known["rows"].append([row[n] for n in self.kept])
        return [*out, (key[0], known["seq"], True, *known["rows"][-1])]


def frame_pairs(regions: DataFrame, least: float = 0.7, late: str = "10 minutes") -> DataFrame:
    """Sure enough regions (stream, frame, ts, ...) as joins.with_previous_frame numbers them (now), and each frame's again
    under the number of the next frame, so that a frame meets the one before by an equi join on (stream, seq)."""
    rows = regions.where(f"confidence >= {least}").withWatermark("ts", late)
    p = FramePairs(rows.drop("stream").schema)
    out = StructType([rows.schema["stream"]]).add("seq", "long").add("now", "boolean")
    for n in p.kept:
        out = out.add(n, rows.schema[n].dataType)
    return rows.groupBy("stream").transformWithStateInPandas(p, out, "append", "EventTime")
