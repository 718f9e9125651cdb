"""From summaries to events to frames and back, with the confidence of each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Applications in which frames are the more relevant.
INTERACTIVE = ("Safari", "Chrome", "Firefox", "Xcode", "Terminal", "Finder")


def in_sessions(sessions: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows (stream, us, ...) within the closed time of a session of their stream, with the session's columns. Sessions of a
    stream don't overlap, so a row's session is the last one that began before it: one window, no join by range."""
    named = [c for c in sessions.columns if c != "stream"]
    both = rows.select("stream", F.col("us").alias("at"), F.lit(1).alias("kind"), F.struct(*rows.columns).alias("row"), F.lit(None).cast(sessions.select(F.struct(*named).alias("s")).schema["s"].dataType).alias("session"))
    starts = sessions.select("stream", F.col("start_us").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.struct(*named).alias("session"))
    w = Window.partitionBy("stream").orderBy("at", "kind")
    met = both.unionByName(starts).withColumn("in", F.last("session", ignorenulls=True).over(w)).where("kind = 1 AND at <= in.end_us")
    return met.select("in.*", "row.*")


def frames_inside(sessions: DataFrame, frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Frames (frame_id, stream, us) within each session's closed time."""
    return in_sessions(sessions.select(*keys, "start_us", "end_us"), frames.select("stream", "frame_id", "us"), keys).select(*keys, "frame_id", "us")


def nearest(rows: DataFrame, others: DataFrame, within_us: int) -> DataFrame:
    """Each row's nearest other row of its stream within that time, by time cells; score 1 at no distance, 0 at the limit."""
    cell = lambda c: F.floor(F.col(c) / within_us)
    a = rows.select("stream", F.col("event_id").alias("a_id"), F.col("us").alias("a_us")).withColumn("cell", F.explode(F.sequence(cell("a_us") - 1, cell("a_us") + 1)))
    b = others.select(F.col("stream").alias("of"), F.col("event_id").alias("b_id"), F.col("us").alias("b_us")).withColumn("at", cell("b_us"))
    j = a.join(b, (F.col("stream") == F.col("of")) & (F.col("cell") == F.col("at"))).where("a_id != b_id").withColumn("apart", F.abs(F.col("a_us") - F.col("b_us")))
    j = j.where(F.col("apart") <= within_us)
    best = Window.partitionBy("stream", "a_id").orderBy("apart", "b_id")
    return j.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("stream", "a_id", "b_id", F.round(1 - F.col("apart") / within_us, 6).alias("score"))


def links(events: DataFrame, frames: DataFrame) -> DataFrame:
    """A row per event and frame of its evidence that there is; frames listed twice count once, unknown ones fall out."""
    first = frames.groupBy("frame_id").agg(F.min_by(F.struct("app_name", "us"), "us").alias("f"))
    return events.select("stream", "event_id", "confidence", F.explode(F.array_distinct("evidence_frames")).alias("frame_id")).join(first, "frame_id").select("stream", "event_id", "frame_id", "confidence", "f.app_name")


def spatial_consistency(linked: DataFrame) -> DataFrame:
    """Per event: frames of its evidence, apps in them, 1 if one app, 0.5 if more."""
    g = linked.groupBy("event_id").agg(F.countDistinct("frame_id").alias("frames"), F.countDistinct("app_name").alias("apps"))
    return g.withColumn("spatial", F.when(F.col("apps") <= 1, 1.0).otherwise(0.5))


def both_ways(linked: DataFrame) -> DataFrame:
    """For each event its frames and for each frame its events, as sorted arrays."""
    e = linked.groupBy(F.lit("event").alias("of"), F.col("event_id").alias("id")).agg(F.sort_array(F.collect_set("frame_id")).alias("linked"))
    return e.unionByName(linked.groupBy(F.lit("frame").alias("of"), F.col("frame_id").alias("id")).agg(F.sort_array(F.collect_set("event_id")).alias("linked")))


def traces(sessions: DataFrame, grouped: DataFrame, linked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per session the walk from summary over its events to their frames: steps, and their mean confidence, where a
    summary's counts 0.1, an event's 0.3, a frame's 0.6. A session without frames is incomplete."""
    e = grouped.select(*keys, "event_id", "confidence")
    f = e.join(linked.select("event_id", "frame_id"), "event_id")
    n = e.groupBy(*keys).agg(F.count("*").alias("events"), F.sum("confidence").alias("sure")).join(f.groupBy(*keys).agg(F.countDistinct("frame_id").alias("frames")), list(keys), "left")
    j = sessions.select(*keys, "avg_confidence").join(n, list(keys)).withColumn("frames", F.coalesce("frames", F.lit(0).cast("long")))
    total = 0.1 * F.col("avg_confidence") + 0.3 * F.col("sure") + 0.6 * F.col("frames")
    steps = 1 + F.col("events") + F.col("frames")
    return j.select(*keys, "events", "frames", steps.alias("steps"), F.round(total / steps, 6).alias("confidence"), (F.col("frames") > 0).alias("complete"))


def relevance(app: Column, title: Column) -> Column:
    """0.5, more for an app that people work in and for a title that says more than the app's name."""
    return F.least(F.lit(1.0), 0.5 + F.when(app.isin(*INTERACTIVE), 0.3).otherwise(0.0) + F.when((title != "") & (title != app), 0.2).otherwise(0.0))
