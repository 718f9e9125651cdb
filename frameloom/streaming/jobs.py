"""The engine's streams: Structured Streaming over the same operators, with watermarks for late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import operations
from ..operators.joins import TEMPORAL
from ..sources import segments

def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of events as they come, with ts as an instant, which watermarks need."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def segment_stream(spark: SparkSession, path: str) -> DataFrame:
    """New video files with path, length and time, each once it is whole: not empty, and no longer growing."""
    segments.register(spark)
    return spark.readStream.format("segments").option("path", path).load()


def segment_notes(spark: SparkSession, path: str, schema: str, least: int = 100_000) -> DataFrame:
    return spark.readStream.schema(schema).json(path).where(F.col("file_size") > least)


def sessions(events: DataFrame, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Per stream, sessions that end with a gap: start, end, events, mean confidence."""
    w = F.session_window("ts", gap)
    g = events.withWatermark("ts", late).groupBy("stream", w).agg(F.count("*").alias("n_events"), F.avg("confidence").alias("avg_confidence"))
    return g.select("stream", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", "avg_confidence")


def counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "type", "n")


def correlations(left: DataFrame, right: DataFrame, horizon: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Directed pairs of correlated types of a stream within the horizon, by a stream-stream interval join."""
    a = left.withWatermark("ts", late).select(*[F.col(c).alias(f"a_{c}") for c in ("stream", "event_id", "type", "ts", "confidence")])
    b = right.withWatermark("ts", late).select(*[F.col(c).alias(f"b_{c}") for c in ("stream", "event_id", "type", "ts", "confidence")])
    near = (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {horizon}"))
    pair = F.concat("a_type", F.lit(">"), "b_type").isin([f"{x}>{y}" for x, y in TEMPORAL])
    return a.join(b, (F.col("a_stream") == F.col("b_stream")) & near & (F.col("a_event_id") != F.col("b_event_id"))).where(pair)


def first_sightings(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once, however often it is sent within the time that late rows may take."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _focus(key: tuple, batches: Iterator[pd.DataFrame], state, least_us: int):
    app, at = state.get if state.exists else (None, None)
    out = []
    rows = pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable")
    for r in rows.itertuples(index=False):
        if app is None:
            app, at = r.app_name, r.us
        elif r.app_name != app and r.us - at >= least_us:
            out.append((key[0], r.event_id, r.us, app, r.app_name))
            app, at = r.app_name, r.us
    state.update((app, at))
    yield pd.DataFrame(out, columns=["stream", "event_id", "us", "from_app", "to_app"])


def focus_changes(events: DataFrame, least_us: int = 100_000) -> DataFrame:
    """Changes of focus against the last recorded one, kept per stream across triggers."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("stream").applyInPandasWithState(
        lambda k, b, s: _focus(k, b, s, least_us), "stream long, event_id long, us long, from_app string, to_app string", "app string, us long", "append", GroupStateTimeout.NoTimeout
    )


def recognised(regions: DataFrame, origins: DataFrame, least: float = 0.3) -> DataFrame:
    """Recognised regions as they come, in any order and on as many tasks as there are files: sure enough ones, moved by the
    origin of the part of the frame they were read in (a static table)."""
    j = regions.where(F.col("confidence") >= least).join(origins, ["stream", "frame"], "left")
    return j.withColumns({"x": F.col("x") + F.coalesce("ox", F.lit(0.0)), "y": F.col("y") + F.coalesce("oy", F.lit(0.0))}).drop("ox", "oy")


def monitoring(metrics: DataFrame, path: str, checkpoint: str, every: str | None = "2 seconds"):
    """Health alerts of samples as they come, at every tick."""
    return append_to(operations.health_alerts(metrics), path, checkpoint, every)


def alerts(audit: DataFrame) -> DataFrame:
    """Critical audit rows as they come."""
    return audit.where("severity = 'critical'")


def append_to(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Write a stream's rows to a Parquet folder: on a trigger of that interval, or once over all there is."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
