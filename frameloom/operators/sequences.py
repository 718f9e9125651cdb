"""Window operators over streams of frames, events, cursor samples and visits. Every window is partitioned by stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images, text
from . import kernels, scans

#: What the names of applications for talking and for building hold, lower case.
COMMUNICATION = ("mail", "messages", "slack", "teams", "zoom", "skype")
DEVELOPMENT = ("xcode", "vscode", "intellij", "terminal", "git", "github")


def _compared(batches):
    """Over frames sorted by (stream, frame): each compared with the one before it in its stream. One image is held."""
    held = None
    for batch in batches:
        for part in (batch.slice(k, 1024) for k in range(0, len(batch), 1024)):
            part = part.filter(pc.is_valid(part.column("pixels")))
            sizes = np.asarray(pc.list_value_length(part.column("pixels")))
            cuts = np.flatnonzero(np.diff(sizes)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(part)]):
                rows = part.slice(s, e - s)
                if not len(rows):
                    continue
                x = np.asarray(pc.fill_null(rows.column("pixels").flatten(), 0), dtype=np.float64).reshape(len(rows), -1)
                streams = rows.column("stream").to_pylist()
                same = np.array([a == b for a, b in zip([held[0] if held else None, *streams], streams)])
                before = np.concatenate([held[1][None] if held and held[1].shape == x[0].shape else np.zeros_like(x[:1]), x[:-1]])
                same[0] &= held is not None and held[1].shape == x[0].shape
                held = (streams[-1], x[-1].copy())
                if not same.any() or not x.shape[1]:
                    continue
                here, was = x[same], before[same]
                apart = [bin(int(v)).count("1") for v in images.stacked_hash(here) ^ images.stacked_hash(was)]
                turn = np.abs(images.stacked_entropy(here) - images.stacked_entropy(was))
                keys = [rows.column(c).filter(pa.array(same)) for c in ("stream", "frame")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(images.stacked_ssim(was, here)), pa.array(apart, pa.int32()), pa.array(turn)], ["stream", "frame", "ssim", "distance", "entropy_delta"])


def _edges(batches):
    """The first and the last frame of each stream in a range, with head for the first."""
    last = None
    for batch in batches:
        streams = batch.column("stream").to_pylist()
        for k, stream in enumerate(streams):
            row = batch.slice(k, 1) if k in (0, len(streams) - 1) or stream != streams[k - 1] or stream != streams[k + 1] else None
            if row is None:
                continue
            if last is None or last[0] != stream:
                if last is not None and not last[2]:
                    yield last[1].append_column("head", pa.array([False]))
                yield row.append_column("head", pa.array([True]))
                last = (stream, row, True)
            else:
                last = (stream, row, False)
    if last is not None and not last[2]:
        yield last[1].append_column("head", pa.array([False]))


def scene_changes(frames: DataFrame) -> DataFrame:
    """Consecutive frames of a stream that differ: stream, frame, ssim, distance, entropy_delta, change_type, confidence.

    Frames are dealt out by ranges of (stream, frame) and compared in order, whole batches in numpy; no window carries
    pixels. Frames without pixels are left out, and one of another size than the one before it isn't compared.
    """
    f = frames.where("pixels is not null").select("stream", F.col("frame").cast("long").alias("frame"), F.col("pixels").cast("array<int>").alias("pixels"))
    schema = f.select("stream", "frame").schema.add("ssim", "double").add("distance", "integer").add("entropy_delta", "double")
    # ranges of the frames are compared within; the first frame of each with the last of the one before
    r = scans.ranged(f, ("stream",), ("frame",)).drop("__range")
    edges = r.mapInArrow(_edges, f.schema.add("head", "boolean"))
    seams = edges.repartition("stream").sortWithinPartitions("stream", "frame")
    heads = edges.where("head").select("stream", "frame")
    m = r.mapInArrow(_compared, schema).unionByName(seams.drop("head").mapInArrow(_compared, schema).join(heads, ["stream", "frame"], "left_semi"))
    low, far = F.col("ssim") < 0.8, F.col("distance")
    kind = F.when(low & (far > 20), "cut").when(low & (F.col("entropy_delta") > 0.2), "content_change").when(low, "fade").when(far > 10, "motion").when(F.col("entropy_delta") > 0.1, "content_change")
    sure = F.least(F.lit(1.0), 0.5 * (1 - F.col("ssim")) + 0.3 * F.least(F.lit(1.0), far / 64) + 0.2 * F.least(F.lit(1.0), F.col("entropy_delta") / 8))
    return m.withColumn("change_type", kind).withColumn("confidence", sure).where("change_type is not null")


def islands(events: DataFrame, gap_us: int, most: int | None = None, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """events with island: per stream, a new one after a gap of more than gap_us, and after every `most` events."""
    w = Window.partitionBy("stream").orderBy(*order)
    fresh = F.when(F.col("us") - F.lag("us").over(w) <= gap_us, 0).otherwise(1)
    out = events.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(w)).drop("__new")
    if most:
        inside = Window.partitionBy("stream", "island").orderBy(*order)
        out = out.withColumn("chunk", F.floor((F.row_number().over(inside) - 1) / max(2, most)).cast("int"))
    return out


def limited(events: DataFrame, gap_us: int, most: int = 50) -> DataFrame:
    """events with island: per stream, a new one after a gap of more than gap_us, and after `most` events. All from windows of
    one order, so the rows are sorted once."""
    w = Window.partitionBy("stream").orderBy("us", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("us") - F.lag("us").over(w) > gap_us, F.lit(True))
    e = events.select("*", F.row_number().over(w).alias("__n"), fresh.alias("__new"))
    e = e.withColumn("__first", F.max(F.when(F.col("__new"), F.col("__n"))).over(so_far))
    opens = F.when((F.col("__n") - F.col("__first")) % most == 0, 1).otherwise(0)
    return e.withColumn("island", F.sum(opens).over(so_far)).drop("__n", "__new", "__first")


def context_split(events: DataFrame, gap_us: int, threshold: float = 0.7, most: int | None = None) -> DataFrame:
    """events with island (and chunk, given an event limit), similarity to the event before in it, and context: a new one
    where that is under threshold."""
    w = Window.partitionBy("stream", "island", *(["chunk"] if most else [])).orderBy("us", "event_id")
    e = islands(events, gap_us, most)
    before = lambda c: F.lag(c).over(w)
    e = e.select("*", before("type").alias("__type"), before("app_name").alias("__app"), before("target").alias("__target"), before("us").alias("__us"))
    app = F.when(F.col("app_name") == F.col("__app"), 1.0).otherwise(0.0)
    known = F.col("app_name").isNotNull() & F.col("__app").isNotNull()
    near = F.greatest(F.lit(0.0), 1 - (F.col("us") - F.col("__us")) / gap_us)
    parts = text.relatedness(F.col("type"), F.col("__type")) + text.token_jaccard(F.col("target"), F.col("__target")) + near
    similarity = F.when(known, (parts + app) / 4).otherwise(parts / 3)
    e = e.withColumn("similarity", F.when(F.col("__type").isNotNull(), similarity))
    fresh = F.when(F.col("similarity") >= threshold, 0).otherwise(1)
    return e.withColumn("context", F.sum(fresh).over(w)).drop("__type", "__app", "__target", "__us")


def sessions(grouped: DataFrame, keys: tuple[str, ...] = ("stream", "island"), least_events: int = 3, least_seconds: float = 60) -> DataFrame:
    """A row per group with enough events over enough time: counts by type, session type, primary app, mean confidence.

    forms counts submissions and changed fields, navigations changes of the application too. The apps of all events decide
    whether a session communicates or develops.
    """
    n = lambda *types: F.count_if(F.col("type").isin(*types))
    any_app = lambda words: F.coalesce(F.bool_or(F.lower("app_name").rlike("|".join(words))), F.lit(False))
    s = grouped.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        n("form_submission", "field_change").alias("forms"), n("data_entry").alias("data"), n("navigation", "app_switch").alias("navigations"), n("click").alias("clicks"), n("error_display").alias("errors"),
        n("form_submission").alias("submissions"), n("navigation").alias("visits"), any_app(COMMUNICATION).alias("communicates"), any_app(DEVELOPMENT).alias("develops"),
        F.mode("app_name", True).alias("primary_app"),
    )
    s = s.withColumn("seconds", (F.col("end_us") - F.col("start_us")) / 1e6).where((F.col("n_events") >= least_events) & (F.col("seconds") >= least_seconds))
    return s.withColumn("session_type", session_type())


def session_type() -> Column:
    n = F.col("n_events")
    research = (F.col("navigations") > F.floor(n / 3)) & (F.col("clicks") > F.floor(n / 4))
    return (
        F.when(F.col("forms") / n > 0.5, "form_filling").when(F.col("data") / n > 0.4, "data_entry").when(F.col("navigations") / n > 0.6, "navigation").when(F.col("errors") > 0, "mixed")
        .when(research, "research").when(F.col("communicates"), "communication").when(F.col("develops"), "development").otherwise("mixed")
    )


def movements(samples: DataFrame, least: float = 5.0) -> DataFrame:
    """Cursor samples at least so far from the one before."""
    w = Window.partitionBy("stream").orderBy("ms", "seq")
    far = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return samples.withColumn("distance", far).where(F.col("distance") >= least)


def inferred_clicks(samples: DataFrame) -> DataFrame:
    """Samples where the cursor rested: the last five within 5 of the newest, the seventh-last over 10 away."""
    w = Window.partitionBy("stream").orderBy("ms", "seq")
    s = samples.withColumn("__last", F.collect_list(F.struct("x", "y")).over(w.rowsBetween(-4, 0)))
    s = s.withColumn("__x", F.lag("x", 6).over(w)).withColumn("__y", F.lag("y", 6).over(w))
    rest = (F.size("__last") == 5) & F.forall("__last", lambda p: F.hypot(p["x"] - F.col("x"), p["y"] - F.col("y")) <= 5)
    return s.where(rest & (F.hypot(F.col("__x") - F.col("x"), F.col("__y") - F.col("y")) > 10)).drop("__last", "__x", "__y")


def trails(samples: DataFrame, window_ms: int = 1000, history: int = 5, least: float = 0.64, dealt: bool = False) -> DataFrame:
    """The movement over the last window_ms at each sample: points, path length, speed per second, turns of over 30 degrees
    between steps of over 1 px, linearity, kind and confidence. Emitted for three points or more over some time, once the
    stream has `history` samples, if the confidence is `least` or more. Thresholds are fixed values.

    Samples are sorted once by stream and time, and a pass over them in Arrow batches measures the windows in numpy; it holds
    the last window of a stream. dealt: whole streams lie in one partition each already.
    """
    at = samples.select("stream", F.col("ms").cast("long").alias("ms"), "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = at.select("stream", "ms", "seq").schema
    for name, kind in kernels.TRAIL_MEASURES:
        schema = schema.add(name, kind)
    s = (at if dealt else at.repartition("stream")).sortWithinPartitions("stream", "ms", "seq").mapInArrow(kernels.trail_batches(window_ms, history), schema)
    direct = F.col("direct")
    s = s.withColumn("speed", F.col("path") * 1000 / F.col("ms_span")).withColumn("linearity", F.when(F.col("path") > 0, direct / F.col("path")).otherwise(0.0))
    less = lambda test, by: F.when(test, by).otherwise(1.0)
    sure = less(F.col("points") < 5, 0.7) * less(F.col("path") < 20, 0.8) * less(F.col("ms_span") < 100, 0.6) * F.pow(F.lit(0.9), F.col("gaps"))
    s = s.withColumn("confidence", sure).where(F.col("confidence") >= least)
    ratio = F.col("turns") / F.col("points")
    radius = F.col("radius")
    circular = (F.col("points") >= 8) & (radius > 20) & (F.col("spread") < F.pow(0.3 * radius, F.lit(2)))
    kind = F.when(F.col("path") < 10, "stationary").when((F.col("linearity") > 0.9) & (ratio < 0.1), "linear").when(ratio > 0.5, "erratic").when(circular, "circular").otherwise("curved")
    return s.select("stream", "ms", "seq", "points", "ms_span", "path", "turns", "speed", "linearity", kind.alias("kind"), "confidence")


def tab_changes(samples: DataFrame, least_us: int = 100_000, confidence: float = 0.8) -> DataFrame:
    """Changes of application or tab (columns app_name, tab), at least so long after the sample before, a tenth less sure
    than other changes."""
    return changes(samples, ("app_name", "tab"), least_us).withColumn("confidence", F.lit(confidence * 0.9))


def changes(samples: DataFrame, columns: tuple[str, ...], least_us: int = 100_000) -> DataFrame:
    """Samples in which one of the columns differs from the sample before, at least so long after it; was_<column>."""
    w = Window.partitionBy("stream").orderBy("us", "event_id")
    s = samples.select("*", *[F.lag(c).over(w).alias(f"was_{c}") for c in columns], (F.col("us") - F.lag("us").over(w)).alias("after_us"))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return s.where(differs & (F.col("after_us") >= least_us))


def navigation_types(visits: DataFrame) -> DataFrame:
    """visits with nav_type: back if the url is the second-last one, same or other domain than the last, else direct."""
    v = scans.lagged(visits, ("stream",), ("page_id",), {"__last": ("url", 1), "__second": ("url", 2)})
    last = F.regexp_extract("__last", r"^https?://([^/?#]+)", 1)
    kind = F.when(F.col("url") == F.col("__second"), "back").when(F.col("__last").isNull(), "direct").when(F.col("host") == last, "same_domain").otherwise("other_domain")
    return v.withColumn("nav_type", kind).drop("__last", "__second")


def transition_scores(events: DataFrame) -> DataFrame:
    """events with transition: other app 0.5, same app with another target 0.3, over 5 s since the last 0.2."""
    e = scans.lagged(events, ("stream",), ("us", "event_id"), {"__app": ("app_name", 1), "__target": ("target", 1), "__us": ("us", 1)})
    return e.withColumn("transition", _transition("app_name", "target", F.col("__app"), F.col("__target"), F.col("__us"))).drop("__app", "__target", "__us")


def transition(w: Window, app: str, title: str) -> Column:
    """How much a row differs from the one before in the window; 0 for the first."""
    return _transition(app, title, F.lag(app).over(w), F.lag(title).over(w), F.lag("us").over(w))


def _transition(app: str, title: str, was: Column, titled: Column, us: Column) -> Column:
    score = F.when(was != F.col(app), 0.5).when((was == F.col(app)) & (titled != F.col(title)), 0.3).otherwise(0.0) + F.when(F.col("us") - us > 5_000_000, 0.2).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def sections(regions: DataFrame, gap: float = 50.0) -> DataFrame:
    """Regions of a frame by y, split where the distance to the bottom of the one before is over gap."""
    w = Window.partitionBy("stream", "frame").orderBy("y", "x", "idx")
    fresh = F.when(F.col("y") - F.lag(F.col("y") + F.col("h")).over(w) > gap, 1).otherwise(0)
    out = regions.withColumn("__new", fresh).withColumn("section", F.sum("__new").over(w)).drop("__new")
    return out.groupBy("stream", "frame", "section").agg(F.count("*").alias("n"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))


def runs(rows: DataFrame, flag: Column, keys: tuple[str, ...], order: tuple[str, ...], least: int = 2) -> DataFrame:
    """Runs of at least `least` consecutive rows with the flag, the last run too: keys, run, n, first and last order value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("__flag", flag).withColumn("run", F.sum(F.when(F.col("__flag"), 0).otherwise(1)).over(w)).where("__flag")
    return out.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")).where(F.col("n") >= least)


#: How many of the newest each ring buffer holds.
RINGS = {"positions": 1000, "clicks": 100, "focus": 100, "correlation_events": 1000, "urls": 100}


def ring(rows: DataFrame, name: str, order: str, key: str) -> DataFrame:
    """What a ring buffer of each stream holds when all rows have come: the newest of them, by order, then key."""
    kept = scans.top_n(rows.select("stream", F.col(order).alias("at"), F.col(key).cast("string").alias("id")), ("stream",), (F.desc("at"), F.desc("id")), RINGS[name], ("id",))
    return kept.select(F.lit(name).alias("ring"), F.col("stream").cast("string").alias("stream"), "id", F.col("rank").cast("int").alias("rank"))


def recent(events: DataFrame, n: int = 5) -> DataFrame:
    """events with the types of the last n events of their stream, oldest first."""
    w = Window.partitionBy("stream").orderBy("us", "event_id").rowsBetween(-(n - 1), 0)
    return events.withColumn("recent", F.collect_list("type").over(w))


def rates(samples: DataFrame, value: str) -> DataFrame:
    """Change of a counter per second since the sample before."""
    w = Window.partitionBy("stream").orderBy("us", "event_id")
    seconds = (F.col("us") - F.lag("us").over(w)) / 1e6
    return samples.withColumn("rate", F.when(seconds > 0, (F.col(value) - F.lag(value).over(w)) / seconds)).where("rate is not null")


def field_changes(regions: DataFrame) -> DataFrame:
    """Fields (by box) whose text differs from the last time they were seen in the stream."""
    field = F.format_string("field_%d_%d_%d_%d", *[F.col(c).cast("int") for c in "xywh"])
    w = Window.partitionBy("stream", "field").orderBy("frame", "idx")
    r = regions.withColumn("field", field).withColumn("was", F.lag("text").over(w))
    return r.where(F.col("was").isNotNull() & (F.col("was") != F.col("text"))).select("stream", "field", "frame", "idx", "was", F.col("text").alias("now"))


def field_states(regions: DataFrame) -> DataFrame:
    """The last text of every field of a stream."""
    field = F.format_string("field_%d_%d_%d_%d", *[F.col(c).cast("int") for c in "xywh"])
    return regions.withColumn("field", field).groupBy("stream", "field").agg(F.max_by("text", F.struct("frame", "idx")).alias("text"), F.max("frame").alias("frame"))
