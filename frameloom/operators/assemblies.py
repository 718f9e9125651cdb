"""Operators put together: a frame's events, the correlation of all sources, frame metadata, regions of interest, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..llm.common import stored
from . import detection, joins, kernels, scans, sequences

#: Sizes between which a region of interest lies, and the priority of its type.
ROI_LEAST, ROI_MOST = (20, 10), (800, 200)
ROI_PRIORITY = {"text_field": 5, "button": 4, "dialog": 3, "label": 2, "menu_item": 1, "general": 0}
#: Confidence of what sources say that give none of their own.
SURE = {"movement": 0.9, "click": 0.56, "window": 0.8, "tab": 0.72, "focus": 0.8}
#: What the correlator calls the state that a source reports, and its confidence there if not the source's own.
STATES = {"movement": ("cursor_movement", 0.9), "click": ("click", None), "window": ("window_change", 0.9), "tab": ("tab_change", 0.85), "focus": ("focus_change", None)}
#: What the correlator calls a detected event; all others are changes of the screen.
DETECTED = {"field_change": "field_change", "navigation": "screen_change", "error_display": "error_display", "modal_appearance": "modal_appearance"}


def frame_events(regions: DataFrame, least: float = 0.7) -> DataFrame:
    """All events that the regions of frames with sure enough text give: field changes, data entered, error, dialog and submit
    words, error and dialog rules, dialogs by layout: stream, frame, idx, source, type, target, confidence."""
    numbered = joins.with_previous_frame(regions, least)
    sure = regions.where(F.col("confidence") >= least)
    out = ("stream", "frame", "idx", "source", "type", "target", "confidence")
    tagged = lambda df, source: df.withColumn("source", F.lit(source)).select(*out)
    changed = joins.field_change_events(numbered).withColumn("type", F.lit("field_change"))
    entered = joins.data_entry_events(numbered).withColumns({"type": F.lit("data_entry"), "target": F.lit("new_field")})
    words = detection.standalone_events(sure).withColumn("target", F.col("type"))
    dialogs = detection.layout_dialogs(kernels.clusters(sure)).select("stream", "frame", F.col("cluster").alias("idx"), F.lit("modal_appearance").alias("type"), F.concat_ws("_", "kind", "severity").alias("target"), F.col("score").alias("confidence"))
    found = [(changed, "delta"), (entered, "delta"), (words, "words"), (detection.error_modal_events(sure), "rules"), (dialogs, "layout")]
    union = tagged(*found[0])
    for df, source in found[1:]:
        union = union.unionByName(tagged(df, source))
    return union


def with_patterns(events: DataFrame) -> DataFrame:
    """frame_events() weighed by what the last frames held: confidence, and the pattern's name and share (M6's projection)."""
    p = kernels.temporal_patterns(events)
    name = F.when(F.col("share") > 0.7, "recurring").when(F.col("share") > 0.3, "occasional").when(F.col("share").isNotNull(), "rare")
    return p.withColumn("temporal_pattern", name)


def as_events(rows: DataFrame, source: str, target: Column, key: Column, us: Column | str = "us", confidence: Column | None = None, at: tuple[str, str] | None = None) -> DataFrame:
    """Any source's rows as detected events: stream, us, source, event_id, type, target, confidence, x, y."""
    sure = confidence if confidence is not None else F.lit(SURE[source])
    when = F.col(us) if isinstance(us, str) else us
    x, y = (F.col(c).cast("double") for c in at) if at else (F.lit(None).cast("double"),) * 2
    return rows.select(
        "stream", when.cast("long").alias("us"), F.lit(source).alias("source"), F.concat(F.lit(f"{source}-"), key.cast("string")).alias("event_id"), F.lit("navigation").alias("type"), target.alias("target"), sure.cast("double").alias("confidence"), x.alias("x"), y.alias("y"))


def source_events(samples: DataFrame, cursor: DataFrame, resting: dict[str, Column] | None = None, clock: Column | None = None, focus_us: int = 100_000) -> DataFrame:
    """What all sources detect, as one relation: changes of window, tab and focus, movements, clicks and trails of the cursor.

    samples: stream, us, event_id, app_name, window, tab; cursor: stream, ms, seq, x, y, whose time in microseconds is
    `clock`; resting: x and y as clicks are looked for in them, if not the cursor's. Detected events are all navigation.
    """
    clock = F.col("ms") * 1000 if clock is None else clock
    key, seq = F.col("event_id"), F.col("seq")
    # one shuffle of the cursor's samples, which its three detectors read
    cursor = cursor.select("stream", "ms", "seq", "x", "y").repartition("stream")
    rested = sequences.inferred_clicks(cursor.withColumns(resting or {}))
    found = [
        as_events(sequences.changes(samples, ("app_name", "window")), "window", F.concat(F.lit("window_"), F.col("app_name"), F.lit("_"), F.col("window")), key),
        as_events(sequences.tab_changes(samples), "tab", F.concat(F.lit("tab_"), F.col("app_name"), F.lit("_0")), key, confidence=F.col("confidence")),
        as_events(kernels.focus_changes(samples.select("stream", "event_id", "us", F.col("window").alias("app_name")), focus_us), "focus", F.concat(F.lit("focus_"), F.col("to_app")), key),
        as_events(sequences.movements(cursor), "movement", F.lit("cursor_movement"), seq, clock, at=("x", "y")),
        as_events(rested, "click", F.format_string("click_%d_%d", F.round("x").cast("int"), F.round("y").cast("int")), seq, clock, at=("x", "y")),
        as_events(sequences.trails(cursor, dealt=True), "trail", F.concat(F.lit("movement_trail_"), F.col("kind")), seq, clock, F.round("confidence", 6)),
    ]
    union = found[0]
    for df in found[1:]:
        union = union.unionByName(df)
    return union


def correlation_events(sources: DataFrame, screen: DataFrame) -> DataFrame:
    """What the correlator hears: each source's state under its own name, and all detected events, those of the screen too.

    screen: stream, us, event_id, type, confidence, metadata (a map, in which roi_x and roi_y tell a place, as text). The
    same detection stands in the result twice, as the state it changed and as a change of the screen; trails have no state.
    """
    out = ("stream", "us", "event_id", "type", "confidence", "x", "y")
    of = lambda i: F.create_map(*[F.lit(v) for k, s in STATES.items() if s[i] is not None for v in (k, s[i])])[F.col("source")]
    named = F.create_map(*[F.lit(v) for p in DETECTED.items() for v in p])
    none = F.lit(None).cast("double")
    heard = lambda i, t, c, x, y: F.struct(i.alias("event_id"), t.alias("type"), c.alias("confidence"), x.alias("x"), y.alias("y"))
    state = F.when(F.col("source").isin(*STATES), heard(F.col("event_id"), of(0), F.coalesce(of(1), F.col("confidence")), F.col("x"), F.col("y")))
    detected = heard(F.concat("event_id", F.lit("-detected")), F.coalesce(named[F.col("type")], F.lit("screen_change")), F.col("confidence"), none, none)
    # both from one reading of the sources
    told = sources.select("stream", "us", F.explode(F.array_compact(F.array(state, detected))).alias("e")).select("stream", "us", "e.*")
    place = lambda c: F.col("metadata")[c].try_cast("double")
    both = place("roi_x").isNotNull() & place("roi_y").isNotNull()
    seen = screen.select(
        "stream", "us", F.concat(F.lit("screen-"), F.col("event_id").cast("string")).alias("event_id"), F.coalesce(named[F.col("type")], F.lit("screen_change")).alias("type"), F.col("confidence").cast("double").alias("confidence"),
        F.when(both, place("roi_x")).alias("x"), F.when(both, place("roi_y")).alias("y"))
    return told.select(*out).unionByName(seen)


def rings(sources: DataFrame, screen: DataFrame, visits: DataFrame) -> DataFrame:
    """What all ring buffers of each stream hold when all rows have come (sequences.RINGS): ring, stream, id, rank. Sources are
    read once: each row goes to its source's ring and, as the correlator hears it, to that of correlation events.

    All rings of a stream have one order, so rows are shuffled once by stream, before they are told twice, sorted once, and
    ranked by counts of each ring's rows so far. visits: stream, page_id.
    """
    own = F.create_map(*[F.lit(v) for p in {"movement": "positions", "click": "clicks", "focus": "focus"}.items() for v in p])[F.col("source")]
    # the correlator hears a row as its state, if it has one, and as detected, and what the screen shows as it is; a state is its source's own row
    out = lambda key, ring, state, detected: ("stream", F.col("us").alias("at"), key.alias("id"), ring.alias("own"), state.alias("state"), detected.alias("detected"))
    told = sources.select(*out(F.col("event_id"), own, F.coalesce(F.col("source").isin(*STATES), F.lit(False)), F.lit(True)))
    seen = screen.select(*out(F.concat(F.lit("screen-"), F.col("event_id").cast("string")), F.lit(None).cast("string"), F.lit(True), F.lit(False)))
    # the number of parts is fixed: joined by their size before rows are told twice, they'd be too large to be sorted in memory
    dealt = told.unionByName(seen).repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stream")
    of = lambda key, ring: F.struct(key.alias("id"), ring.alias("own"))
    entries = F.array(F.when(F.col("state"), of(F.col("id"), F.col("own"))), F.when(F.col("detected"), of(F.concat("id", F.lit("-detected")), F.lit(None).cast("string"))))
    heard = dealt.select("stream", "at", F.explode(F.array_compact(entries)).alias("h")).select("stream", "at", "h.*")
    so_far = Window.partitionBy("stream").orderBy(F.desc("at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    inside = {"correlation_events": F.lit(True)} | {r: F.col("own") == r for r in ("positions", "clicks", "focus")}
    ranked = heard.select("*", *[F.count_if(test).over(so_far).cast("int").alias(f"n_{r}") for r, test in inside.items()])
    kept = F.array(*[F.when(test & (F.col(f"n_{r}") <= sequences.RINGS[r]), F.struct(F.lit(r).alias("ring"), F.col(f"n_{r}").alias("rank"))) for r, test in inside.items()])
    kept = ranked.select(F.col("stream").cast("string").alias("stream"), "id", F.explode(F.array_compact(kept)).alias("r")).select("r.ring", "stream", "id", "r.rank")
    return kept.unionByName(sequences.ring(visits, "urls", "page_id", "page_id"))


def correlations(events: DataFrame, horizon_us: int, radius: float = 50.0) -> DataFrame:
    """Links of the events of the last horizon of each stream, by time, place and cause; none for a stream with one event.
    Events have event_id, us, type, confidence, x, y: stream, a_id, b_id, kind, confidence."""
    w = Window.partitionBy("stream")
    e = events.select("stream", "us", "event_id", "type", "confidence", "x", "y").withColumn("__last", F.max("us").over(w)).where(F.col("us") >= F.col("__last") - horizon_us).drop("__last")
    # three kinds of links read the last events, five times in all: they are found once
    e = stored(e, "last-events")
    t = joins.temporal_links(e, horizon_us).select(F.col("a_stream").alias("stream"), F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), F.lit("temporal").alias("kind"), "confidence")
    p = joins.typed_spatial_links(e, radius).select("stream", "a_id", "b_id", F.lit("spatial").alias("kind"), "confidence")
    c = joins.causal_links(e, horizon_us).select("stream", F.col("event_id").alias("a_id"), F.col("next_id").alias("b_id"), F.lit("causal").alias("kind"), F.col("causal").alias("confidence"))
    return t.unionByName(p).unionByName(c)


def navigation_metrics(events: DataFrame) -> DataFrame:
    """Per stream: events by kind, and the mean processing time (column took_ms) in whole ms a navigation event."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    return events.groupBy("stream").agg(F.count("*").alias("frames"), n("navigation").alias("navigations"), n("click").alias("clicks"), F.sum("took_ms").alias("took")).select(
        "stream", "frames", "navigations", "clicks", F.expr("CASE WHEN navigations + clicks > 0 THEN took div (navigations + clicks) END").alias("avg_ms"))


def frame_metadata(frames: DataFrame, samples: DataFrame, within_us: int = 1_000_000) -> DataFrame:
    """frames (stream, us, frame_id) with the application of the last window sample up to a second before, else Unknown."""
    f = frames.select("stream", "us", "frame_id", F.lit(None).cast("string").alias("app_name"), F.lit(None).cast("long").alias("at"))
    s = samples.select("stream", "us", F.lit(None).cast("long").alias("frame_id"), "app_name", F.col("us").alias("at"))
    w = Window.partitionBy("stream").orderBy("us", F.col("frame_id").isNotNull())
    last = F.last(F.when(F.col("at").isNotNull(), F.struct("app_name", "at")), ignorenulls=True).over(w)
    j = f.unionByName(s).withColumn("seen", last).where("frame_id is not null")
    near = F.col("us") - F.col("seen.at") <= within_us
    return j.select("stream", "frame_id", F.when(near, F.coalesce("seen.app_name", F.lit("Unknown"))).otherwise("Unknown").alias("app_name"))


def interest(regions: DataFrame, screen_w: float = 1920.0, screen_h: float = 1080.0, most: int = 10) -> DataFrame:
    """Regions of interest of each frame, cut to the screen: type by shape and place, priority, the first ten by priority.
    A column has_text tells text regions from rectangles; without it all have text."""
    if "has_text" not in regions.columns:
        regions = regions.withColumn("has_text", F.lit(True))
    x, y = F.greatest(F.col("x"), F.lit(0.0)), F.greatest(F.col("y"), F.lit(0.0))
    r = regions.withColumns({"w": F.least(F.col("x") + F.col("w"), F.lit(screen_w)) - x, "h": F.least(F.col("y") + F.col("h"), F.lit(screen_h)) - y, "x": x, "y": y}).where("w > 0 and h > 0")
    r = r.where(F.col("w").between(ROI_LEAST[0], ROI_MOST[0]) & F.col("h").between(ROI_LEAST[1], ROI_MOST[1]) & (F.col("w") * F.col("h") >= 200))
    kind = F.when(F.coalesce(F.col("has_text"), F.lit(True)), geometry.region_type(geometry.box(), screen_w, screen_h)).otherwise(geometry.rectangle_type(geometry.box(), screen_w, screen_h))
    r = r.withColumn("kind", kind).withColumn("priority", F.create_map(*[F.lit(v) for p in ROI_PRIORITY.items() for v in p])[F.col("kind")])
    w = Window.partitionBy("stream", "frame").orderBy(F.desc("priority"), "idx")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("stream", "frame", "idx", "kind", "priority", "rank")


def app_key(metadata: Column) -> Column:
    """The first of app_name, application, bundle_id that a map has."""
    return F.coalesce(metadata["app_name"], metadata["application"], metadata["bundle_id"])


def context_of(text: Column, start: Column, end: Column, reach: int = 20) -> Column:
    """A match with up to `reach` characters on either side."""
    first = F.greatest(start - reach, F.lit(0))
    return F.substring(text, first + 1, end + reach - first)


def references(sessions: DataFrame, grouped: DataFrame, linked: DataFrame, correlated: DataFrame, keys: tuple[str, ...], direct: int = 5, near: int = 3) -> DataFrame:
    """What a session rests on: its events' own frames, the first `direct` of them, and the best `near` correlated ones."""
    own = grouped.select(*keys, "event_id").join(linked.select("event_id", "frame_id"), "event_id").groupBy(*keys).agg(F.sort_array(F.collect_set("frame_id")).alias("frames"))
    other = correlated.where(F.col("rank") <= near).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "frame_id"))), lambda s: s["frame_id"]).alias("correlated"))
    j = sessions.select(*keys).join(own, list(keys), "left").join(other, list(keys), "left")
    none = F.array().cast("array<bigint>")
    return j.select(*keys, F.coalesce(F.size("frames"), F.lit(0)).alias("n_frames"), F.coalesce(F.slice("frames", 1, direct), none).alias("direct"), F.coalesce("correlated", none).alias("correlated"))


def related_sessions(grouped: DataFrame, keys: tuple[str, ...], least: float = 0.6, most: int = 5, group: str = "stream") -> DataFrame:
    """For each session the others of its stream whose words (types and apps of events) are like its own, best first.

    Distinct sets of words are paired, not sessions: two of a stream that share a word and could reach the threshold by
    their sizes. Of each set the first sessions by key are all that any session can want of it, one more than `most`.
    """
    own = [k for k in keys if k != group]
    sets = grouped.select(*keys, F.explode(F.array("type", "app_name")).alias("word")).where("word is not null").groupBy(*keys).agg(F.sort_array(F.collect_set("word")).alias("words"))
    firsts = scans.top_n(sets, (group, "words"), tuple(F.col(k) for k in own), most + 1, keys).select(group, F.col("words").alias("b_words"), *[F.col(k).alias(f"b_{k}") for k in own])
    distinct = sets.select(group, "words").distinct()
    # two sets that are like enough have their first common word among the first words of both, so many as may be missing and one:
    # they meet there once, and no pair is counted together
    n = F.size("words")
    listed = distinct.select(group, "words", n.alias("n"), F.explode(F.slice("words", 1, n - F.ceil(least * n - 1e-9).cast("int") + 1)).alias("word"))
    a, b = listed.select(group, "word", F.col("words").alias("a_words"), F.col("n").alias("a_n")), listed.select(group, "word", F.col("words").alias("b_words"), F.col("n").alias("b_n"))
    common = F.array_intersect("a_words", "b_words")
    j = a.join(b, [group, "word"]).where((F.col("a_n") >= least * F.col("b_n")) & (F.col("b_n") >= least * F.col("a_n")) & (F.get(common, F.lit(0)) == F.col("word"))).withColumn("both", F.size(common))
    j = j.withColumn("similarity", F.col("both") / (F.col("a_n") + F.col("b_n") - F.col("both"))).where(F.col("similarity") >= least).select(group, "a_words", "b_words", "similarity")
    # sessions of one set have the same others, but for themselves: they are ranked once a set, one more than `most`
    other = F.struct(*[F.col(f"b_{k}").alias(k) for k in own])
    ranked = j.join(firsts, [group, "b_words"]).select(group, "a_words", "similarity", other.alias("other"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(group, "a_words").orderBy(F.desc("similarity"), "other"))).where(F.col("rank") <= most + 1)
    best = ranked.groupBy(group, "a_words").agg(F.sort_array(F.collect_list(F.struct("rank", "similarity", "other"))).alias("best"))
    met = sets.select(group, F.col("words").alias("a_words"), F.struct(*own).alias("own")).join(best, [group, "a_words"])
    near = F.slice(F.filter("best", lambda b: b["other"] != F.col("own")), 1, most)
    met = met.select(group, "own", F.posexplode(near).alias("at", "b"))
    return met.select(group, *[F.col(f"own.{k}").alias(f"a_{k}") for k in own], *[F.col(f"b.other.{k}").alias(f"b_{k}") for k in own], F.round("b.similarity", 6).alias("similarity"), (F.col("at") + 1).cast("int").alias("rank"))


def engine_choice(regions: DataFrame, least: float = 0.4, largest: float = 2000.0) -> DataFrame:
    """Per frame (columns width, height, a_confidence, a_text): engine b for a large one, a if it is sure enough and read
    anything, else b."""
    g = regions.groupBy("frame").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.avg("a_confidence").alias("sure"), F.bool_or(F.length("a_text") > 0).alias("read"))
    return g.select("frame", F.when((F.col("width") > largest) | (F.col("height") > largest), "b").when((F.col("sure") >= least) & F.col("read"), "a").otherwise("b").alias("engine"))


def chosen_texts(regions: DataFrame, least: float = 0.4, largest: float = 2000.0) -> DataFrame:
    """frame, idx, engine, text: each region as the engine read it that was chosen for its frame (columns a_text, b_text)."""
    j = regions.join(engine_choice(regions, least, largest), "frame")
    return j.select("frame", "idx", "engine", F.when(F.col("engine") == "a", F.col("a_text")).otherwise(F.col("b_text")).alias("text"))


def read_batch(regions: DataFrame, origins: DataFrame, least: float = 0.3) -> DataFrame:
    """Recognised regions sure enough to keep, moved by the origin (ox, oy) of the part of the frame they were read in."""
    j = regions.where(F.col("confidence") >= least).join(origins, ["stream", "frame"], "left")
    return j.withColumns({"x": F.col("x") + F.coalesce("ox", F.lit(0.0)), "y": F.col("y") + F.coalesce("oy", F.lit(0.0))}).drop("ox", "oy")


def keyframe_rows(frames: DataFrame, changes: DataFrame, metadata: DataFrame) -> DataFrame:
    """The indexer's rows: each keyframe with its hash's last 16 bits, entropy, scene change if any, and application."""
    return frames.join(changes.select("stream", "frame", "change_type"), ["stream", "frame"], "left").join(metadata.select(F.col("frame_id").alias("frame"), "app_name"), "frame", "left").withColumn("app_name", F.coalesce("app_name", F.lit("Unknown")))


def usage(samples: DataFrame) -> DataFrame:
    """Busy share of the cores, and shares of memory and disk in use, in percent, per stream."""
    share = lambda a, b: F.round(100 * F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 6)
    return samples.groupBy("stream").agg(share("busy", "ticks").alias("cpu"), share("mem_used", "mem_all").alias("memory"), share("disk_used", "disk_all").alias("disk"))


def edited_rules(rules: DataFrame, added: DataFrame, removed: DataFrame, key: str = "app_name") -> DataFrame:
    """A rule table after additions, which replace what has their key, and removals."""
    kept = rules.join(added.select(key), key, "left_anti")
    return kept.unionByName(added).join(removed.select(key), key, "left_anti")


def enabled_plugins(manifest: DataFrame, settings: DataFrame) -> DataFrame:
    """Plugins with the settings that override their defaults; those switched on."""
    j = manifest.join(settings.select("plugin", F.col("enabled").alias("__set")), "plugin", "left")
    return j.withColumn("enabled", F.coalesce("__set", "enabled")).drop("__set").where("enabled")


def orphan_segments(files: DataFrame, now: int, least: int = 1_000_000, young_s: int = 300) -> DataFrame:
    """Segments left behind by a crash: small, and written in the last five minutes."""
    return files.where((F.col("length") < least) & (F.col("mtime") > now - young_s))
