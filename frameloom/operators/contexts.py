"""What a session stands in and rests on: the spans around it, and the confidence that its frames and events hand up to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import evidence, joins, sequences, stories, summaries

#: How far before and after a session its context reaches, in seconds, and how many spans of it count.
BEFORE_S, AFTER_S, MOST = 3600.0, 1800.0, 5
#: What a frame is taken for that has no confidence or quality of its own, and how near frames stand by each other.
OCR, QUALITY, NEAR_US = 0.8, 0.9, 30_000_000
#: Shares of events, frames, time and place in a summary's confidence.
SHARES = (0.4, 0.3, 0.2, 0.1)


def _mean(parts: Column) -> Column:
    known = F.array_compact(parts)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, p: a + p) / F.size(known)).otherwise(0.0)


def session_words(sessions: DataFrame, grouped: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, words: a session's type and application, the types of its events, and the words of their targets and values."""
    said = [text.keywords(F.coalesce(F.col(c), F.lit(""))) for c in ("target", "value") if c in grouped.columns]
    own = grouped.select(*keys, F.explode(F.concat(F.array("type"), *said)).alias("word")).groupBy(*keys).agg(F.collect_set("word").alias("words"))
    j = sessions.select(*keys, "session_type", "primary_app").join(own, list(keys))
    return j.select(*keys, F.array_compact(F.array_union(F.col("words"), F.array("session_type", F.lower("primary_app")))).alias("words"))


def span_words(spans: DataFrame) -> Column:
    """A span's kind and tags, the words of its title, and the first ten of its summary, if it has one."""
    said = F.concat(F.array(F.lower("kind")), F.transform("tags", F.lower), text.keywords(F.col("title")))
    more = F.slice(F.filter(text.tokens(F.coalesce(F.col("summary"), F.lit(""))), lambda w: F.length(w) > 2), 1, 10) if "summary" in spans.columns else F.array().cast("array<string>")
    return F.array_distinct(F.concat(said, more))


def around(sessions: DataFrame, spans: DataFrame, keys: tuple[str, ...], before_s: float = BEFORE_S, after_s: float = AFTER_S, most: int = MOST) -> DataFrame:
    """The spans before and after each session, the nearest `most` of either side: keys, side, gap, and the span's columns.

    spans: span_id, stream, kind, title, tags, t_start and t_end in seconds. Both sides come from joins on time cells.
    """
    s = sessions.select(*keys, F.concat_ws("-", *keys).alias("span_id"), (F.col("start_us") / 1e6).alias("t_start"), (F.col("end_us") / 1e6).alias("t_end"))
    b = spans.withColumn("words", span_words(spans)).select("span_id", "stream", "kind", "title", "tags", "words", "t_start", "t_end")
    side = lambda within, forward: joins.asof_nearest(s, b, within, most, forward).select(*[F.col(f"a_{k}").alias(k) for k in keys], F.lit("after" if forward else "before").alias("side"), "gap", F.col("rank"), *[F.col(f"b_{c}").alias(c) for c in ("span_id", "kind", "title", "tags", "words")])
    return side(before_s, False).unionByName(side(after_s, True))


def workflow_continuity(sessions: DataFrame, grouped: DataFrame, spans: DataFrame, keys: tuple[str, ...], before_s: float = BEFORE_S, after_s: float = AFTER_S, most: int = MOST) -> DataFrame:
    """Per session: whether it is part of a larger workflow, its phase in it, continuity, and related activities.

    Continuity is the mean of what is known of: nearness of the span before and of the one after, likeness of the session's
    words and each span's (one part, over all spans), and 0.8 if a span is tagged with the session's application; 0 if
    nothing is known. Related activities are the spans' kinds and tags, the more frequent first, then by name. titles: of
    the spans before, the nearest first.
    """
    near = around(sessions, spans, keys, before_s, after_s, most).join(session_words(sessions, grouped, keys).withColumnRenamed("words", "own"), list(keys)).join(sessions.select(*keys, "primary_app"), list(keys))
    like = F.size(F.array_intersect("own", "words")) / F.size(F.array_union("own", "words"))
    of = lambda side, c: F.when(F.col("side") == side, F.col(c))
    tagged = F.coalesce(F.array_contains("tags", F.col("primary_app")), F.lit(False))
    g = near.groupBy(*keys).agg(
        F.min(of("before", "gap")).alias("gap_before"), F.min(of("after", "gap")).alias("gap_after"), F.avg(like).alias("alike"), F.bool_or(tagged).alias("tagged"),
        F.collect_list(of("before", "kind")).alias("was"), F.collect_list(of("after", "kind")).alias("will"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == "before", F.struct("rank", "title")))), lambda t: t["title"]).alias("titles"), F.flatten(F.collect_list(F.concat(F.array("kind"), "tags"))).alias("said"),
    )
    # at most 2 * most spans' kinds and tags: counted in place
    counted = F.transform(F.array_distinct("said"), lambda a: F.struct((-F.size(F.filter("said", lambda b: b == a))).alias("n"), a.alias("a")))
    j = sessions.select(*keys, "session_type").join(g.withColumn("related", F.transform(F.array_sort(counted), lambda p: p["a"])).drop("said"), list(keys), "left")
    none = F.array().cast("array<string>")
    or_none = lambda c: F.coalesce(F.col(c), none)
    parts = F.array(F.greatest(F.lit(0.0), 1 - F.col("gap_before") / before_s), F.greatest(F.lit(0.0), 1 - F.col("gap_after") / after_s), F.col("alike"), F.when(F.col("tagged"), 0.8))
    return j.select(
        *keys, (F.size(or_none("was")) + F.size(or_none("will")) > 0).alias("part_of_workflow"), summaries.workflow_phase(F.col("session_type"), or_none("was"), or_none("will")).alias("phase"),
        F.round(_mean(parts), 6).alias("continuity"), or_none("related").alias("related"), or_none("titles").alias("titles"),
    )


def frame_confidence(frames: DataFrame, near_us: int = NEAR_US) -> DataFrame:
    """frames (frame_id, stream, us, app_name, title, ocr, quality) with ocr and quality known, stability, relevance.

    Stability is the share of the frames within half a minute that show the same application, 0.5 without any: two range
    windows of a minute, no join.
    """
    apart = lambda *by: Window.partitionBy("stream", *by).orderBy("us").rangeBetween(-near_us, near_us)
    others, same = F.count("*").over(apart()) - 1, F.count("*").over(apart("app_name")) - 1
    return frames.withColumns({
        "ocr": F.coalesce(F.col("ocr").cast("double"), F.lit(OCR)), "quality": F.coalesce(F.col("quality").cast("double"), F.lit(QUALITY)),
        "stability": F.when(others > 0, same / others).otherwise(0.5), "relevance": evidence.relevance(F.col("app_name"), F.col("title")),
    })


def event_confidence(key_events: DataFrame, frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per key event (evidence_frames: ids): its confidence, frames named, temporal and spatial consistency; and what its
    frames hand up: how many are known, and the sum of their ocr confidence.

    Temporal: 0.4 of five frames and 0.6 of the event's own confidence. Spatial: 0 without known frames, else the mean of 1
    for one application (0.5 for more) and 1 for up to two titles (0.7 for more). A frame named twice is known once for
    consistency and twice for the sum.
    """
    named = key_events.select(*keys, "event_id", "us", "confidence", F.size("evidence_frames").alias("named"), F.explode_outer("evidence_frames").alias("frame_id"))
    j = named.join(frames.select("frame_id", F.col("app_name").alias("app"), "title", "ocr"), "frame_id", "left")
    g = j.groupBy(*keys, "event_id").agg(
        F.first("confidence").alias("confidence"), F.greatest(F.first("named"), F.lit(0)).alias("named"), F.count("ocr").alias("known"), F.sum("ocr").alias("ocr"), F.countDistinct("app").alias("apps"), F.countDistinct("title").alias("titles"))
    temporal = 0.4 * F.least(F.col("named") / 5, F.lit(1.0)) + 0.6 * F.col("confidence")
    spatial = (F.when(F.col("apps") == 1, 1.0).otherwise(0.5) + F.when(F.col("titles") <= 2, 1.0).otherwise(0.7)) / 2
    return g.withColumn("temporal", temporal).withColumn("spatial", F.when(F.col("known") > 0, spatial).otherwise(0.0))


def propagation(sessions: DataFrame, key_events: DataFrame, frames: DataFrame, keys: tuple[str, ...], overall: Column) -> DataFrame:
    """Confidence handed up from frames over events to summaries, per session, with `overall`, the summary's own.

    Each level is an aggregate of the one below: frames to their events, events to their summary. A summary's is 0.4 of its
    key events' mean, 0.3 of their frames', 0.2 of temporal and 0.1 of spatial consistency. completeness: key events of all.
    factors: (name, impact) of what speaks for or against it; at their bounds temporal consistency counts to 12 places, so
    that the order of its sum doesn't decide. trace_confidence: of the walk from the summary over its key events to their
    frames, where the summary counts 0.1, an event 0.3 and a frame 0.6, per step.
    """
    g = event_confidence(key_events, frames, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("event_confidence"), (F.sum("ocr") / F.sum("known")).alias("frame_confidence"), F.sum("known").alias("n_frames"), F.sum("confidence").alias("sure"), F.sum("ocr").alias("seen"), F.avg("temporal").alias("temporal"), F.avg("spatial").alias("spatial"))
    j = sessions.select(*keys, "seconds", "n_events", overall.alias("overall")).join(g, list(keys), "left")
    named = ("event_confidence", "frame_confidence", "temporal", "spatial")
    j = j.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in named} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "n_frames")})
    total = F.lit(0.0)
    for share, c in zip(SHARES, named):
        total = total + share * F.col(c)
    says = lambda test, name, impact: F.when(test, F.struct(F.lit(name).alias("name"), F.lit(impact).alias("impact")))
    n, t, s = F.col("n"), F.round("temporal", 12), F.col("seconds")
    factors = F.array_compact(F.array(
        says(n >= 5, "sufficient_events", 0.2), says(n < 3, "insufficient_events", -0.3), says(t > 0.8, "high_temporal_consistency", 0.15), says(t < 0.5, "low_temporal_consistency", -0.2),
        says(s > 300, "substantial_session", 0.1), says(s < 60, "brief_session", -0.1)))
    rounded = [F.round(c, 6).alias(name) for name, c in [*((c, F.col(c)) for c in named), ("completeness", n / F.col("n_events")), ("confidence", total)]]
    walk = (0.1 * total + 0.3 * F.coalesce("sure", F.lit(0.0)) + 0.6 * F.coalesce("seen", F.lit(0.0))) / (1 + n + F.col("n_frames"))
    return j.select(*keys, F.col("n").alias("n_key_events"), "n_frames", *rounded, "overall", F.round(walk, 12).alias("trace_confidence"), factors.alias("factors"))


def coherent(events: DataFrame, gap_us: int, most: int = 50, threshold: float = 0.7) -> DataFrame:
    """events with island: per stream a new one after a gap, at the event limit, and where the context changes."""
    split = sequences.context_split(events, gap_us, threshold, most)
    w = Window.partitionBy("stream").orderBy("us", "event_id")
    before = F.lag(F.struct("island", "chunk", "context")).over(w)
    fresh = F.when(F.struct("island", "chunk", "context") == before, 0).otherwise(1)
    out = split.withColumn("__new", fresh).drop("island", "chunk", "context", "similarity")
    return out.withColumn("island", F.sum("__new").over(w)).drop("__new")


def summarize(events: DataFrame, spans: DataFrame, from_us: int, to_us: int, gap_us: int = 300_000_000, most: int = 50, threshold: float = 0.7, before_s: float = BEFORE_S, after_s: float = AFTER_S) -> DataFrame:
    """One row per session of the events in the closed range: what it was, what it came to, what it stands in, how sure.

    Events are grouped by gaps, the event limit and context; groups with enough events over enough time are sessions. An
    empty range gives no rows.
    """
    keys = ("stream", "island")
    grouped = coherent(events.where(F.col("us").between(from_us, to_us)), gap_us, most, threshold)
    told = sequences.sessions(grouped)
    context = workflow_continuity(told, grouped, spans, keys, before_s, after_s)
    kind = grouped.groupBy(*keys).agg(F.mode("type", True).alias("primary_type"))
    said = summaries.narratives(grouped, told, keys)
    j = summaries.outcomes(told).join(context, list(keys)).join(kind, list(keys)).join(said, list(keys))
    return summaries.session_confidence(j, F.col("continuity")).select(
        *keys, "start_us", "end_us", "n_events", "primary_app", "session_type", "primary_type", "part_of_workflow", "phase", "continuity", "related", "outcomes", "confidence", "narrative")


def playbook_rollup(sessions: DataFrame, context: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = ("stream",), least_events: int = 3) -> DataFrame:
    """A playbook of all sessions of `by` with enough events: type, duration, events, difficulty, distinct outcomes and
    prerequisites (sorted).

    Prerequisites are the spans before, the applications, and the data of forms. Sets are collected per playbook: phrases
    of a few kinds, with their numbers, and titles of at most five spans a session.
    """
    s = summaries.outcomes(sessions.where(F.col("n_events") >= least_events)).join(context.select(*keys, "titles"), list(keys), "left")
    needs = F.concat(F.transform(F.coalesce("titles", F.array().cast("array<string>")), lambda t: F.concat(F.lit("Complete: "), t)), F.array_compact(F.array(F.concat(F.lit("Have "), F.col("primary_app"), F.lit(" installed and accessible")), F.when(F.col("session_type") == "form_filling", "Have required form data available"))))
    distinct = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))
    g = s.withColumn("needs", needs).groupBy(*by).agg(
        F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"), F.sum("seconds").alias("seconds"), F.min_by("primary_app", F.struct("start_us", *keys)).alias("app"), F.collect_set("session_type").alias("types"), distinct("outcomes").alias("outcomes"), distinct("needs").alias("prerequisites"))
    has = lambda t: F.array_contains("types", t)
    one = F.when(has("form_filling"), "form_workflow").when(has("mixed"), "general").otherwise(F.get("types", F.lit(0)))
    kind = F.when(F.size("types") == 1, one).when(has("form_filling") & has("data_entry"), "form_workflow").when(has("development"), "development").otherwise("general")
    g = g.withColumn("type", kind).withColumn("difficulty", summaries.difficulty(F.col("n_events"), F.col("seconds")))
    n = F.col("n_sessions").cast("string")
    told = F.concat(
        F.lit("This playbook recreates a "), F.replace("type", F.lit("_"), F.lit(" ")), F.lit(" workflow based on "), n, F.when(F.col("n_sessions") == 1, " recorded session with ").otherwise(" recorded sessions with "), F.col("n_events").cast("string"),
        F.lit(" total actions. Follow these steps to reproduce the same workflow."))
    named = F.when(F.col("type") == "form_workflow", "form_filling").otherwise(F.col("type"))
    return g.withColumns({"title": stories.title(named, F.col("app")), "description": told}).drop("types", "app")
