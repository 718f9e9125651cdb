"""The query surface: lookups and statistics over regions, events, spans, audit rows and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_frame(regions: DataFrame, frame) -> DataFrame:
    return regions.where(F.col("frame") == frame)


def by_text(regions: DataFrame, part: str) -> DataFrame:
    """Rows whose text holds `part` in any case, best first. % and _ stand for themselves."""
    return regions.where(F.contains(F.lower("text"), F.lower(F.lit(part)))).orderBy(F.desc("confidence"), "frame", "idx")


def by_confidence(rows: DataFrame, least: float, *ties: str) -> DataFrame:
    return rows.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), *ties)


def by_language(regions: DataFrame, language: str) -> DataFrame:
    return regions.where(F.col("language") == language)


def events_by(events: DataFrame, column: str, value) -> DataFrame:
    return events.where(F.col(column) == value).orderBy(F.desc("us"), "event_id")


def events_between(events: DataFrame, start_us: int, end_us: int) -> DataFrame:
    return events.where(F.col("us").between(start_us, end_us)).orderBy("us", "event_id")


def event_type(name: Column) -> Column:
    """A known type's name; any other is a field change."""
    return F.when(name.isin("field_change", "form_submission", "modal_appearance", "error_display", "navigation", "data_entry"), name).otherwise("field_change")


def spans_where(spans: DataFrame, start: int | None = None, end: int | None = None, kinds=None, tags=(), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Spans that touch [start, end], of one of the kinds, with all tags, latest first; offset counts only with a limit."""
    out = spans
    if start is not None:
        out = out.where(F.col("t_end") >= start)
    if end is not None:
        out = out.where(F.col("t_start") <= end)
    if kinds:
        out = out.where(F.col("kind").isin(list(kinds)))
    for tag in tags:
        out = out.where(F.array_contains("tags", tag))
    out = out.orderBy(F.desc("t_start"), "span_id")
    return out.offset(offset).limit(limit) if limit is not None else out


def overlapping(spans: DataFrame, start: int, end: int) -> DataFrame:
    return spans.where((F.col("t_start") <= end) & (F.col("t_end") >= start)).orderBy("t_start", "span_id")


def upsert(store: DataFrame, changes: DataFrame, key: str = "span_id") -> DataFrame:
    """The store with the changed rows in place of those with their keys."""
    return store.join(changes, key, "left_anti").unionByName(changes.select(store.columns))


def update(store: DataFrame, changes: DataFrame, key: str = "span_id") -> DataFrame:
    """Like upsert(), but a key that the store lacks is an error, and created_at stays."""
    if not changes.join(store, key, "left_anti").isEmpty():
        raise KeyError(f"no such {key}")
    if "created_at" in store.columns:
        changes = changes.drop("created_at").join(store.select(key, "created_at"), key)
    return upsert(store, changes, key)


def delete(store: DataFrame, keys: DataFrame, key: str = "span_id") -> DataFrame:
    if not keys.join(store, key, "left_anti").isEmpty():
        raise KeyError(f"no such {key}")
    return store.join(keys, key, "left_anti")


def statistics(rows: DataFrame, by: str) -> DataFrame:
    """Per value of `by`: rows and mean confidence, most rows first."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence")).orderBy(F.desc("n"), by)


def totals(rows: DataFrame) -> DataFrame:
    """Rows and mean confidence, 0 of no rows."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg("confidence"), 6), F.lit(0.0)).alias("avg_confidence"))


def logs_where(logs: DataFrame, levels=None, categories=None, text: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Log rows that meet every condition given, the text in message, category or function."""
    out = logs
    if levels:
        out = out.where(F.col("level").isin(list(levels)))
    if categories:
        out = out.where(F.col("category").isin(list(categories)))
    if text:
        inside = lambda c: F.contains(F.lower(c), F.lower(F.lit(text)))
        out = out.where(inside("message") | inside("category") | inside("function"))
    if start is not None:
        out = out.where(F.col("us") >= start)
    if end is not None:
        out = out.where(F.col("us") <= end)
    return out


def log_statistics(logs: DataFrame, as_of_us: int) -> DataFrame:
    """Per level: rows, those of the last hour, the oldest and newest."""
    recent = F.col("us") >= as_of_us - 3_600_000_000
    return logs.groupBy("level").agg(F.count("*").alias("n"), F.count_if(recent).alias("last_hour"), F.min("us").alias("oldest"), F.max("us").alias("newest"))


def help_where(items: DataFrame, text: str) -> DataFrame:
    inside = lambda c: F.contains(F.lower(c), F.lower(F.lit(text)))
    return items.where(inside(F.col("title")) | inside(F.col("content")) | F.exists("keywords", inside))


def allowed_apps(samples: DataFrame, blocked: DataFrame, allowed: DataFrame, app: str = "app_name") -> DataFrame:
    """Samples of apps that aren't blocked and, if any app is allowed by name, are among the allowed ones."""
    out = samples.join(blocked.select(app).distinct(), app, "left_anti")
    return out if allowed.isEmpty() else out.join(allowed.select(app).distinct(), app, "left_semi")


def allowed_on_displays(samples: DataFrame, blocked: DataFrame, allowed: DataFrame, on_display: DataFrame, app: str = "app_name") -> DataFrame:
    """Samples (with display) that may be captured where they are shown. on_display: display, app, blocked (or allowed).

    A display with rules of its own blocks what it blocks, and, if it allows any app by name, captures those alone; else the
    rules for all displays hold. Rules are one row a display and app; each kind is met by one join.
    """
    own = on_display.groupBy("display").agg(F.bool_or(~F.col("blocked")).alias("__names"))
    rules = on_display.groupBy("display", app).agg(F.bool_or("blocked").alias("__stops"), F.bool_or(~F.col("blocked")).alias("__lets"))
    everywhere = blocked.select(app).distinct().withColumn("__blocked", F.lit(True))
    names = allowed.select(app).distinct().withColumn("__allowed", F.lit(True))
    j = samples.join(own, "display", "left").join(rules, ["display", app], "left").join(everywhere, app, "left").join(names, app, "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    all_displays = ~is_("__blocked") & (F.lit(allowed.isEmpty()) | is_("__allowed"))
    kept = F.when(is_("__stops"), False).when(is_("__names"), is_("__lets")).otherwise(all_displays)
    return j.where(kept).select(*samples.columns)


def plugin_routes(samples: DataFrame, plugins: DataFrame) -> DataFrame:
    """Samples with each plugin whose pattern is their bundle, or its start if the pattern ends in a star."""
    pattern = F.col("pattern")
    own = plugins.columns
    exact = samples.join(plugins.where(~pattern.endswith("*")), F.col("bundle") == pattern)
    # starts meet by their length: a bundle is cut to each length that a pattern has
    starts = plugins.where(pattern.endswith("*")).withColumn("__start", F.expr("left(pattern, length(pattern) - 1)"))
    lengths = [r["n"] for r in starts.select(F.length("__start").alias("n")).distinct().collect()]  # a few numbers, however many plugins
    cut = samples.withColumn("__cut", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.left("bundle", F.lit(n)).alias("start")) for n in lengths]))) if lengths else None
    if cut is None:
        return exact
    starred = cut.join(starts, (F.col("__cut.start") == F.col("__start")) & (F.col("__cut.n") == F.length("__start")))
    return exact.unionByName(starred.select(*samples.columns, *own))
