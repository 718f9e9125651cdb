"""Reports and playbooks as text, a piece per session, so that a report of any length is a column and not a string in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

FORMATS = ("markdown", "csv", "json", "html")


def _escaped(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _quoted(value: Column) -> Column:
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def rows(told: DataFrame) -> DataFrame:
    """The columns of a report's table: session, type, start, duration, events, confidence, narrative."""
    return told.select(F.concat_ws("-", "stream", "island").alias("session"), "session_type", F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"), text.duration_hms(F.col("seconds")).alias("duration"), "n_events", "avg_confidence", "narrative")


def piece(form: str) -> Column:
    """A row of rows() in one of FORMATS."""
    c = F.col
    if form == "markdown":
        return F.concat(F.lit("## "), c("session"), F.lit(" ("), c("session_type"), F.lit(")\n\n* start: "), c("start"), F.lit("\n* duration: "), c("duration"), F.lit("\n* events: "), c("n_events").cast("string"), F.lit("\n\n"), c("narrative"), F.lit("\n"))
    if form == "html":
        return F.concat(F.lit("<section><h2>"), _escaped(c("session")), F.lit("</h2><p>"), _escaped(c("duration")), F.lit("</p><p>"), _escaped(c("narrative")), F.lit("</p></section>"))
    if form == "csv":
        return F.concat_ws(",", *[_quoted(c(n)) for n in ("session", "session_type", "start", "duration", "n_events", "avg_confidence", "narrative")])
    return F.to_json(F.struct("avg_confidence", "duration", "n_events", "narrative", "session", "session_type", "start"))


def render(told: DataFrame, forms: tuple[str, ...] = FORMATS) -> DataFrame:
    """session, form, text: each session in each form."""
    r = rows(told)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), piece(f).alias("text")) for f in forms]))
    return r.select("session", each.alias("p")).select("session", "p.form", "p.text")


def write(told: DataFrame, path: str, form: str) -> None:
    """A report's pieces in order of session, a text file per partition."""
    render(told, (form,)).repartitionByRange("session").sortWithinPartitions("session").select("text").write.mode("overwrite").text(path)


def csv_rows(sessions: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The columns of a report's CSV, all as text: seven of every session, its confidence and outcomes if it has them, and
    given evidence (keys, frames, trace_confidence) the frames it rests on and how sure the way to them is."""
    c, two = F.col, lambda col, digits: F.format_number(col, digits)
    at = lambda name: F.date_format(F.timestamp_micros(name), "yyyy-MM-dd HH:mm:ss")
    columns = {
        "session_id": F.concat_ws("-", "stream", "island"), "session_type": c("session_type"), "start_time": at("start_us"), "end_time": at("end_us"), "duration_seconds": F.replace(two(c("seconds"), 1), F.lit(","), F.lit("")),
        "event_count": c("n_events").cast("string"), "primary_application": F.coalesce("primary_app", F.lit("")),
    }
    if "confidence" in sessions.columns:
        columns["confidence_score"] = two(c("confidence"), 3)
    if "outcomes" in sessions.columns:
        columns["outcomes"] = F.array_join("outcomes", "; ")
    if evidence is not None:
        sessions = sessions.join(evidence, ["stream", "island"], "left")
        columns["evidence_frames"] = F.coalesce(F.array_join(F.transform("frames", lambda f: f.cast("string")), "; "), F.lit(""))
        columns["evidence_trace_confidence"] = two(F.coalesce("trace_confidence", F.lit(0.0)), 3)
    return sessions.select(*[v.alias(k) for k, v in columns.items()])


def evidence_sections(propagated: DataFrame, direct: DataFrame, correlated: DataFrame, keys: tuple[str, ...], most_direct: int = 5, most_correlated: int = 3) -> DataFrame:
    """Each session's evidence as a piece of a report: keys, form (markdown or html), text.

    direct: keys, frame_id, app_name, ocr (both null for frames that aren't known), once a frame; correlated: keys, frame_id,
    score, reasons, rank. Shown are the first few of either, and the confidence handed up by contexts.propagation.
    """
    percent = lambda c: F.concat(F.format_number(c * 100, 1), F.lit("%"))
    own = direct.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("frame_id", "app_name", "ocr"))), 1, most_direct).alias("direct"))
    near = correlated.where(F.col("rank") <= most_correlated).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "frame_id", "score", "reasons"))).alias("near"))
    j = propagated.join(own, list(keys), "left").join(near, list(keys), "left")
    shown = lambda f: F.concat(F.coalesce(F.concat(F.lit(" ("), f["app_name"], F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" - OCR: "), percent(f["ocr"])), F.lit("")))
    met = lambda f: F.concat(F.lit("(Score: "), F.format_number(f["score"], 2), F.lit(", Reasons: "), F.array_join(f["reasons"], ", "), F.lit(")"))
    parts = (("Frame Confidence", "frame_confidence"), ("Event Confidence", "event_confidence"), ("Temporal Consistency", "temporal"), ("Evidence Completeness", "completeness"))
    lines = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ""), F.lit(""))
    some = lambda c, text: F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, text).otherwise("")
    forms = {
        "markdown": F.concat(
            F.lit("#### Evidence & Traceability\n\n**Trace Confidence:** "), percent(F.col("trace_confidence")), F.lit("\n\n**Direct Evidence Frames:**\n"), lines("direct", lambda f: F.concat(F.lit("- `"), f["frame_id"].cast("string"), F.lit("`"), shown(f), F.lit("\n"))), F.lit("\n"),
            some("near", F.concat(F.lit("**Temporally Correlated Frames:**\n"), lines("near", lambda f: F.concat(F.lit("- `"), f["frame_id"].cast("string"), F.lit("` "), met(f), F.lit("\n"))), F.lit("\n"))),
            F.lit("**Confidence Analysis:**\n"), *[F.concat(F.lit(f"- {name}: "), percent(F.col(c)), F.lit("\n")) for name, c in parts], F.lit("\n")),
        "html": F.concat(
            F.lit('<div class="evidence"><h4>Evidence &amp; Traceability</h4><p><strong>Trace Confidence:</strong> <span class="confidence">'), percent(F.col("trace_confidence")), F.lit("</span></p><h5>Direct Evidence Frames</h5><ul>"),
            lines("direct", lambda f: F.concat(F.lit("<li><code>"), f["frame_id"].cast("string"), F.lit("</code>"), shown(f), F.lit("</li>"))), F.lit("</ul>"),
            some("near", F.concat(F.lit("<h5>Temporally Correlated Frames</h5><ul>"), lines("near", lambda f: F.concat(F.lit("<li><code>"), f["frame_id"].cast("string"), F.lit("</code> "), met(f), F.lit("</li>"))), F.lit("</ul>"))), F.lit("</div>")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("form"), text.alias("text")) for name, text in forms.items()]))
    return j.select(*keys, each.alias("e")).select(*keys, "e.*")
