"""Sessions as text: the dialects of a sentence, the templates of a narrative, the formats of a playbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: How each dialect says an event of a type; %s is its target.
DIALECTS = {
    "narrative": {"field_change": "Modified %s", "form_submission": "Submitted form", "modal_appearance": "Interacted with dialog: %s", "error_display": "Encountered error: %s", "navigation": "Navigated to %s", "data_entry": "Entered data in %s", "app_switch": "Switched to %s", "click": "Clicked on %s"},
    "structured": {"field_change": "%s modified", "form_submission": "Form submitted", "modal_appearance": "%s", "error_display": "%s", "navigation": "→ %s", "data_entry": "%s: data entered", "app_switch": "→ %s", "click": "%s"},
    "playbook": {
        "field_change": "Modify the %s field", "form_submission": "Submit the form by clicking the submit button", "modal_appearance": "Handle the dialog that appears: %s", "error_display": "Address the error message: %s", "navigation": "Navigate to %s", "data_entry": "Enter data in %s",
        "app_switch": "Switch to %s application", "click": "Click on %s",
    },
    "timeline": {"field_change": "Modified %s", "form_submission": "Form submitted", "modal_appearance": "Dialog appeared: %s", "error_display": "Error encountered: %s", "navigation": "Navigated to %s", "data_entry": "Data entered in %s", "app_switch": "Switched to %s", "click": "Clicked %s"},
}
#: What a playbook is called, by the kind of its session.
TITLES = {
    "form_filling": "Form Completion Workflow in %s", "data_entry": "Data Entry Process in %s", "navigation": "Navigation Guide for %s", "research": "Research Workflow in %s", "communication": "Communication Process in %s", "development": "Development Workflow in %s",
}
OTHER_TITLE = "General Workflow in %s"


def said(dialect: str, kind: Column, target: Column) -> Column:
    out = F.lit("Acted")
    for name, words in DIALECTS[dialect].items():
        before, mark, after = words.partition("%s")
        out = F.when(kind == name, F.concat(F.lit(before), target, F.lit(after)) if mark else F.lit(words)).otherwise(out)
    return out


def title(kind: Column, app: Column) -> Column:
    out = F.concat(F.lit(OTHER_TITLE[:-2]), app)
    for name, words in TITLES.items():
        out = F.when(kind == name, F.concat(F.lit(words[:-2]), app)).otherwise(out)
    return out


def _lines(before: str, values: Column, after: str = "") -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit(before), v, F.lit(after))), "\n")


def _section(head: str, lines: Column) -> Column:
    """A head and lines under it, or nothing if there are none."""
    return F.when(F.length(lines) > 0, F.concat(F.lit(head), lines, F.lit("\n"))).otherwise("")


def _known(sessions: DataFrame, grouped: DataFrame, key_events: DataFrame, outcomes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per session what templates tell: its events in each dialect, by time, and its outcomes."""
    each = lambda df, name, dialect: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "type", "target", "confidence"))), lambda e: F.struct(e["us"].alias("us"), e["type"].alias("type"), e["confidence"].alias("confidence"), said(dialect, e["type"], e["target"]).alias("said"))).alias(name))
    j = sessions.join(each(key_events, "narrative", "narrative"), list(keys)).join(each(key_events, "structured", "structured"), list(keys))
    j = j.join(each(grouped, "playbook", "playbook"), list(keys)).join(each(grouped, "timeline", "timeline"), list(keys))
    return j.join(outcomes.select(*keys, "outcomes"), list(keys), "left").withColumn("outcomes", F.coalesce("outcomes", F.array().cast("array<string>")))


def all_templates(sessions: DataFrame, grouped: DataFrame, key_events: DataFrame, outcomes: DataFrame, recommendations: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each session's text in each of five templates: keys, template, text."""
    k = _known(sessions, grouped, key_events, outcomes, keys).join(recommendations.select(*keys, "recommendations"), list(keys))
    kind, app, lasts, n = F.replace("session_type", F.lit("_"), F.lit(" ")), F.col("primary_app"), text.duration_words(F.col("seconds")), F.col("n_events").cast("string")
    percent = lambda c: F.format_string("%d%%", F.round(c * 100).cast("long"))
    stories = {
        "narrative": F.concat(
            F.lit("The user engaged in "), kind, F.lit(" within "), app, F.lit(" for "), lasts, F.lit(", performing "), n, F.lit(" actions.\n\n"),
            _section("Key activities included:\n", _lines("• ", F.transform("narrative", lambda e: e["said"]))), _section("This session resulted in:\n", _lines("• ", F.col("outcomes")))),
        "structured": F.concat(
            F.lit("## Activity Summary\n\n**Session Type:** "), F.initcap(kind), F.lit("\n**Duration:** "), lasts, F.lit("\n**Events:** "), n, F.lit("\n**Primary Application:** "), app, F.lit("\n\n"),
            _section("### Key Events\n\n", _lines("- ", F.transform("structured", lambda e: F.concat(F.lit("**"), F.initcap(F.replace(e["type"], F.lit("_"), F.lit(" "))), F.lit(":** "), e["said"], F.lit(" (Confidence: "), percent(e["confidence"]), F.lit(")"))))), _section("### Outcomes\n\n", _lines("- ", F.col("outcomes")))),
        "playbook": F.concat(
            F.lit("# Action Playbook\n\n## Overview\n\nThis playbook recreates the "), kind, F.lit(" workflow performed in "), app, F.lit(" over "), lasts, F.lit(".\n\n"),
            _section("## Steps\n\n", F.array_join(F.transform("playbook", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["said"])), "\n")), _section("## Expected Outcomes\n\n", _lines("- ", F.col("outcomes")))),
        "timeline": F.concat(F.lit("# Activity Timeline\n\n**Duration:** "), lasts, F.lit("\n\n"), _section("## Event Timeline\n\n", F.array_join(F.transform("timeline", lambda e: F.concat(F.lit("**"), F.date_format(F.timestamp_micros(e["us"]), "HH:mm:ss"), F.lit("** - "), e["said"], F.lit(" ("), percent(e["confidence"]), F.lit(")"))), "\n"))),
        "executive": F.concat(
            F.lit("# Executive Summary\n\n## Overview\n\nUser completed a "), kind, F.lit(" session in "), app, F.lit(" lasting "), lasts, F.lit(" with "), n, F.lit(" recorded actions.\n\n## Key Metrics\n\n- **Duration:** "), lasts, F.lit("\n- **Actions:** "), n, F.lit("\n\n"),
            _section("## Business Impact\n\n", _lines("- ", F.col("outcomes"))), _section("## Recommendations\n\n", _lines("- ", F.col("recommendations")))),
    }
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("template"), story.alias("text")) for name, story in stories.items()]))
    return k.select(*keys, each.alias("s")).select(*keys, "s.*")


def playbook_texts(playbooks: DataFrame, steps: DataFrame, sessions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each session's playbook as markdown, csv, json and html: keys, form, text."""
    listed = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "instruction", "type", "target", "seconds"))).alias("steps"))
    p = playbooks.select(*keys, "n_steps", F.col("seconds").alias("takes"), "difficulty").join(listed, list(keys)).join(sessions.select(*keys, "session_type", "primary_app"), list(keys))
    name, number = title(F.col("session_type"), F.col("primary_app")), lambda c: c.cast("string")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    joined = lambda f, sep: F.array_join(F.transform("steps", f), sep)
    forms = {
        "markdown": F.concat(
            F.lit("# "), name, F.lit("\n\n| Property | Value |\n|----------|-------|\n| Difficulty | "), F.initcap("difficulty"), F.lit(" |\n| Steps | "), number(F.col("n_steps")), F.lit(" |\n\n## Steps\n\n"),
            joined(lambda s: F.concat(number(s["step"]), F.lit(". **"), s["instruction"], F.lit("**\n   - Target: `"), s["target"], F.lit("`")), "\n")),
        "csv": F.concat(F.lit("step_number,action,target\n"), joined(lambda s: F.concat(number(s["step"]), F.lit(","), quoted(s["instruction"]), F.lit(","), F.when(F.contains(s["target"], F.lit(",")), quoted(s["target"])).otherwise(s["target"])), "\n")),
        "json": F.concat(F.lit('{"title":"'), name, F.lit('","difficulty":"'), F.col("difficulty"), F.lit('","steps":['), joined(lambda s: F.concat(F.lit('{"step":'), number(s["step"]), F.lit(',"action":"'), s["instruction"], F.lit('"}')), ","), F.lit("]}")),
        "html": F.concat(F.lit("<h1>"), name, F.lit("</h1>"), joined(lambda s: F.concat(F.lit('<div class="step"><h3>'), s["instruction"], F.lit("</h3></div>")), "")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(form).alias("form"), value.alias("text")) for form, value in forms.items()]))
    return p.select(*keys, each.alias("s")).select(*keys, "s.*")


def report_header(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """One row: sessions told, all events of the range, told or not, the range's length, and its title."""
    s = sessions.agg(F.count("*").alias("sessions"))
    e = events.agg(F.count("*").alias("total_events"), ((F.max("us") - F.min("us")) / 1e6).alias("seconds"), F.date_format(F.timestamp_micros(F.min("us")), "yyyy-MM-dd").alias("first"), F.date_format(F.timestamp_micros(F.max("us")), "yyyy-MM-dd").alias("last"))
    # two rows of totals, whatever is reported
    return s.join(e).select("sessions", "total_events", "seconds", F.concat(F.lit("Activity Report: "), F.col("first"), F.lit(" to "), F.col("last")).alias("title"))
