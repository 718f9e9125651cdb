"""Sessions told: narratives, context among spans, evidence with confidence, reports and playbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .evidence import in_sessions
from .sequences import transition

#: Importance of an event's type; seconds a playbook step of it takes, and of typing a character, at least so many.
IMPORTANCE = {"form_submission": 10, "error_display": 9, "modal_appearance": 8, "data_entry": 7, "field_change": 6, "navigation": 5, "app_switch": 4, "click": 3}
STEP_SECONDS = {"click": 2.0, "navigation": 5.0, "app_switch": 3.0, "form_submission": 2.0, "modal_appearance": 4.0, "error_display": 10.0}
TYPING, LEAST_TYPING, UNKNOWN_LENGTH = 0.2, 3.0, 10
#: What a playbook says of a step; a changed field is entered if its new value is known.
ACTIONS = {
    "field_change": "Modify %s", "form_submission": "Submit the form", "modal_appearance": "Handle dialog or modal", "error_display": "Address error message", "navigation": "Navigate to %s",
    "data_entry": "Enter data in %s", "app_switch": "Switch to %s", "click": "Click on %s",
}
VALUE_ACTION, ENTRY_ACTIONS, MERGED_ACTION = "Enter value in %s", ("Enter value", "Enter data", "Modify"), "Complete data entry for multiple fields"
#: What sessions came to, by what happened in them and by their type.
OUTCOMES = {"form_filling": "Form filling process completed", "research": "Information gathering session completed", "communication": "Communication activities performed", "development": "Development work session completed"}
SENTENCES = {
    "field_change": "Modified %s", "form_submission": "Submitted form", "modal_appearance": "Interacted with dialog: %s", "error_display": "Encountered error: %s", "navigation": "Navigated to %s",
    "data_entry": "Entered data in %s", "app_switch": "Switched to %s", "click": "Clicked on %s",
}


def _of(values: dict, key: Column, otherwise) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in values.items() for x in p])[key], F.lit(otherwise))


def sentence(kind: Column, target: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    out = F.lit("Acted")
    for name, words in sentences.items():
        said = F.concat(F.lit(words.removesuffix("%s")), target) if words.endswith("%s") else F.lit(words)
        out = F.when(kind == name, said).otherwise(out)
    return out


def key_events(grouped: DataFrame, keys: tuple[str, ...], most: int = 5) -> DataFrame:
    """The events of each session that matter most, then the surest."""
    w = Window.partitionBy(*keys).orderBy(F.desc("importance"), F.desc("confidence"), "event_id")
    ranked = grouped.withColumn("importance", _of(IMPORTANCE, F.col("type"), 0)).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= most)


def narratives(grouped: DataFrame, sessions: DataFrame, keys: tuple[str, ...], most: int = 5) -> DataFrame:
    """Per session a sentence on what it was and one on each of its key events, in order of time."""
    k = key_events(grouped, keys, most).withColumn("said", sentence(F.col("type"), F.col("target")))
    told = k.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("us", "event_id", "said"))), lambda s: s["said"]).alias("said"))
    j = sessions.join(told, list(keys))
    head = F.concat(F.lit("A "), F.col("session_type"), F.lit(" session of "), text.duration_words(F.col("seconds")), F.lit(" with "), F.col("n_events").cast("string"), F.lit(" events in "), F.col("primary_app"), F.lit("."))
    return j.select(*keys, F.concat(head, F.lit(" "), F.array_join("said", ". "), F.lit(".")).alias("narrative"))


def session_confidence(sessions: DataFrame, continuity: Column | None = None) -> DataFrame:
    """Mean of the events' confidence, the duration in five minutes, continuity if known, the number of events in ten; to 8
    places by its hundred-millionths, as the SQL rounds doubles (rounding by decimal digits takes some halves down)."""
    parts = [F.col("avg_confidence"), F.least(F.lit(1.0), F.col("seconds") / 300), F.least(F.lit(1.0), F.col("n_events") / 10)] + ([continuity] if continuity is not None else [])
    known = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return sessions.withColumn("confidence", F.round(F.aggregate(known, F.lit(0.0), lambda a, p: a + p) / F.size(known) * 1e8) / 1e8)


def outcomes(sessions: DataFrame) -> DataFrame:
    """What a session came to, as phrases: of what happened in it, then of its type."""
    s = lambda c, before, after="": F.when(F.col(c) > 0, F.concat(F.lit(before), F.col(c).cast("string"), F.lit(after)))
    found = [F.when(F.col("submissions") > 0, "Form submission completed"), s("data", "Data entered in ", " fields"), s("visits", "Navigated through ", " different screens/pages"), F.when(F.col("errors") > 0, "Encountered and potentially resolved errors"), _of(OUTCOMES, F.col("session_type"), None)]
    return sessions.withColumn("outcomes", F.array_compact(F.array(*found)))


def workflow_phase(session_type: Column, before: Column, after: Column) -> Column:
    """Phase by session type and the kinds of spans before and after (arrays)."""
    was, will = lambda k: F.array_contains(before, k), lambda k: F.array_contains(after, k)
    t = lambda name: session_type == name
    return (
        F.when(t("data_entry") & was("research"), "data_collection").when(t("data_entry") & will("form_submission"), "data_input").when(t("data_entry"), "data_entry")
        .when(t("form_filling") & (F.size(before) == 0), "form_initiation").when(t("form_filling") & will("form_submission"), "form_completion").when(t("form_filling"), "form_filling")
        .when(t("navigation") & was("research"), "information_seeking").when(t("navigation"), "navigation")
        .when(t("research") & will("data_entry"), "research_for_action").when(t("research"), "information_gathering")
        .when(t("communication"), "communication").when(t("development") & was("research"), "implementation").when(t("development"), "development").otherwise("mixed_activity")
    )


def correlated_frames(grouped: DataFrame, sessions: DataFrame, keys: tuple[str, ...], frames: DataFrame, within_us: int = 300_000_000, most: int = 10) -> DataFrame:
    """Frames inside a session scored by the nearest event (0.4), the app (0.3), the transition from the frame before in the
    session (0.2) and its place in the workflow (0.1: 0.4 for an app of the session's events, 0.6 for its time), with the
    reasons; the top 10 of those from 0.5 up."""
    f = frames.select("stream", "us", F.col("event_id").alias("frame_id"), F.col("app_name").alias("frame_app"), F.col("target").alias("frame_title"))
    apps = grouped.groupBy(*keys).agg(F.collect_set("app_name").alias("apps"))
    inside = in_sessions(sessions.select(*keys, "start_us", "end_us", "primary_app").join(apps, list(keys)), f, keys)
    inside = inside.withColumn("transition", transition(Window.partitionBy(*keys).orderBy("us", "frame_id"), "frame_app", "frame_title"))
    # the nearest event is the last before or the first after: a window of each session, not a product of its rows
    e = grouped.select(*keys, "us", F.col("us").alias("event_us"))
    past = lambda order: Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    before, after = (F.last("event_us", ignorenulls=True).over(past(order)) for order in ("us", F.desc("us")))
    both = inside.unionByName(e, allowMissingColumns=True).withColumn("apart", F.least(F.col("us") - before, after - F.col("us")))
    near = both.where("frame_id is not null and apart is not null")
    proximity, own = F.greatest(F.lit(0.0), 1 - F.col("apart") / within_us), F.coalesce(F.col("frame_app") == F.col("primary_app"), F.lit(False))
    workflow = F.when(F.array_contains("apps", F.col("frame_app")), 0.4).otherwise(0.0) + 0.6
    score = 0.4 * proximity + F.when(own, 0.3).otherwise(0.0) + 0.2 * F.col("transition") + 0.1 * workflow
    why = [F.when(proximity > 0.5, "temporal_proximity_to_events"), F.when(own, "application_context_match"), F.when(F.col("transition") > 0.7, "significant_scene_transition"), F.when(workflow > 0.6, "workflow_continuity")]
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "frame_id")
    out = near.withColumn("score", F.round(score, 6)).withColumn("reasons", F.array_compact(F.array(*why))).where("score >= 0.5").withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most).select(*keys, "frame_id", "score", "reasons", "rank")


def neighbours_within(frames: DataFrame, us: int = 30_000_000) -> DataFrame:
    """How many other frames of the stream lie within 30 s, by a range window."""
    w = Window.partitionBy("stream").orderBy("us").rangeBetween(-us, us)
    return frames.withColumn("neighbours", F.count("*").over(w) - 1)


def report(sessions: DataFrame) -> DataFrame:
    """Sessions, total and mean duration, mean events and confidence, per session type."""
    return sessions.groupBy("session_type").agg(F.count("*").alias("sessions"), F.round(F.sum("seconds"), 6).alias("seconds"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.round(F.avg("n_events"), 6).alias("avg_events"), F.round(F.avg("avg_confidence"), 6).alias("avg_confidence"))


def recommendations(sessions: DataFrame) -> DataFrame:
    """Sessions (with their continuity) with efficiency, in events a minute, and what is recommended."""
    s = F.col
    rate = s("n_events") / (s("seconds") / 60)
    found = F.array_compact(F.array(
        F.when(s("errors") > 0, "Consider process optimization to reduce error encounters"), F.when(rate < 2, "Workflow efficiency could be improved through automation or training"),
        F.when((s("session_type") == "form_filling") & (s("seconds") > 600), "Form completion time suggests potential for UX improvements"), F.when(s("continuity") < 0.5, "Consider improving workflow integration and context preservation")))
    return sessions.withColumn("efficiency", F.round(rate, 6)).withColumn("recommendations", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Workflow completed successfully with good efficiency"))))


def step_seconds(kind: Column, value: Column) -> Column:
    typing = F.greatest(F.lit(LEAST_TYPING), TYPING * F.coalesce(F.length(value), F.lit(UNKNOWN_LENGTH)))
    return F.when(kind.isin("field_change", "data_entry"), typing).otherwise(_of(STEP_SECONDS, kind, None))


def playbook_steps(grouped: DataFrame, keys: tuple[str, ...], most: int = 50) -> DataFrame:
    """Steps of each session in order, at most 50: a run of steps that enter data is one step for all their targets, with
    their mean confidence and the seconds of all. A column value holds what was entered, if known."""
    value = F.col("value") if "value" in grouped.columns else F.lit(None).cast("string")
    w = Window.partitionBy(*keys).orderBy("us", "event_id")
    entered = F.when((F.col("type") == "field_change") & value.isNotNull(), F.concat(F.lit(VALUE_ACTION.removesuffix("%s")), "target"))
    g = grouped.withColumn("action", F.coalesce(entered, sentence(F.col("type"), F.col("target"), ACTIONS))).withColumn("takes", step_seconds(F.col("type"), value))
    g = g.withColumn("__entry", F.col("action").rlike("|".join(ENTRY_ACTIONS)))
    g = g.withColumn("step", F.sum(F.when(F.col("__entry") & F.coalesce(F.lag("__entry").over(w), F.lit(False)), 0).otherwise(1)).over(w)).where(F.col("step") <= most)
    # targets of a step: those of one session's events, which the event limit bounds
    steps = g.groupBy(*keys, "step").agg(
        F.array_sort(F.collect_list(F.struct("us", "event_id", "type", "target", "action"))).alias("e"), F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.sum("takes"), 6).alias("seconds"))
    first = F.col("e")[0]
    return steps.select(
        *keys, "step", first["type"].alias("type"), F.array_join(F.transform("e", lambda x: x["target"]), ", ").alias("target"), "n", "confidence", "seconds", F.when(F.col("n") > 1, MERGED_ACTION).otherwise(first["action"]).alias("instruction"))


def difficulty(n_events: Column, seconds: Column) -> Column:
    return F.when((n_events < 10) & (seconds < 300), "beginner").when((n_events < 25) & (n_events / (seconds / 60) < 2), "intermediate").otherwise("advanced")


def playbooks(steps: DataFrame, sessions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per session: steps, their seconds, the difficulty of its events in its time, and the steps as a numbered text."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("step", "instruction"))), lambda s: F.concat(s["step"].cast("string"), F.lit(". "), s["instruction"]))
    p = steps.groupBy(*keys).agg(F.count("*").alias("n_steps"), F.round(F.sum("seconds"), 6).alias("seconds"), F.array_join(lines, "\n").alias("markdown"))
    hard = sessions.select(*keys, difficulty(F.col("n_events"), F.col("seconds")).alias("difficulty"))
    return p.join(hard, list(keys))
