"""Errors and dialogs in recognised text, by rule tables kept as data."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text

#: What a text holds (any case, any of the alternatives), type, weight.
RULES = (
    ("fatal|critical|crash|panic|abort", "system_error", 0.9),
    ("segmentation fault|access violation|null pointer", "system_error", 0.95),
    ("connection failed|connection refused|connection timeout|network error|network unavailable", "network_error", 0.8),
    ("dns error|dns failed|host not found|server not responding", "network_error", 0.85),
    ("access denied|unauthorized|authentication failed|authentication required", "auth_error", 0.8),
    ("login failed|login invalid|incorrect password|incorrect credentials", "auth_error", 0.85),
    ("permission denied|insufficient privileges", "auth_error", 0.8),
    ("invalid input|invalid format|invalid value|validation failed|validation error", "validation_error", 0.7),
    ("required field|missing value|missing input|field cannot be empty", "validation_error", 0.75),
    ("error|failed|exception|problem", "application_error", 0.6),
    ("cannot|unable to|failed to", "application_error", 0.5),
    ("warning|caution|notice", "warning", 0.7),
    ("confirm|are you sure|do you want to", "confirmation_dialog", 0.8),
    ("yes|no|ok|cancel|continue|abort", "confirmation_dialog", 0.6),
    ("open file|open folder|open directory|save file|save folder|save directory|choose file|choose folder|choose directory|select file|select folder|select directory", "file_dialog", 0.85),
    ("browse|upload|download", "file_dialog", 0.7),
    ("settings|preferences|options|configuration", "settings_dialog", 0.8),
    ("apply|reset|default", "settings_dialog", 0.6),
    ("progress|loading|please wait|processing", "progress_dialog", 0.8),
    ("[0-9]%|completed|remaining", "progress_dialog", 0.7),
    ("information|about|help", "info_dialog", 0.7),
    ("close|dismiss", "info_dialog", 0.5),
    ("system alert|system notification", "system_alert", 0.9),
    ("would like to access|permission required", "system_alert", 0.85),
    ("security warning|security alert", "system_alert", 0.9),
    ("application error|application warning|app crashed|app stopped", "app_alert", 0.8),
    ("update available|new version", "app_alert", 0.7),
)
#: Buttons match whole words only, but in compat mode.
BUTTONS = "yes|no|ok|cancel|continue|abort"
WHOLE = r"(^|[^\p{L}\p{N}_])(%s)($|[^\p{L}\p{N}_])"
SEVERITY = {"system_error": "critical", "network_error": "high", "auth_error": "high", "system_alert": "high", "application_error": "medium", "validation_error": "medium", "warning": "medium", "app_alert": "medium"}
ERRORS = ("system_error", "network_error", "auth_error", "validation_error", "application_error", "warning")
#: Keyword groups in order, the first that a text holds decides.
DIALOGS = (("save|open|file", "file_dialog"), ("settings|preferences|options", "settings_dialog"), ("progress|loading|%", "progress_dialog"), ("confirm|are you sure", "confirmation_dialog"), ("error|failed|invalid", "application_error"), ("warning|caution", "warning"), ("alert|attention", "alert_dialog"))
LEVELS = (("critical|fatal|crash", "critical"), ("error|failed|denied", "high"), ("warning|caution|invalid", "medium"), ("notice|attention", "low"))


def first_of(value: Column, groups, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for pattern, name in reversed(groups):
        out = F.when(F.lower(value).rlike(pattern), name).otherwise(out)
    return out


def dialog_type(value: Column) -> Column:
    return first_of(value, DIALOGS, "info_dialog")


def severity(value: Column) -> Column:
    return first_of(value, LEVELS, "info")


def _holds(low: Column, words: str) -> Column:
    """Whether a lower-case text holds one of the words: plain searches, but for a pattern in brackets, tried behind one."""
    tests = [F.contains(low, F.lit(w.rpartition("]")[2])) & low.rlike(w) if "[" in w else F.contains(low, F.lit(w)) for w in words.split("|")]
    return reduce(or_, tests)


def _tests(low: Column, compat: bool) -> list[Column]:
    whole = lambda words: low.rlike(WHOLE % words) if words == BUTTONS and not compat else F.lit(True)
    return [_holds(low, words) & whole(words) for words, _, _ in RULES]


def rule_matches(low: Column, compat: bool = False) -> Column:
    """The rules that a text, in lower case, meets, as an array of (order, type, weight)."""
    of = [F.struct(F.lit(k).alias("order"), F.lit(kind).alias("type"), F.lit(weight).alias("weight")) for k, (_, kind, weight) in enumerate(RULES)]
    return F.array_compact(F.array(*[F.when(met, rule) for met, rule in zip(_tests(low, compat), of)]))


def error_modal_events(regions: DataFrame, compat: bool = False, least: float = 0.6) -> DataFrame:
    """Regions that rules find to be errors or dialogs: type, severity, target, title, confidence.

    The rule of the highest weight decides, the later of equals; in compat mode the last one that matches.
    """
    r = regions.withColumn("low", F.lower("text"))
    r = r.where(reduce(or_, _tests(F.col("low"), compat))).withColumn("rules", rule_matches(F.col("low"), compat))
    best = F.element_at("rules", -1) if compat else F.array_max(F.transform("rules", lambda x: F.struct(x["weight"].alias("weight"), x["order"].alias("order"), x["type"].alias("type"))))
    mean = F.aggregate("rules", F.lit(0.0), lambda a, x: a + x["weight"]) / F.size("rules")
    r = r.withColumn("best", best).withColumn("score", F.least(F.lit(1.0), 0.7 * mean + 0.3 * F.col("confidence"))).where(F.col("score") >= least)
    level = F.coalesce(F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])[F.col("best.type")], F.lit("info"))
    r = r.select("stream", "frame", "idx", F.col("best.type").alias("kind"), level.alias("severity"), text.title(F.col("text")).alias("title"), F.round("score", 6).alias("confidence"))
    event = F.when(F.col("kind").isin(*ERRORS), "error_display").otherwise("modal_appearance")
    return r.withColumn("type", event).withColumn("target", F.concat_ws("_", "kind", "severity"))


def standalone_events(regions: DataFrame) -> DataFrame:
    """Regions with error, dialog or submit words; one region may give an event of each kind."""
    c = F.col("confidence")
    kinds = F.filter(
        F.array(*[F.when(text.holds_any(F.col("text"), words), F.struct(F.lit(kind).alias("type"), (c * by).alias("confidence"))) for words, kind, by in (
            (text.ERROR_WORDS, "error_display", 0.9), (text.MODAL_WORDS, "modal_appearance", 0.85), (text.SUBMIT_WORDS, "form_submission", 0.8))]),
        lambda e: e.isNotNull(),
    )
    return regions.select("stream", "frame", "idx", F.explode(kinds).alias("e")).select("stream", "frame", "idx", "e.type", F.round("e.confidence", 6).alias("confidence"))


def group_boxes(regions: DataFrame, *keys: str) -> DataFrame:
    """The box around the regions of each group."""
    g = regions.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), " ").alias("text"))
    return g.withColumn("w", F.col("right") - F.col("x")).withColumn("h", F.col("bottom") - F.col("y")).drop("right", "bottom")


def layout_dialogs(clustered: DataFrame, screen_w: float = 1920.0, screen_h: float = 1080.0) -> DataFrame:
    """Clusters of at least two regions (column cluster) whose box looks like a dialog."""
    g = group_boxes(clustered, "stream", "frame", "cluster").where("n >= 2").withColumn("score", F.round(geometry.layout_score(geometry.box(), screen_w, screen_h), 6))
    return g.where("score >= 0.6").withColumn("kind", dialog_type(F.col("text"))).withColumn("severity", severity(F.col("text")))


def frame_gate(regions: DataFrame, least: float = 0.7) -> DataFrame:
    """Frames with text that is sure enough, numbered in their stream."""
    r = regions.where(F.col("confidence") >= least).groupBy("stream", "frame").agg(F.count("*").alias("n"))
    return r.withColumn("seq", F.row_number().over(Window.partitionBy("stream").orderBy("frame")))
