"""Personal data on screen: detection, masks, decisions, the audit trail."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns, any case, with the order in which overlapping ones win.
PATTERNS = {
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "credit_card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "mac_address": r"(?i)\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "url": r"(?i)\bhttps?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?/?",
    "date_of_birth": r"\b(?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12][0-9]|3[01])[-/](?:19|20)\d{2}\b",
    "passport": r"(?i)\b[A-Z]{1,2}[0-9]{6,9}\b",
    "drivers_license": r"(?i)\b[A-Z]{1,2}[0-9]{6,8}\b",
}
#: What a text holds if it holds a match at all; without any of these a pattern isn't tried. The others need a digit.
HINTS = {"email": ("@",), "url": ("://",), "mac_address": (":", "-")}
CONTEXT = "personal|private|confidential|password|ssn|social security"
CRITICAL, HIGH = ("ssn", "credit_card", "passport", "drivers_license"), ("email", "phone", "date_of_birth")
LEVELS = ("low", "medium", "high", "critical")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def confidence(kind: str, match: Column, full: Column) -> Column:
    n = F.length(_digits(match))
    own = {
        "email": F.when(F.contains(match, F.lit("@")) & F.contains(match, F.lit(".")), 0.9).otherwise(0.3),
        "phone": F.when(n.between(10, 15), 0.8).otherwise(0.4),
        "ssn": F.when((n == 9) & (_digits(match) != "000000000"), 0.95).otherwise(0.2),
        "credit_card": F.when(n.between(13, 19) & F.call_function("luhn_check", _digits(match)), 0.9).otherwise(0.3),
        "ip_address": F.lit(0.85),
        "url": F.lit(0.9),
    }.get(kind, F.lit(0.7))
    return F.least(F.lit(1.0), own + F.when(F.lower(full).rlike(CONTEXT), 0.1).otherwise(0.0))


def matches(rows: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS), least: float = 0.7) -> DataFrame:
    """rows with matches: the sure enough ones as (start, end, kind, match, confidence), by start, then in PATTERNS' order.

    Offsets count code points. What stands between the matches, by split(), gives them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = rows.withColumn("__text", text).withColumn("__digit", F.col("__text").rlike("[0-9]"))
    nothing = F.array().cast("array<string>")
    for k in kinds:
        hint = reduce(or_, [F.contains("__text", F.lit(h)) for h in HINTS[k]]) if k in HINTS else F.col("__digit")
        df = df.withColumn(f"__m_{k}", F.when(hint, F.regexp_extract_all("__text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(nothing))
    for k in kinds:
        df = df.withColumn(f"__g_{k}", F.when(F.size(f"__m_{k}") > 0, F.transform(F.split("__text", PATTERNS[k], -1), F.length)))

    def spans(order: int, k: str) -> Column:
        def fold(state: Column, m: Column) -> Column:
            i = F.size(state["found"])
            start = state["at"] + F.get(f"__g_{k}", i)
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + F.length(m)).alias("end"), F.lit(k).alias("kind"), m.alias("match"), F.round(confidence(k, m, F.col("__text")), 6).alias("confidence"))
            return F.struct((start + F.length(m)).alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

        none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,match:string,confidence:double>>")
        found = F.aggregate(f"__m_{k}", F.struct(F.lit(0).alias("at"), none.alias("found")), fold, lambda s: s["found"])
        return F.filter(F.coalesce(found, none), lambda s: s["confidence"] >= least)

    df = df.withColumn("matches", F.array_sort(F.concat(*[spans(i, k) for i, k in enumerate(kinds)])))
    return df.drop("__text", "__digit", *[f"__{p}_{k}" for k in kinds for p in "mg"])


def without_overlaps(spans: Column) -> Column:
    """Of matches by start, those that don't begin inside one that stays: the first, of equal starts the longest."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["order"] - b["order"]))
    start = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, start, lambda kept, s: F.when((F.size(kept) == 0) | (s["start"] >= F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0))), F.concat(kept, F.array(s))).otherwise(kept))


def masked(match: Column, kind: Column, strategy: str) -> Column:
    """A match after one of: redact, asterisk, partial, hash, placeholder, remove."""
    if strategy == "redact":
        return F.lit("[REDACTED]")
    if strategy == "asterisk":
        return F.regexp_replace(match, "(?s).", "*")
    if strategy == "hash":
        return F.concat(F.lit("#"), F.substring(F.sha2(match, 256), 1, 8))
    if strategy == "placeholder":
        return F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    if strategy == "remove":
        return F.lit("")
    d = _digits(match)
    stars = lambda n: F.repeat(F.lit("*"), F.greatest(n, F.lit(0)))
    last4 = F.when(F.length(d) >= 4, F.concat(stars(F.length(d) - 4), F.substring(d, -4, 4))).otherwise(stars(F.length(match)))
    user, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    hidden = F.when(F.length(user) > 2, F.concat(F.substring(user, 1, 1), stars(F.length(user) - 2), F.substring(user, -1, 1))).otherwise(stars(F.length(user)))
    host = F.when(F.contains(domain, F.lit(".")), F.concat(F.substring(domain, 1, 1), F.lit("***."), F.substring_index(domain, ".", -1))).otherwise(F.lit("***"))
    shown = F.greatest(F.lit(1), F.floor(F.length(match) * 0.2).cast("int"))
    some = F.concat(F.expr("''"), F.substring(match, F.lit(1), shown), stars(F.length(match) - 2 * shown), F.substring(match, -shown, shown))
    return F.when(kind == "email", F.concat(hidden, F.lit("@"), host)).when(kind.isin("phone", "credit_card"), last4).otherwise(some)


def mask_text(rows: DataFrame, strategy: str = "partial", text_col: str = "text") -> DataFrame:
    """rows of matches() with masked: the text with every match, overlaps resolved first, replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    put = F.transform(without_overlaps(F.col("matches")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), masked(s["match"], s["kind"], strategy).alias("by")))

    def step(state: Column, s: Column) -> Column:
        return F.struct(F.concat(state["text"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), s["by"]).alias("text"), s["end"].alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return rows.withColumn("masked", F.aggregate(put, start, step, lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text)))))


def decide(rows: DataFrame, allowed: tuple[str, ...] = (), prevent: bool = False, enabled: bool = True) -> DataFrame:
    """rows of mask_text() with stored (whether the row may be kept) and content (what is kept of it)."""
    kinds = F.array_distinct(F.transform("matches", lambda s: s["kind"]))
    blocked = F.array_except(kinds, F.array(*map(F.lit, allowed)).cast("array<string>"))
    clean = F.lit(not enabled) | (F.size(kinds) == 0) | (F.size(blocked) == 0)
    stop = F.lit(prevent) & ~clean
    return rows.withColumn("kinds", kinds).withColumn("stored", ~stop).withColumn("content", F.when(clean, F.col("text")).when(stop, "[CONTENT BLOCKED - CONTAINS PII]").otherwise(F.col("masked")))


def detection_severity(kinds: Column) -> Column:
    return F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, CRITICAL))), "critical").when(F.arrays_overlap(kinds, F.array(*map(F.lit, HIGH))), "high").when(F.size(kinds) > 3, "medium").otherwise("low")


def rank_of(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def admitted(audit: DataFrame, kinds: tuple[str, ...], least: str = "low") -> DataFrame:
    """Audit rows of enabled kinds of at least that severity, by the levels' order."""
    return audit.where(F.col("event_type").isin(*kinds) & (rank_of(F.col("severity")) >= LEVELS.index(least) + 1))


def audit_rows(decided: DataFrame) -> DataFrame:
    """A detection row for the audit trail of every row with matches."""
    d = decided.where(F.size("kinds") > 0)
    return d.select("frame", F.lit("pii_detected").alias("event_type"), F.col("kinds").alias("pii_types"), detection_severity(F.col("kinds")).alias("severity"), F.when(F.col("stored"), "masked").otherwise("blocked").alias("context"), F.col("stream").alias("source_component"))


def mask_rows(decided: DataFrame, strategy: str = "partial") -> DataFrame:
    """A masking row for the audit trail of every row whose kept text isn't its own."""
    d = decided.where((F.size("kinds") > 0) & F.col("stored") & (F.col("content") != F.col("text")))
    return d.select("frame", F.lit("pii_masked").alias("event_type"), F.col("kinds").alias("pii_types"), detection_severity(F.col("kinds")).alias("severity"), F.lit(strategy).alias("context"), F.col("stream").alias("source_component"))


def decision_rows(decided: DataFrame) -> DataFrame:
    """A row for the audit trail of every decision on a row with matches: what is allowed is low, what is stopped high."""
    d = decided.where(F.size("kinds") > 0)
    level = F.when(F.col("stored"), "low").otherwise("high")
    return d.select("frame", F.lit("filter_decision").alias("event_type"), F.col("kinds").alias("pii_types"), level.alias("severity"), F.when(F.col("stored"), "allowed").otherwise("blocked").alias("context"), F.col("stream").alias("source_component"))


def configuration_rows(changes: DataFrame) -> DataFrame:
    """A row for the audit trail of every changed setting (frame, setting, was, now, source)."""
    c = changes.where(~F.col("was").eqNullSafe(F.col("now")))
    none = F.array().cast("array<string>")
    return c.select("frame", F.lit("configuration_changed").alias("event_type"), none.alias("pii_types"), F.lit("medium").alias("severity"), F.concat_ws(" ", "setting", F.lit("from"), F.coalesce("was", F.lit("nothing")), F.lit("to"), F.coalesce("now", F.lit("nothing"))).alias("context"), F.col("source").alias("source_component"))


def audit_statistics(audit: DataFrame) -> DataFrame:
    """Counts by event type, severity, kind of data and source, in one pass over exploded rows."""
    parts = F.array(
        F.struct(F.lit("type").alias("by"), F.col("event_type").alias("value")), F.struct(F.lit("severity").alias("by"), F.col("severity").alias("value")), F.struct(F.lit("source").alias("by"), F.col("source_component").alias("value")))
    kinds = F.transform("pii_types", lambda k: F.struct(F.lit("pii").alias("by"), k.alias("value")))
    return audit.select(F.explode(F.concat(parts, kinds)).alias("p")).groupBy("p.by", "p.value").agg(F.count("*").alias("n"))


def retained(audit: DataFrame, as_of_us: int, days: int = 90) -> DataFrame:
    """Audit rows of the last days; older ones are to go."""
    return audit.where(F.col("us") >= as_of_us - days * 86_400_000_000)


def preview(rows: DataFrame, strategy: str = "partial") -> DataFrame:
    """rows of matches() as one row a match, with what would stand in its place."""
    m = rows.select("*", F.explode(without_overlaps(F.col("matches"))).alias("__m"))
    return m.select(*[c for c in rows.columns if c != "matches"], F.col("__m.kind").alias("kind"), F.col("__m.match").alias("match"), masked(F.col("__m.match"), F.col("__m.kind"), strategy).alias("masked"))


def holds_any(rows: DataFrame, kinds: tuple[str, ...] | None = None) -> Column:
    """Whether a row of matches() has a match (of the kinds): contains, needs masking."""
    found = F.transform("matches", lambda m: m["kind"])
    return F.size(found) > 0 if kinds is None else F.arrays_overlap(found, F.array(*map(F.lit, kinds)))
