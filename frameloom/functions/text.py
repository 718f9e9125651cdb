"""Text expressions: similarity, predicates, tokens, durations, amounts, masks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Substrings that mark a text, lower case.
ERROR_WORDS = ("error", "failed", "invalid", "incorrect", "wrong", "cannot", "unable", "denied", "forbidden", "timeout", "exception", "warning", "alert", "problem")
MODAL_WORDS = ("confirm", "cancel", "ok", "yes", "no", "close", "dialog", "popup", "modal", "alert", "notification")
SUBMIT_WORDS = ("submit", "send", "save", "create", "update", "login", "register", "sign in", "sign up", "continue")
#: Pairs of related event types.
RELATED_TYPES = (("field_change", "data_entry"), ("data_entry", "form_submission"), ("field_change", "form_submission"), ("navigation", "app_switch"), ("click", "navigation"), ("modal_appearance", "error_display"), ("click", "modal_appearance"))


def edit_distance(a: str, b: str) -> int:
    """Least insertions, deletions and replacements of characters that turn a into b, exact: Myers' bit vectors, in which a
    whole column of the table is one long integer, so that a step costs a few operations on it, not one per cell."""
    if len(a) < len(b):
        a, b = b, a
    start, most = 0, len(b)
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not b:
        return len(a)
    where = dict.fromkeys(b, 0)
    for i, c in enumerate(a):
        if c in where:
            where[c] |= 1 << i
    every, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = every, 0  # rows in which the column rises, and falls
    for c in b:
        same = where[c]
        over = (((same & more) + more) ^ more) | same
        up, down = less | (every & ~(over | more)), more & over
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up, same = (up << 1) | 1, same | less
        more, less = (down << 1 | ~(same | up)) & every, up & same & every
    return distance


def _edit_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer byte length; equal texts 1, an empty one 0."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.arrow_udf(_edit_distances, IntegerType())(a, b) / longer)


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(words))


def interactive(text: Column) -> Column:
    return F.lower(text).rlike("enter|input|select|choose|@") | text.endswith(":") | text.rlike("^[0-9]*$")


def title(text: Column) -> Column:
    """The first line if it has text; else the text, or its first 47 characters and dots if over 50."""
    first = F.trim(F.split(text, "\n")[0])
    return F.when(first != "", first).when(F.length(text) > 50, F.concat(F.substring(text, 1, 47), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]", -1)


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two targets' token sets, empty tokens counted; equal targets 1."""
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(a == b, 1.0).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def keywords(text: Column, most: int | None = None) -> Column:
    words = F.filter(tokens(text), lambda w: F.length(w) > 2)
    return F.array_distinct(F.slice(words, 1, most) if most else words)


def relatedness(a: Column, b: Column) -> Column:
    pairs = [F.lit(f"{x}>{y}") for p in RELATED_TYPES for x, y in (p, p[::-1])]
    return F.when(a == b, 1.0).when(F.array_contains(F.array(*pairs), F.concat(a, F.lit(">"), b)), 0.7).otherwise(0.0)


def quality(text: Column) -> Column:
    """Confidence in recognised text from its look, 0 to 1."""
    n = F.length(text)
    mixed = text.rlike("(?i)[aeiou]") & text.rlike("(?i)[bcdfghjklmnpqrstvwxyz]")
    special = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / F.greatest(n, F.lit(1))
    value = 0.5 + F.when(n > 10, 0.1).otherwise(0.0) + F.when(n > 50, 0.1).otherwise(0.0) + F.when(mixed, 0.2).otherwise(0.0) - F.when(special > 0.3, 0.2).otherwise(0.0)
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def script_language(text: Column) -> Column:
    """Language by script, then by accents, in a fixed order: Han first, so Japanese with Kanji counts as Chinese."""
    rules = ((r"[一-鿿]", "zh-Hans"), (r"[぀-ヿ]", "ja-JP"), (r"[\uac00-\ud7af]", "ko-KR"), ("[äöüßÄÖÜ]", "de-DE"), ("[àâäéèêëïîôöùûüÿçÀÂÄÉÈÊËÏÎÔÖÙÛÜŸÇ]", "fr-FR"), ("[áéíóúüñÁÉÍÓÚÜÑ¿¡]", "es-ES"), ("[àèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ]", "it-IT"))
    out = F.lit(None)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit("en-US"))


def minutes(text: Column) -> Column:
    """Minutes of '2h 30m', '2.5h', '30m' or '2:30'."""
    part = lambda p: F.regexp_extract(text, p, 1)
    number = lambda p: F.when(part(p) != "", part(p).cast("double"))
    hours, mins = number(r"(\d+(?:\.\d+)?)\s*h"), number(r"(\d+)\s*m")
    clock = F.when(text.rlike(r"^\s*\d+:\d{2}\s*$"), number(r"^\s*(\d+):") * 60 + number(r":(\d{2})"))
    return F.coalesce(clock, F.when(hours.isNotNull() | mins.isNotNull(), F.coalesce(hours * 60, F.lit(0.0)) + F.coalesce(mins, F.lit(0.0))))


def percent(text: Column) -> Column:
    """Whole percent of '40%' or '3/4'."""
    p, a, b = F.regexp_extract(text, r"(\d+)\s*%", 1), F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", 1), F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", 2)
    return F.when(p != "", p.try_cast("int")).when((a != "") & (b.try_cast("int") > 0), F.floor(a.try_cast("double") * 100 / b.try_cast("double")).cast("int"))


def amount(text: Column) -> Column:
    """struct(value, code) of an amount of money."""
    found = F.regexp_extract(text, r"([$€£¥]\s*[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    sign = F.substring(found, 1, 1)
    code = F.when(sign == "$", "USD").when(sign == "€", "EUR").when(sign == "£", "GBP").when(sign == "¥", "JPY")
    return F.when(found != "", F.struct(F.regexp_replace(found, "[^0-9.]", "").cast("double").alias("value"), code.alias("code")))


def duration_hms(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), F.floor(seconds % 60).cast("long")
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def duration_words(seconds: Column) -> Column:
    m = F.floor(seconds / 60).cast("long")
    return F.when(m < 1, "less than a minute").when(m == 1, "1 minute").otherwise(F.format_string("%d minutes", m))


def _minutes_seconds(seconds: Column) -> tuple[Column, Column]:
    return F.floor(seconds / 60).cast("long"), F.floor(seconds % 60).cast("long")


def duration_units(seconds: Column) -> Column:
    """'5 minutes', under one '42 seconds'."""
    m, s = _minutes_seconds(seconds)
    one = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    return F.when(m > 0, one(m, "minute")).otherwise(one(s, "second"))


def duration_ms(seconds: Column) -> Column:
    m, s = _minutes_seconds(seconds)
    return F.when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def duration_clock(seconds: Column) -> Column:
    return F.format_string("%d:%02d", *_minutes_seconds(seconds))


def size_text(n: Column) -> Column:
    return F.when(n >= 1 << 30, F.format_string("%.1f GB", n / float(1 << 30))).when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).when(n >= 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%d bytes", n))


#: How levels of a log are shown.
LEVEL_NAMES = {"debug": "Debug", "info": "Info", "default": "Default", "error": "Error", "fault": "Critical"}


def level_name(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in LEVEL_NAMES.items() for x in p])[level], F.lit("Unknown"))


def monitor(segment: Column) -> Column:
    """The number after 'monitor' in the first part of a segment id that starts so; else 0."""
    part = F.get(F.filter(F.split(segment, "_"), lambda p: p.startswith("monitor")), F.lit(0))
    return F.coalesce(F.substring(part, 8, 20).try_cast("int"), F.lit(0))
