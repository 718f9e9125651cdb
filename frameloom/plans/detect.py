"""Detection, privacy and parsing as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection, kernels, privacy
from ..sources import adapters as A
from .registry import query
from .sequence import CLUSTERS

RG = A.REGIONS_SQL


def _rules_sql() -> str:
    """The rule table as SQL values; the buttons' words are matched whole."""
    rows = []
    for k, (pattern, kind, weight) in enumerate(detection.RULES):
        p = detection.WHOLE % pattern if pattern == detection.BUTTONS else f"({pattern})"
        rows.append(f"({k}, '{p}', '{kind}', {weight}::DOUBLE)")
    return f"ru(ord, pat, kind, weight) AS (VALUES {', '.join(rows)})"


MODAL = f"""{RG}, {_rules_sql()}, hit AS (SELECT stream, frame, idx, text, confidence, ord, kind, weight FROM rg JOIN ru ON regexp_matches(lower(text), pat)),
ag AS (SELECT stream, frame, idx, any_value(confidence) AS c, avg(weight) AS mean, arg_max(kind, weight * 1000 + ord) AS kind FROM hit GROUP BY 1, 2, 3),
md AS (SELECT stream, frame, idx, kind, CASE kind WHEN 'system_error' THEN 'critical' WHEN 'network_error' THEN 'high' WHEN 'auth_error' THEN 'high' WHEN 'system_alert' THEN 'high' WHEN 'application_error' THEN 'medium' WHEN 'validation_error' THEN 'medium' WHEN 'warning' THEN 'medium' WHEN 'app_alert' THEN 'medium' ELSE 'info' END AS severity,
 round(least(1, 0.7 * mean + 0.3 * c), 6) AS confidence FROM ag WHERE least(1, 0.7 * mean + 0.3 * c) >= 0.6)"""


@query("p4_error_modal_events", f"WITH {MODAL} SELECT stream, frame, idx, kind, severity, confidence, CASE WHEN kind IN ('system_error','network_error','auth_error','validation_error','application_error','warning') THEN 'error_display' ELSE 'modal_appearance' END AS type, kind || '_' || severity AS target FROM md")
def p4(spark, d):
    return detection.error_modal_events(A.regions(spark, d)).drop("title")


@query("p3_standalone_events", f"""WITH {RG}, t AS (SELECT *, lower(text) AS t FROM rg)
SELECT stream, frame, idx, 'error_display' AS type, round(confidence * 0.9, 6) AS confidence FROM t WHERE regexp_matches(t, 'error|failed|invalid|incorrect|wrong|cannot|unable|denied|forbidden|timeout|exception|warning|alert|problem') UNION ALL
SELECT stream, frame, idx, 'modal_appearance', round(confidence * 0.85, 6) FROM t WHERE regexp_matches(t, 'confirm|cancel|ok|yes|no|close|dialog|popup|modal|alert|notification') UNION ALL
SELECT stream, frame, idx, 'form_submission', round(confidence * 0.8, 6) FROM t WHERE regexp_matches(t, 'submit|send|save|create|update|login|register|sign in|sign up|continue')""")
def p3(spark, d):
    return detection.standalone_events(A.regions(spark, d))


@query("p7_frame_gate", f"WITH {RG}, f AS (SELECT stream, frame, count(*) AS n FROM rg WHERE confidence >= 0.7 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY stream ORDER BY frame)::INT AS seq FROM f")
def p7(spark, d):
    return detection.frame_gate(A.regions(spark, d))


def _first_of(groups, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{v}'" for p, v in groups) + f" ELSE '{otherwise}' END"


@query("p5_layout_dialogs", f"""WITH RECURSIVE {CLUSTERS}, g AS (SELECT stream, frame, cluster::BIGINT AS cluster, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n, string_agg(text, ' ' ORDER BY idx) AS text FROM cl JOIN rg USING (stream, frame, idx) GROUP BY 1, 2, 3),
s AS (SELECT *, round(CASE WHEN w >= 200 AND h >= 100 AND w <= 1536 AND h <= 864 THEN 0.4 ELSE 0 END + CASE WHEN abs(x + w / 2 - 960) <= 384 AND abs(y + h / 2 - 540) <= 216 THEN 0.3 ELSE 0 END + CASE WHEN w / h BETWEEN 0.8 AND 3 THEN 0.2 ELSE 0 END + CASE WHEN x >= 50 AND y >= 50 AND x + w <= 1870 AND y + h <= 1030 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM g WHERE n >= 2)
SELECT stream, frame, cluster, n, score, {_first_of(detection.DIALOGS, 'info_dialog')} AS kind, {_first_of(detection.LEVELS, 'info')} AS severity FROM s WHERE score >= 0.6""")
def p5(spark, d):
    return detection.layout_dialogs(kernels.clusters(A.regions(spark, d))).select("stream", "frame", "cluster", "n", "score", "kind", "severity")


@query("p8_temporal_patterns")
def p8(spark, d):
    e = detection.standalone_events(A.regions(spark, d)).withColumn("target", F.col("type"))
    return kernels.temporal_patterns(e)


@query("e4_group_boxes", f"WITH {RG} SELECT stream, frame, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM rg GROUP BY 1, 2")
def e4(spark, d):
    return detection.group_boxes(A.regions(spark, d), "stream", "frame").drop("text")


#: The one pattern with look-aheads, spelt out without them for SQL engines that have none.
SQL_PATTERNS = privacy.PATTERNS | {"ssn": r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d{2}|6[0-57-9]\d|66[0-57-9])[-\s]?(?:0[1-9]|[1-9]\d)[-\s]?(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"}
DIGITS = "regexp_replace(match, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (i % 2 = 0) THEN (CASE WHEN {DIGITS}[length({DIGITS}) - i + 1]::INT > 4 THEN {DIGITS}[length({DIGITS}) - i + 1]::INT * 2 - 9 ELSE {DIGITS}[length({DIGITS}) - i + 1]::INT * 2 END) ELSE {DIGITS}[length({DIGITS}) - i + 1]::INT END)) % 10 = 0"
OWN = f"""CASE kind WHEN 'email' THEN CASE WHEN contains(match, '@') AND contains(match, '.') THEN 0.9 ELSE 0.3 END WHEN 'phone' THEN CASE WHEN length({DIGITS}) BETWEEN 10 AND 15 THEN 0.8 ELSE 0.4 END WHEN 'ssn' THEN CASE WHEN length({DIGITS}) = 9 AND {DIGITS} <> '000000000' THEN 0.95 ELSE 0.2 END
 WHEN 'credit_card' THEN CASE WHEN length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN} THEN 0.9 ELSE 0.3 END WHEN 'ip_address' THEN 0.85 WHEN 'url' THEN 0.9 ELSE 0.7 END"""


def _found(kind: str) -> str:
    """Matches of a kind with their offsets: what stands before each, and the matches before it, added up."""
    p = SQL_PATTERNS[kind]
    return f"""SELECT stream, frame, idx, text, '{kind}' AS kind, m[i] AS match, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::INT AS start
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM rg WHERE regexp_matches(text, '{p}')))"""


MATCHES = f"""{RG}, fo AS ({' UNION ALL '.join(_found(k) for k in SQL_PATTERNS)}), pm AS (SELECT *, round(least(1, {OWN} + CASE WHEN regexp_matches(lower(text), '{privacy.CONTEXT}') THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS confidence FROM fo), ma AS (SELECT * FROM pm WHERE confidence >= 0.7)"""


def matched(spark, d):
    return privacy.matches(A.regions(spark, d))


@query("pi1_matches", f'WITH {MATCHES} SELECT stream, frame, idx, start, (start + length(match))::INT AS "end", kind, match, confidence FROM ma')
def pi1(spark, d):
    m = matched(spark, d).select("stream", "frame", "idx", F.explode("matches").alias("m"))
    return m.select("stream", "frame", "idx", "m.start", "m.end", "m.kind", "m.match", "m.confidence")


IPS = privacy.PATTERNS["ip_address"]


@query("pi1_addresses", f"WITH {RG} SELECT frame, idx, unnest(regexp_extract_all(text, '{IPS}')) AS ip FROM rg")
def pi1_ip(spark, d):
    m = privacy.matches(A.regions(spark, d), kinds=("ip_address",)).select("frame", "idx", F.explode("matches").alias("m"))
    return m.select("frame", "idx", F.col("m.match").alias("ip"))


USER, DOMAIN = "split_part(match, '@', 1)", "split_part(match, '@', -1)"
#: A match with its middle hidden, as kinds have it.
MASK = f"""CASE WHEN kind = 'email' THEN CASE WHEN length({USER}) > 2 THEN {USER}[1] || repeat('*', length({USER}) - 2) || {USER}[-1] ELSE repeat('*', length({USER})) END || '@' || CASE WHEN contains({DOMAIN}, '.') THEN {DOMAIN}[1] || '***.' || split_part({DOMAIN}, '.', -1) ELSE '***' END
 WHEN kind IN ('phone', 'credit_card') THEN CASE WHEN length({DIGITS}) >= 4 THEN repeat('*', length({DIGITS}) - 4) || right({DIGITS}, 4) ELSE repeat('*', length(match)) END
 ELSE left(match, greatest(1, floor(length(match) * 0.2))::INT) || repeat('*', greatest(0, length(match) - 2 * greatest(1, floor(length(match) * 0.2)))::INT) || right(match, greatest(1, floor(length(match) * 0.2))::INT) END"""
KINDS = "[" + ", ".join(f"'{k}'" for k in privacy.PATTERNS) + "]"
#: Of overlapping matches the first stays, of those that begin together the longest; what lies between is kept.
MASKED = f"""WITH RECURSIVE {MATCHES}, mo AS (SELECT *, start + length(match) AS stop, row_number() OVER (PARTITION BY stream, frame, idx ORDER BY start, length(match) DESC, list_position({KINDS}, kind)) AS k FROM ma),
st AS (SELECT stream, frame, idx, k, start, stop, match, kind, true AS stays, stop AS reached FROM mo WHERE k = 1 UNION ALL SELECT m.stream, m.frame, m.idx, m.k, m.start, m.stop, m.match, m.kind, m.start >= s.reached, CASE WHEN m.start >= s.reached THEN m.stop ELSE s.reached END FROM st s JOIN mo m ON m.stream = s.stream AND m.frame = s.frame AND m.idx = s.idx AND m.k = s.k + 1),
ke AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY stream, frame, idx ORDER BY k), 0) AS since, {MASK} AS hidden FROM st WHERE stays),
pt AS (SELECT ke.stream, ke.frame, ke.idx, any_value(text) AS text, max(stop) AS last, string_agg(substring(text, since::INT + 1, (start - since)::INT) || hidden, '' ORDER BY k) AS said FROM ke JOIN rg ON rg.stream = ke.stream AND rg.frame = ke.frame AND rg.idx = ke.idx GROUP BY 1, 2, 3)"""


@query("pi3_masked", f"{MASKED} SELECT stream, frame, idx, said || substring(text, last::INT + 1) AS masked FROM pt")
def pi3(spark, d):
    m = privacy.mask_text(matched(spark, d).where(F.size("matches") > 0))
    return m.select("stream", "frame", "idx", "masked")


@query("pi4_decisions", f"WITH {MATCHES}, b AS (SELECT DISTINCT stream, frame, idx FROM ma WHERE kind <> 'url') SELECT stream, frame, idx, b.idx IS NULL AS stored, CASE WHEN b.idx IS NULL THEN text ELSE '[CONTENT BLOCKED - CONTAINS PII]' END AS content FROM rg LEFT JOIN b USING (stream, frame, idx)")
def pi4(spark, d):
    m = privacy.decide(privacy.mask_text(matched(spark, d)), allowed=("url",), prevent=True)
    return m.select("stream", "frame", "idx", "stored", "content")


@query("a17_audit_statistics", f"""WITH {MATCHES}, k AS (SELECT stream, frame, idx, list(DISTINCT kind) AS kinds FROM ma GROUP BY 1, 2, 3), se AS (SELECT *, CASE WHEN list_has_any(kinds, ['ssn', 'credit_card', 'passport', 'drivers_license']) THEN 'critical' WHEN list_has_any(kinds, ['email', 'phone', 'date_of_birth']) THEN 'high' WHEN len(kinds) > 3 THEN 'medium' ELSE 'low' END AS severity FROM k),
ad AS (SELECT * FROM se WHERE severity <> 'low'), u AS (SELECT 'type' AS "by", 'pii_detected' AS value FROM ad UNION ALL SELECT 'severity', severity FROM ad UNION ALL SELECT 'source', stream FROM ad UNION ALL SELECT 'pii', unnest(kinds) FROM ad) SELECT "by", value, count(*) AS n FROM u GROUP BY 1, 2""")
def a17(spark, d):
    m = privacy.decide(privacy.mask_text(matched(spark, d)))
    return privacy.audit_statistics(privacy.admitted(privacy.audit_rows(m), ("pii_detected",), "medium"))
