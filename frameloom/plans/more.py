"""Evidence, reports and the remaining helpers as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detection, evidence, joins, kernels, operations, privacy, reports, scans, summaries
from ..sources import adapters as A
from .detect import MATCHES
from .registry import query
from .sequence import GAP, GROUPED, HOUR, SESSIONS, grouped
from .tell import CAME, IMPORTANT, KEYS, PROPAGATED, TOLD, W16, correlated, evidence_frames, propagated, told, told_in_context

EV, RG, SP, VS, CU = A.EVENTS_SQL, A.REGIONS_SQL, A.SPANS_SQL, A.VISITS_SQL, A.CURSOR_SQL


def frames(spark, d):
    return A.events(spark, d).select(F.col("event_id").alias("frame_id"), "stream", "us", "app_name")


def linked(spark, d):
    e = A.events(spark, d).withColumn("evidence_frames", F.array(F.col("event_id"), F.col("event_id") + 1))
    return evidence.links(e, frames(spark, d))


LINKED = f"{EV}, ex AS (SELECT stream, event_id, confidence, unnest([event_id, event_id + 1]) AS frame_id FROM ev), li AS (SELECT ex.stream, ex.event_id, frame_id, ex.confidence, f.app_name FROM ex JOIN ev f ON f.event_id = frame_id)"


@query("j8_frames_in_sessions", f"WITH {SESSIONS} SELECT se.stream, se.island::BIGINT AS island, f.event_id AS frame_id FROM se JOIN ev f ON f.stream = se.stream AND f.us BETWEEN start_us AND end_us")
def j8(spark, d):
    return evidence.frames_inside(told(spark, d), frames(spark, d), KEYS).select(*KEYS, "frame_id")


@query("j9_nearest_event", f"WITH {EV} SELECT a.stream, a.event_id AS a_id, b.event_id AS b_id, round(1 - abs(a.us - b.us) / {HOUR}, 6) AS score FROM ev a JOIN ev b ON a.stream = b.stream AND a.event_id <> b.event_id AND abs(a.us - b.us) <= {HOUR} QUALIFY row_number() OVER (PARTITION BY a.stream, a.event_id ORDER BY abs(a.us - b.us), b.event_id) = 1")
def j9(spark, d):
    e = A.events(spark, d)
    return evidence.nearest(e, e, HOUR)


@query("j10_evidence_frames", f"WITH {LINKED} SELECT stream, event_id, frame_id, confidence, app_name FROM li")
def j10(spark, d):
    return linked(spark, d)


@query("j11_spatial_consistency", f"WITH {LINKED} SELECT event_id, count(DISTINCT frame_id) AS frames, count(DISTINCT app_name) AS apps, CASE WHEN count(DISTINCT app_name) <= 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS spatial FROM li GROUP BY 1")
def j11(spark, d):
    return evidence.spatial_consistency(linked(spark, d))


@query("j13_links_both_ways", f"WITH {LINKED} SELECT 'event' AS of, event_id AS id, list_sort(list(DISTINCT frame_id)) AS linked FROM li GROUP BY event_id UNION ALL SELECT 'frame', frame_id, list_sort(list(DISTINCT event_id)) FROM li GROUP BY frame_id")
def j13(spark, d):
    return evidence.both_ways(linked(spark, d))


@query("j14_traces", f"""WITH {SESSIONS}, ex AS (SELECT stream, island, event_id, unnest([event_id, event_id + 1]) AS frame_id FROM isl), fr AS (SELECT ex.stream, ex.island, count(DISTINCT frame_id) AS frames FROM ex JOIN ev f ON f.event_id = frame_id GROUP BY 1, 2),
en AS (SELECT stream, island, count(*) AS events, sum(confidence) AS sure FROM isl GROUP BY 1, 2) SELECT se.stream, se.island::BIGINT AS island, events, frames, 1 + events + frames AS steps, round((0.1 * avg_confidence + 0.3 * sure + 0.6 * frames) / (1 + events + frames), 6) AS confidence, frames > 0 AS complete FROM se JOIN en USING (stream, island) JOIN fr USING (stream, island)""")
def j14(spark, d):
    return evidence.traces(told(spark, d), grouped(spark, d), linked(spark, d), KEYS)


SHORT = "(right(text, 1) = ':' OR length(text) < 12)"


@query("j15_strict_label_values", f"WITH {RG} SELECT a.frame, a.idx, b.idx AS b_idx FROM rg a JOIN rg b ON a.stream = b.stream AND a.frame = b.frame AND b.idx > a.idx WHERE (right(a.text, 1) = ':' OR length(a.text) < 12) AND NOT (right(b.text, 1) = ':' OR length(b.text) < 12) AND (b.x + b.w / 2 > a.x + a.w / 2 OR b.y + b.h / 2 > a.y + a.h / 2) QUALIFY row_number() OVER (PARTITION BY a.stream, a.frame, a.idx ORDER BY pow(b.x + b.w / 2 - a.x - a.w / 2, 2) + pow(b.y + b.h / 2 - a.y - a.h / 2, 2), b.idx) = 1")
def j15(spark, d):
    return kernels.nearest_later(A.regions(spark, d), F.expr(SHORT)).select("frame", "idx", "b_idx")


@query("j17_first_meeting_region", f"WITH {RG} SELECT a.frame, a.idx, min(b.idx) AS first FROM rg a JOIN rg b ON a.stream = b.stream AND a.frame = b.frame AND a.idx < b.idx AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h GROUP BY 1, 2")
def j17(spark, d):
    r = A.regions(spark, d)
    o = joins.overlaps(r, r, ("stream", "frame")).where("a_idx < b_idx")
    return o.groupBy(F.col("a_frame").alias("frame"), F.col("a_idx").alias("idx")).agg(F.min("b_idx").alias("first"))


@query("a4_pattern_statistics", f"""WITH {EV}, n AS (SELECT type || '>' || lead(type) OVER w AS pattern, us, event_id, confidence FROM ev WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY us DESC, event_id DESC) AS k FROM n WHERE pattern IS NOT NULL) SELECT pattern, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, round(avg(confidence) FILTER (k <= 100), 6) AS recent FROM r GROUP BY 1""")
def a4(spark, d):
    e = scans.lagged(A.events(spark, d), ("stream",), ("us", "event_id"), {"next": ("type", -1)})
    n = e.withColumn("pattern", F.concat("type", F.lit(">"), F.col("next"))).where("pattern is not null")
    last = scans.top_n(n, ("pattern",), (F.desc("us"), F.desc("event_id")), 100, ("event_id",)).groupBy("pattern").agg(F.round(F.avg("confidence"), 6).alias("recent"))
    return n.groupBy("pattern").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence")).join(last, "pattern")


@query("a6_counts_by_type", f"WITH {EV} SELECT stream, count(*) FILTER (type = 'click') AS click, count(*) FILTER (type = 'navigation') AS navigation, count(*) FILTER (type = 'error_display') AS error_display FROM ev GROUP BY 1")
def a6(spark, d):
    return A.events(spark, d).groupBy("stream").agg(*[F.count_if(F.col("type") == t).alias(t) for t in ("click", "navigation", "error_display")])


@query("a8_primary_type", f"WITH {GROUPED}, c AS (SELECT stream, island, type, count(*) AS n FROM isl GROUP BY 1, 2, 3) SELECT stream, island::BIGINT AS island, type FROM c QUALIFY row_number() OVER (PARTITION BY stream, island ORDER BY n DESC, type) = 1")
def a8(spark, d):
    return grouped(spark, d).groupBy(*KEYS).agg(F.mode("type", True).alias("type"))


@query("a22_engine_metrics", f"""WITH {RG}, u AS (SELECT stream, processor AS engine, confidence >= 0.7 AS ok, idx % 9 / 10 AS seconds, processor = 'tesseract' AND frame % 3 = 0 AS fallback FROM rg)
SELECT stream, coalesce(round(avg(ok::INT) FILTER (engine = 'vision'), 6), 0)::DOUBLE AS vision_success_rate, coalesce(round(avg(ok::INT) FILTER (engine = 'tesseract'), 6), 0)::DOUBLE AS tesseract_success_rate, coalesce(round(avg(seconds) FILTER (engine = 'vision'), 6), 0)::DOUBLE AS average_vision_time, coalesce(round(avg(seconds) FILTER (engine = 'tesseract'), 6), 0)::DOUBLE AS average_tesseract_time, round(avg(fallback::INT), 6) AS fallback_rate, count(*) AS total_processed FROM u GROUP BY 1""")
def a22(spark, d):
    r = A.regions(spark, d)
    return operations.engine_metrics(r.select("stream", F.col("processor").alias("engine"), (F.col("confidence") >= 0.7).alias("ok"), (F.col("idx") % 9 / 10).alias("seconds"), ((F.col("processor") == "tesseract") & (F.col("frame") % 3 == 0)).alias("fallback")))


@query("a18_privacy_report", f"WITH {MATCHES} SELECT stream, kind, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS sure, round(avg(confidence), 6) AS avg_confidence FROM ma GROUP BY 1, 2")
def a18(spark, d):
    m = privacy.matches(A.regions(spark, d)).select("stream", F.explode("matches").alias("m"))
    return m.groupBy("stream", "m.kind").agg(F.count("*").alias("n"), F.count_if(F.col("m.confidence") >= 0.8).alias("sure"), F.round(F.avg("m.confidence"), 6).alias("avg_confidence"))


@query("e9_e37_names_and_sizes", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE (o_orderkey % 9)::INT END AS monitor, CASE WHEN o_totalprice::BIGINT * 1024 >= 1048576 THEN 'MB' WHEN o_totalprice::BIGINT * 1024 >= 1024 THEN 'KB' ELSE 'bytes' END AS unit, CASE o_orderkey % 6 WHEN 0 THEN 'Debug' WHEN 1 THEN 'Info' WHEN 2 THEN 'Default' WHEN 3 THEN 'Error' WHEN 4 THEN 'Critical' ELSE 'Unknown' END AS level FROM orders")
def e9(spark, d):
    o = A.table(spark, d, "orders")
    segment = F.when(F.col("o_orderkey") % 3 == 0, F.format_string("segment_%d", F.col("o_orderkey"))).otherwise(F.format_string("segment_monitor%d_%d", F.col("o_orderkey") % 9, F.col("o_orderkey")))
    size = T.size_text(F.round("o_totalprice").cast("long") * 1024)
    return o.select("o_orderkey", T.monitor(segment).alias("monitor"), F.substring_index(size, " ", -1).alias("unit"), T.level_name(F.element_at(F.array(*map(F.lit, (*T.LEVEL_NAMES, "other"))), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("level"))


@query("e28_keywords", f"WITH {SP} SELECT span_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]'), lambda w: length(w) > 2))) AS words FROM sp")
def e28(spark, d):
    return A.spans(spark, d).select("span_id", F.sort_array(T.keywords(F.col("title"))).alias("words"))


@query("w13_horizon", f"WITH {EV}, m AS (SELECT stream, max(us) AS last FROM ev GROUP BY 1) SELECT event_id FROM ev JOIN m USING (stream) WHERE us >= last - {GAP}")
def w13(spark, d):
    e = A.events(spark, d)
    return e.join(e.groupBy("stream").agg(F.max("us").alias("last")), "stream").where(F.col("us") >= F.col("last") - GAP).select("event_id")


NARRATED = f"""{SESSIONS}, k AS (SELECT * FROM isl QUALIFY row_number() OVER (PARTITION BY stream, island ORDER BY {IMPORTANT} DESC, confidence DESC, event_id) <= 5),
t AS (SELECT stream, island, string_agg({TOLD}, '. ' ORDER BY us, event_id) AS said FROM k GROUP BY 1, 2),
rr AS (SELECT stream || '-' || island::BIGINT AS session, session_type, strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%SZ') AS start, CASE WHEN seconds >= 3600 THEN floor(seconds / 3600)::BIGINT || 'h ' || floor(seconds % 3600 / 60)::BIGINT || 'm ' || floor(seconds % 60)::BIGINT || 's' WHEN seconds >= 60 THEN floor(seconds / 60)::BIGINT || 'm ' || floor(seconds % 60)::BIGINT || 's' ELSE floor(seconds)::BIGINT || 's' END AS duration, n_events, avg_confidence,
 'A ' || session_type || ' session of ' || CASE WHEN seconds < 60 THEN 'less than a minute' WHEN seconds < 120 THEN '1 minute' ELSE floor(seconds / 60)::BIGINT || ' minutes' END || ' with ' || n_events || ' events in ' || primary_app || '. ' || said || '.' AS narrative FROM se JOIN t USING (stream, island))"""


DIRECT = "di AS (SELECT DISTINCT stream, island::BIGINT AS island, unnest([event_id, event_id + 1]) AS frame_id FROM ke), dl AS (SELECT stream, island, list(frame_id ORDER BY frame_id) AS frames FROM di GROUP BY 1, 2)"


def direct_frames(spark, d):
    """Frames of sessions' key events, once each, with what is known of them."""
    key = summaries.key_events(grouped(spark, d), KEYS).join(told(spark, d).select(*KEYS), list(KEYS), "left_semi")
    named = key.select(*KEYS, F.explode(F.array(F.col("event_id"), F.col("event_id") + 1)).alias("frame_id")).distinct()
    return named.join(evidence_frames(spark, d).select("frame_id", "app_name", "ocr"), "frame_id", "left")


@query("r12_report_rows", f"""WITH {PROPAGATED}, {DIRECT} SELECT se.stream || '-' || se.island::BIGINT AS session_id, session_type, strftime(make_timestamp(start_us), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(make_timestamp(end_us), '%Y-%m-%d %H:%M:%S') AS end_time, format('{{:.1f}}', seconds) AS duration_seconds, n_events::VARCHAR AS event_count, primary_app AS primary_application,
 format('{{:.3f}}', pr.overall) AS confidence_score, array_to_string({CAME}, '; ') AS outcomes, array_to_string(frames, '; ') AS evidence_frames, format('{{:.3f}}', trace_confidence) AS evidence_trace_confidence FROM se JOIN pr ON pr.stream = se.stream AND pr.island = se.island::BIGINT JOIN dl ON dl.stream = se.stream AND dl.island = se.island::BIGINT""")
def r12(spark, d):
    s = summaries.outcomes(summaries.session_confidence(told_in_context(spark, d), F.col("continuity")))
    frames = direct_frames(spark, d).groupBy(*KEYS).agg(F.sort_array(F.collect_list("frame_id")).alias("frames"))
    return reports.csv_rows(s, propagated(spark, d).select(*KEYS, "trace_confidence").join(frames, list(KEYS)))


@query("r14_evidence_sections", f"""WITH {PROPAGATED}, {W16}, {DIRECT}, dx AS (SELECT di.stream, di.island, di.frame_id, CASE WHEN ev.event_id IS NULL THEN '' ELSE ' (' || app_name || ')' || CASE WHEN ev.event_id % 2 = 0 THEN ' - OCR: ' || format('{{:.1f}}%', confidence * 100) ELSE '' END END AS said FROM di LEFT JOIN ev ON ev.event_id = frame_id QUALIFY row_number() OVER (PARTITION BY di.stream, di.island ORDER BY frame_id) <= 5),
dd AS (SELECT stream, island, string_agg('- `' || frame_id || '`' || said || chr(10), '' ORDER BY frame_id) AS md, string_agg('<li><code>' || frame_id || '</code>' || said || '</li>', '' ORDER BY frame_id) AS ht FROM dx GROUP BY 1, 2),
nn AS (SELECT stream, island::BIGINT AS island, frame_id, rank, '(Score: ' || format('{{:.2f}}', score) || ', Reasons: ' || array_to_string(list_filter([CASE WHEN near > 0.5 THEN 'temporal_proximity_to_events' END, CASE WHEN app = own THEN 'application_context_match' END, CASE WHEN transition > 0.7 THEN 'significant_scene_transition' END, CASE WHEN list_contains(apps, app) THEN 'workflow_continuity' END], lambda x: x IS NOT NULL), ', ') || ')' AS met FROM rk WHERE rank <= 3),
ng AS (SELECT stream, island, string_agg('- `' || frame_id || '` ' || met || chr(10), '' ORDER BY rank) AS md, string_agg('<li><code>' || frame_id || '</code> ' || met || '</li>', '' ORDER BY rank) AS ht FROM nn GROUP BY 1, 2),
f AS (SELECT pr.stream, pr.island, unnest([struct_pack(form := 'markdown', text := '#### Evidence & Traceability' || chr(10) || chr(10) || '**Trace Confidence:** ' || format('{{:.1f}}%', trace_confidence * 100) || chr(10) || chr(10) || '**Direct Evidence Frames:**' || chr(10) || coalesce(dd.md, '') || chr(10) || CASE WHEN ng.md IS NULL THEN '' ELSE '**Temporally Correlated Frames:**' || chr(10) || ng.md || chr(10) END
 || '**Confidence Analysis:**' || chr(10) || '- Frame Confidence: ' || format('{{:.1f}}%', frame_confidence * 100) || chr(10) || '- Event Confidence: ' || format('{{:.1f}}%', event_confidence * 100) || chr(10) || '- Temporal Consistency: ' || format('{{:.1f}}%', temporal * 100) || chr(10) || '- Evidence Completeness: ' || format('{{:.1f}}%', completeness * 100) || chr(10) || chr(10)),
 struct_pack(form := 'html', text := '<div class="evidence"><h4>Evidence &amp; Traceability</h4><p><strong>Trace Confidence:</strong> <span class="confidence">' || format('{{:.1f}}%', trace_confidence * 100) || '</span></p><h5>Direct Evidence Frames</h5><ul>' || coalesce(dd.ht, '') || '</ul>' || CASE WHEN ng.ht IS NULL THEN '' ELSE '<h5>Temporally Correlated Frames</h5><ul>' || ng.ht || '</ul>' END || '</div>')]) AS s
 FROM pr LEFT JOIN dd USING (stream, island) LEFT JOIN ng USING (stream, island)) SELECT stream, island, s.form AS form, s.text AS text FROM f""")
def r14(spark, d):
    return reports.evidence_sections(propagated(spark, d), direct_frames(spark, d), correlated(spark, d), KEYS)


ESCAPED = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
NL = "' || chr(10) || '"


@query("r13_report_pieces", f"""WITH {NARRATED}, f AS (SELECT session, unnest([struct_pack(form := 'markdown', text := '## ' || session || ' (' || session_type || '){NL}{NL}* start: ' || start || '{NL}* duration: ' || duration || '{NL}* events: ' || n_events || '{NL}{NL}' || narrative || chr(10)), struct_pack(form := 'html', text := '<section><h2>' || {ESCAPED('session')} || '</h2><p>' || {ESCAPED('duration')} || '</p><p>' || {ESCAPED('narrative')} || '</p></section>'),
 struct_pack(form := 'csv', text := concat_ws(',', session, session_type, start, duration, n_events, avg_confidence, narrative)), struct_pack(form := 'json', text := '{{"avg_confidence":' || avg_confidence || ',"duration":"' || duration || '","n_events":' || n_events || ',"narrative":"' || narrative || '","session":"' || session || '","session_type":"' || session_type || '","start":"' || start || '"}}')]) AS p FROM rr) SELECT session, p.form AS form, p.text AS text FROM f""")
def r13(spark, d):
    t = told(spark, d).join(summaries.narratives(grouped(spark, d), told(spark, d), KEYS), list(KEYS))
    return reports.render(t)


@query("p6_detected_events", f"""WITH {EV}, {RG} SELECT 'event' AS source, event_id AS id, 0 AS idx, type, confidence FROM ev UNION ALL SELECT 'region', frame, idx, 'error_display', round(confidence * 0.9, 6) FROM rg WHERE regexp_matches(lower(text), 'error|failed|invalid|incorrect|wrong|cannot|unable|denied|forbidden|timeout|exception|warning|alert|problem')
 UNION ALL SELECT 'region', frame, idx, 'modal_appearance', round(confidence * 0.85, 6) FROM rg WHERE regexp_matches(lower(text), 'confirm|cancel|ok|yes|no|close|dialog|popup|modal|alert|notification') UNION ALL SELECT 'region', frame, idx, 'form_submission', round(confidence * 0.8, 6) FROM rg WHERE regexp_matches(lower(text), 'submit|send|save|create|update|login|register|sign in|sign up|continue')""")
def p6(spark, d):
    found = detection.standalone_events(A.regions(spark, d)).select(F.lit("region").alias("source"), F.col("frame").alias("id"), "idx", "type", "confidence")
    return A.events(spark, d).select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.lit(0).cast("long").alias("idx"), "type", "confidence").unionByName(found)


@query("m1_metadata_maps", f"WITH {EV} SELECT event_id, list_filter(['app_name=' || app_name, CASE WHEN type = 'click' THEN 'button=left' END, 'confidence=' || round(confidence * 100)::BIGINT, 'target=' || target], lambda x: x IS NOT NULL) AS entries FROM ev")
def m1(spark, d):
    full = F.create_map(F.lit("app_name"), F.col("app_name"), F.lit("button"), F.when(F.col("type") == "click", "left"), F.lit("confidence"), F.round(F.col("confidence") * 100).cast("long").cast("string"), F.lit("target"), F.col("target"))
    known = F.map_filter(full, lambda k, v: v.isNotNull())
    return A.events(spark, d).select("event_id", F.transform(F.array_sort(F.map_entries(known)), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("entries"))
