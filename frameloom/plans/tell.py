"""Summaries, evidence, reports, playbooks and operations data as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contexts, operations, sequences, summaries
from ..sources import adapters as A
from .registry import query
from .sequence import GAP, GROUPED, ISLANDS, RELATED, SESSIONS, grouped

EV, SP = A.EVENTS_SQL, A.SPANS_SQL
KEYS = ("stream", "island")
IMPORTANT = "CASE type WHEN 'form_submission' THEN 10 WHEN 'error_display' THEN 9 WHEN 'modal_appearance' THEN 8 WHEN 'data_entry' THEN 7 WHEN 'field_change' THEN 6 WHEN 'navigation' THEN 5 WHEN 'app_switch' THEN 4 WHEN 'click' THEN 3 ELSE 0 END"
TOLD = "CASE type WHEN 'form_submission' THEN 'Submitted form' WHEN 'error_display' THEN 'Encountered error: ' || target WHEN 'navigation' THEN 'Navigated to ' || target WHEN 'data_entry' THEN 'Entered data in ' || target WHEN 'click' THEN 'Clicked on ' || target END"


@query("s3_key_events", f"WITH {GROUPED} SELECT event_id, stream, island::BIGINT AS island FROM isl QUALIFY row_number() OVER (PARTITION BY stream, island ORDER BY {IMPORTANT} DESC, confidence DESC, event_id) <= 5")
def s3(spark, d):
    return summaries.key_events(grouped(spark, d), KEYS).select("event_id", *KEYS)


def told(spark, d):
    return sequences.sessions(grouped(spark, d))


@query("r5_narratives", f"""WITH {SESSIONS}, k AS (SELECT * FROM isl QUALIFY row_number() OVER (PARTITION BY stream, island ORDER BY {IMPORTANT} DESC, confidence DESC, event_id) <= 5),
t AS (SELECT stream, island, string_agg({TOLD}, '. ' ORDER BY us, event_id) AS said FROM k GROUP BY 1, 2)
SELECT stream, island::BIGINT AS island, 'A ' || session_type || ' session of ' || CASE WHEN seconds < 60 THEN 'less than a minute' WHEN seconds < 120 THEN '1 minute' ELSE floor(seconds / 60)::BIGINT || ' minutes' END || ' with ' || n_events || ' events in ' || primary_app || '. ' || said || '.' AS narrative FROM se JOIN t USING (stream, island)""")
def r5(spark, d):
    return summaries.narratives(grouped(spark, d), told(spark, d), KEYS)


def session_spans(sessions):
    """Sessions as spans for each other's context: a span of forms filled is a submission; sessions with errors have no tags."""
    return sessions.select(
        F.concat_ws("-", *KEYS).alias("span_id"), "stream", F.when(F.col("session_type") == "form_filling", "form_submission").otherwise(F.col("session_type")).alias("kind"), F.concat("session_type", F.lit(" in "), "primary_app").alias("title"),
        F.when(F.col("errors") == 0, F.array("primary_app")).otherwise(F.array().cast("array<string>")).alias("tags"), (F.col("start_us") / 1e6).alias("t_start"), (F.col("end_us") / 1e6).alias("t_end"))


#: Sessions at hand lie hours and days apart: three days count as before, half as long as after.
BEFORE, AFTER = 259_200.0, 129_600.0
LIKE = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]'), lambda w: length(w) > 2))"
CONTEXT = f"""sp AS (SELECT *, list_distinct([lower(kind)] || list_transform(tags, lambda t: lower(t)) || {LIKE.format("title")}) AS words FROM (SELECT stream, island, stream || '-' || island::BIGINT AS span_id, CASE session_type WHEN 'form_filling' THEN 'form_submission' ELSE session_type END AS kind, session_type || ' in ' || primary_app AS title,
 CASE WHEN errors = 0 THEN [primary_app] ELSE [] END AS tags, start_us / 1e6 AS t0, end_us / 1e6 AS t1 FROM se)),
ow AS (SELECT stream, island, list_distinct(list(w) || [any_value(session_type), lower(any_value(primary_app))]) AS own, any_value(primary_app) AS app FROM (SELECT se.stream, se.island, session_type, primary_app, unnest([type] || {LIKE.format("target")}) AS w FROM isl JOIN se USING (stream, island)) GROUP BY 1, 2),
ar AS (SELECT a.stream, a.island, 'before' AS side, a.t0 - b.t1 AS gap, b.span_id, b.kind, b.title, b.tags, b.words FROM sp a JOIN sp b ON a.stream = b.stream AND a.t0 - b.t1 BETWEEN 0 AND {BEFORE} AND a.span_id <> b.span_id QUALIFY row_number() OVER (PARTITION BY a.span_id ORDER BY a.t0 - b.t1, b.span_id) <= 5
 UNION ALL SELECT a.stream, a.island, 'after', b.t0 - a.t1, b.span_id, b.kind, b.title, b.tags, b.words FROM sp a JOIN sp b ON a.stream = b.stream AND b.t0 - a.t1 BETWEEN 0 AND {AFTER} AND a.span_id <> b.span_id QUALIFY row_number() OVER (PARTITION BY a.span_id ORDER BY b.t0 - a.t1, b.span_id) <= 5),
cx AS (SELECT stream, island, min(gap) FILTER (side = 'before') AS g0, min(gap) FILTER (side = 'after') AS g1, avg(len(list_intersect(own, words)) / len(list_distinct(own || words))) AS alike, bool_or(list_contains(tags, app)) AS tagged, coalesce(list(kind) FILTER (side = 'before'), []) AS was, coalesce(list(kind) FILTER (side = 'after'), []) AS will,
 coalesce(list(title ORDER BY gap, span_id) FILTER (side = 'before'), []) AS titles FROM ar JOIN ow USING (stream, island) GROUP BY 1, 2),
rl AS (SELECT stream, island, list(a ORDER BY n DESC, a) AS related FROM (SELECT stream, island, a, count(*) AS n FROM (SELECT stream, island, unnest([kind] || tags) AS a FROM ar) GROUP BY 1, 2, 3) GROUP BY 1, 2),
wc AS (SELECT se.stream, se.island, session_type AS t, coalesce(was, []) AS was, coalesce(will, []) AS will, coalesce(titles, []) AS titles, coalesce(related, []) AS related, round(coalesce(list_avg(list_filter([greatest(0, 1 - g0 / {BEFORE}), greatest(0, 1 - g1 / {AFTER}), alike, CASE WHEN tagged THEN 0.8 END], lambda x: x IS NOT NULL)), 0), 6) AS continuity
 FROM se LEFT JOIN cx USING (stream, island) LEFT JOIN rl USING (stream, island)),
wf AS (SELECT stream, island, len(was) + len(will) > 0 AS part_of_workflow, CASE WHEN t = 'data_entry' THEN CASE WHEN list_contains(was, 'research') THEN 'data_collection' WHEN list_contains(will, 'form_submission') THEN 'data_input' ELSE 'data_entry' END
 WHEN t = 'form_filling' THEN CASE WHEN len(was) = 0 THEN 'form_initiation' WHEN list_contains(will, 'form_submission') THEN 'form_completion' ELSE 'form_filling' END WHEN t = 'navigation' THEN CASE WHEN list_contains(was, 'research') THEN 'information_seeking' ELSE 'navigation' END
 WHEN t = 'research' THEN CASE WHEN list_contains(will, 'data_entry') THEN 'research_for_action' ELSE 'information_gathering' END WHEN t = 'communication' THEN 'communication' WHEN t = 'development' THEN CASE WHEN list_contains(was, 'research') THEN 'implementation' ELSE 'development' END ELSE 'mixed_activity' END AS phase, continuity, related, titles FROM wc)"""
CAME = """list_filter([CASE WHEN submissions > 0 THEN 'Form submission completed' END, CASE WHEN data > 0 THEN 'Data entered in ' || data || ' fields' END, CASE WHEN visits > 0 THEN 'Navigated through ' || visits || ' different screens/pages' END, CASE WHEN errors > 0 THEN 'Encountered and potentially resolved errors' END,
 CASE session_type WHEN 'form_filling' THEN 'Form filling process completed' WHEN 'research' THEN 'Information gathering session completed' WHEN 'communication' THEN 'Communication activities performed' WHEN 'development' THEN 'Development work session completed' END], lambda x: x IS NOT NULL)"""
ADVICE = """CASE WHEN errors > 0 OR n_events / (seconds / 60) < 2 OR (session_type = 'form_filling' AND seconds > 600) OR continuity < 0.5 THEN list_filter([CASE WHEN errors > 0 THEN 'Consider process optimization to reduce error encounters' END, CASE WHEN n_events / (seconds / 60) < 2 THEN 'Workflow efficiency could be improved through automation or training' END,
 CASE WHEN session_type = 'form_filling' AND seconds > 600 THEN 'Form completion time suggests potential for UX improvements' END, CASE WHEN continuity < 0.5 THEN 'Consider improving workflow integration and context preservation' END], lambda x: x IS NOT NULL) ELSE ['Workflow completed successfully with good efficiency'] END"""
SURE = "round((avg_confidence + least(1, seconds / 300) + least(1, n_events / 10) + continuity) / 4, 8)"


def workflow(spark, d):
    s = told(spark, d)
    return contexts.workflow_continuity(s, grouped(spark, d), session_spans(s), KEYS, BEFORE, AFTER)


def told_in_context(spark, d):
    return told(spark, d).join(workflow(spark, d), list(KEYS))


@query("m12_workflow_continuity", f"WITH {SESSIONS}, {CONTEXT} SELECT stream, island::BIGINT AS island, part_of_workflow, phase, continuity, related, titles FROM wf")
def m12_workflow(spark, d):
    return workflow(spark, d)


@query("a12_continuity", f"WITH {SESSIONS}, {CONTEXT} SELECT stream, island::BIGINT AS island, continuity FROM wf")
def a12(spark, d):
    return workflow(spark, d).select(*KEYS, "continuity")


@query("r3_workflow_phases", f"WITH {SESSIONS}, {CONTEXT} SELECT stream, island::BIGINT AS island, phase FROM wf")
def r3(spark, d):
    return workflow(spark, d).select(*KEYS, "phase")


@query("a11_session_confidence", f"WITH {SESSIONS}, {CONTEXT} SELECT stream, island::BIGINT AS island, {SURE} AS confidence FROM se JOIN wf USING (stream, island)")
def a11(spark, d):
    return summaries.session_confidence(told_in_context(spark, d), F.col("continuity")).select(*KEYS, "confidence")


@query("a10_outcomes", f"WITH {SESSIONS} SELECT stream, island::BIGINT AS island, {CAME} AS outcomes FROM se")
def a10(spark, d):
    return summaries.outcomes(told(spark, d)).select(*KEYS, "outcomes")


@query("r7_recommendations", f"WITH {SESSIONS}, {CONTEXT} SELECT stream, island::BIGINT AS island, round(n_events / (seconds / 60), 6) AS efficiency, {ADVICE} AS recommendations FROM se JOIN wf USING (stream, island)")
def r7(spark, d):
    return summaries.recommendations(told_in_context(spark, d)).select(*KEYS, "efficiency", "recommendations")


def evidence_frames(spark, d):
    """Events as frames: some titled as their application, half of them with a confidence of their own."""
    e, n = A.events(spark, d), F.col("event_id")
    return e.select(n.alias("frame_id"), "stream", "us", "app_name", F.when(n % 3 == 0, F.col("app_name")).otherwise(F.col("target")).alias("title"), F.when(n % 2 == 0, F.col("confidence")).alias("ocr"), F.lit(None).cast("double").alias("quality"))


FRAMED = "pf AS (SELECT event_id AS frame_id, stream, us, app_name AS app, CASE WHEN event_id % 3 = 0 THEN app_name ELSE target END AS title, CASE WHEN event_id % 2 = 0 THEN confidence ELSE 0.8 END AS ocr FROM ev)"
PROPAGATED = f"""{SESSIONS}, {CONTEXT}, {FRAMED}, ke AS (SELECT isl.* FROM isl JOIN se USING (stream, island) QUALIFY row_number() OVER (PARTITION BY stream, island ORDER BY {IMPORTANT} DESC, confidence DESC, event_id) <= 5),
ee AS (SELECT k.stream, k.island, k.event_id, any_value(k.confidence) AS c, count(ocr) AS known, sum(ocr) AS ocr, count(DISTINCT app) AS apps, count(DISTINCT title) AS titled FROM (SELECT *, unnest([event_id, event_id + 1]) AS fid FROM ke) k LEFT JOIN pf ON pf.frame_id = fid GROUP BY 1, 2, 3),
ec AS (SELECT *, 0.4 * 0.4 + 0.6 * c AS temporal, CASE WHEN known = 0 THEN 0 ELSE (CASE WHEN apps = 1 THEN 1 ELSE 0.5 END + CASE WHEN titled <= 2 THEN 1 ELSE 0.7 END) / 2 END::DOUBLE AS spatial FROM ee),
pg AS (SELECT stream, island, count(*) AS n, avg(c) AS ec, sum(ocr) / sum(known) AS fc, sum(known)::BIGINT AS n_frames, sum(c) AS sure, sum(ocr) AS seen, avg(temporal) AS te, avg(spatial) AS sc FROM ec GROUP BY 1, 2),
pr AS (SELECT se.stream, se.island::BIGINT AS island, n AS n_key_events, n_frames, round(ec, 6) AS event_confidence, round(fc, 6) AS frame_confidence, round(te, 6) AS temporal, round(sc, 6) AS spatial, round(n / n_events, 6) AS completeness, round(0.4 * ec + 0.3 * fc + 0.2 * te + 0.1 * sc, 6) AS confidence, {SURE} AS overall, round((0.1 * (0.4 * ec + 0.3 * fc + 0.2 * te + 0.1 * sc) + 0.3 * sure + 0.6 * seen) / (1 + n + n_frames), 12) AS trace_confidence,
 list_filter([CASE WHEN n >= 5 THEN 'sufficient_events +0.2' END, CASE WHEN n < 3 THEN 'insufficient_events -0.3' END, CASE WHEN te > 0.8 THEN 'high_temporal_consistency +0.15' END, CASE WHEN te < 0.5 THEN 'low_temporal_consistency -0.2' END, CASE WHEN seconds > 300 THEN 'substantial_session +0.1' END, CASE WHEN seconds < 60 THEN 'brief_session -0.1' END], lambda x: x IS NOT NULL) AS factors
 FROM se JOIN wf USING (stream, island) JOIN pg USING (stream, island))"""


def propagated(spark, d):
    s = summaries.session_confidence(told_in_context(spark, d), F.col("continuity"))
    key = summaries.key_events(grouped(spark, d), KEYS).withColumn("evidence_frames", F.array(F.col("event_id"), F.col("event_id") + 1))
    p = contexts.propagation(s, key, contexts.frame_confidence(evidence_frames(spark, d)), KEYS, F.col("confidence"))
    shown = F.transform("factors", lambda f: F.concat(f["name"], F.when(f["impact"] > 0, " +").otherwise(" "), f["impact"].cast("string")))
    return p.withColumn("factors", shown)


@query("m12_confidence_propagation", f"WITH {PROPAGATED} SELECT * FROM pr")
def m12_propagation(spark, d):
    return propagated(spark, d)


@query("a13_evidence", f"WITH {PROPAGATED} SELECT stream, island, event_confidence, frame_confidence, temporal, spatial, completeness, confidence FROM pr")
def a13(spark, d):
    key = summaries.key_events(grouped(spark, d), KEYS).withColumn("evidence_frames", F.array(F.col("event_id"), F.col("event_id") + 1))
    p = contexts.propagation(told(spark, d), key, contexts.frame_confidence(evidence_frames(spark, d)), KEYS, F.lit(0.0))
    return p.select(*KEYS, "event_confidence", "frame_confidence", "temporal", "spatial", "completeness", "confidence")


@query("m12_frame_confidence", f"""WITH {EV}, {FRAMED}, n AS (SELECT *, count(*) OVER (PARTITION BY stream ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND 21600000000 FOLLOWING) - 1 AS others, count(*) OVER (PARTITION BY stream, app ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND 21600000000 FOLLOWING) - 1 AS same FROM pf)
SELECT frame_id, round(ocr, 6) AS ocr, 0.9::DOUBLE AS quality, round(CASE WHEN others > 0 THEN same / others ELSE 0.5 END, 6)::DOUBLE AS stability, least(1, 0.5 + CASE WHEN app IN ('Safari', 'Chrome', 'Firefox', 'Xcode', 'Terminal', 'Finder') THEN 0.3 ELSE 0 END + CASE WHEN title <> '' AND title <> app THEN 0.2 ELSE 0 END)::DOUBLE AS relevance FROM n""")
def m12_frames(spark, d):
    f = contexts.frame_confidence(evidence_frames(spark, d), 6 * 3_600_000_000)
    return f.select("frame_id", *[F.round(c, 6).alias(c) for c in ("ocr", "quality", "stability", "relevance")])


@query("a16_report", f"WITH {SESSIONS} SELECT session_type, count(*) AS sessions, round(sum(seconds), 6) AS seconds, round(avg(seconds), 6) AS avg_seconds, round(avg(n_events), 6) AS avg_events, round(avg(avg_confidence), 6) AS avg_confidence FROM se GROUP BY 1")
def a16(spark, d):
    return summaries.report(told(spark, d))



#: Frames a minute or two off the events of their numbers.
W16 = """ts AS (SELECT event_id, stream, us + event_id % 3 * 60000000 AS us, app_name, target FROM ev), ap AS (SELECT stream, island, list(DISTINCT app_name) AS apps FROM isl GROUP BY 1, 2),
fs AS (SELECT se.stream, se.island, ts.event_id AS frame_id, ts.us, ts.app_name, ts.target, primary_app FROM se JOIN ts ON ts.stream = se.stream AND ts.us BETWEEN start_us AND end_us),
ft AS (SELECT *, coalesce(CASE WHEN lag(app_name) OVER w <> app_name THEN 0.5 WHEN lag(target) OVER w <> target THEN 0.3 ELSE 0 END + CASE WHEN us - lag(us) OVER w > 5000000 THEN 0.2 ELSE 0 END, 0) AS transition FROM fs WINDOW w AS (PARTITION BY stream, island ORDER BY us, frame_id)),
n AS (SELECT ft.stream, ft.island, frame_id, any_value(transition) AS transition, any_value(ft.app_name) AS app, any_value(primary_app) AS own, any_value(apps) AS apps, greatest(0, 1 - min(abs(ft.us - isl.us)) / 300000000) AS near FROM ft JOIN isl USING (stream, island) JOIN ap USING (stream, island) GROUP BY 1, 2, 3),
sc AS (SELECT *, round((0.4 * near + CASE WHEN app = own THEN 0.3 ELSE 0 END + 0.2 * transition + 0.1 * (CASE WHEN list_contains(apps, app) THEN 0.4 ELSE 0 END + 0.6))::DOUBLE, 6) AS score FROM n), rk AS (SELECT *, row_number() OVER (PARTITION BY stream, island ORDER BY score DESC, frame_id) AS rank FROM sc WHERE score >= 0.5)"""


def near_frames(spark, d):
    return A.events(spark, d).withColumn("us", F.col("us") + F.col("event_id") % 3 * 60_000_000)


def correlated(spark, d):
    return summaries.correlated_frames(grouped(spark, d), told(spark, d), KEYS, near_frames(spark, d))


@query("w16_correlated_frames", f"""WITH {SESSIONS}, {W16} SELECT stream, island::BIGINT AS island, frame_id, score, list_filter([CASE WHEN near > 0.5 THEN 'temporal_proximity_to_events' END, CASE WHEN app = own THEN 'application_context_match' END, CASE WHEN transition > 0.7 THEN 'significant_scene_transition' END, CASE WHEN list_contains(apps, app) THEN 'workflow_continuity' END], lambda x: x IS NOT NULL) AS reasons,
 rank::INT AS rank FROM rk WHERE rank <= 10""")
def w16(spark, d):
    return correlated(spark, d)


def valued(spark, d):
    """Events with what was entered: their metadata, some times over."""
    return grouped(spark, d).withColumn("value", F.expr("repeat(metadata, CAST(1 + event_id % 4 AS INT))"))


STEPS = f"""{SESSIONS}, l AS (SELECT *, repeat(metadata, (1 + event_id % 4)::INT) AS value FROM isl), ac AS (SELECT *, CASE type WHEN 'field_change' THEN CASE WHEN value IS NULL THEN 'Modify ' ELSE 'Enter value in ' END || target WHEN 'form_submission' THEN 'Submit the form' WHEN 'modal_appearance' THEN 'Handle dialog or modal' WHEN 'error_display' THEN 'Address error message' WHEN 'navigation' THEN 'Navigate to ' || target
 WHEN 'data_entry' THEN 'Enter data in ' || target WHEN 'app_switch' THEN 'Switch to ' || target WHEN 'click' THEN 'Click on ' || target END AS act, CASE WHEN type IN ('field_change', 'data_entry') THEN greatest(3, 0.2 * coalesce(length(value), 10)) ELSE CASE type WHEN 'click' THEN 2 WHEN 'navigation' THEN 5 WHEN 'app_switch' THEN 3 WHEN 'form_submission' THEN 2 WHEN 'modal_appearance' THEN 4 WHEN 'error_display' THEN 10 END END::DOUBLE AS takes FROM l),
en AS (SELECT *, regexp_matches(act, 'Enter value|Enter data|Modify') AS entry FROM ac), nu0 AS (SELECT *, CASE WHEN entry AND coalesce(lag(entry) OVER (PARTITION BY stream, island ORDER BY us, event_id), false) THEN 0 ELSE 1 END AS new_step FROM en),
nu AS (SELECT *, sum(new_step) OVER (PARTITION BY stream, island ORDER BY us, event_id) AS step FROM nu0), st AS (SELECT stream, island::BIGINT AS island, step::BIGINT AS step, arg_min(type, (us, event_id)) AS type, string_agg(target, ', ' ORDER BY us, event_id) AS target, count(*) AS n, round(avg(confidence), 6) AS confidence, round(sum(takes), 6) AS seconds,
 CASE WHEN count(*) > 1 THEN 'Complete data entry for multiple fields' ELSE any_value(act) END AS instruction FROM nu GROUP BY 1, 2, 3 HAVING step <= 50),
hd AS (SELECT stream, island::BIGINT AS island, CASE WHEN n_events < 10 AND seconds < 300 THEN 'beginner' WHEN n_events < 25 AND n_events / (seconds / 60) < 2 THEN 'intermediate' ELSE 'advanced' END AS difficulty FROM se)"""


def steps(spark, d):
    return summaries.playbook_steps(valued(spark, d), KEYS)


@query("w20_playbook_steps", f"WITH {STEPS} SELECT stream, island, step, type, target, n, confidence, seconds, instruction FROM st")
def w20(spark, d):
    return steps(spark, d)


@query("r15_playbooks", f"""WITH {STEPS} SELECT stream, island, count(*) AS n_steps, round(sum(seconds), 6) AS seconds, difficulty, string_agg(step || '. ' || instruction, chr(10) ORDER BY step) AS markdown FROM st JOIN hd USING (stream, island) GROUP BY stream, island, difficulty""")
def r15(spark, d):
    return summaries.playbooks(steps(spark, d), told(spark, d), KEYS).select(*KEYS, "n_steps", "seconds", "difficulty", "markdown")


@query("a28_playbook_rollup", f"""WITH {SESSIONS}, {CONTEXT}, v AS (SELECT se.*, {CAME} AS outcomes, list_transform(titles, lambda t: 'Complete: ' || t) || ['Have ' || primary_app || ' installed and accessible'] || CASE WHEN session_type = 'form_filling' THEN ['Have required form data available'] ELSE [] END AS needs FROM se JOIN wf USING (stream, island)),
r AS (SELECT stream, count(*) AS n_sessions, sum(n_events)::BIGINT AS n_events, sum(seconds) AS seconds, arg_min(primary_app, (start_us, stream, island)) AS app, list_distinct(list(session_type)) AS types, list_sort(list_distinct(flatten(list(outcomes)))) AS outcomes, list_sort(list_distinct(flatten(list(needs)))) AS prerequisites FROM v GROUP BY 1),
k AS (SELECT app, stream, n_sessions, n_events, round(seconds, 3) AS seconds, outcomes, prerequisites, CASE WHEN len(types) = 1 THEN CASE types[1] WHEN 'form_filling' THEN 'form_workflow' WHEN 'mixed' THEN 'general' ELSE types[1] END WHEN list_contains(types, 'form_filling') AND list_contains(types, 'data_entry') THEN 'form_workflow' WHEN list_contains(types, 'development') THEN 'development' ELSE 'general' END AS type,
 CASE WHEN n_events < 10 AND seconds < 300 THEN 'beginner' WHEN n_events < 25 AND n_events / (seconds / 60) < 2 THEN 'intermediate' ELSE 'advanced' END AS difficulty FROM r)
SELECT * EXCLUDE (app), CASE type WHEN 'form_workflow' THEN 'Form Completion Workflow in ' WHEN 'data_entry' THEN 'Data Entry Process in ' WHEN 'navigation' THEN 'Navigation Guide for ' WHEN 'research' THEN 'Research Workflow in ' WHEN 'communication' THEN 'Communication Process in ' WHEN 'development' THEN 'Development Workflow in ' ELSE 'General Workflow in ' END || app AS title,
 'This playbook recreates a ' || replace(type, '_', ' ') || ' workflow based on ' || n_sessions || CASE WHEN n_sessions = 1 THEN ' recorded session' ELSE ' recorded sessions' END || ' with ' || n_events || ' total actions. Follow these steps to reproduce the same workflow.' AS description FROM k""")
def a28(spark, d):
    return contexts.playbook_rollup(told(spark, d), workflow(spark, d), KEYS).withColumn("seconds", F.round("seconds", 3))


#: Twenty days from the fifth on.
FROM_US, TO_US = 1704412800000000, 1706140800000000
SUMMARIZED = f"""{EV.replace("ev AS (", "ev0 AS (", 1)}, ev AS (SELECT * FROM ev0 WHERE us BETWEEN {FROM_US} AND {TO_US}),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)), i0 AS (SELECT *, sum(fresh) OVER (PARTITION BY stream ORDER BY us, event_id) AS gi FROM g),
i1 AS (SELECT *, (row_number() OVER (PARTITION BY stream, gi ORDER BY us, event_id) - 1) // 50 AS gc FROM i0), i2 AS (SELECT *, lag(type) OVER w AS was, lag(us) OVER w AS was_us FROM i1 WINDOW w AS (PARTITION BY stream, gi, gc ORDER BY us, event_id)),
i3 AS (SELECT *, CASE WHEN was IS NULL OR (CASE WHEN type = was THEN 1 {RELATED} ELSE 0 END + 1 + greatest(0, 1 - (us - was_us) / {GAP}) + 1) / 4 < 0.7 THEN 1 ELSE 0 END AS opens FROM i2),
isl AS (SELECT * EXCLUDE (gi, gc, was, was_us, opens), sum(opens) OVER (PARTITION BY stream ORDER BY us, event_id) AS island FROM i3), {SESSIONS[SESSIONS.index("s0 AS ("):]}, {CONTEXT},
k AS (SELECT * FROM isl QUALIFY row_number() OVER (PARTITION BY stream, island ORDER BY {IMPORTANT} DESC, confidence DESC, event_id) <= 5),
na AS (SELECT stream, island, string_agg({TOLD}, '. ' ORDER BY us, event_id) AS said FROM k GROUP BY 1, 2), pt AS (SELECT stream, island, type AS primary_type FROM isl GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY stream, island ORDER BY count(*) DESC, type) = 1)"""


@query("r1_summaries", f"""WITH {SUMMARIZED} SELECT stream, island::BIGINT AS island, start_us, end_us, n_events, primary_app, session_type, primary_type, part_of_workflow, phase, continuity, related, {CAME} AS outcomes, {SURE} AS confidence,
 'A ' || session_type || ' session of ' || CASE WHEN seconds < 60 THEN 'less than a minute' WHEN seconds < 120 THEN '1 minute' ELSE floor(seconds / 60)::BIGINT || ' minutes' END || ' with ' || n_events || ' events in ' || primary_app || '. ' || said || '.' AS narrative
 FROM se JOIN wf USING (stream, island) JOIN na USING (stream, island) JOIN pt USING (stream, island)""")
def r1(spark, d):
    e = A.events(spark, d)
    # the spans that exist are those of the sessions of the same days
    s = sequences.sessions(contexts.coherent(e.where(F.col("us").between(FROM_US, TO_US)), GAP))
    return contexts.summarize(e, session_spans(s), FROM_US, TO_US, GAP, before_s=BEFORE, after_s=AFTER)


def files(spark, d, *more):
    """Files of kinds and ages, from the line items' dates and prices, with `more` of their columns."""
    kinds = F.array(*map(F.lit, operations.RETENTION))
    l = A.table(spark, d, "lineitem")
    return l.select(F.format_string("f_%d_%d", F.col("l_orderkey"), F.col("l_linenumber").cast("long")).alias("path"), F.element_at(kinds, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("data_type"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("mtime"), F.floor("l_extendedprice").alias("length"), *more)


FILES = """fi AS (SELECT 'f_' || l_orderkey || '_' || l_linenumber AS path, ['raw_video','frame_metadata','ocr_data','event_data','spans','summaries'][l_linenumber % 6 + 1] AS data_type, epoch(l_shipdate)::BIGINT AS mtime, floor(l_extendedprice)::BIGINT AS length FROM lineitem),
pl AS (SELECT *, CASE data_type WHEN 'raw_video' THEN 30 WHEN 'frame_metadata' THEN 90 WHEN 'ocr_data' THEN 90 WHEN 'event_data' THEN 365 ELSE -1 END AS days FROM fi)"""
AS_OF = 880_000_000


@query("r17_retention_plan", f"WITH {FILES} SELECT path, data_type, days FROM pl WHERE days > 0 AND mtime < {AS_OF} - (days + 1) * 86400")
def r17(spark, d):
    return operations.retention_plan(files(spark, d), AS_OF).select("path", "data_type", "days")


@query("a21_retention_estimate", f"WITH {FILES} SELECT data_type, count(*) AS files, sum(length)::BIGINT AS bytes FROM pl WHERE days > 0 AND mtime < {AS_OF} - (days + 1) * 86400 GROUP BY 1")
def a21(spark, d):
    return operations.retention_estimate(files(spark, d), AS_OF)


#: Files a hundred times their size on three volumes, with little, some and much free.
VOLUMES = {"A": 400_000_000, "N": 3_000_000_000, "R": 800_000_000}


@query("a20_storage_health", f"""WITH {FILES}, v AS (SELECT l_returnflag AS volume, data_type, length * 100 AS bytes, CASE WHEN days > 0 AND mtime < {AS_OF} - (days + 1) * 86400 THEN length * 100 ELSE 0 END AS old, CASE l_returnflag {" ".join(f"WHEN '{k}' THEN {v}" for k, v in VOLUMES.items())} END AS free FROM (SELECT *, CASE data_type WHEN 'raw_video' THEN 30 WHEN 'frame_metadata' THEN 90 WHEN 'ocr_data' THEN 90 WHEN 'event_data' THEN 365 ELSE -1 END AS days FROM (SELECT l_returnflag, ['raw_video','frame_metadata','ocr_data','event_data','spans','summaries'][l_linenumber % 6 + 1] AS data_type, epoch(l_shipdate)::BIGINT AS mtime, floor(l_extendedprice)::BIGINT AS length FROM lineitem))),
k AS (SELECT volume, data_type, sum(bytes)::BIGINT AS bytes, sum(old)::BIGINT AS old, min(free) AS free FROM v GROUP BY 1, 2)
SELECT volume, sum(bytes)::BIGINT AS bytes, min(free)::BIGINT AS free, list(data_type || ' ' || bytes ORDER BY data_type) AS kinds, CASE WHEN min(free) < 500000000 THEN 'critical' WHEN min(free) < 2000000000 THEN 'warning' ELSE 'healthy' END AS status,
 CASE WHEN min(free) < 1000000000 THEN ['Low disk space available. Consider reducing retention periods.'] ELSE [] END || coalesce(list('Can reclaim ' || CASE WHEN old >= 1073741824 THEN format('{{:.1f}} GB', old / 1073741824) ELSE format('{{:.1f}} MB', old / 1048576) END || ' by cleaning up ' || data_type ORDER BY data_type) FILTER (old > 100000000), []) AS recommendations FROM k GROUP BY 1""")
def a20(spark, d):
    f = files(spark, d, "l_returnflag").withColumn("length", F.col("length") * 100).withColumnRenamed("l_returnflag", "volume")
    f = f.withColumn("free", F.create_map(*[F.lit(x) for p in VOLUMES.items() for x in p])[F.col("volume")])
    return operations.storage_health(f, AS_OF).withColumn("free", F.col("free").cast("long")).withColumn("kinds", F.transform("kinds", lambda k: F.concat_ws(" ", k["data_type"], k["bytes"].cast("string"))))


@query("m22_latest_files", f"WITH {FILES} SELECT path, data_type, row_number() OVER (PARTITION BY data_type ORDER BY mtime DESC, path) <= 5 AS kept FROM fi")
def m22(spark, d):
    return operations.latest_files(files(spark, d)).select("path", "data_type", "kept")


def metrics(spark, d):
    e = A.events(spark, d)
    n = F.col("event_id")
    return e.select("stream", "us", "event_id", (n % 101).alias("cpu"), (n * 7 % 101).alias("mem_pct"), (n * 13 % 101).alias("disk_pct"), (n % 13).alias("errors"), (n * 29 % 97 * 50_000_000).alias("free"))


@query("r18_health_alerts", f"""WITH {EV}, m AS (SELECT stream, us, event_id % 101 AS cpu, event_id * 7 % 101 AS mem_pct, event_id * 13 % 101 AS disk_pct, event_id % 13 AS errors, event_id * 29 % 97 * 50000000 AS free FROM ev),
a AS (SELECT stream, us, free, errors, 'cpu' AS metric, cpu::DOUBLE AS value, CASE WHEN cpu > 90 THEN 2 ELSE 1 END AS level FROM m WHERE cpu > 80 UNION ALL SELECT stream, us, free, errors, 'mem_pct', mem_pct, CASE WHEN mem_pct > 95 THEN 2 ELSE 1 END FROM m WHERE mem_pct > 85
 UNION ALL SELECT stream, us, free, errors, 'disk_pct', disk_pct, CASE WHEN disk_pct > 95 THEN 2 ELSE 1 END FROM m WHERE disk_pct > 90 UNION ALL SELECT stream, us, free, errors, 'free', free, 2 FROM m WHERE free < 1073741824 UNION ALL SELECT stream, us, free, errors, 'errors', errors, 1 FROM m WHERE errors > 10)
SELECT stream, us, metric, value, level, CASE WHEN free < 1073741824 AND errors <= 10 THEN 2 ELSE 1 END AS status FROM a""")
def r18(spark, d):
    return operations.health_alerts(metrics(spark, d))


REASONS = ("multi_monitor_failure", "display_disconnected", "system_resource_exhaustion", "permission_denied", "screen_capture_session_failed", "encoding_failure", "storage_failure", "crash", "unknown", "manual_trigger")


@query("r19_recovery", "SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN CASE WHEN o_custkey % 3 = 1 THEN 'graceful_degradation' ELSE 'single_monitor_fallback' END WHEN 1 THEN 'graceful_degradation' WHEN 2 THEN 'quality_reduction' WHEN 3 THEN 'temporary_pause' ELSE 'full_restart' END AS strategy FROM orders")
def r19(spark, d):
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return A.table(spark, d, "orders").select("o_orderkey", operations.recovery_strategy(reason, F.col("o_custkey") % 3).alias("strategy"))


@query("a23_recovery_statistics", "SELECT o_orderpriority AS reason, count(*) AS attempts, round(avg((o_orderstatus = 'F')::INT), 6) AS success_rate, round(avg(o_totalprice), 6) AS avg_seconds FROM orders GROUP BY 1")
def a23(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("reason"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_totalprice").alias("seconds"))
    return operations.recovery_statistics(o)


@query("e39_violations", "WITH st AS (SELECT c_custkey, c_custkey % 200 - 10 AS margin, c_custkey % 180 AS interval FROM customer) SELECT c_custkey, 'safetyMarginHours' AS field, 'Safety margin must be between 0 and 168 hours' AS message FROM st WHERE margin NOT BETWEEN 0 AND 168 UNION ALL SELECT c_custkey, 'cleanupIntervalHours', 'Cleanup interval must be between 1 and 168 hours' FROM st WHERE interval NOT BETWEEN 1 AND 168")
def e39(spark, d):
    n = F.col("c_custkey")
    rules = (("safetyMarginHours", "Safety margin must be between 0 and 168 hours", (n % 200 - 10).between(0, 168)), ("cleanupIntervalHours", "Cleanup interval must be between 1 and 168 hours", (n % 180).between(1, 168)))
    return operations.violations(A.table(spark, d, "customer"), "c_custkey", rules)


@query("a26_rolling", f"WITH {EV}, t AS (SELECT *, (event_id % 7)::BIGINT AS took FROM ev) SELECT event_id, round(avg(took) OVER l, 9) AS rolling, coalesce(CASE WHEN sum(took) OVER l > 0 THEN floor((2000000 // 240) * row_number() OVER w * 8 / sum(took) OVER l) END, 0)::BIGINT AS bitrate FROM t WINDOW w AS (PARTITION BY stream ORDER BY us, event_id), l AS (PARTITION BY stream ORDER BY us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def a26(spark, d):
    return operations.encoder_metrics(A.events(spark, d).withColumn("took", F.col("event_id") % 7), "took").select("event_id", F.round("rolling", 9).alias("rolling"), "bitrate")


@query("m19_segments", f"WITH {EV} SELECT stream, epoch_us(time_bucket(INTERVAL '120 seconds', ts)) AS start, count(*) AS n, 'segments/' || strftime(time_bucket(INTERVAL '120 seconds', ts), '%Y-%m-%d/%H-%M-%S') || '.mp4' AS path FROM ev GROUP BY ALL")
def m19(spark, d):
    return operations.segments(A.events(spark, d)).select("stream", F.unix_micros("start").alias("start"), "n", "path")


@query("a7_session_windows", f"""WITH {ISLANDS} SELECT stream, count(*) AS n, min(us) AS start, max(us) + {GAP} AS "end" FROM isl GROUP BY stream, island""")
def a7(spark, d):
    w = F.session_window("ts", "6 hours")
    g = A.events(spark, d).groupBy("stream", w).agg(F.count("*").alias("n"))
    return g.select("stream", "n", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"))


@query("a9_related_kinds", f"WITH {SP}, k AS (SELECT kind AS tag FROM sp UNION ALL SELECT unnest(tags) FROM sp) SELECT tag, count(*) AS n FROM k GROUP BY 1")
def a9(spark, d):
    return A.spans(spark, d).select(F.explode(F.concat(F.array("kind"), F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")
