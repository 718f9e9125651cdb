"""Fixed values and rules, by literal cases: what the queries' SQL shares with the operators it can't show wrong."""

import pytest
from pyspark.sql import functions as F

from frameloom.functions import geometry, text
from frameloom.operators import assemblies, contexts, detection, evidence, joins, operations, privacy, reports, sequences, settings, summaries

EVENT = "event_id long, stream long, us long, type string, target string, confidence double, app_name string, value string"
KEYS = ("stream", "island")
S = 1_000_000


def events(spark, rows):
    """(seconds, type, target, confidence, app) or with a value."""
    full = [(k, 1, int(r[0] * S), *r[1:5], r[5] if len(r) > 5 else None) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def one(spark, expression, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "said, error, modal, submit",
    [
        ("Error: Invalid email format", True, False, False), ("Password incorrect", True, False, False), ("Something went wrong", True, False, False), ("Access forbidden", True, False, False), ("ALERT", True, True, False), ("A problem occurred", True, False, False),
        ("Request failed", True, False, False), ("Connection timeout", True, False, False), ("Unable to load", True, False, False), ("crash", False, False, False), ("fatal", False, False, False), ("refused", False, False, False),
        ("Confirm Deletion", False, True, False), ("Cancel", False, True, False), ("OK", False, True, False), ("Popup", False, True, False), ("Dialog", False, True, False), ("Notification", False, True, False), ("accept", False, False, False), ("dismiss", False, False, False),
        ("Submit Form", False, False, True), ("Create account", False, False, True), ("Update", False, False, True), ("Sign up", False, False, True), ("Sign in", False, False, True), ("Login", False, False, True), ("Continue", False, False, True), ("Next", False, False, False), ("Apply", False, False, False),
        ("Item: Document.pdf", False, False, False), ("Username:", False, False, False),
    ],
)
def test_words_that_mark_a_text(spark, said, error, modal, submit):
    t = F.lit(said)
    row = spark.range(1).select(text.holds_any(t, text.ERROR_WORDS).alias("e"), text.holds_any(t, text.MODAL_WORDS).alias("m"), text.holds_any(t, text.SUBMIT_WORDS).alias("s")).first()
    assert (row["e"], row["m"], row["s"]) == (error, modal, submit)


def test_a_text_may_be_several_events(spark):
    r = spark.createDataFrame([("s", 1, 0, "Error: Invalid email format", 0.93), ("s", 1, 1, "Submit Form", 0.98), ("s", 1, 2, "OK", 0.98), ("s", 1, 3, "Name: John Smith", 0.95)], "stream string, frame long, idx long, text string, confidence double")
    found = {(e["idx"], e["type"], round(e["confidence"], 4)) for e in detection.standalone_events(r).collect()}
    assert found == {(0, "error_display", 0.837), (1, "form_submission", 0.784), (2, "modal_appearance", 0.833)}


#: Sessions of the kinds that tests of such a grouper have: their events, and their type.
SESSIONS = {
    "form_filling": [(0, "field_change", "name_field", 0.9, "Safari"), (30, "field_change", "email_field", 0.9, "Safari"), (60, "form_submission", "contact_form", 0.95, "Safari")],
    "data_entry": [(0, "data_entry", "spreadsheet_cell_A1", 0.9, "Excel"), (30, "data_entry", "spreadsheet_cell_A2", 0.9, "Excel"), (60, "data_entry", "spreadsheet_cell_A3", 0.9, "Excel")],
    "navigation": [(0, "navigation", "page1", 0.8, "Safari"), (30, "navigation", "page2", 0.8, "Safari"), (60, "app_switch", "Chrome", 0.75, "Chrome"), (90, "navigation", "page3", 0.8, "Chrome")],
    "research": [(0, "navigation", "google.com", 0.8, "Safari"), (30, "click", "search_result_1", 0.75, "Safari"), (60, "click", "link_1", 0.75, "Safari"), (90, "navigation", "wikipedia.org", 0.8, "Safari")],
    "communication": [(0, "click", "a", 0.8, "Safari"), (30, "click", "b", 0.8, "Microsoft Teams"), (60, "modal_appearance", "c", 0.8, "Safari")],
    "development": [(0, "click", "a", 0.8, "Safari"), (30, "click", "b", 0.8, "GitHub Desktop"), (60, "modal_appearance", "c", 0.8, "Safari")],
    "mixed": [(0, "click", "a", 0.8, "Slack"), (30, "error_display", "b", 0.8, "Slack"), (60, "modal_appearance", "c", 0.8, "Slack")],
}


@pytest.mark.parametrize("kind", SESSIONS)
def test_session_types(spark, kind):
    found = sequences.sessions(sequences.limited(events(spark, SESSIONS[kind]), 300 * S)).collect()
    assert [r["session_type"] for r in found] == [kind]


def test_sessions_end_at_a_gap_and_at_the_event_limit(spark):
    e = events(spark, [(10 * k + (400 if k >= 6 else 0), "click", "t", 0.9, "Safari") for k in range(9)])
    assert [r["island"] for r in sequences.limited(e, 300 * S, most=4).orderBy("event_id").collect()] == [1, 1, 1, 1, 2, 2, 3, 3, 3]
    # 1 + 1 + 1 + nearness of 0.97, over 4, or 0 + 0 + ... where nothing is alike
    split = contexts.coherent(events(spark, [(0, "click", "a_b", 0.9, "Safari"), (10, "click", "a_b", 0.9, "Safari"), (20, "data_entry", "c", 0.9, "Mail"), (30, "field_change", "c", 0.9, "Mail")]), 300 * S)
    assert [r["island"] for r in split.orderBy("event_id").collect()] == [1, 1, 2, 2]


@pytest.mark.parametrize("a, b, value", [("field_change", "data_entry", 0.7), ("navigation", "app_switch", 0.7), ("modal_appearance", "click", 0.7), ("click", "form_submission", 0.0), ("navigation", "tab_switch", 0.0), ("click", "click", 1.0), ("error_display", "modal_appearance", 0.7)])
def test_related_types(spark, a, b, value):
    assert one(spark, text.relatedness(F.lit(a), F.lit(b))) == value == one(spark, text.relatedness(F.lit(b), F.lit(a)))


def heard(spark, *rows):
    return spark.createDataFrame([(str(k), 1, int(ms * 1000), t, c, x, y) for k, (ms, t, c, x, y) in enumerate(rows)], "event_id string, stream long, us long, type string, confidence double, x double, y double")


@pytest.mark.parametrize(
    "first, second, temporal, causal",
    [
        ("click", "screen_change", 0.84, None), ("click", "window_change", 0.84, 0.855), ("click", "tab_change", 0.84, 0.83), ("window_change", "cursor_movement", 0.84, None), ("error_display", "click", 0.84, None),
        ("click", "field_change", None, 0.805), ("error_display", "cursor_movement", None, 0.755), ("modal_appearance", "click", None, 0.78), ("navigation", "form_submission", None, None), ("screen_change", "click", None, None),
    ],
)
def test_correlations_of_neighbours(spark, first, second, temporal, causal):
    # half a second apart of two; both sure by 0.9: 0.6 * 0.75 + 0.4 * 0.9, less; cause: half its strength + 0.3 * 0.75 + 0.2 * 0.9
    e = heard(spark, (0, first, 0.9, None, None), (500, second, 0.9, None, None))
    found = {r["kind"]: round(r["confidence"], 6) for r in assemblies.correlations(e, 2_000_000).collect()}
    want = {"temporal": 0.6 * 0.75 + 0.4 * 0.9 if temporal else None, "causal": causal}
    assert found == {k: pytest.approx(v) for k, v in want.items() if v}


def test_neighbours_beyond_the_horizon_have_no_cause(spark):
    assert joins.causal_links(heard(spark, (0, "click", 1.0, None, None), (2001, "window_change", 1.0, None, None)), 2_000_000).count() == 0
    assert joins.causal_links(heard(spark, (0, "click", 1.0, None, None), (2000, "window_change", 1.0, None, None)), 2_000_000).count() == 1


def test_places_correlate_only_where_known(spark):
    e = heard(spark, (0, "click", 0.9, 10.0, 10.0), (100, "field_change", 0.9, 13.0, 14.0), (200, "field_change", 0.9, None, None), (300, "field_change", 0.9, 10.0, 70.0))
    assert [(r["a_id"], r["b_id"], round(r["confidence"], 6)) for r in joins.typed_spatial_links(e).collect()] == [("0", "1", 0.9)]


def test_what_the_correlator_hears(spark):
    sources = spark.createDataFrame([(1, 5, "movement", "movement-1", "navigation", "cursor_movement", 0.7, 3.0, 4.0), (1, 6, "tab", "tab-2", "navigation", "tab_x_0", 0.72, None, None), (1, 7, "trail", "trail-3", "navigation", "t", 0.64, None, None)], "stream long, us long, source string, event_id string, type string, target string, confidence double, x double, y double")
    screen = spark.createDataFrame([(1, 8, 1, "field_change", 0.9, {"roi_x": "12.5", "roi_y": "7"}), (1, 9, 2, "form_submission", 0.8, {"roi_x": "?", "roi_y": "7"}), (1, 9, 3, "error_display", 0.8, None)], "stream long, us long, event_id long, type string, confidence double, metadata map<string,string>")
    found = {(r["event_id"], r["type"], r["confidence"], r["x"], r["y"]) for r in assemblies.correlation_events(sources, screen).collect()}
    assert found == {
        ("movement-1", "cursor_movement", 0.9, 3.0, 4.0), ("tab-2", "tab_change", 0.85, None, None), ("movement-1-detected", "screen_change", 0.7, None, None), ("tab-2-detected", "screen_change", 0.72, None, None),
        ("trail-3-detected", "screen_change", 0.64, None, None), ("screen-1", "field_change", 0.9, 12.5, 7.0), ("screen-2", "screen_change", 0.8, None, None), ("screen-3", "error_display", 0.8, None, None),
    }


@pytest.mark.parametrize("kinds, level", [(["passport"], "critical"), (["drivers_license", "url"], "critical"), (["ssn"], "critical"), (["credit_card"], "critical"), (["email"], "high"), (["phone", "url"], "high"), (["date_of_birth"], "high"), (["url", "ip_address"], "low"), (["url", "ip_address", "mac_address", "custom"], "medium"), ([], "low")])
def test_severity(spark, kinds, level):
    assert one(spark, privacy.detection_severity(F.array(*map(F.lit, kinds)).cast("array<string>"))) == level


def test_relevance(spark):
    value = lambda app, title: round(one(spark, evidence.relevance(F.lit(app), F.lit(title))), 6)
    assert [value("Firefox", "News"), value("Finder", "Finder"), value("Slack", "general"), value("Mail", ""), value("Terminal", "x")] == [1.0, 0.8, 0.7, 0.5, 1.0]


@pytest.mark.parametrize("said, code", [("straße", "de-DE"), ("août", "fr-FR"), ("L'Haÿ", "fr-FR"), ("Ÿ", "fr-FR"), ("mañana", "es-ES"), ("sí", "es-ES"), ("così", "it-IT"), ("plain", "en-US"), ("漢かな", "zh-Hans"), ("かな", "ja-JP"), ("한글", "ko-KR"), ("über août", "de-DE")])
def test_language_by_letters(spark, said, code):
    assert one(spark, text.script_language(F.lit(said))) == code


@pytest.mark.parametrize("x, y, w, h, kind, bare", [(100, 500, 400, 40, "text_field", "general"), (100, 500, 200, 80, "button", "button"), (100, 20, 700, 60, "menu_item", "general"), (300, 300, 1000, 400, "dialog", "button"), (300, 300, 1000, 500, "dialog", "dialog"), (300, 500, 700, 200, "label", "general"), (300, 500, 600, 100, "label", "button")])
def test_shapes_of_regions(spark, x, y, w, h, kind, bare):
    box = {k: F.lit(float(v)) for k, v in zip("xywh", (x, y, w, h))}
    row = spark.range(1).select(geometry.region_type(box).alias("t"), geometry.rectangle_type(box).alias("b")).first()
    want_bare = "button" if 2 < w / h < 8 and w * h / (1920 * 1080) < 0.05 else "dialog" if w * h / (1920 * 1080) > 0.2 else "general"
    assert (row["t"], row["b"]) == (kind, want_bare)


@pytest.mark.parametrize("reason, failed, strategy", [("multi_monitor_failure", 1, "graceful_degradation"), ("multi_monitor_failure", 2, "single_monitor_fallback"), ("display_disconnected", 2, "graceful_degradation"), ("system_resource_exhaustion", 0, "quality_reduction"), ("permission_denied", 0, "temporary_pause"), ("crash", 0, "full_restart"), ("unknown", 1, "full_restart"), ("storage_failure", 0, "full_restart")])
def test_recovery(spark, reason, failed, strategy):
    assert one(spark, operations.recovery_strategy(F.lit(reason), F.lit(failed))) == strategy


def test_storage_health(spark):
    rows = [("a", "raw_video", 0, 300_000_000, 499_999_999), ("a", "spans", 0, 900_000_000, 499_999_999), ("b", "raw_video", 0, 100_000_000, 1_999_999_999), ("c", "ocr_data", 0, 150_000_000, 2_000_000_000), ("c", "event_data", 10**9, 5, 2_000_000_000)]
    found = operations.storage_health(spark.createDataFrame(rows, "volume string, data_type string, mtime long, length long, free long"), 100 * 86_400).orderBy("volume").collect()
    assert [(r["volume"], r["bytes"], r["status"], r["recommendations"]) for r in found] == [
        ("a", 1_200_000_000, "critical", ["Low disk space available. Consider reducing retention periods.", "Can reclaim 286.1 MB by cleaning up raw_video"]),
        ("b", 100_000_000, "warning", []), ("c", 150_000_005, "healthy", ["Can reclaim 143.1 MB by cleaning up ocr_data"]),
    ]


def test_health_alerts(spark):
    rows = [(1, 1, 95.0, 10.0, 10.0, 0.0, 1 << 31), (1, 2, 85.0, 96.0, 10.0, 0.0, 1000), (1, 3, 10.0, 10.0, 96.0, 11.0, 1000), (1, 4, 80.0, 85.0, 90.0, 10.0, 1 << 30)]
    found = operations.health_alerts(spark.createDataFrame(rows, "stream long, us long, cpu double, mem_pct double, disk_pct double, errors double, free long")).collect()
    assert sorted((r["us"], r["metric"], r["level"], r["status"]) for r in found) == [(1, "cpu", 2, 1), (2, "cpu", 1, 2), (2, "free", 2, 2), (2, "mem_pct", 2, 2), (3, "disk_pct", 2, 1), (3, "errors", 1, 1), (3, "free", 2, 1)]


def test_no_display_is_a_warning():
    assert [level for _, level, said, _ in settings.RULES if said == "No displays selected for recording"] == ["warning"]


def test_playbook_steps(spark):
    rows = [
        (0, "navigation", "page", 0.9, "Safari"), (5, "field_change", "name", 0.8, "Safari", "x" * 40), (9, "data_entry", "mail", 0.6, "Safari"), (12, "form_submission", "form", 0.9, "Safari"), (20, "field_change", "age", 0.9, "Safari"),
        (30, "app_switch", "Mail", 0.9, "Mail"), (40, "error_display", "oops", 0.9, "Mail"), (50, "modal_appearance", "sure", 0.9, "Mail"), (60, "click", "Modify rule", 0.9, "Mail"), (61, "data_entry", "rule", 0.7, "Mail", "abc"),
    ]
    found = summaries.playbook_steps(sequences.limited(events(spark, rows), 300 * S), KEYS).orderBy("step").collect()
    assert [(r["instruction"], r["target"], r["n"], r["seconds"]) for r in found] == [
        ("Navigate to page", "page", 1, 5.0), ("Complete data entry for multiple fields", "name, mail", 2, 11.0), ("Submit the form", "form", 1, 2.0), ("Modify age", "age", 1, 3.0), ("Switch to Mail", "Mail", 1, 3.0),
        ("Address error message", "oops", 1, 10.0), ("Handle dialog or modal", "sure", 1, 4.0), ("Complete data entry for multiple fields", "Modify rule, rule", 2, 5.0),
    ]


@pytest.mark.parametrize("n, seconds, level", [(9, 299.0, "beginner"), (9, 300.0, "intermediate"), (24, 800.0, "intermediate"), (24, 720.0, "advanced"), (25, 6000.0, "advanced")])
def test_difficulty(spark, n, seconds, level):
    assert one(spark, summaries.difficulty(F.lit(n), F.lit(seconds))) == level


def test_outcomes_and_recommendations(spark):
    s = sequences.sessions(sequences.limited(events(spark, SESSIONS["form_filling"]), 300 * S))
    assert summaries.outcomes(s).first()["outcomes"] == ["Form submission completed", "Form filling process completed"]
    r = summaries.recommendations(s.withColumn("continuity", F.lit(0.4))).first()
    assert (r["efficiency"], r["recommendations"]) == (3.0, ["Consider improving workflow integration and context preservation"])
    assert summaries.recommendations(s.withColumn("continuity", F.lit(0.5))).first()["recommendations"] == ["Workflow completed successfully with good efficiency"]
    mixed = sequences.sessions(sequences.limited(events(spark, SESSIONS["mixed"]), 300 * S))
    assert summaries.outcomes(mixed).first()["outcomes"] == ["Encountered and potentially resolved errors"]


def spans(spark, rows):
    return spark.createDataFrame(rows, "span_id string, stream long, kind string, title string, tags array<string>, t_start double, t_end double")


def test_workflow_continuity(spark):
    at = [(t + 10_000, *rest) for t, *rest in SESSIONS["data_entry"]]
    g = sequences.limited(events(spark, at), 300 * S)
    s = sequences.sessions(g)
    near = spans(spark, [("a", 1, "research", "Excel help", ["Excel"], 9000.0, 9100.0), ("b", 1, "note", "old", [], 100.0, 200.0), ("c", 1, "form_submission", "sent", [], 10_060.0 + 900, 12_000.0), ("d", 2, "research", "other", [], 9000.0, 9990.0)])
    r = contexts.workflow_continuity(s, g, near, KEYS).first()
    # before: 900 of 3600 s; after: 900 of 1800 s; words: {data_entry, excel, spreadsheet, cell}: excel of {research, excel, help}, nothing of {form_submission, sent}
    assert r["continuity"] == pytest.approx((0.75 + 0.5 + (1 / 6 + 0) / 2 + 0.8) / 4, abs=1e-6)
    assert (r["part_of_workflow"], r["phase"], r["related"], r["titles"]) == (True, "data_collection", ["Excel", "form_submission", "research"], ["Excel help"])
    alone = contexts.workflow_continuity(s, g, near.limit(0), KEYS).first()
    assert (alone["part_of_workflow"], alone["phase"], alone["continuity"], alone["related"]) == (False, "data_entry", 0.0, [])


def test_confidence_propagation(spark):
    e = events(spark, SESSIONS["research"])
    g = sequences.limited(e, 300 * S)
    s = sequences.sessions(g).withColumn("sure", F.lit(0.7))
    key = summaries.key_events(g, KEYS).withColumn("evidence_frames", F.when(F.col("event_id") == 0, F.array(F.lit(1), F.lit(2), F.lit(99))).when(F.col("event_id") == 1, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))
    frames = spark.createDataFrame([(1, 1, 0, "Safari", "a", 0.6, None), (2, 1, S, "Chrome", "b", None, None)], "frame_id long, stream long, us long, app_name string, title string, ocr double, quality double")
    f = contexts.frame_confidence(frames)
    assert [(r["ocr"], r["quality"], r["stability"], round(r["relevance"], 6)) for r in f.orderBy("frame_id").collect()] == [(0.6, 0.9, 0.0, 1.0), (0.8, 0.9, 0.0, 1.0)]
    r = contexts.propagation(s, key, f, KEYS, F.col("sure")).first()
    temporal = ((0.4 * 0.6 + 0.6 * 0.8) + (0.4 * 0.2 + 0.6 * 0.75) + 0.6 * 0.75 + 0.6 * 0.8) / 4
    spatial = ((0.5 + 1) / 2 + 1 + 0 + 0) / 4
    mean, ocr = 0.775, (0.6 + 0.8 + 0.8) / 3
    want = {"n_key_events": 4, "n_frames": 3, "event_confidence": mean, "frame_confidence": ocr, "temporal": temporal, "spatial": spatial, "completeness": 1.0, "confidence": 0.4 * mean + 0.3 * ocr + 0.2 * temporal + 0.1 * spatial, "overall": 0.7}
    assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-6)
    assert r["factors"] == []
    none = contexts.propagation(s, key.limit(0), f, KEYS, F.col("sure")).first()
    assert (none["n_key_events"], none["confidence"], [x["name"] for x in none["factors"]]) == (0, 0.0, ["insufficient_events", "low_temporal_consistency"])


@pytest.mark.parametrize("named,sure,absent", [(1, (0.41, 0.99), "low_temporal_consistency"), (4, (0.42, 0.99, 0.99), "high_temporal_consistency")])
def test_temporal_consistency_at_its_bounds(spark, named, sure, absent):
    # means of just 0.5 and 0.8, whose sums of doubles come out below and above in any order
    s = spark.createDataFrame([(1, 1, 200.0, 3)], "stream long, island long, seconds double, n_events long")
    key = spark.createDataFrame([(1, 1, i, i * S, c, list(range(named))) for i, c in enumerate(sure)], "stream long, island long, event_id long, us long, confidence double, evidence_frames array<long>")
    f = contexts.frame_confidence(spark.createDataFrame([], "frame_id long, stream long, us long, app_name string, title string, ocr double, quality double"))
    r = contexts.propagation(s, key, f, KEYS, F.lit(0.7)).first()
    assert r["temporal"] == (0.5 if named == 1 else 0.8) and absent not in [x["name"] for x in r["factors"]]


def test_session_confidence_of_halves(spark):
    # (0.806 + 204.24135 / 300 + 1 + 0.727861) / 4 is just 0.803666375, as doubles a little less
    s = spark.createDataFrame([(0.806, 204.24135, 50, 0.727861)], "avg_confidence double, seconds double, n_events long, continuity double")
    assert summaries.session_confidence(s, F.col("continuity")).first()["confidence"] == 0.80366638


def test_summaries_of_a_range(spark):
    e = events(spark, SESSIONS["data_entry"] + [(5000 + t, *rest) for t, *rest in SESSIONS["navigation"][:2]])
    none = spans(spark, []).limit(0)
    got = contexts.summarize(e, none, 0, 60 * S).collect()
    assert [(r["session_type"], r["primary_type"], r["n_events"], r["phase"], r["continuity"], r["part_of_workflow"], r["outcomes"]) for r in got] == [("data_entry", "data_entry", 3, "data_entry", 0.0, False, ["Data entered in 3 fields"])]
    assert contexts.summarize(e, none, 1, 60 * S).count() == 0 == contexts.summarize(e, none, 0, 60 * S - 1).count()


def test_evidence_section_of_a_report(spark):
    p = spark.createDataFrame([(1, 1, 0.4567, 0.8125, 0.775, 0.5, 1.0)], "stream long, island long, trace_confidence double, frame_confidence double, event_confidence double, temporal double, completeness double")
    direct = spark.createDataFrame([(1, 1, k, a, o) for k, a, o in ((7, "Safari", 0.9), (3, None, None), (5, "Mail", None), (9, "x", 0.1), (8, "y", 0.1), (10, "late", 0.1))], "stream long, island long, frame_id long, app_name string, ocr double")
    near = spark.createDataFrame([(1, 1, 20 + k, 0.9 - k / 10, ["application_context_match", "workflow_continuity"], k) for k in (1, 2, 3, 4)], "stream long, island long, frame_id long, score double, reasons array<string>, rank int")
    text = {r["form"]: r["text"] for r in reports.evidence_sections(p, direct, near, KEYS).collect()}
    assert text["markdown"] == (
        "#### Evidence & Traceability\n\n**Trace Confidence:** 45.7%\n\n**Direct Evidence Frames:**\n- `3`\n- `5` (Mail)\n- `7` (Safari) - OCR: 90.0%\n- `8` (y) - OCR: 10.0%\n- `9` (x) - OCR: 10.0%\n\n"
        "**Temporally Correlated Frames:**\n- `21` (Score: 0.80, Reasons: application_context_match, workflow_continuity)\n- `22` (Score: 0.70, Reasons: application_context_match, workflow_continuity)\n- `23` (Score: 0.60, Reasons: application_context_match, workflow_continuity)\n\n"
        "**Confidence Analysis:**\n- Frame Confidence: 81.2%\n- Event Confidence: 77.5%\n- Temporal Consistency: 50.0%\n- Evidence Completeness: 100.0%\n\n"
    )
    assert text["html"].count("<li>") == 8 and "45.7%</span>" in text["html"]
    alone = {r["form"]: r["text"] for r in reports.evidence_sections(p, direct.limit(0), near.limit(0), KEYS).collect()}
    assert "Correlated" not in alone["markdown"] and "<ul></ul></div>" in alone["html"]


def test_csv_rows_of_a_report(spark):
    s = summaries.outcomes(sequences.sessions(sequences.limited(events(spark, SESSIONS["form_filling"]), 300 * S))).withColumn("confidence", F.lit(0.71251))
    plain = reports.csv_rows(s.drop("confidence", "outcomes")).first().asDict()
    assert plain == {"session_id": "1-1", "session_type": "form_filling", "start_time": "1970-01-01 00:00:00", "end_time": "1970-01-01 00:01:00", "duration_seconds": "60.0", "event_count": "3", "primary_application": "Safari"}
    evidence = spark.createDataFrame([(1, 1, [4, 5], 0.5)], "stream long, island long, frames array<long>, trace_confidence double")
    full = reports.csv_rows(s, evidence).first().asDict()
    assert (full["confidence_score"], full["outcomes"], full["evidence_frames"], full["evidence_trace_confidence"]) == ("0.713", "Form submission completed; Form filling process completed", "4; 5", "0.500")


def test_encoder_and_engine_metrics(spark):
    s = spark.createDataFrame([(1, k, k, t) for k, t in enumerate([0, 2, 4])], "stream long, us long, event_id long, took long")
    assert [(r["rolling"], r["bitrate"]) for r in operations.encoder_metrics(s, "took", 24_000, 30, 2).orderBy("us").collect()] == [(0.0, 0), (1.0, 800), (3.0, 400)]
    r = operations.engine_metrics(spark.createDataFrame([(1, "vision", True, 1.0, False), (1, "vision", False, 3.0, False), (1, "tesseract", True, 5.0, True), (2, "vision", True, 1.0, False)], "stream long, engine string, ok boolean, seconds double, fallback boolean")).orderBy("stream").collect()
    assert tuple(r[0])[1:] == (0.5, 1.0, 2.0, 5.0, 0.333333, 3) and tuple(r[1])[1:] == (1.0, 0.0, 1.0, 0.0, 0.0, 1)
