"""Lookups, statistics and expressions as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import images
from ..functions import text as T
from ..operators import detection, lookups
from ..sources import adapters as A
from .registry import query

EV, RG, SP, FR, VS, CU = A.EVENTS_SQL, A.REGIONS_SQL, A.SPANS_SQL, A.FRAMES_SQL, A.VISITS_SQL, A.CURSOR_SQL
DAY_US = 86_400_000_000


@query("q1_regions_by_frame", f"WITH {RG} SELECT frame, idx, text, confidence FROM rg WHERE frame = 12")
def q1(spark, d):
    return lookups.by_frame(A.regions(spark, d), 12).select("frame", "idx", "text", "confidence")


@query("q2_regions_by_text", f"WITH {RG} SELECT frame, idx, confidence FROM rg WHERE contains(lower(text), 'license')")
def q2(spark, d):
    return lookups.by_text(A.regions(spark, d), "License").select("frame", "idx", "confidence")


@query("q3_regions_by_confidence", f"WITH {RG} SELECT frame, idx, confidence FROM rg WHERE confidence >= 0.9")
def q3(spark, d):
    return lookups.by_confidence(A.regions(spark, d), 0.9, "frame", "idx").select("frame", "idx", "confidence")


@query("q4_regions_by_language", f"WITH {RG} SELECT frame, idx, language FROM rg WHERE language = 'de'")
def q4(spark, d):
    return lookups.by_language(A.regions(spark, d), "de").select("frame", "idx", "language")


@query("q5_events_by_type", f"WITH {EV} SELECT event_id, us, type FROM ev WHERE type = 'click'")
def q5(spark, d):
    return lookups.events_by(A.events(spark, d), "type", "click").select("event_id", "us", "type")


@query("q6_events_by_target", f"WITH {EV} SELECT event_id, us, target FROM ev WHERE target = 'user_42'")
def q6(spark, d):
    return lookups.events_by(A.events(spark, d), "target", "user_42").select("event_id", "us", "target")


@query("q7_events_by_confidence", f"WITH {EV} SELECT event_id, confidence FROM ev WHERE confidence >= 0.9")
def q7(spark, d):
    return lookups.by_confidence(A.events(spark, d), 0.9, "event_id").select("event_id", "confidence")


@query("q8_events_between", f"WITH {EV} SELECT event_id, us FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'")
def q8(spark, d):
    return lookups.events_between(A.events(spark, d), 1704412800000000, 1704585600000000).select("event_id", "us")


@query("q9_event_type_names", "SELECT event_id, CASE WHEN event_type IN ('field_change','form_submission','modal_appearance','error_display','navigation','data_entry') THEN event_type ELSE 'field_change' END AS type FROM events")
def q9(spark, d):
    return A.table(spark, d, "events").select("event_id", lookups.event_type(F.col("event_type")).alias("type"))


@query("q11_span_upsert", f"WITH {SP} SELECT span_id, CASE WHEN span_id % 10 = 0 THEN 'changed' ELSE title END AS title FROM sp UNION ALL SELECT -span_id, 'added' FROM sp WHERE span_id % 100 = 0 AND span_id > 0")
def q11(spark, d):
    s = A.spans(spark, d).select("span_id", "title")
    changed = s.where("span_id % 10 = 0").select("span_id", F.lit("changed").alias("title"))
    added = s.where("span_id % 100 = 0 and span_id > 0").select((-F.col("span_id")).alias("span_id"), F.lit("added").alias("title"))
    return lookups.upsert(lookups.update(s, changed), added)


@query("q11_span_delete", f"WITH {SP} SELECT span_id FROM sp WHERE span_id % 7 <> 0")
def q11_delete(spark, d):
    s = A.spans(spark, d).select("span_id")
    return lookups.delete(s, s.where("span_id % 7 = 0"))


@query("q12_span_query", f"WITH {SP} SELECT span_id, kind, t_start FROM sp WHERE t_end >= 800000000 AND t_start <= 900000000 AND kind IN ('F', 'O') AND list_contains(tags, '1-URGENT') ORDER BY t_start DESC, span_id LIMIT 50 OFFSET 5")
def q12(spark, d):
    return lookups.spans_where(A.spans(spark, d), 800000000, 900000000, ("F", "O"), ("1-URGENT",), 50, 5).select("span_id", "kind", "t_start")


@query("q13_overlapping_spans", f"WITH {SP} SELECT span_id, t_start, t_end FROM sp WHERE t_start <= 850000000 AND t_end >= 840000000")
def q13(spark, d):
    return lookups.overlapping(A.spans(spark, d), 840000000, 850000000).select("span_id", "t_start", "t_end")


@query("q14_span_count", f"WITH {SP} SELECT count(*) AS n FROM sp WHERE kind = 'O'")
def q14(spark, d):
    return lookups.spans_where(A.spans(spark, d), kinds=("O",)).agg(F.count("*").alias("n"))


@query("q15_recent_audit", f"WITH {EV} SELECT event_id, us FROM ev WHERE type = 'error_display' ORDER BY us DESC, event_id LIMIT 100")
def q15(spark, d):
    return lookups.events_by(A.events(spark, d), "type", "error_display").limit(100).select("event_id", "us")


@query("q16_log_filter", f"WITH {EV} SELECT event_id, us FROM ev WHERE type IN ('click','error_display') AND app_name = 'Slack' AND contains(lower(target), '_1') AND us >= 1704412800000000")
def q16(spark, d):
    logs = A.events(spark, d).select("event_id", "us", F.col("type").alias("level"), F.col("app_name").alias("category"), F.col("target").alias("message"), F.lit("f").alias("function"))
    return lookups.logs_where(logs, ("click", "error_display"), ("Slack",), "_1", 1704412800000000).select("event_id", "us")


@query("q17_help_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_type), '1') OR contains(lower(p_brand), '1')")
def q17(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("content"), F.array("p_brand").alias("keywords"))
    return lookups.help_where(p, "1").select("p_partkey")


@query("q18_allowlist", f"WITH {EV} SELECT event_id FROM ev WHERE app_name NOT IN ('Mail') AND app_name IN ('Safari', 'Slack', 'Mail')")
def q18(spark, d):
    app = lambda *names: spark.createDataFrame([(n,) for n in names], "app_name string")
    return lookups.allowed_apps(A.events(spark, d), app("Mail"), app("Safari", "Slack", "Mail")).select("event_id")


@query("q18_display_allowlists", f"""WITH {EV}, d AS (SELECT *, event_id % 4 AS display FROM ev) SELECT event_id, display FROM d WHERE CASE WHEN display = 0 THEN app_name IN ('Mail', 'Xcode') WHEN display = 1 THEN app_name NOT IN ('Safari', 'Mail') AND app_name IN ('Safari', 'Slack', 'Mail') WHEN display = 2 THEN app_name = 'Mail' ELSE app_name <> 'Mail' AND app_name IN ('Safari', 'Slack', 'Mail') END""")
def q18_displays(spark, d):
    app = lambda *names: spark.createDataFrame([(n,) for n in names], "app_name string")
    rules = spark.createDataFrame([(0, "Mail", False), (0, "Xcode", False), (0, "Slack", True), (1, "Safari", True), (2, "Mail", False), (2, "Safari", False), (2, "Safari", True)], "display long, app_name string, blocked boolean")
    return lookups.allowed_on_displays(A.events(spark, d).withColumn("display", F.col("event_id") % 4), app("Mail"), app("Safari", "Slack", "Mail"), rules).select("event_id", "display")


@query("q19_plugin_routing", f"WITH {EV}, pl(plugin, pattern) AS (VALUES ('web', 'Saf*'), ('dev', 'Xcode'), ('all', '*')) SELECT event_id, plugin FROM ev JOIN pl ON app_name = pattern OR (suffix(pattern, '*') AND starts_with(app_name, left(pattern, length(pattern)::BIGINT - 1)))")
def q19(spark, d):
    plugins = spark.createDataFrame([("web", "Saf*"), ("dev", "Xcode"), ("all", "*")], "plugin string, pattern string")
    return lookups.plugin_routes(A.events(spark, d).withColumnRenamed("app_name", "bundle"), plugins).select("event_id", "plugin")


@query("a1_region_statistics", f"WITH {RG} SELECT language, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM rg GROUP BY 1")
def a1(spark, d):
    return lookups.statistics(A.regions(spark, d), "language")


@query("a1_processor_statistics", f"WITH {RG} SELECT processor, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM rg GROUP BY 1")
def a1b(spark, d):
    return lookups.statistics(A.regions(spark, d), "processor")


@query("events_by_type", f"WITH {EV} SELECT type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM ev GROUP BY 1")
def a2(spark, d):
    return lookups.statistics(A.events(spark, d), "type")


@query("a3_totals", f"WITH {RG} SELECT count(*) AS n, coalesce(round(avg(confidence), 6), 0) AS avg_confidence FROM rg WHERE frame = 3")
def a3(spark, d):
    return lookups.totals(lookups.by_frame(A.regions(spark, d), 3))


@query("a19_log_statistics", f"WITH {EV} SELECT type AS level, count(*) AS n, count(*) FILTER (us >= 1706659200000000 - 3600000000) AS last_hour, min(us) AS oldest, max(us) AS newest FROM ev GROUP BY 1")
def a19(spark, d):
    return lookups.log_statistics(A.events(spark, d).withColumnRenamed("type", "level"), 1706659200000000)


@query("e1_e8_boxes", f"""WITH {RG} SELECT frame, idx, w * h AS area, 'field_' || x::INT || '_' || y::INT || '_' || w::INT || '_' || h::INT AS field, CASE WHEN w / h > 5 AND h / 1080 < 0.05 THEN 'text_field' WHEN w / h < 3 AND w / 1920 < 0.3 AND h / 1080 < 0.1 THEN 'button' WHEN (y + h / 2) / 1080 < 0.1 OR (y + h / 2) / 1080 > 0.9 THEN 'menu_item' WHEN w / 1920 > 0.5 AND h / 1080 > 0.3 THEN 'dialog' ELSE 'label' END AS shape,
 CASE WHEN w / h > 2 AND w / h < 8 AND w * h / (1920 * 1080) < 0.05 THEN 'button' WHEN w * h / (1920 * 1080) > 0.2 THEN 'dialog' ELSE 'general' END AS bare FROM rg""")
def e1(spark, d):
    return A.regions(spark, d).select("frame", "idx", G.area(G.box()).alias("area"), F.format_string("field_%d_%d_%d_%d", *[F.col(c).cast("int") for c in "xywh"]).alias("field"), G.region_type(G.box()).alias("shape"), G.rectangle_type(G.box()).alias("bare"))


@query("e10_e13_image_measures", f"""WITH {FR}, m AS (SELECT frame, pixels, floor(list_sum(pixels) / 64)::INT AS mean FROM fr),
h AS (SELECT frame, list_sum(list_transform(pixels, lambda v: (v > mean)::INT))::BIGINT AS bits_set FROM m),
u AS (SELECT frame, unnest(pixels) AS v FROM fr), c AS (SELECT frame, v, count(*) AS n FROM u GROUP BY 1, 2)
SELECT h.frame, bits_set, round(e, 6) AS entropy FROM h JOIN (SELECT frame, sum(-(n / 64.0) * log2(n / 64.0)) AS e FROM c GROUP BY 1) x ON x.frame = h.frame""")
def e10(spark, d):
    f = A.frames(spark, d)
    return f.select("frame", F.bit_count(images.average_hash(F.col("pixels"))).cast("long").alias("bits_set"), F.round(images.entropy(F.col("pixels")), 6).alias("entropy"))


@query("e15_e17_text_predicates", f"""WITH {RG} SELECT frame, idx, regexp_matches(lower(text), 'error|failed|invalid|incorrect|wrong|cannot|unable|denied|forbidden|timeout|exception|warning|alert|problem') AS error,
regexp_matches(lower(text), 'submit|send|save|create|update|login|register|sign in|sign up|continue') AS submit,
(regexp_matches(lower(text), 'enter|input|select|choose|@') OR suffix(text, ':') OR regexp_full_match(text, '[0-9]*')) AS interactive FROM rg""")
def e15(spark, d):
    t = F.col("text")
    return A.regions(spark, d).select("frame", "idx", T.holds_any(t, T.ERROR_WORDS).alias("error"), T.holds_any(t, T.SUBMIT_WORDS).alias("submit"), T.interactive(t).alias("interactive"))


@query("e19_dialog_content", f"""WITH {RG}, t AS (SELECT frame, idx, lower(text) AS t FROM rg) SELECT frame, idx,
CASE WHEN regexp_matches(t, 'save|open|file') THEN 'file_dialog' WHEN regexp_matches(t, 'settings|preferences|options') THEN 'settings_dialog' WHEN regexp_matches(t, 'progress|loading|%') THEN 'progress_dialog' WHEN regexp_matches(t, 'confirm|are you sure') THEN 'confirmation_dialog' WHEN regexp_matches(t, 'error|failed|invalid') THEN 'application_error' WHEN regexp_matches(t, 'warning|caution') THEN 'warning' WHEN regexp_matches(t, 'alert|attention') THEN 'alert_dialog' ELSE 'info_dialog' END AS kind,
CASE WHEN regexp_matches(t, 'critical|fatal|crash') THEN 'critical' WHEN regexp_matches(t, 'error|failed|denied') THEN 'high' WHEN regexp_matches(t, 'warning|caution|invalid') THEN 'medium' WHEN regexp_matches(t, 'notice|attention') THEN 'low' ELSE 'info' END AS severity FROM t""")
def e19(spark, d):
    return A.regions(spark, d).select("frame", "idx", detection.dialog_type(F.col("text")).alias("kind"), detection.severity(F.col("text")).alias("severity"))


@query("e20_layout_score", f"""WITH {RG} SELECT frame, idx, round(CASE WHEN w >= 200 AND h >= 100 AND w <= 1536 AND h <= 864 THEN 0.4 ELSE 0 END + CASE WHEN abs(x + w / 2 - 960) <= 384 AND abs(y + h / 2 - 540) <= 216 THEN 0.3 ELSE 0 END
+ CASE WHEN w / h BETWEEN 0.8 AND 3 THEN 0.2 ELSE 0 END + CASE WHEN x >= 50 AND y >= 50 AND x + w <= 1870 AND y + h <= 1030 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM rg""")
def e20(spark, d):
    return A.regions(spark, d).select("frame", "idx", F.round(G.layout_score(G.box()), 6).alias("score"))


@query("e21_script_language", f"""WITH {RG} SELECT frame, idx, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh-Hans' WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja-JP' WHEN regexp_matches(text, '[\\x{{AC00}}-\\x{{D7AF}}]') THEN 'ko-KR' WHEN regexp_matches(text, '[äöüßÄÖÜ]') THEN 'de-DE' WHEN regexp_matches(text, '[àâäéèêëïîôöùûüÿçÀÂÄÉÈÊËÏÎÔÖÙÛÜŸÇ]') THEN 'fr-FR' WHEN regexp_matches(text, '[áéíóúüñÁÉÍÓÚÜÑ¿¡]') THEN 'es-ES' WHEN regexp_matches(text, '[àèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ]') THEN 'it-IT' ELSE 'en-US' END AS script,
 round(least(greatest(0.5 + CASE WHEN length(text) > 10 THEN 0.1 ELSE 0 END + CASE WHEN length(text) > 50 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)[aeiou]') AND regexp_matches(text, '(?i)[bcdfghjklmnpqrstvwxyz]') THEN 0.2 ELSE 0 END - CASE WHEN length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / greatest(length(text), 1) > 0.3 THEN 0.2 ELSE 0 END, 0), 1)::DOUBLE, 6) AS quality FROM rg""")
def e21(spark, d):
    return A.regions(spark, d).select("frame", "idx", T.script_language(F.col("text")).alias("script"), F.round(T.quality(F.col("text")), 6).alias("quality"))


@query("e25_e27_similarity", f"""WITH {EV}, p AS (SELECT a.event_id, a.target AS x, b.target AS y, a.type AS s, b.type AS t FROM ev a JOIN ev b ON b.event_id = a.event_id + 1),
w AS (SELECT *, regexp_split_to_array(lower(x), '[^a-z0-9]') AS u, regexp_split_to_array(lower(y), '[^a-z0-9]') AS v FROM p)
SELECT event_id, round(CASE WHEN x = y THEN 1.0 ELSE len(list_intersect(u, v))::DOUBLE / len(list_distinct(list_concat(u, v))) END, 6) AS jaccard,
CASE WHEN s = t THEN 1.0 WHEN (s || '>' || t) IN ('field_change>data_entry','data_entry>field_change','field_change>form_submission','form_submission>field_change','data_entry>form_submission','form_submission>data_entry','navigation>app_switch','app_switch>navigation','navigation>click','click>navigation','error_display>modal_appearance','modal_appearance>error_display','click>modal_appearance','modal_appearance>click') THEN 0.7 ELSE 0.0 END::DOUBLE AS related FROM w""")
def e25(spark, d):
    e = A.events(spark, d)
    a, b = e.select("event_id", F.col("target").alias("x"), F.col("type").alias("s")), e.select((F.col("event_id") - 1).alias("event_id"), F.col("target").alias("y"), F.col("type").alias("t"))
    return a.join(b, "event_id").select("event_id", F.round(T.token_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), T.relatedness(F.col("s"), F.col("t")).alias("related"))


@query("e29_durations", f"WITH {SP}, s AS (SELECT span_id, (t_end - t_start + span_id * 7) % 7300 AS n FROM sp) SELECT span_id, CASE WHEN n // 3600 > 0 THEN (n // 3600) || 'h ' || (n % 3600 // 60) || 'm ' || (n % 60) || 's' WHEN n // 60 > 0 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE n || 's' END AS hms, CASE WHEN n < 60 THEN 'less than a minute' WHEN n < 120 THEN '1 minute' ELSE (n // 60) || ' minutes' END AS words, CASE WHEN n // 60 > 0 THEN (n // 60) || ' minute' || CASE WHEN n // 60 = 1 THEN '' ELSE 's' END ELSE n || ' second' || CASE WHEN n = 1 THEN '' ELSE 's' END END AS units, CASE WHEN n // 60 > 0 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE n || 's' END AS ms, (n // 60) || ':' || lpad((n % 60)::VARCHAR, 2, '0') AS clock FROM s")
def e29(spark, d):
    n = (F.col("t_end") - F.col("t_start") + F.col("span_id") * 7) % 7300  # so that all forms show
    return A.spans(spark, d).select("span_id", T.duration_hms(n).alias("hms"), T.duration_words(n).alias("words"), T.duration_units(n).alias("units"), T.duration_ms(n).alias("ms"), T.duration_clock(n).alias("clock"))


@query("e30_url_parts", f"WITH {VS} SELECT page_id, host, scheme, title FROM vs")
def e30(spark, d):
    return A.visits(spark, d).select("page_id", "host", "scheme", "title")


@query("e38_json_metadata", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def e38(spark, d):
    from ..sources.stores import metadata_map

    return A.table(spark, d, "events").select("event_id", metadata_map(F.col("props"))["k"].alias("k"))
