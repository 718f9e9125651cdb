"""Assembled operators, regions of interest, stories and operations data as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images
from ..operators import assemblies, evidence, operations, plugins, privacy, sequences, settings, stories, summaries
from ..sources import adapters as A
from .detect import MASKED, MATCHES
from .more import linked
from .registry import query
from .sequence import GROUPED, HOUR, PIXELS, SESSIONS, grouped
from .tell import ADVICE, CAME, CONTEXT, IMPORTANT, KEYS, STEPS, W16, correlated, steps, told, told_in_context

EV, RG, FR, CU, VS = A.EVENTS_SQL, A.REGIONS_SQL, A.FRAMES_SQL, A.CURSOR_SQL, A.VISITS_SQL


@query("e11_hash16", f"WITH {FR} SELECT frame, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN pixels[i] > floor(list_avg(pixels)) THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END))::BIGINT AS hash FROM fr")
def e11(spark, d):
    return A.frames(spark, d).select("frame", images.hash16(F.col("pixels")).alias("hash"))


@query("e26_app_keys", f"WITH {EV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN app_name WHEN 1 THEN target WHEN 2 THEN 'com.' || app_name END AS app FROM ev")
def e26(spark, d):
    n = F.col("event_id") % 4
    m = F.create_map(F.lit("app_name"), F.when(n == 0, F.col("app_name")), F.lit("application"), F.when(n < 2, F.col("target")), F.lit("bundle_id"), F.when(n < 3, F.concat(F.lit("com."), F.col("app_name"))))
    return A.events(spark, d).select("event_id", assemblies.app_key(m).alias("app"))


@query("e35_match_context", f"WITH {MATCHES} SELECT frame, idx, start, kind, match, substring(text, greatest(start - 20, 0)::INT + 1, (start + length(match) + 20 - greatest(start - 20, 0))::INT) AS context FROM ma")
def e35(spark, d):
    m = privacy.matches(A.regions(spark, d)).select("frame", "idx", "text", F.explode("matches").alias("m"))
    return m.select("frame", "idx", "m.start", "m.kind", "m.match", assemblies.context_of(F.col("text"), F.col("m.start"), F.col("m.end")).alias("context"))


@query("s4_regions_of_interest", f"""WITH {RG}, c AS (SELECT stream, frame, idx, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, 1920) - greatest(x, 0) AS w, least(y + h, 1080) - greatest(y, 0) AS h FROM rg),
k AS (SELECT *, CASE WHEN idx % 4 = 0 THEN CASE WHEN w / h > 2 AND w / h < 8 AND w * h / (1920 * 1080) < 0.05 THEN 'button' WHEN w * h / (1920 * 1080) > 0.2 THEN 'dialog' ELSE 'general' END WHEN w / h > 5 AND h / 1080 < 0.05 THEN 'text_field' WHEN w / h < 3 AND w / 1920 < 0.3 AND h / 1080 < 0.1 THEN 'button' WHEN (y + h / 2) / 1080 < 0.1 OR (y + h / 2) / 1080 > 0.9 THEN 'menu_item' WHEN w / 1920 > 0.5 AND h / 1080 > 0.3 THEN 'dialog' ELSE 'label' END AS kind FROM c WHERE w > 0 AND h > 0 AND w BETWEEN 20 AND 800 AND h BETWEEN 10 AND 200 AND w * h >= 200),
p AS (SELECT *, CASE kind WHEN 'text_field' THEN 5 WHEN 'button' THEN 4 WHEN 'dialog' THEN 3 WHEN 'label' THEN 2 WHEN 'menu_item' THEN 1 ELSE 0 END AS priority FROM k) SELECT stream, frame, idx, kind, priority, (row_number() OVER (PARTITION BY stream, frame ORDER BY priority DESC, idx))::INT AS rank FROM p QUALIFY rank <= 10""")
def s4(spark, d):
    # every fourth region stands for a rectangle without text
    return assemblies.interest(A.regions(spark, d).withColumn("has_text", F.col("idx") % 4 != 0))


@query("a5_navigation_metrics", f"WITH {EV} SELECT stream, count(*) AS frames, count(*) FILTER (type = 'navigation') AS navigations, count(*) FILTER (type = 'click') AS clicks, CASE WHEN count(*) FILTER (type IN ('navigation', 'click')) > 0 THEN sum(event_id % 97)::BIGINT // count(*) FILTER (type IN ('navigation', 'click')) END AS avg_ms FROM ev GROUP BY 1")
def a5(spark, d):
    return assemblies.navigation_metrics(A.events(spark, d).withColumn("took_ms", F.col("event_id") % 97))


@query("a27_help_contexts", f"WITH {EV} SELECT type AS context, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, type) AS place FROM ev GROUP BY 1")
def a27(spark, d):
    from pyspark.sql import Window

    n = A.events(spark, d).groupBy(F.col("type").alias("context")).agg(F.count("*").alias("n"))
    # a row a help context: a fixed, short list
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "context")).cast("long"))


@query("m4_frame_metadata", f"""WITH {EV}, fr AS (SELECT stream, us + event_id % 3 * 600000 AS us, event_id AS frame_id FROM ev), l AS (SELECT fr.stream, frame_id, fr.us, e.app_name, e.us AS at FROM fr LEFT JOIN ev e ON e.stream = fr.stream AND e.us BETWEEN fr.us - 1000000 AND fr.us QUALIFY row_number() OVER (PARTITION BY fr.stream, frame_id ORDER BY e.us DESC) = 1)
SELECT stream, frame_id, coalesce(app_name, 'Unknown') AS app_name FROM l""")
def m4(spark, d):
    e = A.events(spark, d)
    f = e.select("stream", (F.col("us") + F.col("event_id") % 3 * 600_000).alias("us"), F.col("event_id").alias("frame_id"))
    return assemblies.frame_metadata(f, e)


@query("p7_frame_events")
def p7_events(spark, d):
    e = assemblies.frame_events(A.regions(spark, d))
    return e.withColumn("confidence", F.round("confidence", 6))


@query("m6_pattern_events")
def m6(spark, d):
    return assemblies.with_patterns(assemblies.frame_events(A.regions(spark, d))).withColumn("share", F.round("share", 6))



@query("p14_read_batch", f"WITH {RG} SELECT stream, frame, idx, x + CASE WHEN frame % 2 = 0 THEN 100 ELSE 0 END AS x, y + CASE WHEN frame % 2 = 0 THEN 50 ELSE 0 END AS y FROM rg WHERE confidence - 0.3 >= 0.3")
def p14(spark, d):
    r = A.regions(spark, d).withColumn("confidence", F.col("confidence") - 0.3)
    origins = r.where("frame % 2 = 0").select("stream", "frame", F.lit(100.0).alias("ox"), F.lit(50.0).alias("oy")).distinct()
    return assemblies.read_batch(r, origins).select("stream", "frame", "idx", "x", "y")


@query("p15_engines", f"WITH {RG}, s AS (SELECT frame, CASE WHEN frame % 5 = 0 THEN 2560 ELSE 1920 END AS width, confidence - 0.4 AS c, text FROM rg) SELECT frame, CASE WHEN max(width) > 2000 THEN 'b' WHEN avg(c) >= 0.4 AND bool_or(length(text) > 0) THEN 'a' ELSE 'b' END AS engine FROM s GROUP BY 1")
def p15(spark, d):
    r = A.regions(spark, d).select("frame", F.when(F.col("frame") % 5 == 0, 2560).otherwise(1920).alias("width"), F.lit(1080).alias("height"), (F.col("confidence") - 0.4).alias("a_confidence"), F.col("text").alias("a_text"))
    return assemblies.engine_choice(r)


@query("p15_engine_choice", f"WITH {RG}, s AS (SELECT *, CASE WHEN frame % 5 = 0 THEN 2560 ELSE 1920 END AS width, confidence - 0.4 AS c FROM rg), g AS (SELECT frame, CASE WHEN max(width) > 2000 THEN 'b' WHEN avg(c) >= 0.4 AND bool_or(length(text) > 0) THEN 'a' ELSE 'b' END AS engine FROM s GROUP BY 1) SELECT rg.frame, idx, engine, CASE WHEN engine = 'a' THEN text ELSE reverse(text) END AS text FROM rg JOIN g ON g.frame = rg.frame")
def p15_texts(spark, d):
    r = A.regions(spark, d)
    read = r.select("frame", "idx", F.when(F.col("frame") % 5 == 0, 2560).otherwise(1920).alias("width"), F.lit(1080).alias("height"), (F.col("confidence") - 0.4).alias("a_confidence"), F.col("text").alias("a_text"), F.reverse("text").alias("b_text"))
    return assemblies.chosen_texts(read)


@query("p13_keyframe_rows", f"WITH {FR}, {PIXELS} SELECT fr.frame, fr.stream, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN pixels[i] > floor(list_avg(pixels)) THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END))::BIGINT AS hash, change_type, CASE WHEN fr.frame % 2 = 0 THEN 'Safari' ELSE 'Unknown' END AS app_name FROM fr LEFT JOIN c ON c.frame = fr.frame AND c.stream = fr.stream")
def p13(spark, d):
    f = A.frames(spark, d)
    keyed = f.select("frame", "stream", images.hash16(F.col("pixels")).alias("hash"))
    metadata = f.where("frame % 2 = 0").select(F.col("frame").alias("frame_id"), F.lit("Safari").alias("app_name"))
    return assemblies.keyframe_rows(keyed, sequences.scene_changes(f), metadata).select("frame", "stream", "hash", "change_type", "app_name")


@query("r8_references", f"""WITH {SESSIONS}, {W16}, ex AS (SELECT stream, island, unnest([event_id, event_id + 1]) AS frame_id FROM isl), dr AS (SELECT stream, island, list_sort(list(DISTINCT frame_id)) AS frames FROM ex WHERE frame_id IN (SELECT event_id FROM ev) GROUP BY 1, 2), ne AS (SELECT stream, island, list(frame_id ORDER BY rank) AS near_frames FROM rk WHERE rank <= 3 GROUP BY 1, 2)
SELECT stream, island::BIGINT AS island, coalesce(len(frames), 0)::INT AS n_frames, coalesce(frames[1:5], []) AS direct, coalesce(near_frames, []) AS correlated FROM se LEFT JOIN dr USING (stream, island) LEFT JOIN ne USING (stream, island)""")
def r8(spark, d):
    g, s = grouped(spark, d), told(spark, d)
    return assemblies.references(s, g, linked(spark, d), correlated(spark, d), KEYS)


@query("r9_relevance", f"WITH {EV} SELECT event_id, least(1, 0.5 + CASE WHEN app_name IN ('Safari', 'Chrome', 'Firefox', 'Xcode', 'Terminal', 'Finder') THEN 0.3 ELSE 0 END + CASE WHEN title <> '' AND title <> app_name THEN 0.2 ELSE 0 END)::DOUBLE AS relevance FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN app_name WHEN 1 THEN target ELSE '' END AS title FROM ev)")
def r9(spark, d):
    n = F.col("event_id") % 3
    return A.events(spark, d).select("event_id", evidence.relevance(F.col("app_name"), F.when(n == 0, F.col("app_name")).when(n == 1, F.col("target")).otherwise("")).alias("relevance"))


@query("r4_related_sessions", f"""WITH {GROUPED}, w AS (SELECT DISTINCT stream, island, unnest([type, app_name]) AS word FROM isl), s AS (SELECT *, count(*) OVER (PARTITION BY stream, island) AS n FROM w),
j AS (SELECT a.stream, a.island AS a_island, b.island AS b_island, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM s a JOIN s b ON a.stream = b.stream AND a.word = b.word AND a.island <> b.island GROUP BY 1, 2, 3)
SELECT stream, a_island::BIGINT AS a_island, b_island::BIGINT AS b_island, round(similarity, 6) AS similarity, (row_number() OVER (PARTITION BY stream, a_island ORDER BY similarity DESC, b_island))::INT AS rank FROM j WHERE similarity >= 0.6 QUALIFY rank <= 5""")
def r4(spark, d):
    return assemblies.related_sessions(grouped(spark, d), KEYS)


@query("r2_report_header", f"WITH {SESSIONS} SELECT (SELECT count(*) FROM se) AS sessions, count(*) AS total_events, (max(us) - min(us)) / 1e6 AS seconds, 'Activity Report: ' || strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS title FROM ev")
def r2(spark, d):
    return stories.report_header(told(spark, d), A.events(spark, d))


def _said(dialect: str) -> str:
    cases = []
    for kind, said in stories.DIALECTS[dialect].items():
        before, mark, after = said.partition("%s")
        cases.append(f"WHEN '{kind}' THEN '{before}'" + (f" || target || '{after}'" if mark else ""))
    return f"CASE type {' '.join(cases)} ELSE 'Acted' END"


LASTS = "CASE WHEN seconds < 60 THEN 'less than a minute' WHEN seconds < 120 THEN '1 minute' ELSE floor(seconds / 60)::BIGINT || ' minutes' END"
KIND = "replace(session_type, '_', ' ')"
CAPS = lambda c: f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
SURE = "round(confidence * 100)::BIGINT || '%'"
OUTCOMES = lambda head, mark: f"CASE WHEN len(outcomes) > 0 THEN '{head}' || array_to_string(list_transform(outcomes, lambda o: '{mark}' || o), chr(10)) || chr(10) ELSE '' END"
NL = "' || chr(10) || '"


TEMPLATES = f"""WITH {SESSIONS}, {CONTEXT}, ke AS (SELECT * FROM isl QUALIFY row_number() OVER (PARTITION BY stream, island ORDER BY {IMPORTANT} DESC, confidence DESC, event_id) <= 5),
na AS (SELECT stream, island, string_agg('• ' || {_said('narrative')}, chr(10) ORDER BY us, event_id) AS na, string_agg('- **' || {CAPS("replace(type, '_', ' ')")} || ':** ' || {_said('structured')} || ' (Confidence: ' || {SURE} || ')', chr(10) ORDER BY us, event_id) AS st FROM ke GROUP BY 1, 2),
nu AS (SELECT *, row_number() OVER (PARTITION BY stream, island ORDER BY us, event_id) AS k FROM isl), al AS (SELECT stream, island, string_agg(k || '. ' || {_said('playbook')}, chr(10) ORDER BY us, event_id) AS pl, string_agg('**' || strftime(ts, '%H:%M:%S') || '** - ' || {_said('timeline')} || ' (' || {SURE} || ')', chr(10) ORDER BY us, event_id) AS ti FROM nu GROUP BY 1, 2),
t AS (SELECT se.*, na, st, pl, ti, {KIND} AS kind, {LASTS} AS lasts, {CAME} AS outcomes, {ADVICE} AS advice FROM se JOIN wf USING (stream, island) JOIN na USING (stream, island) JOIN al USING (stream, island)),
f AS (SELECT stream, island::BIGINT AS island, unnest([
 struct_pack(template := 'narrative', text := 'The user engaged in ' || kind || ' within ' || primary_app || ' for ' || lasts || ', performing ' || n_events || ' actions.{NL}{NL}Key activities included:{NL}' || na || chr(10) || {OUTCOMES("This session resulted in:' || chr(10) || '", '• ')}),
 struct_pack(template := 'structured', text := '## Activity Summary{NL}{NL}**Session Type:** ' || {CAPS('kind')} || '{NL}**Duration:** ' || lasts || '{NL}**Events:** ' || n_events || '{NL}**Primary Application:** ' || primary_app || '{NL}{NL}### Key Events{NL}{NL}' || st || chr(10) || {OUTCOMES("### Outcomes' || chr(10) || chr(10) || '", '- ')}),
 struct_pack(template := 'playbook', text := '# Action Playbook{NL}{NL}## Overview{NL}{NL}This playbook recreates the ' || kind || ' workflow performed in ' || primary_app || ' over ' || lasts || '.{NL}{NL}## Steps{NL}{NL}' || pl || chr(10) || {OUTCOMES("## Expected Outcomes' || chr(10) || chr(10) || '", '- ')}),
 struct_pack(template := 'timeline', text := '# Activity Timeline{NL}{NL}**Duration:** ' || lasts || '{NL}{NL}## Event Timeline{NL}{NL}' || ti || chr(10)),
 struct_pack(template := 'executive', text := '# Executive Summary{NL}{NL}## Overview{NL}{NL}User completed a ' || kind || ' session in ' || primary_app || ' lasting ' || lasts || ' with ' || n_events || ' recorded actions.{NL}{NL}## Key Metrics{NL}{NL}- **Duration:** ' || lasts || '{NL}- **Actions:** ' || n_events || '{NL}{NL}' || {OUTCOMES("## Business Impact' || chr(10) || chr(10) || '", '- ')}
  || '## Recommendations{NL}{NL}' || array_to_string(list_transform(advice, lambda a: '- ' || a), chr(10)) || chr(10))]) AS s FROM t)"""


@query("m13_all_templates", f"{TEMPLATES} SELECT s.template AS template, count(*) AS n, min(length(s.text))::BIGINT AS shortest, max(length(s.text))::BIGINT AS longest FROM f GROUP BY 1")
def m13_lengths(spark, d):
    return m13(spark, d).groupBy("template").agg(F.count("*").alias("n"), F.min(F.length("text")).cast("long").alias("shortest"), F.max(F.length("text")).cast("long").alias("longest"))


@query("m13_template_texts", f"{TEMPLATES} SELECT stream, island, s.template AS template, s.text AS text FROM f")
def m13(spark, d):
    g, s = grouped(spark, d), told(spark, d)
    return stories.all_templates(s, g, summaries.key_events(g, KEYS), summaries.outcomes(s), summaries.recommendations(told_in_context(spark, d)), KEYS)


NAMED = "CASE session_type " + " ".join(f"WHEN '{k}' THEN '{v[:-2]}'" for k, v in stories.TITLES.items()) + f" ELSE '{stories.OTHER_TITLE[:-2]}' END || primary_app"


@query("r16_playbook_formats", f"""WITH {STEPS},
pb AS (SELECT stream, island, difficulty AS hard, count(*) AS n_steps, string_agg(step || '. **' || instruction || '**{NL}   - Target: `' || target || '`', chr(10) ORDER BY step) AS md, string_agg(step || ',"' || instruction || '",' || CASE WHEN contains(target, ',') THEN '"' || target || '"' ELSE target END, chr(10) ORDER BY step) AS csv,
 string_agg('{{"step":' || step || ',"action":"' || instruction || '"}}', ',' ORDER BY step) AS js, string_agg('<div class="step"><h3>' || instruction || '</h3></div>', '' ORDER BY step) AS ht FROM st JOIN hd USING (stream, island) GROUP BY 1, 2, 3), j AS (SELECT stream, pb.island, {NAMED} AS name, pb.* EXCLUDE (stream, island) FROM (SELECT * REPLACE (island::BIGINT AS island) FROM se) se JOIN pb USING (stream, island)),
f AS (SELECT stream, island, unnest([struct_pack(form := 'markdown', text := '# ' || name || '{NL}{NL}| Property | Value |{NL}|----------|-------|{NL}| Difficulty | ' || upper(hard[1]) || hard[2:] || ' |{NL}| Steps | ' || n_steps || ' |{NL}{NL}## Steps{NL}{NL}' || md), struct_pack(form := 'csv', text := 'step_number,action,target{NL}' || csv),
 struct_pack(form := 'json', text := '{{"title":"' || name || '","difficulty":"' || hard || '","steps":[' || js || ']}}'), struct_pack(form := 'html', text := '<h1>' || name || '</h1>' || ht)]) AS s FROM j) SELECT stream, island, s.form AS form, s.text AS text FROM f""")
def r16(spark, d):
    s, t = steps(spark, d), told(spark, d)
    return stories.playbook_texts(summaries.playbooks(s, t, KEYS), s, t, KEYS)


@query("pi8_audit_retention", f"WITH {EV} SELECT event_id FROM ev WHERE us >= (SELECT max(us) FROM ev) - 10 * {24 * HOUR}")
def pi8(spark, d):
    e = A.events(spark, d)
    return privacy.retained(e, e.agg(F.max("us")).first()[0], days=10).select("event_id")


@query("pi9_preview", f"{MASKED} SELECT stream, frame, idx, match, hidden AS masked FROM ke")
def pi9(spark, d):
    return privacy.preview(privacy.matches(A.regions(spark, d))).select("stream", "frame", "idx", "match", "masked")


@query("m9_edited_rules", f"WITH {EV}, r AS (SELECT DISTINCT app_name, 1 AS level FROM ev) SELECT app_name, level FROM r WHERE app_name NOT IN ('Slack', 'Mail') UNION ALL SELECT 'Slack', 2 UNION ALL SELECT 'Zoom', 2")
def m9(spark, d):
    rules = A.events(spark, d).select("app_name", F.lit(1).alias("level")).distinct()
    make = lambda *names: spark.createDataFrame([(n, 2) for n in names], "app_name string, level int")
    return assemblies.edited_rules(rules, make("Slack", "Zoom"), make("Mail"))


@query("m21_usage", f"WITH {EV} SELECT stream, round(100 * sum(event_id % 80) / nullif(sum(100), 0), 6) AS cpu, round(100 * sum(event_id % 60) / nullif(sum(64), 0), 6) AS memory, round(100 * sum(event_id % 500) / nullif(sum(512), 0), 6) AS disk FROM ev GROUP BY 1")
def m21(spark, d):
    n = F.col("event_id")
    s = A.events(spark, d).select("stream", (n % 80).alias("busy"), F.lit(100).alias("ticks"), (n % 60).alias("mem_used"), F.lit(64).alias("mem_all"), (n % 500).alias("disk_used"), F.lit(512).alias("disk_all"))
    return assemblies.usage(s)


#: Plugins are named after nations; their suppliers set whether they are on.
PLUGINS = """pl AS (SELECT n_name AS plugin, n_nationkey % 3 <> 0 AS enabled FROM nation), ps AS (SELECT n_name AS plugin, count(*) % 2 = 0 AS on_ FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 3)"""


@query("m25_plugins", f"WITH {PLUGINS} SELECT plugin, coalesce(on_, enabled) AS enabled FROM pl LEFT JOIN ps USING (plugin) WHERE coalesce(on_, enabled)")
def m25(spark, d):
    n, s = A.table(spark, d, "nation"), A.table(spark, d, "supplier")
    manifest = n.select(F.col("n_name").alias("plugin"), (F.col("n_nationkey") % 3 != 0).alias("enabled"))
    settings_of = s.join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_name").alias("plugin")).agg(F.count("*").alias("n")).where("n > 3").select("plugin", (F.col("n") % 2 == 0).alias("enabled"))
    return assemblies.enabled_plugins(manifest, settings_of)


@query("m25_user_parser", f"""WITH {A.SCREENS_SQL}, ap AS (SELECT *, list_extract({list(A.SCREEN_APPS)}, (frame % {len(A.SCREEN_APPS)} + 1)::INT) AS app FROM sc), ro AS (SELECT * FROM ap WHERE starts_with(app, 'Sa') OR app = 'Notion'),
k AS (SELECT *, trim(text, ' ') <> '' AND length(text) < 200 AS short FROM ro), g AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY stream, frame ORDER BY idx) AS grp FROM k),
b AS (SELECT stream, frame, min(idx) AS idx, avg(confidence) AS confidence, list(text ORDER BY idx) AS lines, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM g WHERE short GROUP BY stream, frame, grp HAVING count(*) >= 2)
SELECT 'blocks' AS plugin, stream, frame, idx, 'block' AS semantic_type, round(confidence, 6) AS confidence, lines, x, y, w, h, lines[1] AS title FROM b""")
def m25_parser(spark, d):
    table = spark.createDataFrame([("blocks", "Sa*"), ("blocks", "Notion"), ("off", "*")], "plugin string, pattern string").withColumn("enabled", F.col("plugin") != "off")
    found = plugins.parsed(A.screens(spark, d), table, {"blocks": (plugins.ShortLineBlocks, 200, "title")})
    more = F.from_json("more", "lines array<string>, x double, y double, w double, h double, title string")
    return found.withColumn("m", more).select("plugin", "stream", "frame", "idx", "semantic_type", F.round("confidence", 6).alias("confidence"), "m.*")


@query("r19_orphan_segments", "SELECT 'f_' || l_orderkey || '_' || l_linenumber AS path FROM lineitem WHERE floor(l_extendedprice) < 20000 AND epoch(l_shipdate)::BIGINT > (SELECT max(epoch(l_shipdate)::BIGINT) FROM lineitem) - 8640000")
def r19(spark, d):
    from .tell import files

    f = files(spark, d)
    return assemblies.orphan_segments(f, f.agg(F.max("mtime")).first()[0], least=20_000, young_s=8_640_000).select("path")


#: Settings of sorts, valid and not, from the customers' keys: the same expressions in both engines.
SETTINGS = {
    "log_level": "CASE c_custkey % 5 WHEN 0 THEN 'Debug' WHEN 1 THEN 'verbose' ELSE 'info' END", "menu_icon": "c_custkey % 3 = 0", "notifications": "c_custkey % 4 = 0", "frame_rate": "CASE c_custkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 60 WHEN 2 THEN 24 ELSE 30 END", "quality": "CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'Low' ELSE 'best' END",
    "segment_s": "CASE c_custkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 90 ELSE 300 END", "displays": "c_custkey % 5", "masking": "c_custkey % 2 = 0", "mask_any": "c_custkey % 3 = 0", "app_filter": "c_custkey % 2 = 1", "bundle": "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'com.example.App' WHEN 2 THEN 'no bundle' ELSE 'a.b' END",
    "margin_h": "c_custkey % 200 - 10", "interval_h": "c_custkey % 180", "retention_days": "c_custkey % 12 - 3", "cpu": "c_custkey % 60", "memory": "c_custkey % 50 * 100", "disk_io": "c_custkey % 110", "hardware": "c_custkey % 7 > 0", "hotkey": "CASE c_custkey % 3 WHEN 0 THEN '⌘⇧R' WHEN 1 THEN 'R' ELSE '⌘' END", "timeout": "c_custkey % 70", "max_rows": "c_custkey % 120 * 100",
}
PROBLEMS = " UNION ALL ".join(f"SELECT c_custkey, '{g}' AS section, '{level}' AS level, '{m}' AS message FROM st WHERE {broken}" for g, level, m, broken in settings.RULES).replace("regexp_like(", "regexp_matches(")


@query("m26_settings_problems", f"WITH st AS (SELECT c_custkey, {', '.join(f'{e} AS {n}' for n, e in SETTINGS.items())} FROM customer) {PROBLEMS}")
def m26(spark, d):
    return settings.problems(A.table(spark, d, "customer").select("c_custkey", *[F.expr(e).alias(n) for n, e in SETTINGS.items()]), "c_custkey")


@query("m26_repeated_hotkeys", "SELECT c_nationkey, c_custkey % 9 AS hotkey, count(*) AS n, list_sort(list(c_name)) AS actions FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def m26_hotkeys(spark, d):
    return settings.repeated_hotkeys(A.table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 9).alias("hotkey"), F.col("c_name").alias("action")), "c_nationkey")


@query("m10_audit_rows", f"""WITH {MATCHES}, k AS (SELECT stream, frame, idx, list_sort(list(DISTINCT kind)) AS kinds, bool_or(kind <> 'url') AS stopped FROM ma GROUP BY 1, 2, 3)
SELECT frame, 'filter_decision' AS event_type, kinds AS pii_types, CASE WHEN stopped THEN 'high' ELSE 'low' END AS severity, CASE WHEN stopped THEN 'blocked' ELSE 'allowed' END AS context, stream AS source_component FROM k
UNION ALL SELECT frame, 'configuration_changed', [], 'medium', 'masking from off to ' || lang, source FROM (SELECT doc_id AS frame, lang, source FROM documents WHERE lang IS NOT NULL AND lang <> 'off')""")
def m10(spark, d):
    decided = privacy.decide(privacy.mask_text(privacy.matches(A.regions(spark, d))), allowed=("url",), prevent=True)
    changed = A.table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("frame"), F.lit("masking").alias("setting"), F.lit("off").alias("was"), F.col("lang").alias("now"), "source")
    return privacy.decision_rows(decided).withColumn("pii_types", F.sort_array("pii_types")).unionByName(privacy.configuration_rows(changed))


@query("m20_recovery_gate", f"WITH {EV} SELECT event_id, event_id % 50 <= 2 * 10 AND event_id % 900 <= 2 * 300 AND event_id % 3000 >= 1000 AS healthy FROM ev")
def m20(spark, d):
    n = F.col("event_id")
    s = A.events(spark, d).select("event_id", (n % 50).alias("cpu"), F.lit(10).alias("cpu_limit"), (n % 900).alias("mem"), F.lit(300).alias("mem_limit"), (n % 3000).alias("free_mb"))
    return operations.recovery_gate(s).select("event_id", "healthy")


@query("m22_log_files", "SELECT path, rank = 1 AND length > 10485760 AS rotate, rank <= 5 AS kept, rank <= 3 AS read FROM (SELECT 'f_' || l_orderkey || '_' || l_linenumber AS path, floor(l_extendedprice)::BIGINT * 400 AS length, row_number() OVER (PARTITION BY l_suppkey ORDER BY epoch(l_shipdate) DESC, 'f_' || l_orderkey || '_' || l_linenumber) AS rank FROM lineitem)")
def m22(spark, d):
    l = A.table(spark, d, "lineitem")
    f = l.select(F.format_string("f_%d_%d", F.col("l_orderkey"), F.col("l_linenumber").cast("long")).alias("path"), F.col("l_suppkey").alias("data_type"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("mtime"), (F.floor("l_extendedprice") * 400).alias("length"))
    return operations.log_files(f).select("path", "rotate", "kept", "read")


@query("m28_tips", "SELECT p_partkey, p_type = 'PROMO' AS own FROM (SELECT p_partkey, split_part(p_type, ' ', 1) AS p_type FROM part) WHERE p_type IN ('PROMO', 'STANDARD')")
def m28(spark, d):
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    items = A.table(spark, d, "part").select("p_partkey", F.when(kind == "STANDARD", "general").otherwise(kind).alias("context"))
    return operations.tips(items, "PROMO").select("p_partkey", "own")
