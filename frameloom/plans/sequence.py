"""Windows and joins as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, kernels, sequences
from ..sources import adapters as A
from .registry import query

EV, RG, SP, FR, VS, CU = A.EVENTS_SQL, A.REGIONS_SQL, A.SPANS_SQL, A.FRAMES_SQL, A.VISITS_SQL, A.CURSOR_SQL
#: Gap of a session of a user, in microseconds: six hours, as users here act hours apart.
GAP = 6 * 3_600_000_000
HOUR = 3_600_000_000

ISLANDS = f"""{EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY stream ORDER BY us, event_id) AS island FROM g)"""
#: Sessions end at 50 events, too.
GROUPED = f"""{EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)),
i0 AS (SELECT *, sum(fresh) OVER (PARTITION BY stream ORDER BY us, event_id) AS gi FROM g), i1 AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY stream, gi ORDER BY us, event_id) - 1) % 50 = 0 THEN 1 ELSE 0 END AS opens FROM i0),
isl AS (SELECT * EXCLUDE (opens, gi), sum(opens) OVER (PARTITION BY stream ORDER BY us, event_id) AS island FROM i1)"""
SESSIONS = f"""{GROUPED}, s0 AS (SELECT stream, island, count(*) AS n_events, min(us) AS start_us, max(us) AS end_us, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (type IN ('form_submission', 'field_change')) AS forms,
 count(*) FILTER (type = 'data_entry') AS data, count(*) FILTER (type IN ('navigation', 'app_switch')) AS navigations, count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type = 'error_display') AS errors, count(*) FILTER (type = 'form_submission') AS submissions, count(*) FILTER (type = 'navigation') AS visits,
 bool_or(regexp_matches(lower(app_name), 'mail|messages|slack|teams|zoom|skype')) AS communicates, bool_or(regexp_matches(lower(app_name), 'xcode|vscode|intellij|terminal|git|github')) AS develops, min(app_name) AS primary_app FROM isl GROUP BY 1, 2),
s AS (SELECT *, (end_us - start_us) / 1e6 AS seconds FROM s0 WHERE n_events >= 3 AND end_us - start_us >= 60000000),
se AS (SELECT *, CASE WHEN forms / n_events > 0.5 THEN 'form_filling' WHEN data / n_events > 0.4 THEN 'data_entry' WHEN navigations / n_events > 0.6 THEN 'navigation' WHEN errors > 0 THEN 'mixed' WHEN navigations > n_events // 3 AND clicks > n_events // 4 THEN 'research' WHEN communicates THEN 'communication' WHEN develops THEN 'development' ELSE 'mixed' END AS session_type FROM s)"""


def grouped(spark, d):
    return sequences.limited(A.events(spark, d), GAP)


PIXELS = """l AS (SELECT stream, frame, pixels AS q, lag(pixels) OVER (PARTITION BY stream ORDER BY frame) AS p FROM fr), k AS (SELECT *, list_avg(p) AS mp, list_avg(q) AS mq FROM l WHERE p IS NOT NULL),
v AS (SELECT *, list_sum(list_transform(p, lambda x: (x - mp) * (x - mp))) / 63 AS vp, list_sum(list_transform(q, lambda x: (x - mq) * (x - mq))) / 63 AS vq, list_sum(list_transform(range(1, 65), lambda i: (p[i] - mp) * (q[i] - mq))) / 63 AS cov,
 list_sum(list_transform(range(1, 65), lambda i: ((p[i] > floor(mp)) <> (q[i] > floor(mq)))::INT))::INT AS distance, list_sum(list_transform(list_distinct(p), lambda x: -(len(list_filter(p, lambda y: y = x)) / 64) * log2(len(list_filter(p, lambda y: y = x)) / 64))) AS ep,
 list_sum(list_transform(list_distinct(q), lambda x: -(len(list_filter(q, lambda y: y = x)) / 64) * log2(len(list_filter(q, lambda y: y = x)) / 64))) AS eq FROM k),
m AS (SELECT stream, frame, (2 * mp * mq + 6.5025) * (2 * cov + 58.5225) / ((mp * mp + mq * mq + 6.5025) * (vp + vq + 58.5225)) AS ssim, distance, abs(eq - ep) AS delta FROM v),
c AS (SELECT *, CASE WHEN ssim < 0.8 AND distance > 20 THEN 'cut' WHEN ssim < 0.8 AND delta > 0.2 THEN 'content_change' WHEN ssim < 0.8 THEN 'fade' WHEN distance > 10 THEN 'motion' WHEN delta > 0.1 THEN 'content_change' END AS change_type FROM m)"""


@query("w1_scene_changes", f"WITH {FR}, {PIXELS} SELECT stream, frame, round(ssim, 6) AS ssim, distance, round(delta, 6) AS entropy_delta, change_type, round(least(1, 0.5 * (1 - ssim) + 0.3 * least(1, distance / 64) + 0.2 * least(1, delta / 8)), 6) AS confidence FROM c WHERE change_type IS NOT NULL")
def w1(spark, d):
    return sequences.scene_changes(A.frames(spark, d)).select("stream", "frame", F.round("ssim", 6).alias("ssim"), "distance", F.round("entropy_delta", 6).alias("entropy_delta"), "change_type", F.round("confidence", 6).alias("confidence"))


@query("w2_islands", f"WITH {ISLANDS} SELECT event_id, stream, island::BIGINT AS island, ((row_number() OVER (PARTITION BY stream, island ORDER BY us, event_id) - 1) // 5)::INT AS chunk FROM isl")
def w2(spark, d):
    return sequences.islands(A.events(spark, d), GAP, most=5).select("event_id", "stream", "island", "chunk")


RELATED = "WHEN type || '>' || was IN ('field_change>data_entry', 'data_entry>field_change', 'data_entry>form_submission', 'form_submission>data_entry', 'field_change>form_submission', 'form_submission>field_change', 'navigation>app_switch', 'app_switch>navigation', 'click>navigation', 'navigation>click', 'modal_appearance>error_display', 'error_display>modal_appearance', 'click>modal_appearance', 'modal_appearance>click') THEN 0.7"


@query("w3_context_split", f"""WITH {ISLANDS}, l AS (SELECT *, lag(type) OVER w AS was, lag(us) OVER w AS was_us FROM isl WINDOW w AS (PARTITION BY stream, island ORDER BY us, event_id)),
s AS (SELECT *, CASE WHEN was IS NOT NULL THEN (CASE WHEN type = was THEN 1 {RELATED} ELSE 0 END + 1 + greatest(0, 1 - (us - was_us) / {GAP}) + 1) / 4 END AS similarity FROM l)
SELECT event_id, stream, island::BIGINT AS island, round(similarity, 6) AS similarity, sum(CASE WHEN similarity >= 0.7 THEN 0 ELSE 1 END) OVER (PARTITION BY stream, island ORDER BY us, event_id)::BIGINT AS context FROM s""")
def w3(spark, d):
    return sequences.context_split(A.events(spark, d), GAP).select("event_id", "stream", "island", F.round("similarity", 6).alias("similarity"), "context")


@query("session_summary", f"WITH {SESSIONS} SELECT stream, island::BIGINT AS island, n_events, start_us, end_us, avg_confidence, forms, data, navigations, clicks, errors, submissions, visits, communicates, develops, primary_app, seconds, session_type FROM se")
def session_summary(spark, d):
    return sequences.sessions(grouped(spark, d))


@query("w5_movements", f"WITH {CU}, m AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS distance FROM cu WINDOW w AS (PARTITION BY stream ORDER BY ms, seq)) SELECT stream, seq, round(distance, 4) AS distance FROM m WHERE distance >= 5")
def w5(spark, d):
    return sequences.movements(A.cursor(spark, d)).select("stream", "seq", F.round("distance", 4).alias("distance"))


TRAILS = f"""{CU}, nu AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS number FROM cu), wi AS (SELECT a.stream, a.ms AS now, a.seq AS own, a.number, b.ms, b.seq, b.x::DOUBLE AS x, b.y::DOUBLE AS y FROM nu a JOIN nu b ON a.stream = b.stream AND b.ms BETWEEN a.ms - 1000 AND a.ms),
st AS (SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, ms - lag(ms) OVER o AS gap, avg(x) OVER (PARTITION BY stream, now, own) AS cx, avg(y) OVER (PARTITION BY stream, now, own) AS cy FROM wi WINDOW o AS (PARTITION BY stream, now, own ORDER BY ms, seq)),
an AS (SELECT *, CASE WHEN abs(dx) > 1 OR abs(dy) > 1 THEN atan2(dy, dx) END AS angle, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS radius FROM st),
wa AS (SELECT *, abs(angle - last_value(angle IGNORE NULLS) OVER (PARTITION BY stream, now, own ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS apart FROM an),
tr AS (SELECT stream, now AS ms, own AS seq, max(number) AS number, count(*) AS points, max(ms) - min(ms) AS ms_span, sum(sqrt(dx * dx + dy * dy)) AS path, count(*) FILTER (least(apart, 2 * pi() - apart) > pi() / 6) AS turns, count(*) FILTER (gap > 500) AS gaps,
 sqrt((arg_max(x, (ms, seq)) - arg_min(x, (ms, seq))) ** 2 + (arg_max(y, (ms, seq)) - arg_min(y, (ms, seq))) ** 2) AS direct, avg(radius) AS r, var_pop(radius) AS spread FROM wa GROUP BY 1, 2, 3),
li AS (SELECT *, CASE WHEN path > 0 THEN direct / path ELSE 0 END AS linearity, (CASE WHEN points < 5 THEN 0.7 ELSE 1 END * CASE WHEN path < 20 THEN 0.8 ELSE 1 END * CASE WHEN ms_span < 100 THEN 0.6 ELSE 1 END)::DOUBLE * pow(0.9, gaps) AS confidence FROM tr WHERE points >= 3 AND ms_span > 0 AND number >= 5)"""


@query("w6_trails", f"""WITH {TRAILS} SELECT stream, seq, points::INT AS points, round(path, 4) AS path, turns::INT AS turns, round(path * 1000 / ms_span, 4) AS speed, round(linearity, 6) AS linearity,
 CASE WHEN path < 10 THEN 'stationary' WHEN linearity > 0.9 AND turns / points < 0.1 THEN 'linear' WHEN turns / points > 0.5 THEN 'erratic' WHEN points >= 8 AND r > 20 AND spread < pow(0.3 * r, 2) THEN 'circular' ELSE 'curved' END AS kind, round(confidence, 6) AS confidence FROM li WHERE confidence >= 0.64""")
def w6(spark, d):
    t = sequences.trails(A.cursor(spark, d))
    return t.select("stream", "seq", "points", F.round("path", 4).alias("path"), "turns", F.round("speed", 4).alias("speed"), F.round("linearity", 6).alias("linearity"), "kind", F.round("confidence", 6).alias("confidence"))


@query("w7_inferred_clicks", f"""WITH {CU}, sl AS (SELECT * REPLACE (floor(x / 500) * 500 AS x, floor(y / 60) * 60 AS y) FROM cu), la AS (SELECT *, list(struct_pack(x := x, y := y)) OVER (PARTITION BY stream ORDER BY ms, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS near, lag(x, 6) OVER w AS x6, lag(y, 6) OVER w AS y6 FROM sl WINDOW w AS (PARTITION BY stream ORDER BY ms, seq))
SELECT stream, seq, x::DOUBLE AS x, y::DOUBLE AS y FROM la WHERE len(near) = 5 AND len(list_filter(near, lambda p: sqrt((p.x - la.x) ** 2 + (p.y - la.y) ** 2) > 5)) = 0 AND sqrt((x6 - x) ** 2 + (y6 - y) ** 2) > 10""")
def w7(spark, d):
    # cursors at hand never rest: their places are taken by cells of 500 by 60
    slow = A.cursor(spark, d).withColumn("x", (F.floor(F.col("x") / 500) * 500).cast("double")).withColumn("y", (F.floor(F.col("y") / 60) * 60).cast("double"))
    return sequences.inferred_clicks(slow).select("stream", "seq", "x", "y")


@query("w9_tab_changes", f"WITH {EV}, l AS (SELECT event_id, app_name || ' ' || type AS tab, lag(app_name || ' ' || type) OVER w AS was_tab, us - lag(us) OVER w AS after_us FROM ev WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)) SELECT event_id, was_tab, tab, 0.72::DOUBLE AS confidence FROM l WHERE tab IS DISTINCT FROM was_tab AND after_us >= 100000")
def w9(spark, d):
    e = A.events(spark, d).withColumn("tab", F.concat_ws(" ", "app_name", "type"))
    return sequences.tab_changes(e).select("event_id", "was_tab", "tab", F.round("confidence", 6).alias("confidence"))


@query("w8_window_changes", f"WITH {EV}, l AS (SELECT *, lag(type) OVER w AS was_type, us - lag(us) OVER w AS after_us FROM ev WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)) SELECT event_id, stream, was_type, type, after_us FROM l WHERE type IS DISTINCT FROM was_type AND after_us >= 100000")
def w8(spark, d):
    return sequences.changes(A.events(spark, d), ("type",)).select("event_id", "stream", "was_type", "type", "after_us")


@query("w10_focus_changes", f"""WITH RECURSIVE {EV}, n AS (SELECT stream, event_id, us, type, row_number() OVER (PARTITION BY stream ORDER BY us, event_id) AS k FROM ev),
r AS (SELECT stream, k, event_id, us, type AS app, us AS at, NULL::VARCHAR AS from_app FROM n WHERE k = 1 UNION ALL SELECT n.stream, n.k, n.event_id, n.us, CASE WHEN n.type <> r.app AND n.us - r.at >= {HOUR} THEN n.type ELSE r.app END, CASE WHEN n.type <> r.app AND n.us - r.at >= {HOUR} THEN n.us ELSE r.at END,
 CASE WHEN n.type <> r.app AND n.us - r.at >= {HOUR} THEN r.app END FROM r JOIN n ON n.stream = r.stream AND n.k = r.k + 1) SELECT stream, event_id, us, from_app, app AS to_app FROM r WHERE from_app IS NOT NULL""")
def w10(spark, d):
    e = A.events(spark, d).withColumn("app_name", F.col("type"))
    return kernels.focus_changes(e.select("stream", "event_id", "us", "app_name"), HOUR)


@query("w12_recent_types", f"WITH {EV} SELECT event_id, list(type) OVER (PARTITION BY stream ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM ev")
def w12(spark, d):
    return sequences.recent(A.events(spark, d)).select("event_id", "recent")


@query("w14_navigation_types", f"WITH {VS}, l AS (SELECT *, lag(url) OVER w AS p1, lag(url, 2) OVER w AS p2, scheme AS stream FROM vs WINDOW w AS (PARTITION BY scheme ORDER BY page_id)) SELECT page_id, CASE WHEN url = p2 THEN 'back' WHEN p1 IS NULL THEN 'direct' WHEN host = regexp_extract(p1, '^https?://([^/?#]+)', 1) THEN 'same_domain' ELSE 'other_domain' END AS nav_type FROM l")
def w14(spark, d):
    return sequences.navigation_types(A.visits(spark, d).withColumn("stream", F.col("scheme"))).select("page_id", "nav_type")


@query("w15_transitions", f"WITH {EV}, l AS (SELECT *, lag(app_name) OVER w AS a, lag(target) OVER w AS t, lag(us) OVER w AS u FROM (SELECT * REPLACE (user_id % 10 AS stream) FROM (SELECT ev.*, stream AS user_id FROM ev)) WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)) SELECT event_id, least(1.0, CASE WHEN a <> app_name THEN 0.5 WHEN a = app_name AND t <> target THEN 0.3 ELSE 0.0 END + CASE WHEN us - u > 5000000 THEN 0.2 ELSE 0.0 END)::DOUBLE AS transition FROM l")
def w15(spark, d):
    return sequences.transition_scores(A.events(spark, d).withColumn("stream", F.col("stream") % 10)).select("event_id", F.round("transition", 6).alias("transition"))


@query("w17_sections", f"WITH {RG}, g AS (SELECT *, CASE WHEN y - lag(y + h) OVER w > 50 THEN 1 ELSE 0 END AS fresh FROM rg WINDOW w AS (PARTITION BY stream, frame ORDER BY y, x, idx)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY stream, frame ORDER BY y, x, idx) AS section FROM g) SELECT stream, frame, section::BIGINT AS section, count(*) AS n, min(y) AS top, max(y + h) AS bottom FROM n GROUP BY 1, 2, 3")
def w17(spark, d):
    return sequences.sections(A.regions(spark, d))


@query("w19_runs", f"WITH {EV}, r AS (SELECT *, sum(CASE WHEN confidence >= 0.7 THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY us, event_id) AS run FROM ev) SELECT stream, run::BIGINT AS run, count(*) AS n, min(us) AS first, max(us) AS last FROM r WHERE confidence >= 0.7 GROUP BY 1, 2 HAVING count(*) >= 2")
def w19(spark, d):
    return sequences.runs(A.events(spark, d), F.col("confidence") >= 0.7, ("stream",), ("us", "event_id"))


CLUSTERS = f"""{RG}, cn AS (SELECT stream, frame, idx, x + w / 2 AS cx, y + h / 2 AS cy, row_number() OVER (PARTITION BY stream, frame ORDER BY idx) AS k FROM rg),
cl AS (SELECT stream, frame, idx, k, [struct_pack(x := cx, y := cy)] AS seeds, 0 AS cluster FROM cn WHERE k = 1 UNION ALL SELECT stream, frame, idx, k, CASE WHEN first = 0 THEN list_append(seeds, struct_pack(x := cx, y := cy)) ELSE seeds END, CASE WHEN first = 0 THEN len(seeds) ELSE first - 1 END::INT FROM
 (SELECT n.stream, n.frame, n.idx, n.k, cx, cy, seeds, coalesce(list_position(list_transform(seeds, lambda s: sqrt((s.x - cx) ** 2 + (s.y - cy) ** 2) < 100), true), 0) AS first FROM cl JOIN cn n ON n.stream = cl.stream AND n.frame = cl.frame AND n.k = cl.k + 1))"""


@query("w22_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT stream, frame, idx, cluster::BIGINT AS cluster FROM cl")
def w22(spark, d):
    return kernels.clusters(A.regions(spark, d)).select("stream", "frame", "idx", "cluster")


@query("w23_tables", f"""WITH RECURSIVE {RG}, n AS (SELECT stream, frame, idx, x, y, text, row_number() OVER (PARTITION BY stream, frame ORDER BY y, x, idx) AS k FROM rg),
r AS (SELECT stream, frame, k, y AS top, 0 AS line FROM n WHERE k = 1 UNION ALL SELECT n.stream, n.frame, n.k, CASE WHEN abs(n.y - r.top) <= 10 THEN r.top ELSE n.y END, CASE WHEN abs(n.y - r.top) <= 10 THEN r.line ELSE r.line + 1 END FROM r JOIN n ON n.stream = r.stream AND n.frame = r.frame AND n.k = r.k + 1),
c AS (SELECT n.stream, n.frame, line, text, row_number() OVER (PARTITION BY n.stream, n.frame, line ORDER BY x, n.k) - 1 AS col FROM r JOIN n USING (stream, frame, k)) SELECT c.stream, c.frame, c.line AS "row", c.col::INT AS "column", coalesce(h.text, 'Column ' || (c.col + 1)) AS header, c.text FROM c LEFT JOIN c h ON h.stream = c.stream AND h.frame = c.frame AND h.line = 0 AND h.col = c.col""")
def w23(spark, d):
    return kernels.tables(A.regions(spark, d))


@query("w24_non_maximum", f"""WITH RECURSIVE {RG}, n AS (SELECT stream, frame, idx, x, y, w, h, row_number() OVER (PARTITION BY stream, frame ORDER BY w * h DESC, idx) AS k FROM rg),
r AS (SELECT stream, frame, idx, k, [struct_pack(x := x, y := y, w := w, h := h)] AS kept, true AS stays FROM n WHERE k = 1 UNION ALL SELECT stream, frame, idx, k, CASE WHEN stays THEN list_append(kept, struct_pack(x := x, y := y, w := w, h := h)) ELSE kept END, stays FROM
 (SELECT n.*, kept, len(list_filter(kept, lambda b: greatest(0, least(n.x + n.w, b.x + b.w) - greatest(n.x, b.x)) * greatest(0, least(n.y + n.h, b.y + b.h) - greatest(n.y, b.y)) > 0.5 * least(n.w * n.h, b.w * b.h))) = 0 AS stays FROM r JOIN n ON n.stream = r.stream AND n.frame = r.frame AND n.k = r.k + 1))
SELECT stream, frame, idx FROM r WHERE stays""")
def w24(spark, d):
    return kernels.non_maximum(A.regions(spark, d)).select("stream", "frame", "idx")


@query("w25_rates", f"WITH {EV}, l AS (SELECT event_id, (event_id - lag(event_id) OVER w) / ((us - lag(us) OVER w) / 1e6) AS rate, us - lag(us) OVER w AS gone FROM ev WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)) SELECT event_id, round(rate, 6) AS rate FROM l WHERE gone > 0")
def w25(spark, d):
    e = A.events(spark, d).withColumn("counter", F.col("event_id"))
    return sequences.rates(e, "counter").select("event_id", F.round("rate", 6).alias("rate"))


NUMBERED = f"""{RG}, nz AS (SELECT * FROM rg WHERE confidence >= 0.7), fs AS (SELECT stream, frame, row_number() OVER (PARTITION BY stream ORDER BY frame) AS seq FROM (SELECT DISTINCT stream, frame FROM nz)),
nb AS (SELECT nz.*, seq FROM nz JOIN fs USING (stream, frame)),
pr AS (SELECT a.stream, a.seq, a.frame, a.idx, a.text, a.confidence, b.idx AS b_idx, b.text AS b_text, b.confidence AS b_confidence, a.x, a.y, a.w, a.h,
 greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS common, a.w * a.h + b.w * b.h AS areas FROM nb a JOIN nb b ON a.stream = b.stream AND a.seq = b.seq + 1),
io AS (SELECT *, common / (areas - common) AS iou FROM pr WHERE common > 0),
mt AS (SELECT * FROM io WHERE iou > 0.3 QUALIFY row_number() OVER (PARTITION BY stream, seq, idx ORDER BY iou DESC, b_idx) = 1)"""


def numbered(spark, d):
    return joins.with_previous_frame(A.regions(spark, d))


@query("j1_region_matches", f"WITH {NUMBERED} SELECT stream, seq, idx, b_idx, round(iou, 6) AS iou FROM mt")
def j1(spark, d):
    return joins.region_matches(numbered(spark, d)).select(F.col("a_stream").alias("stream"), F.col("a_seq").alias("seq"), F.col("a_idx").alias("idx"), "b_idx", F.round("iou", 6).alias("iou"))


@query("j2_new_regions", f"WITH {NUMBERED} SELECT stream, seq, idx FROM nb WHERE seq > 1 AND NOT EXISTS (SELECT 1 FROM io WHERE io.stream = nb.stream AND io.seq = nb.seq AND io.idx = nb.idx AND iou >= 0.3)")
def j2(spark, d):
    return joins.new_regions(numbered(spark, d)).select("stream", "seq", "idx")


@query("j4_spatial_links", f"WITH {CU} SELECT a.seq AS a_seq, b.seq AS b_seq, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS distance FROM cu a JOIN cu b ON a.stream = b.stream AND a.seq < b.seq AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 15")
def j4(spark, d):
    return joins.spatial_links(A.cursor(spark, d), 15.0).select("a_seq", "b_seq", F.round("distance", 4).alias("distance"))


#: Places on a screen for events, by their ids; data entered changes a field.
PLACED = f"{EV}, pl AS (SELECT * REPLACE (CASE type WHEN 'data_entry' THEN 'field_change' ELSE type END AS type), (event_id * 37 % 120)::DOUBLE AS x, (event_id * 53 % 90)::DOUBLE AS y FROM ev)"


def placed(spark, d):
    e = A.events(spark, d).withColumn("type", F.when(F.col("type") == "data_entry", "field_change").otherwise(F.col("type")))
    return e.withColumn("x", (F.col("event_id") * 37 % 120).cast("double")).withColumn("y", (F.col("event_id") * 53 % 90).cast("double"))


@query("j4_typed_spatial_links", f"""WITH {PLACED}, p AS (SELECT a.stream, a.event_id AS a_id, b.event_id AS b_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance, (a.confidence + b.confidence) / 2 AS c FROM pl a JOIN pl b ON a.stream = b.stream AND (a.us < b.us OR (a.us = b.us AND a.event_id < b.event_id)) WHERE a.type IN ('click', 'cursor_movement') AND b.type = 'field_change')
SELECT stream, a_id, b_id, round(0.7 * (1 - distance / 50) + 0.3 * c, 6) AS confidence FROM p WHERE distance <= 50 AND 0.7 * (1 - distance / 50) + 0.3 * c >= 0.6""")
def j4_typed(spark, d):
    return joins.typed_spatial_links(placed(spark, d)).select("stream", "a_id", "b_id", F.round("confidence", 6).alias("confidence"))


WEEK = 7 * 86_400


@query("j6_preceding_spans", f"WITH {SP} SELECT a.span_id AS a_id, b.span_id AS b_id, a.t_start - b.t_end AS gap FROM sp a JOIN sp b ON a.stream = b.stream AND b.t_end BETWEEN a.t_start - {4 * WEEK} AND a.t_start AND a.span_id <> b.span_id QUALIFY row_number() OVER (PARTITION BY a.span_id ORDER BY a.t_start - b.t_end, b.span_id) <= 5")
def j6(spark, d):
    s = A.spans(spark, d)
    return joins.asof_nearest(s, s, 4 * WEEK, 5, forward=False).select(F.col("a_span_id").alias("a_id"), F.col("b_span_id").alias("b_id"), "gap")


@query("j7_following_spans", f"WITH {SP} SELECT a.span_id AS a_id, b.span_id AS b_id, b.t_start - a.t_end AS gap FROM sp a JOIN sp b ON a.stream = b.stream AND b.t_start BETWEEN a.t_end AND a.t_end + {2 * WEEK} AND a.span_id <> b.span_id QUALIFY row_number() OVER (PARTITION BY a.span_id ORDER BY b.t_start - a.t_end, b.span_id) <= 5")
def j7(spark, d):
    s = A.spans(spark, d)
    return joins.asof_nearest(s, s, 2 * WEEK, 5, forward=True).select(F.col("a_span_id").alias("a_id"), F.col("b_span_id").alias("b_id"), "gap")


@query("j12_neighbouring_frames", f"WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY stream ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND {HOUR} FOLLOWING) - 1 AS neighbours FROM ev")
def j12(spark, d):
    from ..operators.summaries import neighbours_within

    return neighbours_within(A.events(spark, d), HOUR).select("event_id", "neighbours")


@query("j16_label_values", f"""WITH {RG} SELECT a.frame, a.idx, b.idx AS b_idx, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM rg a JOIN rg b ON a.stream = b.stream AND a.frame = b.frame WHERE length(a.text) < 50 AND length(b.text) >= 50 AND ((b.x > a.x AND abs(b.y - a.y) <= a.h) OR (b.y > a.y AND abs(b.x - a.x) <= a.w))
 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 200 QUALIFY row_number() OVER (PARTITION BY a.stream, a.frame, a.idx ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.idx) = 1""")
def j16(spark, d):
    r = A.regions(spark, d)
    return joins.label_values(r, F.length("text") < 50).select(F.col("a_frame").alias("frame"), F.col("a_idx").alias("idx"), "b_idx", F.round("distance", 6).alias("distance"))


@query("j18_merged_regions", f"""WITH {RG}, mv AS (SELECT * REPLACE (x + 2 * h AS x) FROM rg), ov AS (SELECT DISTINCT b.stream, b.frame, b.idx FROM mv b JOIN rg a ON a.stream = b.stream AND a.frame = b.frame AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) * 3 > a.w * a.h + b.w * b.h)
 SELECT stream, frame, idx, x FROM rg UNION ALL SELECT stream, frame, idx, x FROM mv WHERE (stream, frame, idx) NOT IN (SELECT stream, frame, idx FROM ov)""")
def j18(spark, d):
    r = A.regions(spark, d)
    # the other side sees every region moved by twice its height: wide ones still meet their own, others may not
    return joins.merged_regions(r, r.withColumn("x", F.col("x") + 2 * F.col("h"))).select("stream", "frame", "idx", "x")


@query("j19_delta", f"""WITH {NUMBERED}, ls AS (SELECT stream, max(seq) AS last FROM nb GROUP BY 1)
SELECT stream, seq, idx, 'modified' AS change FROM mt WHERE text <> b_text UNION ALL
SELECT stream, seq, idx, 'added' FROM nb WHERE seq > 1 AND (stream, seq, idx) NOT IN (SELECT stream, seq, idx FROM mt) UNION ALL
SELECT nb.stream, seq + 1, idx, 'removed' FROM nb JOIN ls USING (stream) WHERE seq < last AND (nb.stream, seq + 1, idx) NOT IN (SELECT stream, seq, b_idx FROM mt)""")
def j19(spark, d):
    return joins.delta(numbered(spark, d))


@query("j20_field_changes", f"WITH {RG}, f AS (SELECT *, 'field_' || x::INT || '_' || y::INT || '_' || w::INT || '_' || h::INT AS field FROM rg), l AS (SELECT *, lag(text) OVER (PARTITION BY stream, field ORDER BY frame, idx) AS was FROM f) SELECT stream, field, frame, idx, was, text AS now FROM l WHERE was <> text")
def j20(spark, d):
    return sequences.field_changes(A.regions(spark, d))


@query("p9_field_states", f"WITH {RG}, f AS (SELECT *, 'field_' || x::INT || '_' || y::INT || '_' || w::INT || '_' || h::INT AS field FROM rg) SELECT stream, field, text, frame FROM f QUALIFY row_number() OVER (PARTITION BY stream, field ORDER BY frame DESC, idx DESC) = 1")
def p9(spark, d):
    return sequences.field_states(A.regions(spark, d))


@query("p1_field_change_events")
def p1(spark, d):
    e = joins.field_change_events(numbered(spark, d))
    return e.select("stream", "frame", "idx", "target", F.round("confidence", 6).alias("confidence"))


@query("p2_data_entry_events", f"WITH {NUMBERED} SELECT stream, frame, idx, round(confidence * 0.8, 6) AS confidence FROM nb WHERE seq > 1 AND NOT EXISTS (SELECT 1 FROM io WHERE io.stream = nb.stream AND io.seq = nb.seq AND io.idx = nb.idx AND iou >= 0.3) AND (regexp_matches(lower(text), 'enter|input|select|choose|@') OR right(text, 1) = ':' OR regexp_matches(text, '^[0-9]*$')) AND confidence * 0.8 >= 0.6")
def p2(spark, d):
    return joins.data_entry_events(numbered(spark, d)).select("stream", "frame", "idx", F.round("confidence", 6).alias("confidence"))
