"""Everything a desk's sources detect, on one clock, and how it correlates, as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemblies, joins
from ..sources import adapters as A
from .registry import query
from .sequence import HOUR, TRAILS

EV = A.EVENTS_SQL
#: A millisecond of the cursor lasts so many microseconds of the events, and both begin at once; events correlate for so long.
PACE, FROM_MS, FROM_US, HORIZON = 51_840_000, 160_000, 1704067200000000, 4 * HOUR
CLOCK = f"{FROM_US} + (ms - {FROM_MS}) * {PACE}"


def samples(spark, d):
    e = A.events(spark, d)
    return e.withColumn("window", F.col("type")).withColumn("tab", F.concat_ws(" ", "app_name", "type"))


def sources(spark, d):
    c = A.cursor(spark, d)
    # cursors at hand never rest: their places are taken by cells of 500 by 60
    slow = {"x": (F.floor(F.col("x") / 500) * 500).cast("double"), "y": (F.floor(F.col("y") / 60) * 60).cast("double")}
    return assemblies.source_events(samples(spark, d), c, slow, F.expr(CLOCK), HOUR)


def screen(spark, d):
    """Detected events of the screen; fields changed have a place."""
    e, n = A.events(spark, d), F.col("event_id")
    kind = F.when(F.col("type") == "data_entry", "field_change").when(F.col("type") == "click", "modal_appearance").otherwise(F.col("type"))
    place = F.create_map(F.lit("roi_x"), (n * 37 % 1000).cast("string"), F.lit("roi_y"), (n * 53 % 100).cast("string"))
    return e.select("stream", "us", n.alias("event_id"), kind.alias("type"), "confidence", F.when(kind == "field_change", place).alias("metadata"))


def heard(spark, d):
    return assemblies.correlation_events(sources(spark, d), screen(spark, d))


SOURCES = f"""{TRAILS}, {EV}, we AS (SELECT *, lag(type) OVER w AS was, lag(event_id) OVER w AS was_id, us - lag(us) OVER w AS after_us FROM ev WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)),
mo AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS far FROM cu WINDOW w AS (PARTITION BY stream ORDER BY ms, seq)),
sl AS (SELECT * REPLACE (floor(x / 500) * 500 AS x, floor(y / 60) * 60 AS y) FROM cu), la AS (SELECT *, list(struct_pack(x := x, y := y)) OVER (PARTITION BY stream ORDER BY ms, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS near, lag(x, 6) OVER w AS x6, lag(y, 6) OVER w AS y6 FROM sl WINDOW w AS (PARTITION BY stream ORDER BY ms, seq)),
fn AS (SELECT stream, event_id, us, type, row_number() OVER (PARTITION BY stream ORDER BY us, event_id) AS k FROM ev),
fo AS (SELECT stream, k, event_id, us, type AS app, us AS at, false AS turned FROM fn WHERE k = 1 UNION ALL SELECT n.stream, n.k, n.event_id, n.us, CASE WHEN n.type <> r.app AND n.us - r.at >= {HOUR} THEN n.type ELSE r.app END, CASE WHEN n.type <> r.app AND n.us - r.at >= {HOUR} THEN n.us ELSE r.at END, n.type <> r.app AND n.us - r.at >= {HOUR} FROM fo r JOIN fn n ON n.stream = r.stream AND n.k = r.k + 1),
so AS (SELECT stream, us, 'window' AS source, 'window-' || event_id AS event_id, 'window_' || app_name || '_' || type AS target, 0.8::DOUBLE AS confidence, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM we WHERE type IS DISTINCT FROM was AND after_us >= 100000
 UNION ALL SELECT stream, us, 'tab', 'tab-' || event_id, 'tab_' || app_name || '_0', 0.72, NULL, NULL FROM we WHERE type IS DISTINCT FROM was AND after_us >= 100000
 UNION ALL SELECT stream, us, 'focus', 'focus-' || event_id, 'focus_' || app, 0.8, NULL, NULL FROM fo WHERE turned
 UNION ALL SELECT stream, {CLOCK}, 'movement', 'movement-' || seq, 'cursor_movement', 0.9, x::DOUBLE, y::DOUBLE FROM mo WHERE far >= 5
 UNION ALL SELECT stream, {CLOCK}, 'click', 'click-' || seq, 'click_' || x::INT || '_' || y::INT, 0.56, x::DOUBLE, y::DOUBLE FROM la WHERE len(near) = 5 AND len(list_filter(near, lambda p: sqrt((p.x - la.x) ** 2 + (p.y - la.y) ** 2) > 5)) = 0 AND sqrt((x6 - x) ** 2 + (y6 - y) ** 2) > 10
 UNION ALL SELECT stream, {CLOCK}, 'trail', 'trail-' || seq, 'movement_trail_' || CASE WHEN path < 10 THEN 'stationary' WHEN linearity > 0.9 AND turns / points < 0.1 THEN 'linear' WHEN turns / points > 0.5 THEN 'erratic' WHEN points >= 8 AND r > 20 AND spread < pow(0.3 * r, 2) THEN 'circular' ELSE 'curved' END, round(confidence, 6), NULL, NULL FROM li WHERE confidence >= 0.64)"""
HEARD = f"""{SOURCES}, sn AS (SELECT stream, us, event_id, CASE type WHEN 'data_entry' THEN 'field_change' WHEN 'click' THEN 'modal_appearance' WHEN 'navigation' THEN 'screen_change' WHEN 'form_submission' THEN 'screen_change' ELSE type END AS type, confidence FROM ev),
ce AS (SELECT stream, us, event_id, CASE source WHEN 'movement' THEN 'cursor_movement' WHEN 'click' THEN 'click' WHEN 'window' THEN 'window_change' WHEN 'tab' THEN 'tab_change' WHEN 'focus' THEN 'focus_change' END AS type, CASE source WHEN 'movement' THEN 0.9 WHEN 'window' THEN 0.9 WHEN 'tab' THEN 0.85 ELSE confidence END AS confidence, x, y FROM so WHERE source <> 'trail'
 UNION ALL SELECT stream, us, event_id || '-detected', 'screen_change', confidence, NULL, NULL FROM so
 UNION ALL SELECT stream, us, 'screen-' || event_id, type, confidence, CASE WHEN type = 'field_change' THEN event_id * 37 % 1000 END::DOUBLE, CASE WHEN type = 'field_change' THEN event_id * 53 % 100 END::DOUBLE FROM sn)"""
LINKS = """t AS (SELECT a.stream, a.event_id AS a_id, b.event_id AS b_id, 'temporal' AS kind, 0.6 * (1 - (b.us - a.us) / {h}) + 0.4 * (a.confidence + b.confidence) / 2 AS c FROM {e} a JOIN {e} b ON a.stream = b.stream AND b.us BETWEEN a.us AND a.us + {h} AND a.event_id <> b.event_id AND (a.us < b.us OR a.event_id < b.event_id)
 WHERE (a.type = 'click' AND b.type IN ('screen_change', 'window_change', 'tab_change')) OR (a.type = 'window_change' AND b.type = 'cursor_movement') OR (a.type = 'error_display' AND b.type = 'click')),
p AS (SELECT a.stream, a.event_id AS a_id, b.event_id AS b_id, 'spatial' AS kind, 0.7 * (1 - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 50) + 0.3 * (a.confidence + b.confidence) / 2 AS c FROM {e} a JOIN {e} b ON a.stream = b.stream AND (a.us < b.us OR (a.us = b.us AND a.event_id < b.event_id)) WHERE a.type IN ('click', 'cursor_movement') AND b.type = 'field_change' AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 50),
nx AS (SELECT *, lead(event_id) OVER w AS next_id, type || '>' || lead(type) OVER w AS pair, lead(us) OVER w - us AS gone, lead(confidence) OVER w AS nc FROM {e} WINDOW w AS (PARTITION BY stream ORDER BY us, event_id)),
ca AS (SELECT stream, event_id AS a_id, next_id AS b_id, 'causal' AS kind, 0.5 * CASE pair WHEN 'click>window_change' THEN 0.9 WHEN 'click>tab_change' THEN 0.85 WHEN 'click>field_change' THEN 0.8 WHEN 'error_display>cursor_movement' THEN 0.7 WHEN 'modal_appearance>click' THEN 0.75 END + 0.3 * (1 - gone / {h}) + 0.2 * (confidence + nc) / 2 AS c FROM nx WHERE gone <= {h}),
ln AS (SELECT stream, a_id, b_id, kind, round(c, 6)::DOUBLE AS confidence FROM (SELECT * FROM t UNION ALL SELECT * FROM p UNION ALL SELECT * FROM ca) WHERE c >= 0.6)"""


@query("p10_source_events", f"WITH RECURSIVE {SOURCES} SELECT stream, us, source, event_id, 'navigation' AS type, target, confidence FROM so")
def p10(spark, d):
    return sources(spark, d).drop("x", "y")


@query("p11_correlation_events", f"WITH RECURSIVE {HEARD} SELECT stream, us, event_id, type, confidence::DOUBLE AS confidence, x, y FROM ce")
def p11(spark, d):
    return heard(spark, d)


@query("p12_navigation_correlations", f"WITH RECURSIVE {HEARD}, la2 AS (SELECT *, max(us) OVER (PARTITION BY stream) AS last FROM ce), e AS (SELECT * FROM la2 WHERE us >= last - {HORIZON}), {LINKS.format(e='e', h=HORIZON)} SELECT * FROM ln")
def p12(spark, d):
    return assemblies.correlations(heard(spark, d), HORIZON).withColumn("confidence", F.round("confidence", 6))


@query("j3_temporal_links", f"WITH RECURSIVE {HEARD}, {LINKS.format(e='ce', h=HOUR)} SELECT a_id, b_id, confidence FROM ln WHERE kind = 'temporal'")
def j3(spark, d):
    return joins.temporal_links(heard(spark, d), HOUR).select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), F.round("confidence", 6).alias("confidence"))


@query("j5_causal_links", f"WITH RECURSIVE {HEARD}, {LINKS.format(e='ce', h=HORIZON)} SELECT a_id AS event_id, b_id AS next_id, confidence AS causal FROM ln WHERE kind = 'causal'")
def j5(spark, d):
    return joins.causal_links(heard(spark, d), HORIZON).select("event_id", "next_id", F.round("causal", 6).alias("causal"))


@query("m3_click_events", f"WITH RECURSIVE {SOURCES} SELECT stream, us, source, event_id, 'navigation' AS type, target, confidence, x, y FROM so WHERE source = 'click'")
def m3(spark, d):
    return sources(spark, d).where("source = 'click'")


@query("m5_correlations", f"WITH RECURSIVE {HEARD}, e AS (SELECT * FROM (SELECT *, max(us) OVER (PARTITION BY stream) AS last FROM ce) WHERE us >= last - {6 * HOUR}), {LINKS.format(e='e', h=6 * HOUR)} SELECT * FROM ln")
def m5(spark, d):
    return assemblies.correlations(heard(spark, d), 6 * HOUR).withColumn("confidence", F.round("confidence", 6))


@query("w12_ring_buffers", f"""WITH RECURSIVE {HEARD}, r AS (SELECT 'positions' AS ring, 1000 AS most, stream::VARCHAR AS stream, us AS t, event_id AS id FROM so WHERE source = 'movement' UNION ALL SELECT 'clicks', 100, stream::VARCHAR, us, event_id FROM so WHERE source = 'click' UNION ALL SELECT 'focus', 100, stream::VARCHAR, us, event_id FROM so WHERE source = 'focus'
 UNION ALL SELECT 'correlation_events', 1000, stream::VARCHAR, us, event_id FROM ce UNION ALL SELECT 'urls', 100, regexp_extract(url, '^https?://([^/?#]+)', 1), page_id, page_id::VARCHAR FROM pages),
k AS (SELECT ring, most, stream, id, (row_number() OVER (PARTITION BY ring, stream ORDER BY t DESC, id DESC))::INT AS rank FROM r) SELECT ring, stream, id, rank FROM k WHERE rank <= most""")
def w12_rings(spark, d):
    return assemblies.rings(sources(spark, d), screen(spark, d), A.visits(spark, d).withColumn("stream", F.col("host")))
