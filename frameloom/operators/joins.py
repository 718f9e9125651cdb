"""Joins by time and place: bands, nearest rows, boxes that meet. All are equi joins on cells with a condition on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from . import scans

#: Directed pairs of types that correlate in time, and in place, and what a pair of neighbours says of its cause.
TEMPORAL = (("click", "screen_change"), ("click", "window_change"), ("click", "tab_change"), ("window_change", "cursor_movement"), ("error_display", "click"))
SPATIAL = (("click", "field_change"), ("cursor_movement", "field_change"))
CAUSAL = {("click", "window_change"): 0.9, ("click", "tab_change"): 0.85, ("click", "field_change"): 0.8, ("error_display", "cursor_movement"): 0.7, ("modal_appearance", "click"): 0.75}


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def band_join(left: DataFrame, right: DataFrame, on: str, at: str, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Pairs of a left row and a right row 0 to width later (a_, b_ columns), joined on time cells of that width."""
    a = _renamed(left, "a_").withColumn("__cell", F.explode(F.array(F.floor(F.col(f"a_{at}") / width), F.floor(F.col(f"a_{at}") / width) + 1)))
    b = _renamed(right, "b_").withColumn("__cell", F.floor(F.col(f"b_{at}") / width))
    same = [a[f"a_{k}"] == b[f"b_{k}"] for k in keys] + [a["__cell"] == b["__cell"]]
    late = F.col(f"b_{at}") - F.col(f"a_{at}")
    return a.join(b, same).where((late >= 0) & (late <= width) & (F.col(f"a_{on}") != F.col(f"b_{on}"))).drop("__cell")


def temporal_links(events: DataFrame, horizon_us: int) -> DataFrame:
    """Directed pairs of correlated types within the horizon, with confidence; those under 0.6 are left out."""
    first, second = (F.col("type").isin(*{p[k] for p in TEMPORAL}) for k in (0, 1))
    j = band_join(events.where(first), events.where(second), "event_id", "us", horizon_us)
    j = j.where((F.col("a_us") < F.col("b_us")) | (F.col("a_event_id") < F.col("b_event_id")))
    pair = F.concat("a_type", F.lit(">"), "b_type").isin([f"{a}>{b}" for a, b in TEMPORAL])
    sure = 0.6 * (1 - (F.col("b_us") - F.col("a_us")) / horizon_us) + 0.4 * (F.col("a_confidence") + F.col("b_confidence")) / 2
    return j.where(pair).withColumn("confidence", sure).where("confidence >= 0.6")


def causal_links(events: DataFrame, horizon_us: int) -> DataFrame:
    """Each event and the next of its stream within the horizon, if their types tell of a cause; from 0.6 up."""
    w = Window.partitionBy("stream").orderBy("us", "event_id")
    after = lambda c: F.lead(c).over(w)
    e = events.select("stream", "event_id", "type", "us", "confidence", after("event_id").alias("next_id"), after("type").alias("next_type"), after("us").alias("next_us"), after("confidence").alias("next_confidence")).where("next_id is not null")
    strength = F.create_map(*[F.lit(v) for (a, b), s in CAUSAL.items() for v in (f"{a}>{b}", s)])[F.concat("type", F.lit(">"), "next_type")]
    apart = F.col("next_us") - F.col("us")
    e = e.withColumn("strength", strength).where(F.col("strength").isNotNull() & (apart <= horizon_us))
    return e.withColumn("causal", 0.5 * F.col("strength") + 0.3 * (1 - apart / horizon_us) + 0.2 * (F.col("confidence") + F.col("next_confidence")) / 2).where("causal >= 0.6")


def spatial_links(points: DataFrame, radius: float = 50.0, keys: tuple[str, ...] = ("stream",), key: str = "seq") -> DataFrame:
    """Pairs of points of a stream at most radius apart, each once: a grid of cells, each point against its 3 by 3."""
    a = _renamed(points, "a_").select("*", F.explode(F.expr("sequence(-1, 1)")).alias("dx")).select("*", F.explode(F.expr("sequence(-1, 1)")).alias("dy"))
    a = a.withColumn("cx", F.floor(F.col("a_x") / radius) + F.col("dx")).withColumn("cy", F.floor(F.col("a_y") / radius) + F.col("dy"))
    b = _renamed(points, "b_").withColumn("bx", F.floor(F.col("b_x") / radius)).withColumn("by", F.floor(F.col("b_y") / radius))
    j = a.join(b, [a[f"a_{k}"] == b[f"b_{k}"] for k in keys] + [a["cx"] == b["bx"], a["cy"] == b["by"]])
    j = j.withColumn("distance", F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")))
    return j.where((F.col(f"a_{key}") < F.col(f"b_{key}")) & (F.col("distance") <= radius)).drop("dx", "dy", "cx", "cy", "bx", "by")


def typed_spatial_links(events: DataFrame, radius: float = 50.0, least: float = 0.6) -> DataFrame:
    """Directed pairs of types that correlate in place, at most radius apart, with confidence: 0.7 of nearness, 0.3 of the
    events' own; in order of time."""
    j = spatial_links(events.where("x is not null and y is not null"), radius, key="event_id")
    late = (F.col("a_us") > F.col("b_us")) | ((F.col("a_us") == F.col("b_us")) & (F.col("a_event_id") > F.col("b_event_id")))
    first, second = F.when(late, F.col("b_type")).otherwise(F.col("a_type")), F.when(late, F.col("a_type")).otherwise(F.col("b_type"))
    pair = F.concat(first, F.lit(">"), second).isin([f"{a}>{b}" for a, b in SPATIAL])
    sure = 0.7 * (1 - F.col("distance") / radius) + 0.3 * (F.col("a_confidence") + F.col("b_confidence")) / 2
    ids = [F.when(late, F.col(f"{x}_event_id")).otherwise(F.col(f"{y}_event_id")) for x, y in ("ba", "ab")]
    return j.where(pair).select(F.col("a_stream").alias("stream"), ids[0].alias("a_id"), ids[1].alias("b_id"), "distance", sure.alias("confidence")).where(F.col("confidence") >= least)


def asof_nearest(rows: DataFrame, others: DataFrame, within: int, most: int, forward: bool, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """For each span the `most` spans that end in the time `within` before its start, latest end first; or that start in
    the time after its end, earliest first."""
    at, other = ("t_end", "t_start") if forward else ("t_start", "t_end")
    a = _renamed(rows, "a_").withColumn("__cell", F.explode(F.array(*[F.floor(F.col(f"a_{at}") / within) + d for d in ((0, 1) if forward else (-1, 0))])))
    b = _renamed(others, "b_").withColumn("__cell", F.floor(F.col(f"b_{other}") / within))
    j = a.join(b, [a[f"a_{k}"] == b[f"b_{k}"] for k in keys] + [a["__cell"] == b["__cell"]]).drop("__cell")
    gap = F.col(f"b_{other}") - F.col(f"a_{at}") if forward else F.col(f"a_{at}") - F.col(f"b_{other}")
    j = j.withColumn("gap", gap).where(F.col("gap").between(0, within) & (F.col("a_span_id") != F.col("b_span_id")))
    order = Window.partitionBy("a_span_id").orderBy("gap", "b_span_id")
    return j.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _cells(df: DataFrame, size: float) -> DataFrame:
    """A row for each grid cell that a box touches."""
    low = lambda c: F.floor(F.col(c) / size)
    out = df.withColumn("cx", F.explode(F.sequence(low("x"), F.floor((F.col("x") + F.col("w")) / size))))
    return out.withColumn("cy", F.explode(F.sequence(low("y"), F.floor((F.col("y") + F.col("h")) / size))))


def overlaps(left: DataFrame, right: DataFrame, keys: tuple[str, ...], cell: float = 256.0) -> DataFrame:
    """Pairs of boxes with equal keys that share area, with their IoU (a_, b_ columns), each once."""
    a, b = _renamed(_cells(left, cell), "a_"), _renamed(_cells(right, cell), "b_")
    j = a.join(b, [a[f"a_{k}"] == b[f"b_{k}"] for k in (*keys, "cx", "cy")])
    first_x, first_y = F.greatest(F.floor(F.col("a_x") / cell), F.floor(F.col("b_x") / cell)), F.greatest(F.floor(F.col("a_y") / cell), F.floor(F.col("b_y") / cell))
    j = j.where((F.col("a_cx") == first_x) & (F.col("a_cy") == first_y))  # the cell with their common corner
    return j.withColumn("iou", geometry.iou(geometry.box("a_"), geometry.box("b_"))).where("iou > 0").drop("a_cx", "a_cy", "b_cx", "b_cy")


def with_previous_frame(regions: DataFrame, least: float = 0.7) -> DataFrame:
    """Regions of at least that confidence with seq, their frame's number in the stream, frames without any left out."""
    r = regions.where(F.col("confidence") >= least)
    numbered = scans.numbered(r.select("stream", "frame").distinct(), ("stream",), ("frame",), "seq").withColumn("seq", F.col("seq").cast("int"))
    return r.join(numbered, ["stream", "frame"])


def region_matches(numbered: DataFrame, least: float = 0.3, carried: tuple[Column, ...] = ()) -> DataFrame:
    """Each region and the region of the frame before with the best IoU over `least`, the first of equals; or its keys and
    b_idx with only the carried columns."""
    before = numbered.withColumn("seq", F.col("seq") + 1)
    o = overlaps(numbered, before, ("stream", "seq")).where(F.col("iou") > least)
    if carried:
        o = o.select("a_stream", "a_seq", "a_idx", "b_idx", "iou", *carried)
    best = Window.partitionBy("a_stream", "a_seq", "a_idx").orderBy(F.desc("iou"), "b_idx")
    return o.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def new_regions(numbered: DataFrame, least: float = 0.3) -> DataFrame:
    """Regions of a stream's second and later frames without a region of IoU `least` or more in the frame before."""
    before = numbered.withColumn("seq", F.col("seq") + 1)
    met = overlaps(numbered, before, ("stream", "seq")).where(F.col("iou") >= least).select(F.col("a_stream").alias("stream"), F.col("a_seq").alias("seq"), F.col("a_idx").alias("idx")).distinct()
    return numbered.where("seq > 1").join(met, ["stream", "seq", "idx"], "left_anti")


def delta(numbered: DataFrame) -> DataFrame:
    """What changed from frame to frame: modified regions, added ones, and removed ones (in the frame that lacks them).

    A match marks its region as met and the one of the frame before as found again. So regions are matched once, and one
    group a region, with its marks as bits, tells the rest. Whether texts differ is told before matches are ranked, so that
    no text is sorted with them.
    """
    met, changed, again = 1, 2, 4
    m = region_matches(numbered, carried=(F.when(F.col("a_text") != F.col("b_text"), met | changed).otherwise(met).alias("mark"),))
    marks = m.select(F.col("a_stream").alias("stream"), F.explode(F.array(F.struct(F.col("a_seq").alias("seq"), F.col("a_idx").alias("idx"), "mark"), F.struct((F.col("a_seq") - 1).alias("seq"), F.col("b_idx").alias("idx"), F.lit(again).alias("mark")))).alias("r"))
    # regions are dealt out before they are grouped, into a fixed number of parts: their rows are so short that they would be put
    # together in few tasks
    parts = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = numbered.select("stream", "seq", "idx", F.lit(0).alias("mark")).unionByName(marks.select("stream", "r.*")).repartition(parts, "stream", "seq", "idx")
    g = both.groupBy("stream", "seq", "idx").agg(F.bit_or("mark").alias("mark"))
    last = numbered.groupBy("stream").agg(F.max("seq").alias("last"))
    has = lambda bit: F.col("mark").bitwiseAND(bit) != 0
    tells = lambda test, seq, change: F.when(test, F.struct(seq.alias("seq"), F.lit(change).alias("change")))
    seq = F.col("seq")
    told = F.array_compact(F.array(tells(has(changed), seq, "modified"), tells(~has(met) & (seq > 1), seq, "added"), tells(~has(again) & (seq < F.col("last")), seq + 1, "removed")))
    return g.join(last, "stream").select("stream", "idx", F.explode(told).alias("r")).select("stream", "r.seq", "idx", "r.change")


def label_values(regions: DataFrame, is_label: Column, radius: float = 200.0) -> DataFrame:
    """Each label of a frame with the nearest other text to its right or below within the radius, the first of equals."""
    points = regions.withColumn("px", F.col("x")).withColumn("py", F.col("y"))
    labels, values = points.where(is_label), points.where(~is_label)
    a = _renamed(labels, "a_").withColumn("cx", F.explode(F.expr(f"sequence(floor(a_x / {radius}) - 1, floor(a_x / {radius}) + 1)"))).withColumn("cy", F.explode(F.expr(f"sequence(floor(a_y / {radius}) - 1, floor(a_y / {radius}) + 1)")))
    b = _renamed(values, "b_").withColumn("bx", F.floor(F.col("b_x") / radius)).withColumn("by", F.floor(F.col("b_y") / radius))
    j = a.join(b, (a["a_stream"] == b["b_stream"]) & (a["a_frame"] == b["b_frame"]) & (a["cx"] == b["bx"]) & (a["cy"] == b["by"]))
    far = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    right = (F.col("b_x") > F.col("a_x")) & (F.abs(F.col("b_y") - F.col("a_y")) <= F.col("a_h"))
    below = (F.col("b_y") > F.col("a_y")) & (F.abs(F.col("b_x") - F.col("a_x")) <= F.col("a_w"))
    j = j.withColumn("distance", far).where((right | below) & (F.col("distance") <= radius))
    best = Window.partitionBy("a_stream", "a_frame", "a_idx").orderBy("distance", "b_idx")
    return j.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "cx", "cy", "bx", "by")


def merged_regions(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("stream", "frame"), least: float = 0.5) -> DataFrame:
    """All regions of a, and those of b that no region of a overlaps by more than `least`."""
    met = overlaps(b, a, keys).where(F.col("iou") > least).select(*[F.col(f"a_{k}").alias(k) for k in (*keys, "idx")]).distinct()
    return a.unionByName(b.join(met, [*keys, "idx"], "left_anti"))


def field_change_events(numbered: DataFrame) -> DataFrame:
    """Matched regions whose text differs, as events from confidence 0.6 up."""
    m = region_matches(numbered).where("a_text != b_text")
    like = text.similarity(F.col("a_text"), F.col("b_text"))
    sure = F.least(F.lit(1.0), 0.4 * (F.col("a_confidence") + F.col("b_confidence")) / 2 + 0.3 * F.col("iou") + 0.3 * (1 - like))
    target = F.format_string("field_%d_%d_%d_%d", *[F.col(f"a_{c}").cast("int") for c in "xywh"])
    out = m.select(F.col("a_stream").alias("stream"), F.col("a_frame").alias("frame"), F.col("a_idx").alias("idx"), target.alias("target"), F.col("b_text").alias("value_from"), F.col("a_text").alias("value_to"), sure.alias("confidence"))
    return out.where("confidence >= 0.6")


def data_entry_events(numbered: DataFrame) -> DataFrame:
    """New regions that take input, as events from confidence 0.6 up."""
    out = new_regions(numbered).where(text.interactive(F.col("text"))).withColumn("confidence", F.col("confidence") * 0.8)
    return out.where("confidence >= 0.6").select("stream", "frame", "idx", "text", "confidence")
