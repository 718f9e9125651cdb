"""Ordered scans over many ranges give what windows over whole streams give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.operators import assemblies, joins, kernels, scans, sequences

KEYS = ("stream", "island")


def rows(spark, n, seed):
    rng = random.Random(seed)
    # one stream holds most rows
    data = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), k, rng.choice([None, "x", "y", "z"])) for k in range(n)]
    return spark.createDataFrame(data, "stream string, at long, value string").repartition(3)


@pytest.mark.parametrize("n, parts", [(0, 4), (1, 4), (7, 5), (60, 4), (60, 40), (200, 7)])
def test_lagged_and_numbered(spark, n, parts):
    r = rows(spark, n, n)
    w = Window.partitionBy("stream").orderBy("at")
    values = {"v1": ("value", 1), "v3": ("at", 3), "n1": ("value", -1), "n2": ("at", -2)}
    want = r.select("*", *[(F.lag(c, k) if k > 0 else F.lead(c, -k)).over(w).alias(name) for name, (c, k) in values.items()])
    as_set = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert as_set(scans.lagged(r, ("stream",), ("at",), values, parts)) == as_set(want)
    known = r.where("stream is not null")
    assert as_set(scans.numbered(known, ("stream",), ("at",), "k", parts)) == as_set(known.withColumn("k", F.row_number().over(w).cast("long")))


def test_top_n_in_two_phases(spark):
    r = rows(spark, 300, 1)
    w = Window.partitionBy("stream").orderBy(F.desc("value"), "at")
    want = r.withColumn("rank", F.row_number().over(w)).where("rank <= 7")
    assert sorted(map(tuple, scans.top_n(r, ("stream",), (F.desc("value"), F.col("at")), 7, ("at",), deals=5).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_no_window_by_the_stream_alone_sees_all_rows(spark):
    plan = scans.lagged(rows(spark, 50, 2), ("stream",), ("at",), {"v": ("value", 1)})._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning(__range" in plan


@pytest.mark.parametrize("parts", ["1", "5", "60"])
def test_scene_changes_do_not_depend_on_ranges(spark, parts):
    rng = random.Random(3)
    frames = [("hot" if k % 4 else "b", k, None if k % 17 == 5 else [rng.choice([0, 80, 255]) for _ in range(64 if k < 70 else 16)]) for k in range(90)]
    f = spark.createDataFrame(frames, "stream string, frame long, pixels array<int>").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r["stream"], r["frame"]): round(r["ssim"], 9) for r in sequences.scene_changes(f).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    alone = {}
    for stream in ("hot", "b"):
        own = [x for x in frames if x[0] == stream and x[2] is not None]
        for a, b in zip(own, own[1:]):
            if len(a[2]) == len(b[2]):
                pair = spark.createDataFrame([a, b], "stream string, frame long, pixels array<int>") if (stream, b[1]) in got and b[1] % 11 == 0 else None
                alone[stream, b[1]] = None if pair is None else round(sequences.scene_changes(pair.coalesce(1)).first()["ssim"], 9)
    assert set(got) <= set(alone) and len(got) > 60
    assert all(v is None or got[k] == v for k, v in alone.items())


def test_related_sessions_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    data = [(s, i, rng.choice("abcdef"), rng.choice(["A", "B", None])) for s in range(2) for i in range(40) for _ in range(rng.randrange(1, 5))]
    g = spark.createDataFrame(data, "stream long, island long, type string, app_name string")
    words = {}
    for s, i, t, a in data:
        words.setdefault((s, i), set()).update({t, a} - {None})
    want = set()
    for (s, i), x in words.items():
        best = sorted((-len(x & y) / len(x | y), j) for (q, j), y in words.items() if q == s and j != i and len(x & y) / len(x | y) >= 0.6)[:5]
        want |= {(s, i, j, round(-v, 6), k + 1) for k, (v, j) in enumerate(best)}
    assert {tuple(r) for r in assemblies.related_sessions(g, KEYS).collect()} == want


def test_frames_longer_than_batches(spark):
    rng = random.Random(4)
    data = [("s" if f else None, f, k, f"t{k}", 0.9, rng.random() * 300, float(rng.randrange(60)), 10.0 + k % 7, 10.0) for f in (0, 1, 2) for k in range((30, 700, 3)[f])]
    r = spark.createDataFrame(data, "stream string, frame long, idx long, text string, confidence double, x double, y double, w double, h double").repartition(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    label = F.col("idx") % 3 == 0
    runs = []
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        runs.append([sorted(map(tuple, df.collect()), key=str) for df in (kernels.clusters(r), kernels.non_maximum(r), kernels.tables(r), kernels.nearest_later(r, label, ("text",)))])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert runs[0] == runs[1] and all(runs[0])
    centre = {(d[1], d[2]): (d[5] + d[7] / 2, d[6] + d[8] / 2) for d in data}
    for stream, f, i, text, b, b_text in runs[0][3]:
        x, y = centre[f, i]
        far = [((u - x) ** 2 + (v - y) ** 2, j) for (g, j), (u, v) in centre.items() if g == f and j > i and j % 3 and (u > x or v > y)]
        assert min(far)[1] == b and (text, b_text) == (f"t{i}", f"t{b}")


def test_trails_of_any_batches_are_measured_by_one_sort(spark):
    import math

    rng = random.Random(8)
    data = []
    for s in (1, 2, None, 3):
        ms = 0
        for k in range((400, 3, 120, 60)[(s or 3) - 1 if s else 2]):
            ms += rng.choice([0, 0, 20, 100, 300, 600, 1500])
            data.append((s, ms, k, float(rng.randrange(0, 60, 3)), float(rng.randrange(0, 40, 4))))
    r = spark.createDataFrame(data, "stream long, ms long, seq long, x double, y double").repartition(3)
    want = {}
    for stream, now, seq, _, _ in data:
        own = [d for d in data if d[0] == stream]
        w = [d for d in own if now - 1000 <= d[1] <= now]
        if len(w) < 3 or w[-1][1] == w[0][1] or seq + 1 < 5:
            continue
        steps = [(b[3] - a[3], b[4] - a[4]) for a, b in zip(w, w[1:])]
        angles = [math.atan2(v, u) for u, v in steps if abs(u) > 1 or abs(v) > 1]
        apart = [abs(b - a) for a, b in zip(angles, angles[1:])]
        want[stream, seq] = (len(w), now - w[0][1], round(sum(math.hypot(*s) for s in steps), 6), sum(min(a, 2 * math.pi - a) > math.pi / 6 for a in apart))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("10000", "7", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        t = sequences.trails(r, least=0.0)
        assert {(x["stream"], x["seq"]): (x["points"], x["ms_span"], round(x["path"], 6), x["turns"]) for x in t.collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("n", [3, 40, 3000])
def test_latest_files_of_a_large_kind_are_not_sorted_whole(spark, n):
    from frameloom.operators import operations

    rng = random.Random(n)
    # many files of few times, equal rows, kinds and times unknown
    data = [(rng.choice(["raw", "raw", "raw", "ocr", None]), rng.choice([None, 1, 2, 3, 90, 91]) if k % 2 else k, f"p{rng.randrange(n // 2 + 1):04d}") for k in range(n)]
    files = spark.createDataFrame(data, "data_type string, mtime long, path string").repartition(3)
    w = Window.partitionBy("data_type").orderBy(F.desc("mtime"), "path")
    want = files.withColumn("kept", F.row_number().over(w) <= 5)
    got = operations.latest_files(files)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    if n == 3000:
        alone = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [row_number()" in line and "__share" not in line]
        assert alone and got.where("kept").count() == 15
        # the window over a whole kind reads what is left of its shares
        assert "__first" in got._jdf.queryExecution().optimizedPlan().toString()


def test_correlations_and_rings_read_their_sources_once(spark):
    rng = random.Random(6)
    kinds = ("movement", "click", "window", "focus", "trail")
    data = [(k % 3, 1000 * rng.randrange(400), rng.choice(kinds), f"s-{k}", "navigation", "t", 0.9, float(k % 40), 3.0) for k in range(4000)]
    s = spark.createDataFrame(data, "stream long, us long, source string, event_id string, type string, target string, confidence double, x double, y double")
    screen = spark.createDataFrame([(k % 3, 500 * k, k, "error_display", 0.8, {"roi_x": "1", "roi_y": "2"}) for k in range(50)], "stream long, us long, event_id long, type string, confidence double, metadata map<string,string>")
    visits = spark.createDataFrame([(f"h{k % 2}", k) for k in range(230)], "stream string, page_id long")
    heard = assemblies.correlation_events(s, screen)
    scans_of = lambda df: df._jdf.queryExecution().analyzed().toString().count("LogicalRDD")
    found = assemblies.correlations(heard, 50_000)
    assert scans_of(found) == 0 and found.count() > 0
    of = lambda source: s.where(F.col("source") == source)
    want = [sequences.ring(of("movement"), "positions", "us", "event_id"), sequences.ring(of("click"), "clicks", "us", "event_id"), sequences.ring(of("focus"), "focus", "us", "event_id"), sequences.ring(heard, "correlation_events", "us", "event_id"), sequences.ring(visits, "urls", "page_id", "page_id")]
    got = assemblies.rings(s, screen, visits)
    assert scans_of(got) == 3
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for df in want for r in df.collect())


def test_changes_between_frames_sort_no_texts_and_group_a_region_once(spark):
    import re

    rng = random.Random(2)
    data = [(s, f, i, rng.choice(["x", "y"]), 0.9, float(rng.choice([0, 5, 60])), float(rng.choice([0, 40])), 20.0, 10.0) for s in ("a", None) for f in range(1, 6) for i in range(rng.randrange(1, 5))]
    n = spark.createDataFrame(data, "stream string, seq int, idx long, text string, confidence double, x double, y double, w double, h double")
    want = set()

    def iou(p, q):
        common = max(0, min(p[5], q[5]) + 20 - max(p[5], q[5])) * max(0, min(p[6], q[6]) + 10 - max(p[6], q[6]))
        return common / (400 - common)

    own = [d for d in data if d[0] == "a"]
    again = set()
    for d in own:
        near = sorted((-iou(d, q), q[2], q[3]) for q in own if q[1] == d[1] - 1 and iou(d, q) > 0.3)
        if near:
            again.add((d[1] - 1, near[0][1]))
        if near and near[0][2] != d[3]:
            want.add(("a", d[1], d[2], "modified"))
        if not near and d[1] > 1:
            want.add(("a", d[1], d[2], "added"))
    want |= {("a", d[1] + 1, d[2], "removed") for d in own if d[1] < max(x[1] for x in own) and (d[1], d[2]) not in again}
    got = joins.delta(n)
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [row_number()") :]
    assert "text" not in re.search(r"Project \[.*", below)[0].split("mark")[-1]
    assert "bit_or" in plan and "RepartitionByExpression [stream" in plan


def test_related_sets_meet_once_and_are_not_counted_together(spark):
    g = spark.createDataFrame([(1, i, t, "A") for i in range(30) for t in "abcdef"[: 1 + i % 6]], "stream long, island long, type string, app_name string")
    plan = assemblies.related_sessions(g, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [" in line and "a_words" in line and "b_words" in line for line in plan.split("\n"))


def test_rings_shuffle_a_stream_once_and_order_ids_as_text(spark):
    # ids between an id and its detection, times alike, more rows than a ring holds, sources unknown
    rng = random.Random(8)
    tails = ("", "!", "-", "0", "-detecte", "~")
    data = [(k % 2, rng.randrange(900), rng.choice(("movement", "click", "focus", "tab", "trail", None)), f"m{k // 6}{tails[k % 6]}") for k in range(6000)]
    s = spark.createDataFrame(data, "stream long, us long, source string, event_id string").repartition(3)
    screen = spark.createDataFrame([(k % 3, 3 * k, k) for k in range(400)], "stream long, us long, event_id long")
    visits = spark.createDataFrame([(f"h{k % 2}", k) for k in range(230)], "stream string, page_id long")
    held = {}
    for stream, us, source, key in data:
        ring = {"movement": "positions", "click": "clicks", "focus": "focus"}.get(source)
        for name, own in ((ring, key), ("correlation_events", key if source not in ("trail", None) else None), ("correlation_events", f"{key}-detected")):
            if name and own:
                held.setdefault((name, str(stream)), []).append((us, own))
    for k in range(400):
        held.setdefault(("correlation_events", str(k % 3)), []).append((3 * k, f"screen-{k}"))
    for k in range(230):
        held.setdefault(("urls", f"h{k % 2}"), []).append((k, str(k)))
    want = sorted((ring, stream, key, n) for (ring, stream), rows in held.items() for n, (_, key) in enumerate(sorted(rows, reverse=True)[: sequences.RINGS[ring]], 1))
    got = assemblies.rings(s, screen, visits)
    assert sorted(tuple(r) for r in got.collect()) == want
    # the last exchange but that of the visits is of rows before they are told twice, and nothing is ranked in shares
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    told = plan[: plan.index("RepartitionByExpression [stream")]
    assert "Generate explode" in told and "__share" not in told


def test_detectors_of_the_cursor_share_one_shuffle(spark):
    rng = random.Random(9)
    cursor = spark.createDataFrame([(k % 2, 40 * k, k, float(rng.randrange(300)), float(rng.randrange(300))) for k in range(300)], "stream long, ms long, seq long, x double, y double")
    samples = spark.createDataFrame([(k % 2, 200_000 * k, k, "A", f"w{k % 3}", f"t{k % 5}") for k in range(60)], "stream long, us long, event_id long, app_name string, window string, tab string")
    found = assemblies.source_events(samples, cursor, {"x": F.floor(F.col("x") / 250) * 250.0, "y": F.floor(F.col("y") / 250) * 250.0})
    kinds = {r["source"] for r in found.collect()}
    assert {"movement", "click", "trail", "window", "tab"} <= kinds
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert final.count("ReusedExchange") == 2
