"""Stores, streams and the order-dependent steps on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from frameloom.operators import kernels, lookups, operations, sequences
from frameloom.sources import stores
from frameloom.streaming import jobs


def regions(spark, rows):
    return spark.createDataFrame([("s", f, k, t, c, *map(float, b)) for k, (f, t, c, b) in enumerate(rows)], "stream string, frame long, idx long, text string, confidence double, x double, y double, w double, h double")


def test_frames_round_trip(spark, tmp_path):
    rows = [(1_000_000_000, 0, "seg", "/a.png", 12345, 5.5, "App", 'a,b "c"', 1920, 1080), (2_000_000_000, 1, "seg", "/b.png", 67890, 6.25, "Other", "two\nlines", 2560, 1440)]
    df = spark.createDataFrame(rows, stores.FRAMES)
    stores.write_store(df, f"{tmp_path}/p", "frames")
    assert sorted(map(tuple, stores.read_store(spark, f"{tmp_path}/p", stores.FRAMES).collect())) == rows
    stores.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, stores.read_csv(spark, f"{tmp_path}/c").collect())) == rows
    assert stores.read_store(spark, f"{tmp_path}/none", stores.FRAMES).count() == 0
    assert stores.stored_bytes(spark, f"{tmp_path}/p").where(F.col("path").endswith(".parquet")).agg(F.sum("length")).first()[0] > 0


def test_events_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a", {"k": "1"}), ("b", {})], "event_id string, metadata map<string,string>")
    stores.write_events(df, f"{tmp_path}/e")
    back = stores.read_store(spark, f"{tmp_path}/e", "event_id string, metadata string")
    assert dict(map(tuple, back.collect())) == {"a": '{"k":"1"}', "b": None}
    assert dict(map(tuple, back.select("event_id", stores.metadata_map(F.col("metadata"))).collect())) == {"a": {"k": "1"}, "b": {}}
    assert [r[0] for r in spark.createDataFrame([('["x"]',), ("no json",)], "t string").select(stores.tag_array(F.col("t"))).collect()] == [["x"], []]


def test_encryption_round_trip(spark):
    key = F.lit("0123456789abcdef")
    df = spark.createDataFrame([("secret",), (None,)], "text string")
    hidden = stores.encrypted(df, ("text",), key)
    assert "secret" not in {r[0] for r in hidden.collect()}
    assert [r[0] for r in stores.decrypted(hidden, ("text",), key).collect()] == ["secret", None]


def test_logs_round_trip(spark):
    lines = ["[2024-01-01 10:00:00.123] ERROR   [storage        ] disk (almost) full (store.rs:42)", "no log line"]
    logs = stores.parse_logs(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = logs.first()
    assert (logs.count(), r["level"], r["category"], r["message"], r["file"], r["line"]) == (1, "ERROR", "storage", "disk (almost) full", "store.rs", 42)
    assert stores.log_lines(logs).first()[0] == lines[0]


def test_log_export_and_notes(spark, tmp_path):
    lines = ["[2024-01-01 10:00:00.123] ERROR   [storage        ] disk (almost) full (store.rs:42)"]
    logs = stores.parse_logs(spark.createDataFrame([(x,) for x in lines], "value string"))
    for form in ("json", "csv", "text"):
        stores.export_logs(logs, f"{tmp_path}/{form}", form)
    assert spark.read.json(f"{tmp_path}/json").first()["message"] == "disk (almost) full"
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["line"] == "42"
    assert [r[0] for r in spark.read.text(f"{tmp_path}/text").collect()] == lines
    notes = spark.createDataFrame([("a", 0.0, 1.0, "/a.mp4", ["1"], 100_001), ("b", 0.0, 1.0, "/b.mp4", [], 100_000)], stores.SEGMENT_NOTES)
    stores.write_notes(notes, f"{tmp_path}/notes")
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/notes").collect()] == ["a"]
    files = spark.createDataFrame([("/a", 5, 100), ("/b", 0, 100), ("/c", 5, 101)], "path string, length long, mtime long")
    assert [r["path"] for r in stores.settled(files, 102).collect()] == ["/a"]


def test_migrations(spark):
    df = spark.createDataFrame([(1, "a")], "span_id long, title string")
    steps = {1: (lambda d: d.withColumn("tags", F.lit("[]")), lambda d: d.drop("tags")), 2: (lambda d: d.withColumnRenamed("title", "name"), lambda d: d.withColumnRenamed("name", "title"))}
    up, version = stores.migrated(df, 0, steps)
    assert version == 2 and up.columns == ["span_id", "name", "tags"]
    down, version = stores.migrated(up, 2, steps, to=0)
    assert version == 0 and [tuple(r) for r in down.collect()] == [(1, "a")]


def test_monitoring_and_recognition_streams(spark, tmp_path):
    metrics = spark.createDataFrame([("m", 1, 95, 10, 10, 0), ("m", 2, 10, 10, 10, 0)], "stream string, us long, cpu int, mem_pct int, disk_pct int, errors int")
    metrics.write.parquet(f"{tmp_path}/metrics")
    jobs.monitoring(spark.readStream.schema(metrics.schema).parquet(f"{tmp_path}/metrics"), f"{tmp_path}/alerts", f"{tmp_path}/c1", None).awaitTermination(60)
    assert [(r["metric"], r["level"]) for r in spark.read.parquet(f"{tmp_path}/alerts").collect()] == [("cpu", 2)]
    r = regions(spark, [(1, "a", 0.9, (1, 2, 3, 4)), (2, "b", 0.9, (1, 2, 3, 4)), (1, "c", 0.2, (1, 2, 3, 4))])
    r.write.parquet(f"{tmp_path}/regions")
    origins = spark.createDataFrame([("s", 1, 100.0, 50.0)], "stream string, frame long, ox double, oy double")
    jobs.append_to(jobs.recognised(spark.readStream.schema(r.schema).parquet(f"{tmp_path}/regions"), origins), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination(60)
    assert sorted((x["text"], x["x"], x["y"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 101.0, 52.0), ("b", 1.0, 2.0)]


def test_frame_events_are_the_parts_together(spark):
    from frameloom.operators import assemblies, detection, joins

    r = regions(spark, [(1, "Name:", 0.9, (10, 50, 80, 20)), (1, "error: disk full", 0.9, (10, 90, 200, 20)), (2, "Name:", 0.9, (10, 50, 80, 20)), (2, "warning: slow", 0.95, (10, 90, 200, 20)), (2, "Enter your name", 0.8, (400, 400, 90, 20)), (3, "plain", 0.5, (0, 0, 10, 10))])
    got = {(e["source"], e["type"], e["frame"], e["idx"]) for e in assemblies.frame_events(r).collect()}
    n, sure = joins.with_previous_frame(r), r.where("confidence >= 0.7")
    want = {("delta", "field_change", e["frame"], e["idx"]) for e in joins.field_change_events(n).collect()} | {("delta", "data_entry", e["frame"], e["idx"]) for e in joins.data_entry_events(n).collect()}
    want |= {("words", e["type"], e["frame"], e["idx"]) for e in detection.standalone_events(sure).collect()} | {("rules", e["type"], e["frame"], e["idx"]) for e in detection.error_modal_events(sure).collect()}
    assert want and {g for g in got if g[0] != "layout"} == want
    assert {e["temporal_pattern"] for e in assemblies.with_patterns(assemblies.frame_events(r)).where("frame = 2").collect()} <= {"recurring", "occasional", "rare", None}


def test_span_updates(spark):
    s = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "span_id long, title string, created_at long")
    changed = spark.createDataFrame([(2, "c", 99)], s.schema)
    assert sorted(map(tuple, lookups.update(s, changed).collect())) == [(1, "a", 10), (2, "c", 20)]
    with pytest.raises(KeyError):
        lookups.update(s, spark.createDataFrame([(3, "x", 1)], s.schema))
    with pytest.raises(KeyError):
        lookups.delete(s, spark.createDataFrame([(3,)], "span_id long"))


def test_sampling_and_retention(spark):
    f = spark.range(60).withColumnRenamed("id", "frame_no")
    assert [tuple(r) for r in stores.sampled_frames(f, 30, 1).collect()] == [(0, 0), (30, 1_000_000_000)]
    files = spark.createDataFrame([("a", "raw_video", 0, 5), ("b", "spans", 0, 5), ("c", "raw_video", 31 * 86_400, 5)], "path string, data_type string, mtime long, length long")
    assert [r["path"] for r in operations.retention_plan(files, 31 * 86_400 + 1).collect()] == ["a"]


def activity(spark):
    rows = [(1, 0, "field_change", "email_field", 0.9), (2, 30, "field_change", "password_field", 0.85), (3, 60, "form_submission", "login_form", 0.95), (4, 400, "navigation", "dashboard", 0.8), (5, 430, "click", "menu_button", 0.75), (6, 460, "navigation", "settings", 0.8)]
    return spark.createDataFrame([(i, 1, s * 1_000_000, t, g, c, "Safari") for i, s, t, g, c in rows], "event_id long, stream long, us long, type string, target string, confidence double, app_name string")


def test_islands_and_contexts(spark):
    e = activity(spark)
    assert [r["island"] for r in sequences.islands(e, 300_000_000).orderBy("event_id").collect()] == [1, 1, 1, 2, 2, 2]
    assert [r["chunk"] for r in sequences.islands(e, 300_000_000, most=2).orderBy("event_id").collect()] == [0, 0, 1, 0, 0, 1]
    assert [r["island"] for r in sequences.islands(e, 340_000_000).orderBy("event_id").collect()] == [1] * 6  # a gap of just that joins
    c = {r["event_id"]: r for r in sequences.context_split(e, 300_000_000).collect()}
    assert c[2]["similarity"] == pytest.approx(3.2333333 / 4) and c[3]["similarity"] == pytest.approx(0.65)
    assert (c[1]["context"], c[2]["context"], c[3]["context"]) == (1, 1, 2)
    assert sequences.sessions(sequences.islands(e, 300_000_000)).count() == 2
    assert sequences.sessions(sequences.islands(e.limit(0), 300_000_000)).count() == 0


def test_clusters_boxes_tables(spark):
    r = regions(spark, [(1, "a", 0.9, (0, 0, 10, 10)), (1, "b", 0.9, (60, 0, 10, 10)), (1, "c", 0.9, (120, 0, 10, 10)), (1, "d", 0.9, (500, 500, 10, 10))])
    assert [x["cluster"] for x in kernels.clusters(r).orderBy("idx").collect()] == [0, 0, 1, 2]  # by the seed, not on from its members
    n = regions(spark, [(1, "a", 0.9, (0, 0, 100, 100)), (1, "b", 0.9, (10, 10, 50, 50)), (1, "c", 0.9, (90, 90, 50, 50))])
    assert sorted(x["text"] for x in kernels.non_maximum(n).collect()) == ["a", "c"]
    t = regions(spark, [(1, "Name", 0.9, (0, 0, 10, 10)), (1, "Age", 0.9, (50, 2, 10, 10)), (1, "Ann", 0.9, (0, 30, 10, 10)), (1, "7", 0.9, (50, 33, 10, 10)), (1, "x", 0.9, (90, 31, 10, 10))])
    assert [(x["row"], x["header"], x["text"]) for x in kernels.tables(t).orderBy("row", "column").collect()][2:] == [(1, "Name", "Ann"), (1, "Age", "7"), (1, "Column 3", "x")]


def test_temporal_patterns_feed_on_what_they_keep(spark):
    rows = [("s", f, 0, "error_display", "t", 0.62) for f in range(4)]
    e = spark.createDataFrame(rows, "stream string, frame long, idx long, type string, target string, confidence double")
    assert [(r["frame"], r["confidence"]) for r in kernels.temporal_patterns(e).orderBy("frame").collect()] == [(0, 0.62), (1, 0.72), (2, 0.72), (3, 0.72)]


T0 = dt.datetime(2024, 1, 1)
STREAM = "stream long, event_id long, us long, ts timestamp, type string, app_name string, confidence double"


def stream_rows(spark, path):
    rows = [(1, k, s * 1_000_000, T0 + dt.timedelta(seconds=s), t, a, 0.9) for k, (s, t, a) in enumerate([(0, "click", "A"), (1, "navigation", "A"), (100, "click", "B"), (1000, "click", "A"), (1001, "navigation", "B")])]
    df = spark.createDataFrame(rows, STREAM)
    df.coalesce(1).write.parquet(path)
    return df


def drained(stream, mode="append"):
    name = f"t{abs(hash(stream))}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams_give_what_batches_give(spark, tmp_path):
    batch = stream_rows(spark, f"{tmp_path}/in")
    s = lambda: jobs.event_stream(spark, f"{tmp_path}/in", STREAM)
    assert drained(jobs.sessions(s()), "append").where("start < '2024-01-01 00:05:00'").count() <= 1
    assert {tuple(r) for r in drained(jobs.sessions(s()), "complete").collect()} == {tuple(r) for r in jobs.sessions(batch).collect()}
    assert sorted(tuple(r) for r in drained(jobs.counts(s()), "complete").collect()) == sorted(tuple(r) for r in jobs.counts(batch).collect())
    screen = lambda: s().replace({"navigation": "screen_change"}, subset=["type"])
    assert {(r["a_event_id"], r["b_event_id"]) for r in drained(jobs.correlations(screen(), screen())).collect()} == {(0, 1), (3, 4)}
    focus = {tuple(r) for r in drained(jobs.focus_changes(s().select("stream", "event_id", "us", "app_name"))).collect()}
    assert focus == {tuple(r) for r in kernels.focus_changes(batch.select("stream", "event_id", "us", "app_name")).collect()}
    assert drained(jobs.first_sightings(s())).count() == 5


def test_append_and_notes(spark, tmp_path):
    stream_rows(spark, f"{tmp_path}/in")
    jobs.append_to(jobs.event_stream(spark, f"{tmp_path}/in", STREAM), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    spark.createDataFrame([("a", 0.0, 1.0, "/x", ["1"], 200_000), ("b", 0.0, 1.0, "/y", ["1"], 10)], stores.SEGMENT_NOTES).write.json(f"{tmp_path}/notes")
    assert [r["id"] for r in drained(jobs.segment_notes(spark, f"{tmp_path}/notes", stores.SEGMENT_NOTES)).collect()] == ["a"]


REGION = "stream string, frame long, idx long, text string, x double, y double, w double, h double"


def test_nearest_later_values_at_any_distance(spark):
    import random

    r = random.Random(5)
    rows = [("s", f, i, r.choice(["a:", "value"]), float(r.randrange(3000)), float(r.randrange(3000)), float(r.randrange(200)), 20.0) for f in range(5) for i in range(40)]
    rows += [("s", 9, 0, "a:", 0.0, 0.0, 10.0, 10.0), ("s", 9, 1, "value", 5000.0, 900.0, 10.0, 10.0), ("s", 10, 0, "value", 50.0, 0.0, 9.0, 9.0), ("s", 10, 1, "a:", 0.0, 0.0, 9.0, 9.0)]
    want = set()
    for s, f, i, t, x, y, w, h in rows:
        near = [(((X + W / 2 - x - w / 2) ** 2 + (Y + H / 2 - y - h / 2) ** 2) ** 0.5, I) for _, F_, I, T, X, Y, W, H in rows if t == "a:" and (F_, T) == (f, "value") and I > i and (X + W / 2 > x + w / 2 or Y + H / 2 > y + h / 2)]
        want |= {(f, i, min(near)[1])} if near else set()
    got = kernels.nearest_later(spark.createDataFrame(rows, REGION), F.col("text") == "a:").collect()
    assert sorted((g["frame"], g["idx"], g["b_idx"]) for g in got) == sorted(want) and (9, 0, 1) in want


def test_label_values_across_a_cell_above(spark):
    from frameloom.operators import joins

    rows = [("s", 0, 0, "a:", 10.0, 205.0, 30.0, 20.0), ("s", 0, 1, "value", 60.0, 195.0, 30.0, 20.0)]
    assert [(g["a_idx"], g["b_idx"]) for g in joins.label_values(spark.createDataFrame(rows, REGION), F.col("text") == "a:").collect()] == [(0, 1)]


def test_merged_regions_take_all_regions(spark, tmp_path):
    from frameloom.plans import catalog
    from frameloom.sources import adapters

    spark.createDataFrame([(1, "en", "s", "\n".join(f"line {k}" for k in range(160)))], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    a = [tuple(r) for r in adapters.regions(spark, str(tmp_path)).select("idx", "x", "y", "w", "h").collect()]

    def iou(p, q):
        common = max(0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1])) * max(0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]))
        return common / (p[3] * p[4] + q[3] * q[4] - common)

    b = [(i, x + 2 * h, y, w, h) for i, x, y, w, h in a]
    b = [q for q in b if all(iou(p, q) <= 0.5 for p in a)]
    got = [(r["idx"], r["x"]) for r in catalog.queries()["j18_merged_regions"](spark, str(tmp_path)).collect()]
    assert 0 < len(b) < len(a) and sorted(got) == sorted([p[:2] for p in a] + [q[:2] for q in b])


def test_temporal_patterns_hold_only_the_last_frames():
    import pyarrow as pa

    read, names = [0], ["stream", "frame", "idx", "type", "target", "confidence"]

    def batches():
        for k in range(50):
            read[0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (["s"] * 2, [k // 2] * 2, [2 * k, 2 * k + 1], ["a"] * 2, ["a"] * 2, [0.62] * 2)], names)

    out = kernels.pattern_batches(5, 0.6)(batches())
    first = next(out)
    assert read[0] == 1 and first.num_rows == 2  # nothing waits for the stream's end
    rest = list(out)
    # a frame that goes on in the next batch doesn't count as past of itself
    assert rest[0].column("share").to_pylist() == [None, None] and rest[1].column("share").to_pylist() == [1.0, 1.0]
    assert sum(b.num_rows for b in rest) == 98


def test_a_lookup_reads_few_row_groups_of_a_store_of_any_size(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(200_000).select(F.concat(F.lit("frame_"), F.lpad((F.col("id") % 5000).cast("string"), 5, "0")).alias("frame_id"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    read = []
    for name, n in (("small", 20_000), ("large", 200_000)):
        path = f"{tmp_path}/{name}"
        assert stores.write_for_lookups(rows.where(F.col("k") < n), path, "frame_id", rows_per_file=20_000, group_bytes=128 << 10) == n // 20_000
        groups = [pq.ParquetFile(f).metadata for f in tmp_path.joinpath(name).glob("*.parquet")]
        stats = [m.row_group(g).column(0).statistics for m in groups for g in range(m.num_row_groups)]
        holding = sum(s.min <= "frame_02500" <= s.max for s in stats)
        assert len(stats) >= 3 * n // 20_000 and holding <= 2
        found = spark.read.parquet(path).where("frame_id = 'frame_02500'")
        assert found.count() == n // 5000
        # a value inside a group's range that isn't in the store: the Bloom filter spares its rows
        scanned = spark.read.parquet(path).where("frame_id = 'frame_02500x'").select("k")
        assert scanned.collect() == []
        plan = scanned._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        read.append(leaf.metrics().apply("numOutputRows").value())
        assert "EqualTo(frame_id,frame_02500x)" in plan.toString()
    assert read == [0, 0]
