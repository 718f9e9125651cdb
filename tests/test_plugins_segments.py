"""User parsers by contract, rules by display, and segments that count once they are whole."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from frameloom.operators import lookups, parsers, plugins
from frameloom.sources import segments
from frameloom.streaming import jobs

REGION = "stream string, frame long, idx long, text string, confidence double, x double, y double, w double, h double, app string"
PLUGIN = "plugin string, pattern string, enabled boolean"


def regions(spark):
    rows = []
    for frame, app, lines in ((1, "com.a.Notes", ["short", "two", "x" * 30, "three", "four", "five"]), (2, "com.b.Web", ["a", "b"]), (3, "com.a.Mail", ["only", "y" * 40, None, "last"])):
        rows += [("s", frame, k, t, 0.8, 10.0 * k, 5.0 * k, 20.0, 4.0, app) for k, t in enumerate(lines)]
    return spark.createDataFrame(rows, REGION).repartition(3)


def test_a_user_parser_gets_whole_frames_that_are_routed_to_it(spark):
    table = spark.createDataFrame([("blocks", "com.a.*", True), ("blocks", "com.b.Web", False), ("terminal", "com.b.*", True)], PLUGIN)
    found = plugins.parsed(regions(spark), table, {"blocks": (plugins.ShortLineBlocks, 10, "title,second,third")}).orderBy("frame", "idx").collect()
    assert [(r["plugin"], r["frame"], r["idx"], r["semantic_type"]) for r in found] == [("blocks", 1, 0, "block"), ("blocks", 1, 3, "block")]
    assert json.loads(found[0]["more"]) == {"lines": ["short", "two"], "x": 0.0, "y": 0.0, "w": 30.0, "h": 9.0, "title": "short", "second": "two"}
    assert json.loads(found[1]["more"])["third"] == "five"
    assert plugins.parsed(regions(spark).limit(0), table, {"blocks": (plugins.ShortLineBlocks, 10, "")}).count() == 0


def test_columns_follow_the_arguments_and_the_contract_is_held(spark):
    r = regions(spark).select(*plugins.GIVEN)
    assert F.udtf(plugins.ShortLineBlocks)(r.asTable(), F.lit(10), F.lit("a,b")).columns[-2:] == ["a", "b"]

    class Lacking:
        @staticmethod
        def analyze(table):
            from pyspark.sql.types import LongType, StructType

            return plugins.frame_by_frame(StructType().add("stream", LongType()))

        def eval(self, row):
            yield (1,)

    with pytest.raises(PySparkException, match="lack frame, idx, semantic_type, confidence"):
        F.udtf(Lacking)(r.asTable()).collect()


def test_built_in_parsers_start_no_python(spark):
    plan = parsers.elements(regions(spark).withColumn("app", F.lit("Terminal")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_of_displays(spark):
    s = spark.createDataFrame([(d, a) for d in (1, 2, 3) for a in "PQR"], "display long, app_name string")
    app = lambda names: spark.createDataFrame([(n,) for n in names], "app_name string")
    rules = spark.createDataFrame([(1, "P", True), (2, "R", False), (2, "P", True), (2, "P", False)], "display long, app_name string, blocked boolean")
    kept = lambda blocked, allowed: {(r["display"], r["app_name"]) for r in lookups.allowed_on_displays(s, app(blocked), app(allowed), rules).collect()}
    # display 1 blocks P and names nothing, so else the rules for all hold; 2 captures R alone; 3 has no rules
    assert kept("R", "") == {(1, "Q"), (2, "R"), (3, "P"), (3, "Q")}
    assert kept("", "P") == {(2, "R"), (3, "P")}


def put(folder, name, n, mtime=None):
    with open(f"{folder}/{name}", "wb") as f:
        f.write(b"x" * n)


def test_growing_files_wait_and_restarts_go_on(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    os.mkdir(folder)

    def run():
        q = jobs.append_to(jobs.segment_stream(spark, folder), out, checkpoint)
        assert q.awaitTermination(120) and q.exception() is None
        return sorted((os.path.basename(r["path"]), r["length"]) for r in spark.read.parquet(out).collect()) if os.path.exists(out) else []

    for name, n in (("a.mp4", 10), ("b.MOV", 20), ("empty.mkv", 0), ("note.txt", 9)):
        put(folder, name, n)
    reader = segments.SegmentStreamReader(folder, segments.EXTENSIONS)
    rows, first = reader.read(reader.initialOffset())
    assert list(rows) == [] and set(map(os.path.basename, first["waiting"])) == {"a.mp4", "b.MOV", "empty.mkv"}
    put(folder, "b.MOV", 25)
    rows, second = reader.read(first)
    assert [os.path.basename(r[0]) for r in rows] == ["a.mp4"] and list(reader.read(second)[0])[0][1] == 25
    assert [os.path.basename(r[0]) for r in reader.readBetweenOffsets(first, second)] == ["a.mp4"]
    seen = run() or run()
    put(folder, "c.webm", 7)
    for _ in range(3):
        seen = run()
    assert seen == [("a.mp4", 10), ("b.MOV", 25), ("c.webm", 7)]


def test_segments_as_a_table(spark, tmp_path):
    segments.register(spark)
    put(tmp_path, "a.mp4", 3)
    put(tmp_path, "b.bin", 4)
    read = lambda path, **o: sorted((os.path.basename(r["path"]), r["length"]) for r in spark.read.format("segments").options(path=str(path), **o).load().collect())
    assert read(tmp_path) == [("a.mp4", 3)] and read(tmp_path, extensions="BIN") == [("b.bin", 4)] and read(tmp_path / "none") == []
