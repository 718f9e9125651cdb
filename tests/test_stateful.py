"""Streams with state and timers give what batches give, however files arrive and wherever a query is restarted."""

import datetime as dt
import random

import pytest

from frameloom.operators import contexts, joins, kernels
from frameloom.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
EVENTS = "stream long, event_id long, us long, ts timestamp, type string, target string, app_name string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def arrive(spark, rows, schema, path, seed, files=5):
    """rows shuffled over files, then one far later row of another stream, so that all others are settled."""
    rows = rows[:]
    random.Random(seed).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, make, schema, path, out, checkpoint):
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None


def drained(spark, make, rows, schema, far, tmp_path, seed=1):
    """Half of the rows, a restart, the rest, a restart, and the far row."""
    at = lambda name: f"{tmp_path}/{name}"
    half = len(rows) // 2
    for part in (rows[:half], rows[half:], [far]):
        arrive(spark, part, schema, at("in"), seed, 1 if part == [far] else 3)
        run(spark, make, schema, at("in"), at("out"), at("checkpoint"))
    return spark.read.parquet(at("out"))


def test_sessions_close_by_gap_limit_and_context(rocks, tmp_path):
    rng = random.Random(7)
    rows, t = [], {0: 0, 1: 0}
    for k in range(90):
        s = rng.choice([0, 0, 1])
        t[s] += rng.choice([2, 10, 60, 400])
        rows.append((s, k, t[s] * 1_000_000, T0 + dt.timedelta(seconds=t[s]), rng.choice(["click", "navigation", "data_entry"]), rng.choice(["a_b", "a_c", "d"]), rng.choice(["Safari", "Mail", None])))
    rng.shuffle(rows)
    make = lambda s: stateful.sessions(s, 300_000_000, 4, 0.5, "1 day")
    far = (9, 999, 10**12, T0 + dt.timedelta(days=30), "click", "x", None)
    got = sorted((r["stream"], r["start_us"], r["end_us"], tuple(r["event_ids"])) for r in drained(rocks, make, rows, EVENTS, far, tmp_path).collect() if r["stream"] != 9)
    batch = contexts.coherent(rocks.createDataFrame(rows, EVENTS), 300_000_000, 4, 0.5).collect()
    groups = {}
    for r in sorted(batch, key=lambda r: (r["us"], r["event_id"])):
        groups.setdefault((r["stream"], r["island"]), []).append(r)
    want = sorted((k[0], g[0]["us"], g[-1]["us"], tuple(r["event_id"] for r in g)) for k, g in groups.items())
    assert got == want and len(got) > 20


PATTERN = "stream string, frame long, idx long, ts timestamp, type string, target string, confidence double"


def test_patterns_from_late_frames(rocks, tmp_path):
    rng = random.Random(8)
    rows = [(s, f, i, T0 + dt.timedelta(seconds=f), rng.choice(["error_display", "modal_appearance"]), rng.choice("xy"), rng.choice([0.56, 0.62, 0.9])) for s in "ab" for f in range(12) for i in range(rng.randrange(3))]
    want = sorted(map(tuple, kernels.temporal_patterns(rocks.createDataFrame(rows, PATTERN)).collect()), key=str)
    rng.shuffle(rows)
    far = ("z", 99, 0, T0 + dt.timedelta(days=30), "e", "t", 0.9)
    got = drained(rocks, lambda s: stateful.patterns(s, late="1 day"), rows, PATTERN, far, tmp_path).where("stream <> 'z'").select(kernels.PATTERN_NAMES)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 10


REGION = "stream string, frame long, idx long, text string, confidence double, ts timestamp"


def test_frames_meet_the_one_before(rocks, tmp_path):
    rng = random.Random(9)
    rows = [(s, f, i, f"t{i}", rng.choice([0.6, 0.8]), T0 + dt.timedelta(seconds=f)) for s in "ab" for f in range(0, 20, 2) for i in range(rng.randrange(4))]
    numbered = joins.with_previous_frame(rocks.createDataFrame(rows, REGION)).collect()
    last = {s: max(r["seq"] for r in numbered if r["stream"] == s) for s in "ab"}
    want = sorted([(r["stream"], r["seq"], True, r["frame"], r["idx"]) for r in numbered] + [(r["stream"], r["seq"] + 1, False, r["frame"], r["idx"]) for r in numbered if r["seq"] < last[r["stream"]]])
    rng.shuffle(rows)
    far = ("z", 999, 0, "t", 0.9, T0 + dt.timedelta(days=30))
    got = drained(rocks, lambda s: stateful.frame_pairs(s, late="1 day"), rows, REGION, far, tmp_path).where("stream <> 'z'")
    assert sorted((r["stream"], r["seq"], r["now"], r["frame"], r["idx"]) for r in got.collect()) == want
