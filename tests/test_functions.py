"""Expressions on fixed values."""

import pytest
from pyspark.sql import functions as F

from frameloom.functions import geometry as G
from frameloom.functions import images
from frameloom.functions import text as T
from frameloom.operators import detection, parsers, privacy


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("__z")).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, value", [("hello", "hello", 1), ("hello", "hallo", 0.8), ("hello", "", 0), ("", "world", 0), ("hello", "world", 0.2)])
def test_similarity(spark, a, b, value):
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(value)


def box(prefix, *v):
    return {f"{prefix}{k}": float(x) for k, x in zip("xywh", v)}


@pytest.mark.parametrize("b, iou, meets", [((50, 50, 100, 100), 2500 / 17500, True), ((200, 200, 100, 100), 0, False), ((0, 0, 100, 100), 1, True), ((100, 0, 10, 10), 0, True)])
def test_boxes(spark, b, iou, meets):
    v = box("a_", 0, 0, 100, 100) | box("b_", *b)
    assert one(spark, G.iou(G.box("a_"), G.box("b_")), **v) == pytest.approx(iou)
    assert one(spark, G.intersects(G.box("a_"), G.box("b_")), **v) is meets


@pytest.mark.parametrize("segment, number", [("segment_monitor1_123456", 1), ("segment_monitor2_789012", 2), ("segment_123456", 0), ("invalid_format", 0), ("monitorX_1", 0)])
def test_monitor(spark, segment, number):
    assert one(spark, T.monitor(F.col("s")), s=segment) == number


def test_images(spark):
    flat, half = [7] * 64, [0] * 32 + [255] * 32
    v = spark.createDataFrame([(flat, half)], "a array<int>, b array<int>")
    r = v.select(images.average_hash(F.col("a")).alias("ha"), images.entropy(F.col("b")).alias("e"), images.ssim(F.col("b"), F.col("b")).alias("s"), images.hamming(F.lit(0b11110000), F.lit(0b00001111)).alias("h"), F.bit_count(images.average_hash(F.col("b"))).alias("n")).first()
    assert (r["ha"], r["e"], r["h"], r["n"]) == (0, 1.0, 8, 32)
    assert r["s"] == pytest.approx(1)


@pytest.mark.parametrize("text, value", [("2h 30m", 150), ("2.5h", 150), ("30m", 30), ("2:30", 150), ("none", None)])
def test_minutes(spark, text, value):
    assert one(spark, T.minutes(F.col("t")), t=text) == value


@pytest.mark.parametrize("text, value", [("40%", 40), ("3/4", 75), ("x", None), ("1/0", None)])
def test_percent(spark, text, value):
    assert one(spark, T.percent(F.col("t")), t=text) == value


def test_amount(spark):
    assert tuple(one(spark, T.amount(F.col("t")), t="$1,250.50")) == (1250.5, "USD")
    assert one(spark, T.amount(F.col("t")), t="1250") is None


@pytest.mark.parametrize("text, confidence, kind, level", [
    ("Fatal error: System crash detected", 0.9, "system_error", "critical"), ("Connection failed: Unable to reach server", 0.85, "network_error", "high"), ("DNS error: Host not found", 0.8, "network_error", "high"),
    ("Access denied: Insufficient privileges", 0.88, "auth_error", "high"), ("Required field: This field cannot be empty", 0.82, "validation_error", "medium"), ("Segmentation fault in process 1234", 0.95, "system_error", "critical"),
    ("Login failed: Incorrect password", 0.9, "auth_error", "high"), ("Invalid input format: Please enter a valid email", 0.75, "validation_error", "medium"), ("Warning: Disk space is running low", 0.78, "warning", "medium"),
    ("Are you sure you want to delete this file?", 0.9, "confirmation_dialog", "info"), ("Yes    No    Cancel", 0.9, "confirmation_dialog", "info"), ("Save file as: document.txt", 0.9, "file_dialog", "info"), ("Choose file to open", 0.9, "file_dialog", "info"),
    ("Settings and Preferences", 0.9, "settings_dialog", "info"), ("Loading... 45% completed", 0.9, "progress_dialog", "info"), ("Information: Task completed successfully", 0.9, "info_dialog", "info"),
])
def test_error_and_dialog_rules(spark, text, confidence, kind, level):
    r = spark.createDataFrame([("s", 1, 0, text, confidence)], "stream string, frame long, idx long, text string, confidence double")
    found = detection.error_modal_events(r).first()
    assert (found["kind"], found["severity"]) == (kind, level)


def test_last_rule_wins_in_compat_mode(spark):
    r = spark.createDataFrame([("s", 1, 0, "Fatal error: System crash detected", 0.9), ("s", 1, 1, "DNS error: Host not found", 0.8)], "stream string, frame long, idx long, text string, confidence double")
    assert {x["kind"] for x in detection.error_modal_events(r, compat=True).collect()} == {"application_error", "confirmation_dialog"}


@pytest.mark.parametrize("text, kinds", [
    ("123-45-6789", {"ssn"}), ("000-00-0000", set()), ("666-12-3456", set()), ("4111111111111111", {"credit_card"}), ("1234567890123456", set()), ("192.168.1.1", {"ip_address"}), ("256.1.1.1", set()),
    ("555-1234", set()), ("call (555) 123-4567", {"phone"}), ("AB123456", {"passport", "drivers_license"}), ("see https://a.example/x?y=1", {"url"}), ("00:1A:2B:3C:4D:5E", {"mac_address"}), (None, set()), ("", set()),
])
def test_personal_data(spark, text, kinds):
    df = spark.createDataFrame([(text,)], "text string")
    assert {m["kind"] for m in privacy.matches(df).first()["matches"]} == kinds


@pytest.mark.parametrize("text, strategy, out", [
    ("Contact test@example.com for info", "remove", "Contact  for info"), ("mail john.doe@company.com now", "partial", "mail j******e@c***.com now"), ("pay 4111111111111111", "partial", "pay ************1111"),
    ("id AB123456 end", "placeholder", "id [PASSPORT] end"), ("ip 8.8.8.8", "asterisk", "ip *******"), ("é 8.8.8.8 and 1.1.1.1", "redact", "é [REDACTED] and [REDACTED]"),
])
def test_masks(spark, text, strategy, out):
    df = privacy.matches(spark.createDataFrame([(text,)], "text string"))
    assert privacy.mask_text(df, strategy).first()["masked"] == out


def test_decisions(spark):
    df = privacy.mask_text(privacy.matches(spark.createDataFrame([("a@b.co",), ("plain",)], "text string")))
    assert [tuple(r) for r in privacy.decide(df, prevent=True).select("stored", "content").collect()] == [(False, "[CONTENT BLOCKED - CONTAINS PII]"), (True, "plain")]
    assert privacy.decide(df, allowed=("email",), prevent=True).where("stored").count() == 2


@pytest.mark.parametrize("text, family, kind, attributes", [
    ("$ sudo git push origin main", "terminal", "command_line", ["command=git", "command_type=version_control", "is_sudo=true"]), ("drwxr-xr-x 5 u g 160 Jan 1 10:00 src", "terminal", "file_listing", ["permissions=drwxr-xr-x", "is_directory=true"]),
    ("permission denied: error", "terminal", "error_message", ["error_type=permission_error", "severity=error"]), ("user@host:~/src $", "terminal", "shell_prompt", ["username=user", "hostname=host", "current_directory=~/src", "shell_type=bash", "is_root=false"]),
    ("/srv/data/a.csv", "terminal", "file_path", ["path_type=absolute", "is_absolute=true", "file_extension=csv", "directory_depth=3"]), ("PROJ-123", "jira", "issue_key", ["project=PROJ", "issue_number=123"]),
    ("Sprint 4 (active)", "jira", "sprint", ["sprint_state=active"]), ("001A0000012abcdEFG", "salesforce", "record_id", ["object_type=Account"]), ("$1,250.50", "salesforce", "currency", ["amount=1250.50", "currency=USD"]), ("Negotiation", "salesforce", "pipeline_stage", ["stage_probability=90", "stage_category=late_stage"]),
    ("Unqualified", "salesforce", "lead_status", ["status_category=qualified"]), ("#general", "slack", "channel", ["channel_type=general", "is_private=false"]), ("@here", "slack", "mention", ["mention_type=channel_mention", "username=here"]), ("3 replies", "slack", "thread", ["thread_count=3"]),
    ("Home > Shop > Cart", "web", "breadcrumb", ["level=3"]), ("Password *", "web", "form_field", ["field_type=password", "required=true"]), ("Select a dropdown", "web", "interactive_element", ["element_type=dropdown", "element_state="]),
    ("Overdue by 3 days", "common", "deadline", ["deadline_urgency=overdue", "is_overdue=true"]), ("- [ ] buy milk", "notion", "block", ["block_type=bulleted_list"]), ("Fix the login bug", "common", "task", ["task_type=bug"]),
])
def test_parsers(spark, text, family, kind, attributes):
    r = spark.createDataFrame([("s", 1, 0, text, 0.9, 250.0)], "stream string, frame long, idx long, text string, confidence double, y double")
    found = {e["semantic_type"]: list(e["attributes"]) for e in parsers.elements(r, families=(family,)).collect()}
    assert found[kind] == attributes


def test_rules_follow_the_application(spark):
    rows = [("s", 1, k, "Overdue: PROJ-1 is done", 0.9, 0.0, app) for k, app in enumerate(("Jira", "Slack", "Safari", "iTerm", "Finder"))]
    r = spark.createDataFrame(rows, "stream string, frame long, idx long, text string, confidence double, y double, app string")
    got = {(e["idx"], e["family"]) for e in parsers.elements(r, "app").collect()}
    assert got >= {(0, "jira"), (0, "common"), (1, "common"), (3, "terminal")} and not got & {(1, "jira"), (2, "common"), (2, "jira"), (4, "common")}


def test_commands(spark):
    r = spark.createDataFrame([("s", 1, k, t, 0.9) for k, t in enumerate(["$ sudo git push origin main", "git pull", "ls -la"])], "stream string, frame long, idx long, text string, confidence double").withColumn("y", F.lit(0.0))
    c = parsers.commands(r)
    assert [tuple(x) for x in c.orderBy("idx").select("command", "kind", "sudo", "arguments").collect()] == [("git", "version_control", True, ["push", "origin", "main"]), ("git", "version_control", False, ["pull"]), ("ls", "file_listing", False, ["-la"])]
    assert {(p["pattern"], p["idx"]) for p in parsers.workflow_patterns(c).collect()} == {("git_workflow", 1)}


def test_preview_and_context(spark):
    from frameloom.operators import assemblies

    rows = privacy.matches(spark.createDataFrame([("mail john.doe@company.com or 8.8.8.8 now",), ("nothing",)], "text string"))
    assert [(r["kind"], r["match"], r["masked"]) for r in privacy.preview(rows).collect()] == [("email", "john.doe@company.com", "j******e@c***.com"), ("ip_address", "8.8.8.8", "8*****8")]
    assert [r[0] for r in rows.select(privacy.holds_any(rows)).collect()] == [True, False]
    assert [r[0] for r in rows.select(privacy.holds_any(rows, ("url",))).collect()] == [False, False]
    assert one(spark, assemblies.context_of(F.col("t"), F.lit(25), F.lit(28)), t="x" * 25 + "abc" + "y" * 40) == "x" * 20 + "abc" + "y" * 20


def test_stacked_images_are_the_columns(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.integers(0, 256, (6, 64))
    rows = spark.createDataFrame([(k, [int(v) for v in p], [int(v) for v in x[k - 1]]) for k, p in enumerate(x)], "k int, p array<int>, q array<int>")
    got = rows.orderBy("k").select(images.average_hash(F.col("p")).alias("hash"), images.entropy(F.col("p")).alias("entropy"), images.ssim(F.col("p"), F.col("q")).alias("ssim")).collect()
    assert [np.uint64(g["hash"] & 0xFFFFFFFFFFFFFFFF) for g in got] == images.stacked_hash(x.astype(float)).tolist()
    assert np.allclose([g["entropy"] for g in got], images.stacked_entropy(x)) and np.allclose([g["ssim"] for g in got], images.stacked_ssim(x.astype(float), x[[-1, 0, 1, 2, 3, 4]].astype(float)))
    large = np.kron(x[0].reshape(8, 8), np.ones((8, 8))).reshape(1, -1)
    assert images.stacked_hash(large)[0] == images.stacked_hash(x[:1].astype(float))[0]


def test_edit_distances_of_long_texts_take_no_cell_by_cell(spark):
    import random
    import time

    rng = random.Random(5)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            was, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
        return row[-1]

    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for k in range(300):
        letters = ("ab", "aé漢😀 ")[k % 2]
        a, b = make(rng.randrange(60), letters), make(rng.randrange(60), letters)
        assert T.edit_distance(a, b) == plain(a, b)
    a, b = make(40_000, "abcd"), make(40_000, "abcd")
    start = time.time()
    assert 0 < one(spark, T.similarity(F.col("a"), F.col("b")), a=a, b=b) < 1
    assert time.time() - start < 15  # cell by cell: 1.6e9 cells, over 30 s
