"""The engine's relations over the tables at hand: who did what when, what stood on screen where, and longer spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"click": "click", "view": "navigation", "error": "error_display", "purchase": "form_submission", "signup": "data_entry"}
APPS = ("Safari", "Xcode", "Slack", "Mail")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, stream (the user), ts, us (epoch microseconds), type, target, confidence, app_name, metadata."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return e.select(
        "event_id", F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.coalesce(kind[F.col("event_type")], F.lit("field_change")).alias("type"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("target"),
        (0.5 + (F.col("event_id") % 50) / 100.0).alias("confidence"), F.element_at(F.array(*map(F.lit, APPS)), (F.col("user_id") % 4 + 1).cast("int")).alias("app_name"),
        F.col("props").alias("metadata"),
    )


EVENTS_SQL = """ev AS (SELECT event_id, user_id AS stream, ts, epoch_us(ts) AS us,
 CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'navigation' WHEN 'error' THEN 'error_display' WHEN 'purchase' THEN 'form_submission' WHEN 'signup' THEN 'data_entry' ELSE 'field_change' END AS type,
 'user_' || user_id AS target, 0.5 + (event_id % 50)::DOUBLE / 100 AS confidence, ['Safari', 'Xcode', 'Slack', 'Mail'][(user_id % 4 + 1)::INT] AS app_name, props AS metadata FROM events)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text regions, a line of a document each: stream (source), frame (doc_id), idx, text, language, confidence, processor, box."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    i = F.col("idx").cast("long")
    return lines.select(
        F.col("source").alias("stream"), F.col("doc_id").alias("frame"), i.alias("idx"), "text", F.col("lang").alias("language"), (0.5 + ((i + F.col("doc_id")) % 50) / 100.0).alias("confidence"),
        F.when(F.col("doc_id") % 2 == 0, "vision").otherwise("tesseract").alias("processor"),
        (i % 100 * 10).cast("double").alias("x"), (i % 50 * 20).cast("double").alias("y"), (100 + i % 200).cast("double").alias("w"), (20 + i % 30).cast("double").alias("h"),
    )


REGIONS_SQL = r"""ln AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
rg AS (SELECT source AS stream, doc_id AS frame, idx, text, lang AS language, 0.5 + ((idx + doc_id) % 50)::DOUBLE / 100 AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'vision' ELSE 'tesseract' END AS processor,
 (idx % 100 * 10)::DOUBLE AS x, (idx % 50 * 20)::DOUBLE AS y, (100 + idx % 200)::DOUBLE AS w, (20 + idx % 30)::DOUBLE AS h FROM ln)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """span_id, stream (the customer), kind, t_start, t_end (epoch seconds), title, tags: an order until its last shipment."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shipped = l.groupBy("l_orderkey").agg(F.max(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("last"))
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    joined = o.join(shipped, o["o_orderkey"] == shipped["l_orderkey"], "left")
    return joined.select(
        F.col("o_orderkey").alias("span_id"), F.col("o_custkey").alias("stream"), F.col("o_orderstatus").alias("kind"), start.alias("t_start"),
        F.greatest(start, F.coalesce("last", start)).alias("t_end"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.array("o_orderpriority", "o_orderstatus").alias("tags"),
    )


SPANS_SQL = """sp AS (SELECT o_orderkey AS span_id, o_custkey AS stream, o_orderstatus AS kind, epoch(o_orderdate)::BIGINT AS t_start,
 greatest(epoch(o_orderdate)::BIGINT, coalesce(last, epoch(o_orderdate)::BIGINT)) AS t_end, 'order ' || o_orderkey AS title, [o_orderpriority, o_orderstatus] AS tags
 FROM orders LEFT JOIN (SELECT l_orderkey, max(epoch(l_shipdate)::BIGINT) AS last FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, stream (the label), pixels: 64 grey values of 8 by 8, from the embeddings' components."""
    e = table(spark, sf_dir, "embeddings")
    grey = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 128).cast("int"))))
    return e.select(F.col("vec_id").alias("frame"), F.col("label").alias("stream"), grey.alias("pixels"))


FRAMES_SQL = """fr AS (SELECT vec_id AS frame, label AS stream, list_transform(embedding, lambda v: greatest(0, least(255, floor((v::DOUBLE + 1) * 128)::INT))) AS pixels FROM embeddings)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages visited in page order, by host: page_id, url, host, scheme, title."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^(https?)://", 1).alias("scheme"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


VISITS_SQL = """vs AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"""


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor samples: stream (the supplier), ms, seq, x, y, from line items in shipping order, a day being 20 ms."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("stream"), F.expr("unix_seconds(CAST(l_shipdate AS TIMESTAMP)) div 86400 * 20").alias("ms"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_quantity") * 20).alias("x"), (F.col("l_discount") * 1000).alias("y"))


CURSOR_SQL = """cu AS (SELECT l_suppkey AS stream, epoch(l_shipdate)::BIGINT // 86400 * 20 AS ms, l_orderkey * 10 + l_linenumber AS seq, l_quantity * 20 AS x, l_discount * 1000 AS y FROM lineitem)"""


SCREEN_APPS = ("Terminal", "Safari", "Jira", "Salesforce", "Word", "Slack", "Notion", "Asana", "Finder")


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """regions with app, the application that each frame shows."""
    return regions(spark, sf_dir).withColumn("app", F.element_at(F.array(*map(F.lit, SCREEN_APPS)), (F.col("frame") % len(SCREEN_APPS) + 1).cast("int")))


SCREENS_SQL = f"""{REGIONS_SQL}, sc AS (SELECT *, ['terminal', 'web', 'jira', 'salesforce', 'office', 'slack', 'notion', 'asana', 'base'][(frame % {len(SCREEN_APPS)} + 1)::INT] AS family FROM rg)"""

#: Lines of a terminal, dealt to orders by their keys.
LINES = (
    "$ git status", "$ git commit -m fix", "ls -la /srv/data", "drwxr-xr-x 2 root root 4096 Jan 5 10:00 logs", "$ sudo npm install --save left-pad", "cd ../build", "$ make all", "error: command not found", "warning: this option is deprecated",
    "user@host:~/src $", "cp a.txt b.txt", "mv b.txt /tmp/c.txt", "mkdir -p out/one", "docker ps -a", "ssh deploy@web1", "Last login: Mon Jan 5", "CPU: 12.5% used", "Memory: 512 MB", "grep -r todo .", "find . -name x.py", "logout", "12 root 0.0 %CPU init",
)


def terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of terminals: stream (the customer), frame (epoch seconds of the order), idx (its key), text, confidence, box."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    line = F.element_at(F.array(*map(F.lit, LINES)), ((F.floor(k / 3) + F.col("o_custkey")) % len(LINES) + 1).cast("int"))
    return o.select(
        F.col("o_custkey").alias("stream"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("frame"), k.alias("idx"), line.alias("text"), (0.5 + (k % 50) / 100.0).alias("confidence"),
        F.lit(0.0).alias("x"), (k % 40 * 20).cast("double").alias("y"), F.lit(400.0).alias("w"), F.lit(18.0).alias("h"),
    )


TERMINAL_SQL = f"""tm AS (SELECT o_custkey AS stream, epoch(o_orderdate)::BIGINT AS frame, o_orderkey AS idx, [{', '.join(f"'{x}'" for x in LINES)}][((o_orderkey // 3 + o_custkey) % {len(LINES)} + 1)::INT] AS text, 0.5 + (o_orderkey % 50)::DOUBLE / 100 AS confidence,
 0::DOUBLE AS x, (o_orderkey % 40 * 20)::DOUBLE AS y, 400::DOUBLE AS w, 18::DOUBLE AS h FROM orders)"""


def read_sql(relation: str, family: str = "'base'") -> str:
    """What parser rules read of a relation, as SQL: t, low, cmd, family."""
    return f"""re AS (SELECT *, CASE WHEN said[1] = 'sudo' THEN coalesce(said[2], '') ELSE coalesce(said[1], '') END AS cmd FROM
 (SELECT *, lower(t) AS low, list_filter(string_split(regexp_replace(t, '^[$%#] ', ''), ' '), lambda w: w <> '') AS said FROM (SELECT * EXCLUDE (text{", family" if family != "'base'" else ""}), trim(text) AS t, {family} AS family FROM {relation}) WHERE t <> ''))"""
