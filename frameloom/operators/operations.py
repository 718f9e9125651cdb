"""Operations data: retention, health, recovery, storage, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Days that data of a kind stays, -1 for ever.
RETENTION = {"raw_video": 30, "frame_metadata": 90, "ocr_data": 90, "event_data": 365, "spans": -1, "summaries": -1}
DAY = 86_400
#: Limits of what is healthy, and the levels that are critical.
HEALTH = (("cpu", 80.0, 90.0), ("mem_pct", 85.0, 95.0), ("disk_pct", 90.0, 95.0), ("errors", 10.0, 1e9))
LEAST_FREE = 1 << 30
#: Free bytes under which storage is critical, or gives a warning, or calls for less; bytes worth reclaiming.
FREE_CRITICAL, FREE_WARNING, FREE_LOW, WORTH_RECLAIMING = 500_000_000, 2_000_000_000, 1_000_000_000, 100_000_000
#: What to do after a failure, by its reason; any other calls for a full restart.
RECOVERY = {"display_disconnected": "graceful_degradation", "system_resource_exhaustion": "quality_reduction", "permission_denied": "temporary_pause"}


def retention_plan(files: DataFrame, as_of: int, policies: dict[str, int] = RETENTION) -> DataFrame:
    """Files (data_type, mtime in s, length) older than their kind's days and a day's margin. A plan; nothing is deleted."""
    days = F.create_map(*[F.lit(x) for p in policies.items() for x in p])[F.col("data_type")]
    return files.withColumn("days", days).where((F.col("days") > 0) & (F.col("mtime") < as_of - (F.col("days") + 1) * DAY))


def retention_estimate(files: DataFrame, as_of: int, policies: dict[str, int] = RETENTION) -> DataFrame:
    return retention_plan(files, as_of, policies).groupBy("data_type").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def storage_health(files: DataFrame, as_of: int, policies: dict[str, int] = RETENTION) -> DataFrame:
    """Per volume (columns volume, free: its free bytes): bytes in use, in all and by kind, status, and recommendations.

    Free space alone decides the status. Recommended is to keep less, where little is free, and to clean up each kind of
    which more than a little has outlived its days; kinds in the order of their names.
    """
    days = F.create_map(*[F.lit(x) for p in policies.items() for x in p])[F.col("data_type")]
    old = F.when((days > 0) & (F.col("mtime") < as_of - (days + 1) * DAY), F.col("length")).otherwise(0)
    kinds = files.groupBy("volume", "data_type").agg(F.sum("length").alias("bytes"), F.sum(old).alias("reclaimable"), F.min("free").alias("free"))
    g = kinds.groupBy("volume").agg(F.sum("bytes").alias("bytes"), F.min("free").alias("free"), F.sort_array(F.collect_list(F.struct("data_type", "bytes", "reclaimable"))).alias("kinds"))
    status = F.when(F.col("free") < FREE_CRITICAL, "critical").when(F.col("free") < FREE_WARNING, "warning").otherwise("healthy")
    low = F.when(F.col("free") < FREE_LOW, F.array(F.lit("Low disk space available. Consider reducing retention periods."))).otherwise(F.array().cast("array<string>"))
    clean = F.transform(F.filter("kinds", lambda k: k["reclaimable"] > WORTH_RECLAIMING), lambda k: F.concat(F.lit("Can reclaim "), text.size_text(k["reclaimable"]), F.lit(" by cleaning up "), k["data_type"]))
    return g.select("volume", "bytes", "free", F.transform("kinds", lambda k: F.struct(k["data_type"].alias("data_type"), k["bytes"].alias("bytes"))).alias("kinds"), status.alias("status"), F.concat(low, clean).alias("recommendations"))


def health_alerts(metrics: DataFrame) -> DataFrame:
    """An alert for each limit that a sample is over; the sample's status: 2 (critical) if too few bytes are free and no
    errors came after that test, else 1 (degraded). A single alert over its second limit is critical, the sample isn't."""
    tests = [F.when(F.col(c) > limit, F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.when(F.col(c) > worst, 2).otherwise(1).alias("level"))) for c, limit, worst in HEALTH]
    free = F.col("free") if "free" in metrics.columns else F.lit(None).cast("long")
    little = F.coalesce(free < LEAST_FREE, F.lit(False))
    full = F.when(little, F.struct(F.lit("free").alias("metric"), free.cast("double").alias("value"), F.lit(2).alias("level")))
    m = metrics.select("stream", "us", F.filter(F.array(*tests[:3], full, *tests[3:]), lambda a: a.isNotNull()).alias("alerts"), little.alias("__full"), tests[3].isNotNull().alias("__errors"))
    # tests run in order and the last one that strikes sets the status: errors make a critical sample a degraded one
    status = F.when(F.col("__full") & ~F.col("__errors"), 2).otherwise(1)
    return m.select("stream", "us", status.alias("status"), F.explode("alerts").alias("a")).select("stream", "us", "status", "a.*")


def recovery_strategy(reason: Column, failed_displays: Column) -> Column:
    """What to do after a failure. Of several monitors, one that failed is left out; if more did, one alone goes on."""
    several = F.when(failed_displays == 1, "graceful_degradation").otherwise("single_monitor_fallback")
    named = F.create_map(*[F.lit(x) for p in RECOVERY.items() for x in p])[reason]
    return F.when(reason == "multi_monitor_failure", several).otherwise(F.coalesce(named, F.lit("full_restart")))


def recovery_statistics(attempts: DataFrame) -> DataFrame:
    """Attempts, success rate and mean time by reason."""
    return attempts.groupBy("reason").agg(F.count("*").alias("attempts"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"), F.round(F.avg("seconds"), 6).alias("avg_seconds"))


def violations(rows: DataFrame, key: str, rules: tuple[tuple[str, str, Column], ...]) -> DataFrame:
    """key, field, message for every rule (field, message, condition that must hold) that a row breaks; null breaks too."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, m, ok in rules]
    return rows.select(key, F.explode(F.filter(F.array(*broken), lambda b: b.isNotNull())).alias("b")).select(key, "b.*")


def rolling(samples: DataFrame, value: str, n: int = 100) -> DataFrame:
    """Mean over the last n samples of the stream."""
    w = Window.partitionBy("stream").orderBy("us", "event_id").rowsBetween(-(n - 1), 0)
    return samples.withColumn("rolling", F.avg(value).over(w))


def encoder_metrics(samples: DataFrame, took: str, target_bitrate: int = 2_000_000, frame_rate: int = 30, n: int = 100) -> DataFrame:
    """Per frame encoded: mean time of the last n frames, and the bitrate that the time they took and all frames so far give
    for frames of the target's size; 0 while no time has passed."""
    w = Window.partitionBy("stream").orderBy("us", "event_id")
    last = w.rowsBetween(-(n - 1), 0)
    size = target_bitrate // (8 * frame_rate)
    total = F.sum(took).over(last)
    rate = F.when(total > 0, F.floor(size * F.row_number().over(w) * 8 / total)).otherwise(0)
    return samples.withColumns({"rolling": F.avg(took).over(last), "bitrate": rate.cast("long")})


def engine_metrics(runs: DataFrame, by: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Recognition runs (engine, ok, seconds, fallback): success rate and mean seconds of each engine, 0 without a run of it,
    the share of runs that stood in for another, and their number."""
    of = lambda name, value: F.coalesce(F.round(F.avg(F.when(F.col("engine") == name, value)), 6), F.lit(0.0))
    ok = F.col("ok").cast("double")
    return runs.groupBy(*by).agg(
        of("vision", ok).alias("vision_success_rate"), of("tesseract", ok).alias("tesseract_success_rate"), of("vision", F.col("seconds")).alias("average_vision_time"), of("tesseract", F.col("seconds")).alias("average_tesseract_time"),
        F.round(F.avg(F.col("fallback").cast("double")), 6).alias("fallback_rate"), F.count("*").alias("total_processed"))


def segments(samples: DataFrame, seconds: int = 120) -> DataFrame:
    """Samples per segment of two minutes, with the path the segment is stored under."""
    start = F.window("ts", f"{seconds} seconds")["start"]
    g = samples.groupBy("stream", start.alias("start")).agg(F.count("*").alias("n"))
    return g.withColumn("path", F.concat(F.lit("segments/"), F.date_format("start", "yyyy-MM-dd"), F.lit("/"), F.date_format("start", "HH-mm-ss"), F.lit(".mp4")))


def latest_files(files: DataFrame, most: int = 5, shares: int = 64) -> DataFrame:
    """files with kept: whether a file is among the newest of its kind, by path where times are equal; the others may go.

    Files of a kind are dealt to shares by their paths. The newest time of each share is a file's, so a file older than the
    newest of `most` shares isn't kept; only the few others are sorted. Times at which that happens are one row a kind.
    """
    share = F.pmod(F.xxhash64("path"), F.lit(shares))
    newest = files.where("mtime is not null").groupBy("data_type", share.alias("share")).agg(F.max("mtime").alias("mtime"))
    bound = newest.groupBy(F.col("data_type").alias("__kind")).agg(F.get(F.sort_array(F.collect_list("mtime"), False), F.lit(most - 1)).alias("__bound"))
    f = files.join(F.broadcast(bound), F.col("data_type").eqNullSafe(F.col("__kind")), "left")
    old = F.col("__bound").isNotNull() & ~F.coalesce(F.col("mtime") >= F.col("__bound"), F.lit(False))
    # what may be kept is ranked within the shares first, then what is left of them
    w = lambda *by: F.row_number().over(Window.partitionBy("data_type", *by).orderBy(F.desc("mtime"), "path"))
    ranked = f.where(~old).withColumn("__share", share).withColumn("__first", w("__share"))
    out = [*files.columns]
    near = ranked.where(F.col("__first") <= most).withColumn("kept", w() <= most).select(*out, "kept")
    rest = ranked.where(F.col("__first") > most).unionByName(f.where(old), allowMissingColumns=True)
    return near.unionByName(rest.select(*out, F.lit(False).alias("kept")))


#: How far over its limit a load is unhealthy, free disk in MB, and log sizes and files.
OVER, FREE_MB, LOG_BYTES, LOG_FILES, LOG_READ = 2.0, 1000, 10 << 20, 5, 3


def recovery_gate(samples: DataFrame) -> DataFrame:
    """samples (cpu, cpu_limit, mem, mem_limit, free_mb) with healthy: whether a recovery may start now."""
    ok = (F.col("cpu") <= OVER * F.col("cpu_limit")) & (F.col("mem") <= OVER * F.col("mem_limit")) & (F.col("free_mb") >= FREE_MB)
    return samples.withColumn("healthy", F.coalesce(ok, F.lit(False)))


def log_files(files: DataFrame) -> DataFrame:
    """Log files newest first: which is to be rotated for its size, which stay, which are read at the start."""
    w = Window.partitionBy("data_type").orderBy(F.desc("mtime"), "path")
    f = files.withColumn("rank", F.row_number().over(w))
    return f.withColumns({"rotate": (F.col("rank") == 1) & (F.col("length") > LOG_BYTES), "kept": F.col("rank") <= LOG_FILES, "read": F.col("rank") <= LOG_READ})


def tips(items: DataFrame, context: str) -> DataFrame:
    """Help items of a context, the general ones last."""
    return items.where(F.col("context").isin(context, "general")).withColumn("own", F.col("context") == context)
