"""Validation of settings: a table of rules, each a condition that mustn't hold, over a row of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Group, level, message, and the SQL condition that breaks the rule; limits and patterns as settings have them.
RULES = (
    ("general", "error", "Invalid log level", "lower(log_level) NOT IN ('debug', 'info', 'warning', 'error')"),
    ("general", "warning", "Both menu bar icon and notifications are disabled", "NOT menu_icon AND NOT notifications"),
    ("recording", "error", "Invalid frame rate", "frame_rate NOT IN (15, 30, 60)"),
    ("recording", "error", "Invalid quality setting", "lower(quality) NOT IN ('low', 'medium', 'high')"),
    ("recording", "error", "Invalid segment duration", "segment_s NOT IN (60, 120, 300)"),
    ("recording", "warning", "No displays selected for recording", "displays = 0"),
    ("recording", "warning", "High resource usage configuration detected", "frame_rate = 60 AND quality = 'high' AND displays > 2"),
    ("privacy", "warning", "PII masking is disabled but specific masking options are enabled", "NOT masking AND mask_any"),
    ("privacy", "warning", "App filtering is enabled but no apps are allowed", "app_filter AND bundle = ''"),
    ("privacy", "error", "Invalid bundle ID format", "bundle <> '' AND NOT regexp_like(bundle, '^[a-zA-Z0-9-]+[.][a-zA-Z0-9-]+([.][a-zA-Z0-9-]+)*$')"),
    ("retention", "error", "Safety margin must be between 0 and 168 hours", "margin_h < 0 OR margin_h > 168"),
    ("retention", "error", "Cleanup interval must be between 1 and 168 hours", "interval_h < 1 OR interval_h > 168"),
    ("retention", "error", "Invalid retention days", "retention_days < -1 OR retention_days = 0"),
    ("retention", "warning", "Very short retention period", "retention_days > 0 AND retention_days < 7"),
    ("performance", "error", "CPU usage limit must be between 1% and 50%", "cpu < 1 OR cpu > 50"),
    ("performance", "error", "Memory usage limit must be between 100MB and 4GB", "memory < 100 OR memory > 4096"),
    ("performance", "error", "Disk I/O limit must be between 5MB/s and 100MB/s", "disk_io < 5 OR disk_io > 100"),
    ("performance", "warning", "High CPU usage limit may impact system performance", "cpu > 15"),
    ("performance", "warning", "Hardware acceleration is disabled", "NOT hardware"),
    ("hotkey", "error", "Invalid hotkey format", "NOT regexp_like(hotkey, '^[⌘⇧⌥⌃]+[A-Za-z0-9]$')"),
    ("plugin", "error", "Timeout must be between 0 and 60 seconds", "timeout <= 0 OR timeout > 60"),
    ("plugin", "warning", "Max table rows should be between 10 and 10,000", "max_rows < 10 OR max_rows > 10000"),
)


def problems(settings: DataFrame, key: str) -> DataFrame:
    """key, section, level, message of every rule that a row of settings breaks; a null breaks nothing."""
    found = [F.when(F.expr(broken), F.struct(F.lit(g).alias("section"), F.lit(level).alias("level"), F.lit(m).alias("message"))) for g, level, m, broken in RULES]
    return settings.select(key, F.explode(F.array(*found)).alias("p")).where("p is not null").select(key, "p.*")


def repeated_hotkeys(hotkeys: DataFrame, key: str) -> DataFrame:
    """Hot keys (columns action, hotkey) that a row's settings give to more than one action."""
    return hotkeys.groupBy(key, "hotkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("action")).alias("actions")).where("n > 1")
