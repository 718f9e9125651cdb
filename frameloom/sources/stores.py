"""Readers and writers of the engine's stores."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

FRAMES = "ts_ns long, monitor_id int, segment_id string, path string, phash16 long, entropy float, app_name string, win_title string, width long, height long"
REGIONS = "frame_id string, roi struct<x:float,y:float,width:float,height:float>, text string, language string, confidence float, processed_at timestamp, processor string"
EVENTS = "event_id string, ts_ns long, type string, target string, value_from string, value_to string, confidence float, evidence_frames array<string>, metadata string"
SPANS = "span_id string, kind string, t_start long, t_end long, title string, summary_md string, tags array<string>, created_at long"
SEGMENT_NOTES = "id string, start_time double, end_time double, file_path string, display_ids array<string>, file_size long"
#: Rows of a file at most, by store, as the stores' flush sizes have it.
FILE_ROWS = {"frames": 10_000, "regions": 50_000, "events": 10_000}
#: Text columns of a store that are kept by dictionary.
DICTIONARY = {"regions": ("frame_id", "text", "language", "processor"), "events": ("type", "target")}
#: Bytes over which a segment is worth a note, and seconds that a file rests before it counts as whole.
NOTE_BYTES, SETTLE_S = 100_000, 2
LOG_LINE = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\] (\w+)\s+\[([^\]]*?)\s*\] (.*?)(?: \(([^():]+):(\d+)\))?$"


def write_store(df: DataFrame, path: str, store: str, by: str | None = None) -> None:
    """Append to a store as Snappy Parquet with files of bounded size, by a partition column if there is one."""
    w = df.write.mode("append").option("compression", "snappy").option("maxRecordsPerFile", FILE_ROWS.get(store, 50_000))
    if store in DICTIONARY:
        w = w.option("parquet.enable.dictionary", False)
        for column in DICTIONARY[store]:
            w = w.option(f"parquet.enable.dictionary#{column}", True)
    (w.partitionBy(by) if by else w).parquet(path)


def write_for_lookups(df: DataFrame, path: str, by: str, rows_per_file: int = 1_000_000, group_bytes: int = 16 << 20, distinct: int = 100_000) -> int:
    """Append rows laid out for point lookups by a column; the number of files.

    Rows are dealt out by ranges of the column and sorted by it, so a value lies in one file or two and there in few row
    groups, which their least and largest values tell; a Bloom filter of the column in each row group (for about `distinct`
    values) spares the groups whose range holds the value but that don't have it. A lookup reads what holds its value, how
    large the store may be.
    """
    files = max(1, -(-df.count() // rows_per_file))
    w = df.repartitionByRange(files, by).sortWithinPartitions(by).write.mode("append").option("compression", "snappy").option("maxRecordsPerFile", rows_per_file)
    w = w.option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{by}", True).option(f"parquet.bloom.filter.expected.ndv#{by}", distinct)
    w.parquet(path)
    return files


def read_store(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A store's rows; none if the folder is missing or has no file yet. Nanosecond times are read as longs."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_events(df: DataFrame, path: str) -> None:
    """Events with their metadata map as JSON text; an empty map as null."""
    write_store(df.withColumn("metadata", F.when(F.size("metadata") > 0, F.to_json("metadata"))), path, "events")


def metadata_map(column: Column) -> Column:
    """JSON text as a map; null or no JSON as the empty map."""
    return F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))


def tag_array(column: Column) -> Column:
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str = FRAMES) -> DataFrame:
    """Quoted fields may hold commas, quotes and line ends; numbers that can't be read are 0."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    zero = [F.coalesce(f.name, F.lit(0)).cast(f.dataType).alias(f.name) if _numeric(f.dataType) else F.col(f.name) for f in df.schema]
    return df.select(zero)


def _numeric(t: DataType) -> bool:
    return t.typeName() in ("integer", "long", "float", "double")


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files of a store: path, length and time of change, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.unix_seconds("modificationTime").alias("mtime"))


def encrypted(df: DataFrame, columns: tuple[str, ...], key: Column) -> DataFrame:
    """Columns as AES-GCM cipher text in base64."""
    return df.withColumns({c: F.base64(F.aes_encrypt(F.col(c).cast("string"), key, F.lit("GCM"))) for c in columns})


def decrypted(df: DataFrame, columns: tuple[str, ...], key: Column) -> DataFrame:
    return df.withColumns({c: F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string") for c in columns})


def encrypted_store(df: DataFrame, path: str, keys: dict[str, str], footer: str, columns: str) -> None:
    """Append to a store of Parquet files that are encrypted as a whole, footer and all columns, by Parquet's own encryption:
    the session's key client knows the master keys by name. keys: its settings; columns: "key:a,b;key:c"."""
    w = df.write.mode("append").option("parquet.encryption.footer.key", footer).option("parquet.encryption.column.keys", columns)
    for name, value in keys.items():
        w = w.option(name, value)
    w.parquet(path)


def settled(files: DataFrame, as_of_s: int, rest_s: int = SETTLE_S) -> DataFrame:
    """Files (length, mtime) that are whole: not empty, and not written to for that long."""
    return files.where((F.col("length") > 0) & (F.col("mtime") <= as_of_s - rest_s))


def write_notes(segments: DataFrame, path: str, least: int = NOTE_BYTES) -> None:
    """A note, as JSON, of each segment of more than `least` bytes."""
    segments.where(F.col("file_size") > least).write.mode("append").json(path)


def export_logs(logs: DataFrame, path: str, form: str) -> None:
    """Logs as json, csv or text lines."""
    w = (log_lines(logs) if form == "text" else logs).write.mode("overwrite")
    {"json": w.json, "csv": lambda p: w.option("header", True).option("escape", '"').csv(p), "text": w.text}[form](path)


def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines as ts, level, category, message, file, line; lines of another form are left out."""
    part = lambda k: F.regexp_extract(column, LOG_LINE, k)
    ts = F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss.SSS")
    return lines.where(F.col(column).rlike(LOG_LINE)).select(ts.alias("ts"), part(2).alias("level"), part(3).alias("category"), part(4).alias("message"), part(5).alias("file"), part(6).try_cast("int").alias("line"))


def log_lines(logs: DataFrame) -> DataFrame:
    """Log rows as text lines of the same form."""
    return logs.select(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("] "), F.rpad("level", 7, " "), F.lit(" ["), F.rpad("category", 15, " "), F.lit("] "), "message", F.lit(" ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")")).alias("value"))


def sampled_frames(frames: DataFrame, source_fps: float, wanted_fps: float) -> DataFrame:
    """Every n-th frame of a segment, with its time in it in ns by the source's rate."""
    n = max(1, round(source_fps / wanted_fps))
    return frames.where(F.col("frame_no") % n == 0).withColumn("ts_ns", (F.col("frame_no") * (1e9 / source_fps)).cast("long"))


def schema_version(migrations: DataFrame) -> int:
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def migrated(df: DataFrame, version: int, steps: dict[int, tuple], to: int | None = None) -> tuple[DataFrame, int]:
    """A span store's rows brought from a version to another (the last by default): steps has (up, down) functions of rows by
    the version that up leads to. Returns the rows and the version reached."""
    goal = max([version, *steps]) if to is None else to
    for v in range(version + 1, goal + 1):
        df = steps[v][0](df)
    for v in range(version, goal, -1):
        df = steps[v][1](df)
    return df, goal
