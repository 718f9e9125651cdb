"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in spark.checkpoint.dir. Where that isn't set, a folder in the
    session's warehouse, or a temporary one if driver and executors are one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        return _own_dir()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/frameloom-steps"


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="frameloom-")


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 4 << 20):
    """While it lasts, rows go to Python in batches of at most so many bytes: a task holds several at once, and texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def steps_dir(spark: SparkSession) -> str:
    """This application's folder of written steps, in the folder that all executors share."""
    return f"{shared_dir(spark)}/steps-{spark.sparkContext.applicationId}"


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back, so that what follows doesn't depend on lost executors; and its path."""
    spark = df.sparkSession
    path = f"{steps_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """As stored_at(), for a step that the result may still read."""
    return stored_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a step that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_steps(spark: SparkSession) -> None:
    """Delete all steps that this application has written: to be called once the results that read them are written."""
    discard(spark, steps_dir(spark))


def held_out(column: str = "doc_id") -> F.Column:
    """Whether a row is kept out of every fit: crc32 of the id as text, mod 5, is 0. A null id is never learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))


def at_most_per_label(rows: DataFrame, most: int, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """About `most` rows of each label, drawn by hash of the id; all of a label that has no more."""
    counts = rows.groupBy(F.col(label_col).alias("__label")).agg(F.count("*").alias("__n"))
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 53)) / F.lit(float(1 << 53))
    joined = rows.join(counts, rows[label_col] == counts["__label"])
    return joined.where(draw * F.col("__n") < most).select(rows.columns)


def packed(df: DataFrame, column: str, without: tuple[str, ...] = ()) -> DataFrame:
    """row: df's columns, but those of `without`, as one struct, so that no name clashes with another; value: one of them."""
    return df.select(F.struct(*[df[c] for c in df.columns if c not in without]).alias("row"), df[column].alias("value"))


def freed() -> None:
    """Give memory that Arrow holds for later back, so that a worker between batches is no larger than what it keeps."""
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, text: str | int, most_bytes: int = 4 << 20):
    """Cut a batch into row ranges of about most_bytes of text each; a longer text gets a range of its own."""
    column = batch.column(text)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1] if len(column) else offsets[:0]
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, int(offsets[start]) + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield batch.slice(start, end - start)
        start = end


def distinct_words(texts: pa.Array, lower: bool = False):
    """The words of a text column: distinct words, each occurrence's index among them, and each text's bounds.

    Null texts have no words. The bounds are len(texts) + 1 offsets into the occurrences.
    """
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    values = lists.flatten()
    filled = pc.not_equal(values, "")
    bounds = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    if not pc.all(filled).as_py() and len(values):
        kept = np.concatenate([[0], np.cumsum(np.asarray(filled))])
        bounds, values = kept[bounds], values.filter(filled)
    coded = values.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), bounds


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values over each range of bounds; 0 over an empty one."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]
