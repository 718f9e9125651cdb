"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most_per_label, distinct_words, held_out, slices, sums

UNDETERMINED = "und"


def gram_buckets(words: pa.Array, orders: tuple[int, ...], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word set between spaces: all buckets, and each word's bounds among them."""
    lengths = np.asarray(pc.utf8_length(words), dtype=np.int64) + 2
    joined = "".join([f" {w} " for w in words.to_pylist()])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    left = np.repeat(starts[1:], lengths) - np.arange(len(points))  # characters from here to the word's end
    owner = np.repeat(np.arange(len(lengths)), lengths)
    owners, buckets = [], []
    rolled = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(orders) + 1):
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] if n <= len(points) else rolled[:0]
        if n in orders:
            there = np.flatnonzero(left[: len(rolled)] >= n)
            mixed = (rolled[there] + np.uint64(n)) * np.uint64(0xFF51AFD7ED558CCD)
            buckets.append(((mixed >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64))
            owners.append(owner[there])
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    bounds = np.searchsorted(owners[order], np.arange(len(lengths) + 1))
    return buckets[order], bounds


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", orders: tuple[int, ...] = (1, 2, 3, 4),
        n_buckets: int = 1 << 16, max_rows_per_label: int = 2000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Labels in order and the matrix (n_buckets, labels) of log-probabilities.

    Learns from whole texts with a label outside the held-out rows: about max_rows_per_label of each label, drawn by hash of
    the id, which bounds the fit at any size of the table. Counts are summed by Spark; the driver gets one number for
    each bucket and label. No labelled row: no labels.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sample = at_most_per_label(known, max_rows_per_label)

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, index, bounds = distinct_words(part.column(0), lower=True)
                buckets, of = gram_buckets(words, orders, n_buckets)
                labels = part.column(1).dictionary_encode()
                codes = np.asarray(labels.indices)
                for code, label in enumerate(labels.dictionary.to_pylist()):
                    rows = np.repeat(codes == code, np.diff(bounds))
                    times = np.bincount(index[rows], minlength=len(words)).astype(np.float64)
                    total = np.bincount(buckets, weights=np.repeat(times, np.diff(of)), minlength=n_buckets).astype(np.int64)
                    there = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["label", "bucket", "n"])

    counted = sample.select("text", "label").mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(counted["label"].unique())
    matrix = np.full((n_buckets, len(labels)), smoothing)
    for k, label in enumerate(labels):
        rows = counted[counted["label"] == label]
        matrix[rows["bucket"].to_numpy(), k] += rows["n"].to_numpy()
    return labels, np.log(matrix / matrix.sum(axis=0, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Language of every whole text: id, held_out, lang_pred, score (the winner's posterior, equal priors).

    A null text, one without a letter, and any text if nothing could be learnt, gives und with score 0. Ties go to the
    label that sorts first. Repeated rows and null ids (held out) give a row each; other columns are ignored.
    """
    labels, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def score(batches):
        table = shared.value
        names = np.array([*labels, UNDETERMINED], dtype=object)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1)
                lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
                best, sure = np.full(len(texts), len(labels)), np.zeros(len(texts))
                if labels and lettered.any():
                    words, index, bounds = distinct_words(texts, lower=True)
                    buckets, of = gram_buckets(words, orders, len(table))
                    of_word = np.add.reduceat(table[buckets], of[:-1], axis=0, dtype=np.float64)  # a word has a gram at least
                    totals = np.stack([sums(of_word[index, k], bounds) for k in range(len(labels))], axis=1)
                    best = np.where(lettered, totals.argmax(axis=1), best)
                    sure = np.where(lettered, 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(sure, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(score, "id long, lang_pred string, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
