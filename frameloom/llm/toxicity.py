"""Toxicity: maximum-scoring segments of token log-odds, aggregated by extreme-value calibration."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import at_most_per_label, distinct_words, freed, held_out, slices, stored
from .shingles import minima, shingle_hashes, word_hashes

#: Trimmed from both ends of a word before it is looked up.
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—·¡¿"
#: Letters of the stems that stand in for a longer word which was not learnt itself, in this order.
STEMS = (5, 4)


@dataclass
class Model:
    """weights: log-odds of the learnt tokens; drift: that of any other token, under 0; the rest calibrates."""

    weights: dict[str, float]
    drift: float
    log_k: float
    location: float
    scale: float


def features(words: pa.Array) -> list[list[str]]:
    """The token of each word, then for each of STEMS the stem token of each longer word ('' for others)."""
    tokens = pc.utf8_trim(pc.utf8_lower(words), EDGES).to_pylist()
    return [tokens, *([w[:n] + "~" if len(w) > n else "" for w in tokens] for n in STEMS)]


def weigh(words: pa.Array, model: Model) -> np.ndarray:
    """Log-odds of each word, above or below 0: its own, else its longest known stem's, else the drift."""
    known, out = model.weights, np.full(len(words), model.drift)
    for tokens in reversed(features(words)):
        found = [(k, known[t]) for k, t in enumerate(tokens) if t in known]
        if found:
            at, value = zip(*found)
            out[list(at)] = value
    return out


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence of token weights, in order.

    One scan over the runs of positive weights keeps a list of candidate segments; each new run is merged with the
    nearest earlier candidate from which the running total never fell below its start. Every candidate is visited once
    as it is merged away, so the scan is linear.
    """
    total = np.concatenate([[0.0], np.cumsum(weights)])
    positive = np.concatenate([[False], weights > 0, [False]])
    starts = np.flatnonzero(positive[1:] & ~positive[:-1])
    ends = np.flatnonzero(~positive[1:] & positive[:-1])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest earlier with a lower total before
    for start, end in zip(starts.tolist(), ends.tolist()):
        low, high = float(total[start]), float(total[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, high - low) for s, e, low, high, _ in found]


def excess(weights: np.ndarray, log_k: float) -> tuple[float, int]:
    """Sum over the significant segments of what their scores have over chance, -log(K n exp(-score)); else the best's.

    Weights are log-likelihood ratios, for which the extreme-value distribution of segment scores has rate 1.
    """
    found = segments(weights)
    if not found:
        return -log_k - math.log(max(len(weights), 1)), 0
    over = [score - log_k - math.log(len(weights)) for _, _, score in found]
    beyond = [x for x in over if x > 0]
    return (sum(beyond) if beyond else max(over)), len(beyond)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows_per_label: int = 10_000, least_docs: int = 3, least_z: float = 3.5, clean_z: float = 2.0, least_words: int = 5, prior: float = 50.0) -> Model:
    """Learn token log-odds with an informative Dirichlet prior, and the calibration, outside the held-out rows.

    Of each label about max_rows_per_label rows are used, drawn by hash of the id, whole texts; that bounds the fit. A
    token counts once a text. The prior is the tokens' own rate over both labels. A token's weight is its log-odds, drawn one
    standard error towards 0; the model keeps the tokens that tell of toxicity, with z scores above least_z and above what
    chance gives the number of tokens tested, and the words that tell against it, with z scores under -clean_z; the sample
    bounds both. A stem (the first letters of longer words) counts as a token, and is kept only if its evidence comes from
    least_words different words of toxic texts or more, none of them kept itself: an insult doesn't make other words that
    begin like it suspect, but an insult in many forms is learnt. Null labels and texts teach nothing; without rows of
    both labels nothing is learnt and every text scores low. A document with two labels teaches both.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & ~held_out("id"))
    marked = at_most_per_label(marked, max_rows_per_label)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # at most about 2 * max_rows_per_label ids, so they go to the texts
    sample = _without_near_copies(rows.join(F.broadcast(marked), "id").select("id", "text", "label"))

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, index, bounds = distinct_words(part.column(0))
                kinds = features(words)
                coded = pa.array([t for tokens in kinds for t in tokens], pa.string()).dictionary_encode()
                of_word = np.asarray(coded.indices, dtype=np.int64)
                toxic = np.asarray(part.column(1)) == 1
                text = np.repeat(np.arange(len(toxic)), np.diff(bounds))
                pairs = np.unique(np.concatenate([text * len(coded.dictionary) + of_word[k * len(words) :][index] for k in range(len(kinds))]))
                token, is_toxic = pairs % max(len(coded.dictionary), 1), toxic[pairs // max(len(coded.dictionary), 1)]
                n = [np.bincount(token, weights=w, minlength=len(coded.dictionary)).astype(np.int64) for w in (is_toxic, ~is_toxic)]
                yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, n)], ["token", "toxic", "clean"])

    counts = sample.mapInArrow(count, "token string, toxic long, clean long").where("token != ''").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, -1.0, 0.0, 1.0, 1.0)
    mass = prior * (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    odds = lambda y, n: F.log((y + mass) / (n + prior - y - mass))
    delta = odds(F.col("toxic"), n_toxic) - odds(F.col("clean"), n_clean)
    error = F.sqrt(1 / (F.col("toxic") + mass) + 1 / (F.col("clean") + mass))
    z = delta / error
    stem = F.col("token").endswith("~")
    counts = stored(counts, "toxicity-tokens")
    tested = counts.where(F.col("toxic") + F.col("clean") >= least_docs).select("token", (F.signum(delta) * (F.abs(delta) - error)).alias("weight"), z.alias("z"), (F.col("toxic") >= least_docs).alias("seen"))
    # of so many tokens without effect, the highest z score is about sqrt(2 ln n)
    bar = max(least_z, math.sqrt(2 * math.log(max(tested.where("seen").count(), 1))))
    kept = tested.where(((F.col("z") >= bar) & F.col("seen") & (F.col("weight") >= 1)) | ((F.col("z") <= -clean_z) & (F.col("weight") < 0) & ~stem))
    # a stem stands for words that it was learnt from, several and none of them learnt itself
    words = counts.where(~stem & (F.col("toxic") > 0)).join(kept.where("weight > 0").select("token"), "token", "left_anti")
    spread = words.select(F.explode(F.array(*[F.concat(F.substring("token", 1, n), F.lit("~")) for n in STEMS])).alias("stem"), "token").where(F.length("stem") <= F.length("token"))  # longer than the stem's letters
    spread = spread.groupBy("stem").agg(F.count("*").alias("words")).where(F.col("words") >= least_words)
    learnt = kept.where(~stem).unionByName(kept.where(stem).join(spread, F.col("token") == F.col("stem")).select(kept.columns))
    weights = {r["token"]: float(r["weight"]) for r in learnt.collect()}
    return _calibrated(sample, weights, n_toxic, n_clean)


def _without_near_copies(rows: DataFrame) -> DataFrame:
    """Of rows that agree in a label and one of three MinHash values of their word pairs, the one with the least id.

    Copies of one text would count as so many witnesses for each of its words.
    """

    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, index, bounds = distinct_words(part.column("text"))
                hashes, bounds = shingle_hashes(word_hashes(words)[index], bounds, 2)
                mins = [pa.array(minima(hashes, bounds, m, m >> 7).astype(np.int64)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
                yield pa.RecordBatch.from_arrays([*part.columns, *mins], ["id", "text", "label", "m1", "m2", "m3"])

    rows = stored(rows.mapInArrow(sketch, "id long, text string, label int, m1 long, m2 long, m3 long"), "toxicity-sample")
    kept = rows.select("id", "label", "m1", "m2", "m3")
    for m in ("m1", "m2", "m3"):
        kept = kept.withColumn("least", F.min("id").over(Window.partitionBy("label", m))).where("id = least").drop("least")
    # the sample is bounded, and so are its ids
    return rows.join(F.broadcast(kept.select("id", "label").distinct()), ["id", "label"]).select("text", "label")


def _calibrated(sample: DataFrame, weights: dict[str, float], n_toxic: int, n_clean: int) -> Model:
    """Set the drift and K from the learnt tokens' rate, and location and scale from the excess of the sample's texts."""
    draft = Model(weights, 0.0, 0.0, 0.0, 1.0)

    def rate(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, index, bounds = distinct_words(part.column(0))
                hit = (weigh(words, draft) > 0)[index]
                text = np.repeat(np.arange(len(part)), np.diff(bounds))
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.bincount(text, weights=hit, minlength=len(part)).astype(np.int64)), pa.array(n)], ["label", "hits", "n"])

    by = {r["label"]: r for r in sample.mapInArrow(rate, "label int, hits long, n long").groupBy("label").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()}
    share = [(by[k]["hits"] + 0.5) / (by[k]["n"] + 1) if k in by else 0.5 for k in (0, 1)]
    drift = min(-1e-3, math.log((1 - share[1]) / (1 - share[0])))
    log_k = math.log(max(-drift, 1e-6))
    model = Model(weights, drift, log_k, 0.0, 1.0)

    def over(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [x for x, _ in _excesses(part.column(0), model)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.round(found, 1))], ["label", "excess"])

    # a histogram in tenths: its size depends on the range of scores, not on the number of texts
    seen = sample.mapInArrow(over, "label int, excess double").groupBy("label", "excess").count().toPandas()
    at = np.unique(seen["excess"].to_numpy())
    n = {k: np.bincount(np.searchsorted(at, of["excess"]), weights=of["count"], minlength=len(at)) for k in (0, 1) for of in [seen[seen["label"] == k]]}
    right = np.concatenate([[0], np.cumsum(n[0])]) + n[1].sum() - np.concatenate([[0], np.cumsum(n[1])])  # texts right if the cut is below at[i]
    best = np.flatnonzero(right == right.max())
    edges = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    cut = float(edges[best[len(best) // 2]])
    mean = float((at * n[0]).sum() / max(n[0].sum(), 1))
    spread = math.sqrt(float(((at - mean) ** 2 * n[0]).sum() / max(n[0].sum(), 1)))
    scale = max(0.5, spread * math.sqrt(6) / math.pi)
    # the Gumbel distribution function is one half at the cut that parts the sample best
    return Model(weights, drift, log_k, cut + scale * math.log(math.log(2)), scale)


def _excesses(texts: pa.Array, model: Model) -> list[tuple[float, int]]:
    words, index, bounds = distinct_words(texts)
    of_word = weigh(words, model)
    weights = of_word[index]
    hits = np.concatenate([[0], np.cumsum(weights > 0)])
    some = hits[bounds[1:]] > hits[bounds[:-1]]
    out = []
    for k in range(len(texts)):
        part = weights[bounds[k] : bounds[k + 1]]
        out.append(excess(part, model.log_k) if some[k] else (-model.log_k - math.log(max(len(part), 1)), 0))
    return out


def _chances(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[int]]:
    """Score and number of significant passages of each text: the Gumbel distribution function at its excess."""
    found = _excesses(texts, model)
    x = np.array([f[0] for f in found])
    return np.exp(-np.exp(np.clip(-(x - model.location) / model.scale, -700, 700))), [f[1] for f in found]


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns of docs. Null and empty texts stay, as repeated rows
    and null ids do."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    column = names.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                value, _ = _chances(part.column(column), shared.value)
                yield part.filter(pa.array(value < 0.5))
            freed()

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text: id, held_out, score in 0 to 1, predicted (1 if score >= 0.5), n_passages.

    The scan runs over the log-odds of every occurrence of a token, though in the fit a token counts once a text.
    Empty and null texts have no passage and score as a clean text of one word does. Repeated rows and null ids give a row
    each; other columns are ignored. The model's size is bounded by the sample of fit(), so it goes out with the code.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value, passages = _chances(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array(passages, pa.int32())], ["id", "score", "n_passages"])
            freed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "id long, score double, n_passages int")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
