"""Removal of repeated passages: FM-indexes over shards of what may repeat, searched for every window of it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, freed, slices, stored
from .fm_index import FmIndex
from .shingles import mixed, word_hashes

_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Plan:
    """window: words of a passage. Windows are dealt out by their least hash of `gram` words; consecutive windows with one
    such hash are a run, of `longest` windows at most. shard_words: words of an index, about. A hash under which more than
    `most` different runs meet is settled by digests of its windows instead: such runs would fill an index of their own.
    chunk: words of a text that are looked at at a time.
    """

    window: int = 50
    gram: int = 12
    longest: int = 64
    shard_words: int = 1 << 18
    most: int = 2048
    chunk: int = 1 << 18


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive words, from hashes of half as many."""
    whole, at, width, power = None, 0, 1, _BASE
    part = hashes
    while True:
        if size & width:
            if whole is None:
                whole = part
            else:
                n = max(0, min(len(whole), len(part) - at))
                whole = whole[:n] * np.uint64(power) + part[at : at + n]
            at += width
        if 2 * width > size:
            return mixed(whole)
        part = part[: max(0, len(part) - width)] * np.uint64(power) + part[width:]
        width, power = 2 * width, power * power % (1 << 64)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[:-have], values[have:]) if len(values) > have else values[:0], 2 * have
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest and len(values) > rest else values[: max(0, len(values) - rest)]


def runs(hashes: np.ndarray, bounds: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start word within it, number of windows, and common least hash of each run of the texts' windows."""
    n = np.maximum(np.diff(bounds) - plan.window + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    if not len(of):
        return of, of, of, np.zeros(0, dtype=np.uint64)
    start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    least = least_of(grams(hashes, plan.gram), plan.window - plan.gram + 1)[bounds[of] + start]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
    begins = np.flatnonzero((np.arange(len(of)) - first) % plan.longest == 0)
    return of[begins], start[begins], np.diff(np.append(begins, len(of))), least[begins]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ord (the id, null last), key (with ord, which text it is), text: of every row."""
    at = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return at.select("id", F.coalesce("id", F.lit(_LAST)).alias("ord"), F.xxhash64("text").alias("key"), "text")


def _shrunk(texts: DataFrame) -> DataFrame:
    """Texts on their way to a join, compressed one by one: size (bytes) and body in place of text."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw = [t.as_buffer() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([b.size for b in raw], pa.int64()), pa.array([press.compress(b) for b in raw], pa.binary())], ["id", "ord", "key", "size", "body"])
            freed()

    return texts.mapInArrow(run, "id long, ord long, key long, size long, body binary")


def _grown(batch: pa.RecordBatch, most_bytes: int = 1 << 20):
    """A batch with bodies as batches with texts, about most_bytes of them or one text each."""
    sizes, start = batch.column("size").to_numpy(), 0
    opened, at = zstandard.ZstdDecompressor(), batch.schema.get_field_index("body")
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), most_bytes, side="right")) + start)
        part = batch.slice(start, end - start)
        yield part.set_column(at, "text", pa.array([opened.decompress(b.as_buffer()) for b in part.column("body")], pa.binary()).cast(pa.large_binary()).cast(pa.large_string()))
        start = end


def _chunks(hashes: np.ndarray, bounds: np.ndarray, plan: Plan):
    """Ranges of whole texts of about chunk words, and overlapping pieces of longer texts: first text, offset, hashes, bounds."""
    k = 0
    while k < len(bounds) - 1:
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + plan.chunk, side="right")) - 1)
        if end == k + 1:
            for at in range(int(bounds[k]), max(int(bounds[end]) - plan.window + 1, int(bounds[k]) + 1), plan.chunk):
                piece = hashes[at : min(at + plan.chunk + plan.window - 1, int(bounds[end]))]
                yield k, at - int(bounds[k]), piece, np.array([0, len(piece)])
        else:
            yield k, 0, hashes[bounds[k] : bounds[end]], bounds[k : end + 1] - bounds[k]
        k = end


def _profiles(plan: Plan):
    """Each text's number of words, the digest of its words joined by a space, and its runs: least, digest, start, n."""
    kind = pa.list_(pa.struct([("m", pa.int64()), ("d", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                shas = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split())).digest() for t in part.column("text")]
                words, index, bounds = distinct_words(part.column("text"))
                hashes = word_hashes(words)[index]
                found = [[], [], [], [], []]
                for k, offset, piece, inner in _chunks(hashes, bounds, plan):
                    of, start, n, least = runs(piece, inner, plan)
                    raw, at = piece.tobytes(), inner[of] + start
                    digests = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(at.tolist(), (at + n + plan.window - 1).tolist())]
                    for values, more in zip(found, (of + k, start + offset, n, least, np.array(digests, dtype=np.uint64))):
                        values.append(more)
                of, start, n, least, digest = (np.concatenate(v) if v else np.zeros(0, dtype=np.uint64) for v in found)
                structs = pa.StructArray.from_arrays([pa.array(least.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["m", "d", "start", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)), structs).cast(kind)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(bounds), pa.int64()), pa.array(shas, pa.binary()), lists], ["id", "ord", "key", "n_words", "sha", "runs"])
            freed()

    return run


def _wanted_words(plan: Plan, windows: bool):
    """The words' hashes of the wanted runs of each text; or, for windows, two digests of each of their windows."""

    def run(batches):
        for batch in batches:
            for part in _grown(batch):
                words, index, bounds = distinct_words(part.column("text"))
                hashes = word_hashes(words)[index]
                lists = part.column("wanted")
                flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
                start = np.asarray(flat.field("start"), dtype=np.int64) + np.repeat(bounds[:-1], np.diff(offsets))
                n = np.asarray(flat.field("n"), dtype=np.int64)
                keep = part.column("ord").take(pa.array(np.repeat(np.arange(len(part)), np.diff(offsets))))
                if not windows:
                    raw = hashes.tobytes()
                    strings = [raw[8 * a : 8 * b] for a, b in zip(start.tolist(), (start + n + plan.window - 1).tolist())]
                    yield pa.RecordBatch.from_arrays([flat.field("m"), flat.field("d"), keep, pa.array(strings, pa.binary())], ["m", "d", "keep", "words"])
                    continue
                of = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                first, second = (grams(h, plan.window)[start[of] + at].view(np.int64) for h in (hashes, mixed(hashes + np.uint64(1))))
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([flat.field("m").take(rows), flat.field("d").take(rows), keep.take(rows), pa.array(at.astype(np.int32)), pa.array(first), pa.array(second)], ["m", "d", "keep", "at", "w1", "w2"])
            freed()

    return run


def repeated_windows(strings: list[bytes], keeps: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """Of each string of word hashes, the windows that a string with a smaller value holds as well, by one index over all."""
    words = np.frombuffer(b"".join(strings), dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(s) // 8 for s in strings])])
    n = np.diff(bounds) - plan.window + 1
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    kept, least = FmIndex(words, bounds, keeps, plan.window).least_values(bounds[of] + at + plan.window, plan.window)
    kept = kept[least < keeps[of[kept]]]
    return np.split(at[kept], np.searchsorted(of[kept], np.arange(1, len(n))))


def _search(plan: Plan):
    """m, d, removed: offsets of a run's windows that a document with a smaller id holds too. Rows come by m; a shard is cut
    between two values of m, where it has shard_words, so windows that are equal lie in one shard."""

    def run(batches):
        held, size = [], 0

        def found():
            removed = repeated_windows([h[3] for h in held], np.array([h[2] for h in held], dtype=np.int64), plan)
            rows = [(h[0], h[1], r.astype(np.int32)) for h, r in zip(held, removed) if len(r)]
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["m", "d", "removed"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("m", "d", "keep", "words"))):
                if size > plan.shard_words and row[0] != held[-1][0]:
                    yield found()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) // 8
        if held:
            yield found()

    return run


def _cut(plan: Plan):
    """n_removed and the digest of the words left of each text, given its runs with repeated windows (removed null: all)."""

    def run(batches):
        for batch in batches:
            for part in _grown(batch):
                n_words, n_removed, shas = [], [], []
                for text, hits in zip(part.column("text"), part.column("hits").to_pylist()):
                    words = text.as_buffer().to_pybytes().split()
                    change = np.zeros(len(words) + 1, dtype=np.int32)
                    for hit in hits:
                        starts = hit["start"] + (np.arange(hit["n"]) if hit["removed"] is None else np.array(hit["removed"], dtype=np.int64))
                        np.add.at(change, starts, 1)
                        np.add.at(change, starts + plan.window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).digest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.binary())], ["id", "n_words", "n_removed", "sha"])
            freed()

    return run


def repeated_runs(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each row's profile (id, ord, key, n_words, sha, runs), and of each text with repeated windows its hits.

    Equal windows have equal least hashes, so they meet under one. A hash in one document only is done with. Where all runs
    under a hash are equal, the document with the least id has them first and nothing is searched. Else one of each
    distinct run, that of its least id, goes with its words to the shard of its hash; later copies of a run repeat all of it.
    """
    texts = _texts(docs, id_col, text_col)
    profiles = stored(texts.mapInArrow(_profiles(plan), "id long, ord long, key long, n_words long, sha binary, runs array<struct<m:long,d:long,start:int,n:int>>"), "profiles")
    each = profiles.select("ord", "key", F.explode("runs").alias("r")).select("ord", "key", "r.*")
    shared = each.groupBy("m").agg(F.min("ord").alias("least"), F.max("ord").alias("most"), (F.min("d") != F.max("d")).alias("mixed")).where("least < most").select("m", "least", "mixed")
    meeting = stored(each.join(shared, "m"), "meeting")

    wanted = meeting.where("mixed").groupBy("m", "d").agg(F.min(F.struct("ord", "key", "start", "n")).alias("rep"))
    wanted = stored(wanted.select("m", "d", "rep.*"), "distinct-runs")
    hot = stored(wanted.groupBy("m").agg(F.count("*").alias("k")).where(F.col("k") > plan.most), "hot")
    lists = lambda rows: rows.groupBy("ord", "key").agg(F.collect_list(F.struct("start", "n", "m", "d")).alias("wanted")).join(_shrunk(texts).drop("id"), ["ord", "key"]).select("ord", "wanted", "size", "body")
    strings = lists(wanted.join(hot, "m", "left_anti")).mapInArrow(_wanted_words(plan, False), "m long, d long, keep long, words binary")
    answers = strings.repartition("m").sortWithinPartitions("m", "d", "keep").mapInArrow(_search(plan), "m long, d long, removed array<int>")
    if not hot.isEmpty():
        windows = lists(wanted.join(hot.select("m"), "m", "left_semi")).mapInArrow(_wanted_words(plan, True), "m long, d long, keep long, at int, w1 long, w2 long")
        windows = stored(windows, "windows")
        first = windows.groupBy("w1", "w2").agg(F.min("keep").alias("least"), F.max("keep").alias("most")).where("least < most").select("w1", "w2", "least")
        late = windows.join(first, ["w1", "w2"]).where("keep > least").groupBy("m", "d").agg(F.collect_set("at").alias("removed"))
        answers = answers.unionByName(late)
    answers = stored(answers.groupBy("m", "d").agg(F.first("removed").alias("removed")), "answers")

    firsts = wanted.select("m", "d", F.col("ord").alias("keep")).join(answers, ["m", "d"], "left")
    copied = meeting.where("not mixed and ord > least").select("ord", "key", "start", "n", F.lit(None).cast("array<int>").alias("removed"))
    judged = meeting.where("mixed").join(firsts, ["m", "d"]).where("ord > keep or removed is not null")
    judged = judged.select("ord", "key", "start", "n", F.when(F.col("ord") <= F.col("keep"), F.col("removed")).alias("removed"))
    hits = copied.unionByName(judged).groupBy("ord", "key").agg(F.collect_set(F.struct("start", "n", "removed")).alias("hits"))
    return profiles, stored(hits, "hits")


def without_repeats(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the words left, joined by a space).

    A word goes if a window of `plan.window` consecutive words over it also starts in a document with a smaller id. A null
    id is larger than any other; rows with the same id never remove from each other, and windows that repeat within one
    document only stay. Null and empty texts, and texts shorter than a window, lose nothing; an empty table gives no rows;
    other columns are ignored. Words are compared by 64-bit hashes, windows by the hashes of all their words.
    """
    profiles, hits = repeated_runs(docs, plan, id_col, text_col)
    cut = hits.join(_shrunk(_texts(docs, id_col, text_col)), ["ord", "key"]).select("id", "size", "body", "hits").mapInArrow(_cut(plan), "id long, n_words long, n_removed long, sha binary")
    cut = stored(cut, "cut")  # written in small batches; without texts it is small
    clean = profiles.join(hits.select("ord", "key"), ["ord", "key"], "left_anti").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha")
    return clean.unionByName(cut).select(F.col("id").alias(id_col), "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"))


#: DuckDB SQL for without_repeats(): every window of every text.
PASSAGES_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT rid, doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT rid, doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS s FROM n),
f AS (SELECT s, min(coalesce(doc_id, 9223372036854775807)) AS least FROM h GROUP BY s),
c AS (SELECT DISTINCT rid, i + k AS p FROM (SELECT rid, i FROM h JOIN f ON f.s = h.s WHERE f.least < coalesce(h.doc_id, 9223372036854775807)), range(50) t(k)),
g AS (SELECT rid, list(p) AS ps FROM c GROUP BY rid)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN g ON g.rid = w.rid
"""
