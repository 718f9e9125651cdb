"""N-gram Jaccard join: MinHash candidates, Bayesian pruning on incremental comparisons, exact verification of the rest."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, freed, slices, stored
from .components import components
from .shingles import minima, mixed, shingle_hashes, word_hashes


@dataclass(frozen=True)
class Plan:
    """size words a shingle; texts are linked at a Jaccard similarity of threshold or more.

    A pair is compared if one of `bands` bands of `rows` MinHash values agrees: at the threshold that fails with a chance of
    (1 - threshold ** rows) ** bands, 0.0004. After each `step` values a pair whose similarity reaches the threshold with a
    posterior probability under `tolerance` (uniform prior) is dropped. block, block_bytes: texts on a side of one
    comparison at most, about, and bytes of their shingles.
    """

    size: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 5
    step: int = 10
    tolerance: float = 1e-6
    block: int = 2048
    block_bytes: int = 8 << 20

    @property
    def n_hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, fewest matches that keep a pair). Given m of n matches, the similarity is Beta(m + 1, n - m + 1)."""
        out = []
        for n in range(self.step, self.n_hashes + 1, self.step):
            # P(similarity >= t) is the chance of at most m successes of n + 1 at rate t
            at_most = np.cumsum([comb(n + 1, k) * self.threshold**k * (1 - self.threshold) ** (n + 1 - k) for k in range(n + 2)])
            out.append((n, int(np.argmax(at_most >= self.tolerance))))
        return out


def _signatures(plan: Plan):
    """Per row of id, h1, h2, text: a digest of the words, the number of shingles, and the lower 16 bits of the MinHash
    values, as bytes. Texts without words get nulls."""
    rng = np.random.default_rng(20240229)
    factors = [(int(m) | 1, int(c)) for m, c in rng.integers(0, 1 << 63, size=(plan.n_hashes, 2))]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, index, bounds = distinct_words(part.column("text"))
                hashes = word_hashes(words)[index]
                filled = np.diff(bounds) > 0
                raw = hashes.tobytes()
                keys = [xxhash.xxh3_128_digest(raw[8 * s : 8 * e]) if e > s else None for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                shingles, of = shingle_hashes(hashes, bounds, plan.size)
                values = np.stack([minima(shingles, of, m, c) for m, c in factors], axis=1).astype(np.uint16)
                signature = pa.array([v.tobytes() if f else None for v, f in zip(values, filled)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(keys, pa.binary()), pa.array(np.diff(of), pa.int32()), signature], ["id", "h1", "h2", "key", "size", "signature"])
            freed()

    return run


def _matrix(signatures: pa.Array, plan: Plan) -> np.ndarray:
    return _flat(signatures, np.uint16)[0].reshape(len(signatures), plan.n_hashes)


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column on end, without a copy, and each row's bounds among them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype), (offsets - offsets[0]).astype(np.int64) // np.dtype(dtype).itemsize


def _bands(plan: Plan):
    """A row per node and band: key, size, band, bucket (a hash of the band's values)."""
    salts = np.random.default_rng(20240301).integers(1, 1 << 63, size=plan.rows).astype(np.uint64) | np.uint64(1)

    def run(batches):
        for batch in batches:
            wide = _matrix(batch.column("signature"), plan).astype(np.uint64).reshape(len(batch), plan.bands, plan.rows)
            buckets = mixed(mixed((wide + np.uint64(1)) * salts).sum(axis=2, dtype=np.uint64) + np.arange(plan.bands, dtype=np.uint64)).astype(np.int64)
            rows = pa.array(np.repeat(np.arange(len(batch)), plan.bands))
            bands = pa.array(np.tile(np.arange(plan.bands, dtype=np.int32), len(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("size").take(rows), bands, pa.array(buckets.ravel())], ["key", "size", "band", "bucket"])

    return run


def _shingle_sets(size: int):
    """The shingle set of each text, sorted, as bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, index, bounds = distinct_words(part.column("text"))
                shingles, of = shingle_hashes(word_hashes(words)[index], bounds, size)
                sets = [np.unique(shingles[s:e]).tobytes() for s, e in zip(of[:-1].tolist(), of[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.binary())], ["key", "shingles"])
            freed()

    return run


def linked_pairs(signatures: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, band: np.ndarray, plan: Plan) -> np.ndarray:
    """Of the pairs (first, second) of rows that meet in `band`, which are similar; each pair counts in its first band only."""
    kept = np.arange(len(first))
    for before in range(int(band.max()) if len(band) else 0):
        columns = slice(before * plan.rows, (before + 1) * plan.rows)
        earlier = (band[kept] > before) & (signatures[first[kept], columns] == signatures[second[kept], columns]).all(axis=1)
        kept = kept[~earlier]
    matches = np.zeros(len(kept), dtype=np.int32)
    for n, least in plan.least_matches():
        if not len(kept):
            break
        columns = slice(n - plan.step, n)
        matches = matches + (signatures[first[kept], columns] == signatures[second[kept], columns]).sum(axis=1)
        going = matches >= least
        kept, matches = kept[going], matches[going]
    return kept[_verified(sets, first[kept], second[kept], plan.threshold)] if len(kept) else kept


def _verified(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of each pair of sorted sets is at least the threshold, exactly."""
    sizes = np.array([len(s) for s in sets])
    rows = np.unique(np.concatenate([first, second]))
    vocabulary = np.unique(np.concatenate([sets[r] for r in rows])) if 2 * len(rows) < len(first) else np.empty(0, np.uint64)
    if len(rows) <= 2048 and 0 < len(rows) ** 2 * len(vocabulary) < 200_000 * len(first):
        # many pairs of few sets: all intersections are a product of membership matrices, a range of the shingles at a time
        at = np.searchsorted(rows, np.arange(len(sets)))
        row, column = np.repeat(np.arange(len(rows)), sizes[rows]), np.searchsorted(vocabulary, np.concatenate([sets[r] for r in rows]))
        shared, wide = np.zeros((len(rows), len(rows)), dtype=np.float32), max(1, 1_000_000 // len(rows))
        for start in range(0, len(vocabulary), wide):
            inside = (column >= start) & (column < start + wide)
            member = np.zeros((len(rows), min(wide, len(vocabulary) - start)), dtype=np.float32)
            member[row[inside], column[inside] - start] = 1
            shared += member @ member.T
        common = shared[at[first], at[second]].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(first.tolist(), second.tolist())], dtype=np.int64)
    union = sizes[first] + sizes[second] - common
    return common >= threshold * union - 1e-9


def _whole_groups(batches, columns: list[str], most_bytes: int = 2 << 20):
    """Rows sorted by the columns, cut into runs that hold whole groups only, about most_bytes of shingles or one group each;
    with each run's group bounds."""

    def starts_of(rows):
        ids = [np.asarray(rows.column(c)) for c in columns]
        return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([i[1:] != i[:-1] for i in ids])]))

    def of(batch, k):
        return [batch.column(c)[k] for c in columns]

    held: list[pa.RecordBatch] = []
    for part in (part for batch in batches for part in slices(batch, "shingles", most_bytes)):
        cut = int(starts_of(part)[-1])
        if held and (cut or of(held[-1], len(held[-1]) - 1) != of(part, 0)):
            rows = pa.Table.from_batches([*held, part.slice(0, cut)]).combine_chunks()
            yield rows, np.append(starts_of(rows), len(rows))
            held = []
        elif cut:
            rows = pa.Table.from_batches([part.slice(0, cut)]).combine_chunks()
            yield rows, np.append(starts_of(rows), len(rows))
        held.append(part.slice(cut))
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, np.append(starts_of(rows), len(rows))


def unite(root: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """root, the least row that each row is linked with so far, after the links of first to second."""
    while True:
        a, b = root[first], root[second]
        apart = a != b
        if not apart.any():
            return root
        first, second, a, b = first[apart], second[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _pairs(low: np.ndarray, high: np.ndarray | None, wide: int = 256):
    """All pairs of rows of low and high, or of low alone, some wide * wide at a time."""
    for i in range(0, len(low), wide):
        a = low[i : i + wide]
        if high is None:
            x, y = np.triu_indices(len(a), 1)
            yield a[x], a[y]
        for j in range(0 if high is not None else i + wide, len(low if high is None else high), wide):
            b = (low if high is None else high)[j : j + wide]
            yield np.repeat(a, len(b)), np.tile(b, len(a))


def _compare(plan: Plan):
    """Over rows sorted by (band, bucket, pair of blocks): per group, a link from each text to the least one it is linked
    with, over any number of links of the group, and how many rows each text is linked with."""

    def run(batches):
        for rows, starts in _whole_groups(batches, ["band", "bucket", "low", "high"]):
            column = lambda c: rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0)
            signatures, n_rows = _matrix(column("signature"), plan), column("n").to_numpy()
            shingles, at = _flat(column("shingles"), np.uint64)
            sets = [shingles[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            band, block, low, high = (column(c).to_numpy() for c in ("band", "block", "low", "high"))
            root, links = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)

            def settle(root, first, second):
                kept = linked_pairs(signatures, sets, first, second, band[first], plan)
                first, second = first[kept], second[kept]
                np.add.at(links, first, n_rows[second])
                np.add.at(links, second, n_rows[first])
                return unite(root, first, second)

            small = []
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = np.arange(start, end)
                one, other = (own, None) if low[start] == high[start] else (own[block[own] == low[start]], own[block[own] == high[start]])
                if end - start <= 32:
                    small.extend(_pairs(one, other))
                    continue
                for first, second in _pairs(one, other):
                    root = settle(root, first, second)
            if small:
                root = settle(root, *(np.concatenate(side) for side in zip(*small)))
            linked = np.flatnonzero(links)
            keys = column("key")
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(linked)), keys.take(pa.array(root[linked])), pa.array(links[linked])], ["a", "b", "n_links"])
            freed()

    return run


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row per document: id, class_id (the least id of the documents it is linked with, over any number of links),
    class_size, n_links (other documents with a similarity of at least the threshold).

    Words are runs of anything but white space, as written. A text of fewer than plan.size words has one shingle, all of
    them. Texts with the same words are one node, and link to each other; null and empty texts have no shingle and no
    link. Repeated rows count as documents. A null id's class has the null as its id only if no other id is in it. An
    empty table gives no rows; other columns are ignored.

    Nodes that share a band key are compared in blocks, so a bucket that holds a third of all nodes is dealt over many
    tasks, and a pair that meets in several bands counts in the first. A bucket of n nodes sends each to n / plan.block
    tasks, and takes n squared comparisons, as counting all its links does. Pairs never leave the tasks that compare them:
    these hand on a link and a count per row.
    """
    out = _decided(docs, id_col, text_col, plan)
    alone = F.col("key").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def _text_hashes(text: Column) -> list[Column]:
    """h1, h2: 128 bits that tell one text from another."""
    return [F.xxhash64(F.lit(k), text).alias(f"h{k}") for k in (1, 2)]


def _decided(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """A row per document: id, h1, h2, key, and if it has words keep (no_id, id, h1, h2 of the document of its class with the
    least id, nulls last, then the least hashes), class_size, n_links."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *_text_hashes(F.col(text_col)), F.col(text_col).alias("text"))
    signed = stored(rows.mapInArrow(_signatures(plan), "id long, h1 long, h2 long, key binary, size int, signature binary"), "signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2"))
    nodes = signed.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), least.alias("least"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    nodes = stored(nodes, "nodes")
    banded = nodes.select("key", "size", "signature").mapInArrow(_bands(plan), "key binary, size int, band int, bucket long")
    crowded = banded.groupBy("band", "bucket").agg(F.count("*").alias("crowd"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("key")).alias("h1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("h2")).where("crowd > 1")
    # of buckets with the same nodes, the one of the first band: it is the first in which any two of them meet
    crowded = crowded.groupBy("crowd", "h1", "h2").agg(F.min(F.struct("band", "bucket", "shingles")).alias("at")).select("crowd", "at.*")
    members = stored(banded.drop("size").join(crowded, ["band", "bucket"]), "members")

    # shingle sets of the nodes that meet another, from the text of the node's least row
    candidates = members.select("key").distinct().join(nodes.select("key", "n", "least", "signature"), "key")
    full = candidates.drop("least").join(_one_text_each(rows, candidates.select("key", "least.*"), plan), "key")

    blocks = F.ceil(F.greatest(F.col("crowd") / plan.block, F.col("shingles") * 8 / plan.block_bytes)).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64("key", "bucket"), blocks).cast("int")).otherwise(0)
    paired = members.withColumn("blocks", blocks).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("key", "band", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    group = ["band", "bucket", "low", "high"]
    compared = paired.join(full, "key").repartition(*group).sortWithinPartitions(*group)
    found = stored(compared.select(*group, "block", "key", "n", "signature", "shingles").mapInArrow(_compare(plan), "a binary, b binary, n_links long"), "found")

    counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("n_links").alias("links"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "key")
    known = nodes.select("key", "n", "least").join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = stored(known, "known")
    classes = known.groupBy("root").agg(F.min("least").alias("keep"), F.sum("n").alias("class_size"))
    known = known.join(classes, "root").select("key", "keep", "class_size", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("id", "h1", "h2", "key").join(known, "key", "left")


def _one_text_each(rows: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """key, shingles: the shingle set of one text of each wanted key, given its row's id (or null) and text hashes.

    The hashes are part of the join's key: rows without an id, or with the same one, meet only their own text.
    """
    named = wanted.select("key", *[F.col(c).alias(f"of_{c}") for c in ("id", "h1", "h2")])
    same = [rows["h1"] == named["of_h1"], rows["h2"] == named["of_h2"], rows["id"].eqNullSafe(named["of_id"])]
    sets = rows.join(named, same).select("key", "text").mapInArrow(_shingle_sets(plan.size), "key binary, shingles binary")
    return stored(sets.dropDuplicates(["key"]), "shingles")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """The rows of docs that are alone, and one row of each class, with the columns of docs.

    That row has the least id of its class. Rows are told apart by id and text, so a null or repeated id decides for no
    other text; of rows with equal ids, or all without one, the text with the least hash stays, and of repeated rows one.
    """
    names = ["id", "h1", "h2"]
    found = _decided(docs, id_col, text_col, plan).where("key is not null")
    kept = F.struct("id", "h1", "h2").eqNullSafe(F.struct("keep.id", "keep.h1", "keep.h2"))
    found = found.select(*names, kept.alias("kept")).groupBy(*names, "kept").agg(F.count("*").alias("n"))
    found = stored(found.where("not kept or n > 1"), "near-copies")
    row = F.struct(*[docs[c] for c in docs.columns])  # in one column, so that no name of docs clashes with another
    at = docs.select(row.alias("row"), docs[id_col].cast("long").alias("id"), *_text_hashes(docs[text_col]))
    same = lambda other: [at[c].eqNullSafe(other[c]) for c in names]
    repeated = found.where("kept")
    alone = at.join(found, same(found), "left_anti").select("row.*")
    if repeated.isEmpty():
        return alone
    once = at.join(repeated, same(repeated), "left_semi").groupBy("id", "h1", "h2").agg(F.first("row").alias("row"))
    return alone.unionByName(once.select("row.*"))
