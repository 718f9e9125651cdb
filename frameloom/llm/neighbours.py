"""Approximate nearest neighbours: learned partitions of a neighbour graph, routed to by a small classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass
class Router:
    """A classifier with one hidden layer, and how many of its most probable partitions a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def nearest(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None, block: int = 512) -> np.ndarray:
    """Rows of x with the k largest inner products with each row of q, best first; own: the row to leave out of each."""
    out = []
    for s in range(0, len(q), block):
        scores = q[s : s + block] @ x.T
        if own is not None:
            scores[np.arange(len(scores)), own[s : s + block]] = -np.inf
        top = np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, axis=1), axis=1), axis=1))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, rounds: int = 8, slack: float = 0.1) -> np.ndarray:
    """Parts of nearly equal size that cut few edges of the neighbour graph.

    Halves along principal directions to start with; then, round after round, nodes move to the part that holds most of
    their neighbours, those who gain most first, as long as it has room.
    """
    part = np.zeros(len(x), dtype=np.int64)
    todo, label = [(np.arange(len(x)), n_parts)], 0
    while todo:
        rows, n = todo.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = label
            label += 1
            continue
        own = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(own.T @ own)[1][:, -1]
        order = rows[np.argsort(own @ direction, kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    room = int(np.ceil(len(x) / n_parts * (1 + slack)))
    both = np.concatenate([graph, np.full_like(graph[:, :1], -1)], axis=1)
    for _ in range(rounds):
        votes = np.zeros((len(x), n_parts), dtype=np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[both[:, :-1]].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        sizes, moved = np.bincount(part, minlength=n_parts), 0
        for row in np.argsort(-gain, kind="stable"):
            if gain[row] <= 0:
                break
            if sizes[best[row]] < room:
                sizes[part[row]] -= 1
                sizes[best[row]] += 1
                part[row] = best[row]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, n_parts: int, hidden: int = 128, epochs: int = 40, seed: int = 5) -> Router:
    """Partition the sample's neighbour graph and learn, for each vector, where its neighbours and itself are. A query visits
    all partitions until set_probes() has seen the index."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if n_parts < 2:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = nearest(x, x, min(10, len(x) - 1), np.arange(len(x)))
    part = balanced_parts(x, graph, n_parts)
    target = np.zeros((len(x), n_parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(x)), part] += 0.5
    scale = 1 / max(float(np.abs(x).std()), 1e-30)
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, n_parts)), np.zeros(n_parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = x * scale
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for s in range(0, len(order), 256):
            rows = order[s : s + 256]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            out = h @ p[2] + p[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            delta = (out / out.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (delta @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((z[rows].T @ back, back.sum(axis=0), h.T @ delta, delta.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(p[0] * scale, *p[1:], probes=n_parts)


def set_probes(router: Router, index: DataFrame, x: np.ndarray, k: int, recall: float) -> float:
    """Set the number of probes to the least that finds `recall` of the k nearest of the vectors x in the whole index, where
    columns x and part are; return the recall it has. A Spark job scores x, a bounded set, against every entry."""
    shared = index.sparkSession.sparkContext.broadcast(x)

    def best(batches):
        q, scores, parts = shared.value, np.empty((len(shared.value), 0)), np.empty((len(shared.value), 0), dtype=np.int32)
        for batch in batches:
            for part in (batch.slice(s, 4096) for s in range(0, len(batch), 4096)):
                here = np.tile(np.asarray(part.column("part")), (len(q), 1))
                scores = np.concatenate([scores, q @ _matrix(part.column("x")).T], axis=1)
                parts = np.concatenate([parts, here], axis=1)
                if scores.shape[1] > k + 1:  # one more, for the vector itself
                    top = np.argpartition(-scores, k, axis=1)[:, : k + 1]
                    scores, parts = np.take_along_axis(scores, top, axis=1), np.take_along_axis(parts, top, axis=1)
        n = scores.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), n)), pa.array(scores.ravel()), pa.array(parts.ravel())], ["q", "score", "part"])

    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "part"))
    top = index.select("x", "part").mapInArrow(best, "q int, score double, part int").withColumn("n", order).where(F.col("n").between(2, k + 1))
    found = top.select("q", "part").toPandas()
    rank = np.argsort(np.argsort(-router.logits(x), axis=1, kind="stable"), axis=1, kind="stable")
    needed = rank[found["q"].to_numpy(), found["part"].to_numpy()]
    n_parts = rank.shape[1]
    router.probes = next((n for n in range(1, n_parts + 1) if len(needed) and (needed < n).mean() >= recall), n_parts)
    return float((needed < router.probes).mean()) if len(needed) else 1.0


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=dtype).reshape(len(column), -1)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           sample_rows: int = 8192, part_rows: int = 16_384, least_parts: int = 8, recall: float = 0.97, tested: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: of each vector whose id `every` divides, the k others found with the largest inner
    product, all others if there are fewer; equal scores by smaller id.

    Null vectors, zero ones and ones with null or non-finite components take no part, nor do null ids. A vector shorter
    than others counts as if zeros followed. Rows that repeat an id are rows of their own: each is a candidate, and each a
    query if the id says so, leaving out only itself. An empty table gives no rows; other columns are ignored.

    Equal vectors are one entry of the index with their k + 1 least ids: more can't be among anyone's k. The router is fit
    on sample_rows entries drawn by hash, a bounded sample; every entry is indexed. There are least_parts partitions, or as
    many as give each about part_rows entries, up to a 32nd of sample_rows; a partition is dealt out in chunks of about
    part_rows entries, and a query visits all chunks of its partitions, which score whole original vectors in double
    precision. The number of partitions to visit is the least that finds `recall` of the true neighbours, in the whole
    index, of `tested` entries outside the sample, or of a quarter of the entries if those are fewer.
    """
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0))
    rows = stored(rows, "vectors")
    lengths = rows.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    d = lengths["most"] or 1
    if lengths["least"] != lengths["most"]:
        rows = stored(rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("x")))), "vectors")

    first = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    entries = rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = stored(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    n_entries = entries.count()
    n_parts = max(1, min(sample_rows // 32, n_entries // 32, max(least_parts, -(-n_entries // part_rows))))
    drawn = entries.select("x").orderBy(F.xxhash64("x"), "x").limit(sample_rows + tested).toArrow()
    drawn = _matrix(drawn.column("x").combine_chunks()) if n_entries else np.zeros((0, d))
    # the tested entries are set apart first, a quarter of a small table at most; what is left is fit on
    apart = min(tested, len(drawn) // 4)
    router = fit_router(drawn[apart : apart + sample_rows] if n_entries else np.zeros((1, d)), n_parts)
    routing = vectors.sparkSession.sparkContext.broadcast(router)

    def place(batches):
        for batch in batches:
            logits = routing.value.logits(_matrix(batch.column("x")))
            yield batch.append_column("part", pa.array(logits.argmax(axis=1).astype(np.int32)))

    def route(batches):
        for batch in batches:
            logits = shared.value.logits(_matrix(batch.column("x")))
            order = np.argsort(-logits, axis=1, kind="stable")[:, : shared.value.probes].astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel()))
            yield batch.append_column("parts", parts)

    index = stored(entries.mapInArrow(place, "x array<double>, ids array<long>, entry long, part int"), "index")
    if n_parts > 1:
        set_probes(router, index, drawn[:apart], k, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(router)
    chunks = {r["part"]: -(-r["n"] // part_rows) for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    n_chunks = F.element_at(F.create_map(*[F.lit(v) for item in (chunks or {0: 1}).items() for v in item]), F.col("part"))
    index = index.select("part", F.pmod(F.xxhash64("entry"), n_chunks).alias("chunk"), F.lit(0).alias("kind"), "entry", "x", "ids")

    asked = rows.where(F.col("id") % every == 0)
    named = asked.join(entries.select(F.col("x").alias("y"), "entry"), F.col("x") == F.col("y")).select(F.col("id").alias("query_id"), "entry", "x")
    named = stored(named, "queries")
    routed = named.select("entry", "x").dropDuplicates(["entry"]).mapInArrow(route, "entry long, x array<double>, parts array<int>")
    visits = routed.select("entry", "x", F.explode("parts").alias("part")).where(F.col("part").isin([int(p) for p in chunks] or [0]))
    visits = visits.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)))
    visits = visits.select("part", F.col("chunk"), F.lit(1).alias("kind"), "entry", "x", F.array().cast("array<long>").alias("ids"))

    met = index.unionByName(visits).repartition("part", "chunk").sortWithinPartitions("part", "chunk", "kind")
    hits = met.mapInArrow(_score(k), "entry long, vec_id long, score double, of long")
    best = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id"))
    found = hits.withColumn("n", best).where(F.col("n") <= k + 1)
    found = found.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "of"))).alias("found"))
    # the query's own row goes, once: another row may have its id, or its vector
    own = F.array_position(F.transform("found", lambda f: (f["vec_id"] == F.col("query_id")) & (f["of"] == F.col("entry"))), True)
    others = F.slice(F.filter("found", lambda f, i: i != own - 1), 1, k)
    out = named.select("query_id", "entry").join(found, "entry").select("query_id", F.posexplode(others).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def _score(k: int):
    """Over rows sorted by (part, chunk, kind): the k + 1 best ids of the chunk for each query that visits it,
    with the entry each is of."""

    def best(x: np.ndarray, ids: list[list[int]], of: list[int], entries: list[int], q: np.ndarray):
        scores = q @ x.T
        n = min(k + 1, len(x))
        # a few more than asked for: equal scores and the last bits of the product are settled below
        wide = min(len(x), n + 8)
        top = np.argpartition(-scores, wide - 1, axis=1)[:, :wide] if wide < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
        least = np.take_along_axis(scores, top, axis=1).min(axis=1)
        for r, entry in enumerate(entries):
            rows = top[r]
            tied = np.flatnonzero(scores[r] >= least[r] - 1e-12 * max(1.0, abs(least[r])))
            rows = tied if len(tied) > len(rows) else rows
            exact = (x[rows] * q[r]).sum(axis=1)
            pairs = sorted((-s, i, of[row]) for s, row in zip(exact.tolist(), rows.tolist()) for i in ids[row])[: k + 1]
            yield from ((entry, i, -s, e) for s, i, e in pairs)

    def run(batches):
        key, xs, ids, of, x = None, [], [], [], None
        for batch in batches:
            parts, chunks, kinds = (np.asarray(batch.column(c)) for c in ("part", "chunk", "kind"))
            cuts = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1]), [True]]))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                piece = batch.slice(s, e - s)
                if (parts[s], chunks[s]) != key:
                    key, xs, ids, of, x = (parts[s], chunks[s]), [], [], [], None
                if kinds[s] == 0:
                    xs.append(_matrix(piece.column("x")))
                    ids.extend(piece.column("ids").to_pylist())
                    of.extend(piece.column("entry").to_pylist())
                    continue
                if not xs:
                    continue
                x = np.concatenate(xs) if x is None else x
                entries, q = piece.column("entry").to_pylist(), _matrix(piece.column("x"))
                for b in range(0, len(q), 256):
                    found = list(best(x, ids, of, entries[b : b + 256], q[b : b + 256]))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["entry", "vec_id", "score", "of"])

    return run
