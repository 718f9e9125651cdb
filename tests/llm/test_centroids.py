"""Centroid clustering against brute force in Python's integers."""

import hashlib
import math
import random

import numpy as np

from frameloom.llm import centroids, common

SCHEMA = "vec_id long, embedding array<float>, id string, vec string, cluster string"


def brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "g"
    now = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        groups = [[] for _ in now]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        now = [[sum(p) // len(g) for p in zip(*g)] if g else c for g, c in zip(groups, now)]
    last = [(i, *near(v)) for i, v in kept]
    of = lambda n: sum(d for _, d, m in last if m == n)
    return sorted(((i, n, d, of(n), sum(d for _, d, _ in last), hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for i, d, n in last), key=str)


def vectors(n, seed=3, centres=12):
    rng = random.Random(seed)
    at = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(centres)]
    rows = []
    for i in range(n):
        c = at[0] if i % 3 == 0 else rng.choice(at)
        rows.append((i, [x + rng.gauss(0, 0.1) for x in c]))
    return rows


def check(spark, rows, parts=3):
    table = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(parts)
    got = centroids.cluster(table)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_clusters_are_those_of_brute_force(spark):
    rows = vectors(300)
    rows += rows[:9] + [(7, rows[8][1]), (None, rows[5][1]), (-4, [-x for x in rows[5][1]])]
    rows += [(900, None), (901, []), (902, rows[0][1][:-1]), (903, [None] * 64), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63), (906, [0.0] * 64)]
    check(spark, rows)


def test_ties_fewer_vectors_and_none(spark):
    check(spark, [(i, [0.5] * 64) for i in range(20)])  # all centroids alike: the smallest number takes all
    check(spark, [(i, [float(i)] + [0.0] * 63) for i in range(3)])
    check(spark, [])
    check(spark, [(1, None)])


def test_large_components_are_exact(spark):
    rows = vectors(60, seed=8) + [(100 + i, [1e6 * i + 0.25] + [0.0] * 63) for i in range(3)]
    check(spark, rows)


def test_bounds_spare_scans_and_are_never_wrong():
    rng = np.random.default_rng(5)
    at = rng.normal(0, 300, (8, 64))
    x = np.floor(at[rng.integers(0, 8, 4000)] + rng.normal(0, 60, (4000, 64))).astype(np.int64)
    now, before = x[:8].tolist(), None
    cluster, upper, lower, scans = np.full(4000, -1, dtype=np.int32), np.zeros(4000), np.zeros(4000), []
    for _ in range(8):
        cluster, upper, lower, n = centroids.Bounds(now, before).assign(x, cluster, upper, lower)
        d = ((x[:, None, :] - np.array(now)[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(4000), cluster])
        d[np.arange(4000), cluster] = d.max() + 1
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(axis=1))).all()
        scans.append(n)
        before, now = now, [(x[cluster == c].sum(axis=0) // max((cluster == c).sum(), 1)).tolist() if (cluster == c).any() else now[c] for c in range(8)]
    assert scans[0] == 4000 and scans[-1] < 400


def test_steps_before_the_last_are_deleted(spark):
    import pathlib

    common.clear_steps(spark)
    got = centroids.cluster(spark.createDataFrame([(i, v, "a", "b", "c") for i, v in vectors(40)], SCHEMA))
    left = list(pathlib.Path(common.steps_dir(spark).removeprefix("file://")).iterdir())
    assert len(left) == 1 and got.count() == 40
    common.clear_steps(spark)
    assert not pathlib.Path(common.steps_dir(spark).removeprefix("file://")).exists()
