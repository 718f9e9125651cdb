"""Removal of repeated passages against brute force over all windows, and the index against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest

from frameloom.llm import fm_index, passages

SCHEMA = "doc_id long, text string, key string, words string, id string"


def brute(rows, window=50):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, ws in split:
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s : s + window])
            first[k] = min(first.get(k, float("inf")), order(i))
    out = []
    for i, ws in split:
        gone = {p for s in range(len(ws) - window + 1) if first[tuple(ws[s : s + window])] < order(i) for p in range(s, s + window)}
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, plan=passages.Plan(), parts=3):
    got = passages.without_repeats(spark.createDataFrame([(i, t, "k", "w", "x") for i, t in rows], SCHEMA).repartition(parts), plan)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = brute(rows, plan.window)
    assert sorted(map(tuple, got.collect()), key=str) == want
    return sum(r[2] for r in want)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["ü", " x", "\x1cy"]
    passage = [[rng.choice(words) for _ in range(rng.choice([50, 51, 70, 130]))] for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += rng.choice([rng.choice(passage), [rng.choice(words) for _ in range(rng.randrange(60))], rng.choice(passage)[3:-5], ["la"] * rng.randrange(120), passage[0]])
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(parts)))
    return rows


ODD = [(None, "a " * 70), (None, "a " * 60), (500, None), (501, ""), (502, " \n"), (503, "one two"), (-7, " ".join(f"w{k}" for k in range(55))), (3, " ".join(f"w{k}" for k in range(60))), (3, " ".join(f"w{k}" for k in range(5, 58)))]


def test_removed_words_are_those_of_brute_force(spark):
    rows = texts(1)
    assert check(spark, rows + rows[:7] + ODD) > 1000


def test_small_shards_chunks_and_hot_hashes(spark):
    for plan in (passages.Plan(shard_words=60, longest=7, chunk=90), passages.Plan(most=1), passages.Plan(window=6, gram=4, most=3, shard_words=200, longest=3, chunk=40)):
        assert check(spark, texts(2, 40) + ODD, plan) > 1000


def test_copies_long_texts_and_none(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30_000))
    check(spark, [(i, "the same text of copies " * 20) for i in range(50)] + [(90, long), (80, "x " + long[5000:90_000])])
    check(spark, [])
    check(spark, [(1, None)])


@pytest.mark.parametrize("seed", range(12))
def test_index_against_plain_search(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 12)
    strings = [[rng.choice([5, 9, 1 << 40, 77]) for _ in range(rng.randrange(6, 40))] for _ in range(n)]
    values = np.array([rng.randrange(100) for _ in range(n)])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    index = fm_index.FmIndex(np.array([w for s in strings for w in s], dtype=np.uint64), bounds, values, 6)
    ends = [(k, e) for k, s in enumerate(strings) for e in range(6, len(s) + 1)]
    kept, least = index.least_values(np.array([bounds[k] + e for k, e in ends]), 6)
    want = {}
    for j, (k, e) in enumerate(ends):
        pattern = strings[k][e - 6 : e]
        holders = [values[q] for q, s in enumerate(strings) for a in range(len(s) - 5) if s[a : a + 6] == pattern]
        if len(holders) > 1:
            want[j] = min(holders)
    assert dict(zip(kept.tolist(), least.tolist())) == want


def test_runs_tile_the_windows_and_equal_windows_share_a_hash():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    hashes = np.concatenate([words[rng.integers(0, 40, 500)], words[:30]])
    hashes[300:380] = hashes[100:180]
    bounds = np.array([0, 200, 500, 500, 530])
    plan = passages.Plan()
    of, start, n, least = passages.runs(hashes, bounds, plan)
    seen = [(k, s + j) for k, s, c in zip(of, start, n) for j in range(c)]
    assert seen == [(k, s) for k in range(4) for s in range(bounds[k + 1] - bounds[k] - 49)]
    hash_of = dict(zip(seen, np.repeat(least, n).tolist()))
    assert all(hash_of[(0, s)] == hash_of[(1, s + 0)] for s in range(100, 131) if (hashes[s : s + 50] == hashes[200 + s : 250 + s]).all()) and (hashes[100:150] == hashes[300:350]).all()
    direct = [min(passages.grams(hashes[a : a + 12], 12)[0] for a in range(s, s + 39)) for s in range(10)]
    assert [hash_of[(0, s)] for s in range(10)] == direct
