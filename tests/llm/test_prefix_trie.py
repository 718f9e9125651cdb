"""The trie of conversations against brute force over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from frameloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, keys string, n_convs string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=str)


def check(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = prefix_trie.conversation_trie(spark.createDataFrame([(*r, "k", "n") for r in rows], SCHEMA).repartition(3))
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_trie_is_that_of_brute_force(spark, parts):
    rng = random.Random(parts)
    texts = ["hi", "", None, "ü", "more of it", "x" * 300]
    rows = []
    for c in range(150):
        if rng.random() < 0.9:
            rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(texts[: 2 if c % 3 else 6])) for k in range(rng.randrange(0, 12))]
    rows += [(c, k, "user", "same") for c in range(200, 260) for k in range(9)]  # a group of copies
    rows += [(-c, 3 - k, "user", "back") for c in range(1, 12) for k in range(4)]
    rows += [(300, k, "user", f"{k}") for k in range(700)] + [(305, k, "user", f"{k}") for k in range(701)]
    rows += [(7, None, "user", "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (None, 1, "user", "lost"), (401, 0, None, None)]
    rng.shuffle(rows)
    check(spark, rows, parts)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(6, 0, "a", "b")], [(5, 0, "a", "b"), (6, 0, "a", "b")]])
def test_small_tables(spark, rows):
    check(spark, rows, 3)


@pytest.mark.parametrize("seed", range(40))
def test_sweep_and_stitch_at_any_cut(seed):
    """However sorted paths are cut into partitions, the nodes are those of one sweep over all."""
    rng = random.Random(seed)
    paths = sorted(([bytes([rng.randrange(2)]) for _ in range(rng.randrange(7))], c) for c in range(rng.randrange(1, 40)))

    def nodes(cuts):
        found, refs, records = [], {}, []
        bounds = [0, *sorted(cuts), len(paths)]
        for pid, (a, b) in enumerate(zip(bounds, bounds[1:])):
            for row in prefix_trie.sweep(((c, p, [len(p)] * len(p)) for p, c in paths[a:b]), pid):
                (records.append((pid, row[-1])) if row[0] == prefix_trie.PATHS else found.append(row[1:]))
        for row in prefix_trie.stitch(records):
            if row[0] == "ref":
                refs[row[9:12]] = row[8]
            else:
                found.append(row[1:])
        return sorted(((*f[:7], refs[f[8:11]] if f[8] is not None else f[7]) for f in found), key=str)

    assert nodes([]) == nodes([rng.randrange(len(paths) + 1) for _ in range(5)]) == nodes(range(len(paths)))
