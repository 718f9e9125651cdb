"""The operators on documents against brute force, and on the cases that tables at large bring."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frameloom.llm import exact_dedup, langid, mixing, near_join, pii, piece_trie, registry, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeats, a very long text and word, clashing extra columns.
ODD = [
    (1, "one two three four five six", "en", "a", 5), (2, "one  two\tthree\nfour five six", "en", "a", 5), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n ", "en", "b", 3), (6, "one two three four five six", "en", "a", 5),
    (None, "a row without an id", "en", None, 5), (7, "twice", "de", "c", 5), (7, "twice", "de", "c", 5), (8, "word " * 30_000, "en", "a", 5), (9, "x" * 50_000, "en", "a", 5), (10, "👍🏽 ü ▁ 漢字 \u0000", "fr", "b", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for name in ("id", "label", "key", "n", "size", "score", "kept", "target", "word", "row", "h1", "part", "__text", "__words", "__id", "__text_sha256", "__keep_id", "decoded", "n_copies", "text_sha256"):
        df = df.withColumn(name, df["source"])
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_token_counts(spark, odd, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(registry.TOKENIZER))
    model = registry.tokenizer_bytes()
    for docs in (odd, none):
        for limit in (1 << 16, 40):  # the second cuts nearly every text
            got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs, model, part_chars=limit).collect())
            texts = [(r["doc_id"] or 0, r["text"] or "") for r in docs.select("doc_id", "text").collect()]
            assert got == sorted((i, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in texts)


def test_safe_parts_join_to_the_same_tokens():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(registry.TOKENIZER))
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice([*"abe tn", " ", "  ", "\n", "▁", "é", "the", " ▁ "]) for _ in range(r.randint(0, 120)))
        assert [i for p in tokens.safe_parts(t, r.randint(1, 30)) for i in sp.encode(p)] == sp.encode(t)


def test_sentencepiece(spark, odd, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(registry.TOKENIZER))
    vocab = piece_trie.vocabulary(registry.tokenizer_bytes())
    got = piece_trie.encoded(odd, vocab).collect()
    assert len(got) == len(ODD) and piece_trie.encoded(none, vocab).count() == 0
    texts = {i: t or "" for i, t, *_ in ODD}
    for r in got:
        assert list(r["ids"]) == sp.encode(texts[r["doc_id"]])
        # a mark in a text is a space to the library, and comes back as one
        assert r["round_trip"] or "▁" in texts[r["doc_id"]]
    clash = piece_trie.decode(piece_trie.encode(odd.withColumn("ids", odd["source"]).withColumn("decoded", odd["source"]), vocab), vocab)
    assert sorted(clash.columns) == sorted({*odd.columns, "ids", "decoded"})
    for r in clash.collect():
        assert list(r["ids"]) == sp.encode(r["text"] or "") and r["decoded"] == sp.decode(list(r["ids"]))


def test_encoder_is_the_library_s():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(registry.TOKENIZER))
    encoder = piece_trie.Encoder(piece_trie.vocabulary(registry.tokenizer_bytes()))
    r = random.Random(3)
    texts = ["".join(r.choice([*"abcdethersion  \n▁éñ世𝒳.,", "the", "ing", "   ", "<0x0A>", "<s>", "tion", "\t"]) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    want = sp.encode(texts)
    for k in range(0, len(texts), 700):  # later parts find words that earlier ones left in the cache
        assert piece_trie._ids(encoder, pa.array(texts[k : k + 700])).to_pylist() == want[k : k + 700]
    assert encoder.words
    back = piece_trie.Decoder(encoder.vocab).texts(pa.array([*want, None, [], [1, 2], [3 + 0xFF, 3 + 0x41]], pa.list_(pa.int32()))).to_pylist()
    assert back[: len(want)] == [sp.decode(ids) for ids in want] and back[len(want) :] == [None, "", "", "\ufffdA"]


def test_shared_prefixes():
    r = random.Random(12)
    words = sorted({"".join(r.choice("ab\x00𝒳") for _ in range(r.randint(0, 9))) for _ in range(500)} | {"a" * 60, "a" * 61})
    got = list(piece_trie.shared_prefixes(words, list(range(len(words))), block=7))
    assert got[0] == 0
    for a, b, n in zip(words, words[1:], got[1:]):
        assert n == min(48, next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))))


def test_unigram_paths_have_the_best_sum():
    pieces = ("<unk>", "▁", "a", "b", "ab", "▁a", "bab", "▁ab")
    vocab = piece_trie.Vocabulary(pieces, (0.0, -2.0, -3.0, -3.1, -4.0, -3.5, -4.2, -6.5), (-1,) * 8, (False, *[True] * 7), 0, False)
    scores = dict(zip(pieces, vocab.scores))

    def best(word):
        if not word:
            return 0.0
        return max((scores[word[:n]] + best(word[n:]) for n in range(1, 4) if word[:n] in scores), default=-math.inf)

    r = random.Random(2)
    words = ["▁" + "".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(60)]
    words = sorted(set(words), key=words.index)
    flat, bounds = piece_trie.Encoder(vocab).encode_words(words)
    for word, (s, e) in zip(words, bounds.tolist()):
        ids = flat[s:e].tolist()
        assert "".join(pieces[i] for i in ids) == word
        assert sum(vocab.scores[i] for i in ids) == pytest.approx(best(word))


def test_exact_dedup(spark, odd, none):
    got = exact_dedup.dedup(odd).collect()
    assert len(got) == len(ODD) and exact_dedup.dedup(none).count() == 0
    groups = collections.defaultdict(list)
    for i, t, *_ in ODD:
        groups[normal(t)].append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    kept = collections.Counter()
    for r in got:
        ids = groups[sha[r["text_sha256"]]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    assert exact_dedup.kept_documents(odd).columns == odd.columns
    assert exact_dedup.kept_documents(odd).count() == len(groups)


def test_trie_against_a_dictionary():
    r = random.Random(5)
    trie, seen = exact_dedup.Trie(), {}
    for k in range(2000):
        t = "".join(r.choice("ab") for _ in range(r.randint(0, 7))).encode()
        i = None if r.random() < 0.1 else r.randint(0, 50)
        trie.insert(t, i, 1, 1, 0, "")
        seen.setdefault(t, []).append(i)
    assert exact_dedup._bytes(trie.root) - exact_dedup.NODE_BYTES == trie.size
    inner = [child for child in trie.root[1].values() if child[1]]
    assert inner and all(len(child[1]) > 1 or child[2] for child in inner)  # strings share their beginnings
    whole, before = list(trie.terminals()), trie.size
    cut = list(trie.spill(trie.size * 2 // 3))
    assert 0 < len(cut) < len(whole) and trie.size < before and sorted(map(str, [*cut, *trie.terminals()])) == sorted(map(str, whole))
    found = {t: (least, n_least, n) for t, least, n_least, n, *_ in whole}
    for t, ids in seen.items():
        least = min((i for i in ids if i is not None), default=None)
        assert found.pop(t) == (least, ids.count(least), len(ids))
    assert not found


def test_owners_that_unload_early(spark, odd):
    rows = lambda df: sorted(map(str, df.collect()))
    more = odd.unionByName(odd.withColumn("text", F.concat(F.lit("one two three "), "text")))
    for held in (10, 2000, 20_000):
        assert rows(exact_dedup.owners(more, held_bytes=held)) == rows(exact_dedup.owners(more))


def jaccard(a, b, size=5):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def near_texts():
    r = random.Random(7)
    out = []
    for base in range(12):
        words = [f"w{base}x{r.randint(0, 400)}" for _ in range(r.choice([6, 12, 60, 200]))]
        for copy in range(r.choice([1, 2, 5, 25])):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"n{r.randint(0, 9999)}"
            out.append(" ".join(w))
    common = " ".join(f"c{k}" for k in range(40))
    return out + [common + " " + " ".join(f"u{k}v{j}" for j in range(80)) for k in range(40)]


def test_near_join_against_all_pairs(spark, odd, none):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(near_texts())] + [(1000 + k, *r[1:]) if r[0] is not None else r for k, r in enumerate(ODD)]
    got = {(r["doc_id"], k): r for k, r in enumerate(near_join.similar(spark.createDataFrame(rows, DOCS).repartition(3), plan=near_join.Plan(block=16)).collect())}
    by_id = {i: r for (i, _), r in got.items()}
    links = collections.defaultdict(set)
    for a, (i, s, *_) in enumerate(rows):
        for b, (j, t, *_) in enumerate(rows[:a]):
            if jaccard(s, t) >= 0.8 - 1e-9:
                links[a].add(b)
                links[b].add(a)
    seen = set()
    for a in range(len(rows)):
        if a not in seen:
            todo, group = [a], set()
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += links[x]
            seen |= group
            least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
            for x in group:
                r = by_id[rows[x][0]]
                assert (r["class_id"], r["class_size"], r["n_links"]) == (least, len(group), len(links[x])), rows[x][0]
    assert near_join.similar(none).count() == 0
    kept = near_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(
        str(x) for x in [(1, ODD[0][1]), (3, None), (4, ""), (5, " \n "), (None, ODD[6][1]), (7, "twice"), *[(i, t) for i, t, *_ in ODD[9:]]])


def test_one_of_each_decides_by_text(spark):
    base = [f"w{k}" for k in range(60)]
    near = lambda n, *at: " ".join(f"x{n}" if k in at else w for k, w in enumerate(base))
    other = lambda n: " ".join(f"{n}v{k}" for k in range(30))
    rows = [(3, near(0)), (None, near(1, 0)), (None, other("a")), (None, other("b")), (7, near(2, 59)), (7, other("c"))]
    rows += [(8, other("d") + " x"), (8, other("d") + " y"), (None, other("e") + " x"), (None, other("e") + " y"), (9, other("f")), (9, other("f")), (9, " " + other("f")), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in near_join.one_of_each(docs).collect()]
    alone = [(3, near(0)), (None, other("a")), (None, other("b")), (7, other("c")), (None, None), (None, "")]
    assert len(got) == len(alone) + 3 and all(got.count(r) == 1 for r in alone)
    for n, i in (("d", 8), ("e", None), ("f", 9)):
        assert [r[0] for r in got if r[1] and other(n) in r[1]] == [i]
    assert len(near_join.one_of_each(docs.where("doc_id = 8 or doc_id = 3")).collect()) == 2


def test_pruning_keeps_what_it_should():
    plan = near_join.Plan()
    for n, least in plan.least_matches():
        assert 0 < least <= n
        # a pair at the threshold is dropped here with a chance of about the tolerance
        lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least))
        assert lost < 1e-4


def base_spans(t):
    def luhn(d):
        return sum((x * 2 - 9 if x > 4 else x * 2) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end(), "card")] * (14 <= len(d) <= 19 and luhn(d))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        out += [(m.start(), 3, m.end(), "phone")] * (10 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii_base_spans(spark, odd, none):
    r = random.Random(9)
    bits = [*"ab1290.-+@ ()%_é𝒳", "192.168.1.1", "4111 1111 1111 1111", "a@b.co", "+49 (30) 1234567", "300.1.1.1", "4111-1111-1111-1111"]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randint(0, 50)))) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    texts = dict(rows)
    for x in pii.digest(pii.find(docs)).collect():
        t = texts.get(x["doc_id"])
        if t is not None and x["doc_id"] > 10:
            base = base_spans(t)
            assert x["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            assert [x[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [base.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
            assert set(base.split(",")) <= set(x["spans"].split(",")) or not base
    assert pii.digest(pii.find(none)).count() == 0


def test_pii_added_kinds_and_redaction(spark):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    said = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(spark.createDataFrame([(0, f'my token = "{token}" x'), (1, f"commit {token}"), (2, "key: " + "a" * 40)], "doc_id long, text string")).collect()}
    assert said == {0: ["secret"], 1: [], 2: []}
    texts = ["my iban DE89 3704 0044 0532 0130 00 is", "DE89 3704 0044 0532 0130 01", "ssn: 123-45-6789", "part no 123-45-6789", "é mail a@b.co, b@c.de", "many a@b.co " * 200]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in found.collect()}
    assert kinds[0] == ["iban"] and kinds[1] == [] and kinds[2] == ["ssn"] and kinds[3] == []
    assert [s["start"] for s in found.where("doc_id = 5").first()["spans"]] == [5 + 12 * k for k in range(200)]
    assert found.where("doc_id = 4").select(pii.redact(found)).first()[0] == "é mail <email>, <email>"


def letters_docs(n=240):
    r = random.Random(4)
    sounds = {"xx": "thandedingre", "yy": "ouêtréqueauxé", "zz": "schßungküver"}
    return [(k, " ".join("".join(r.choice(sounds[g]) for _ in range(r.randint(2, 8))) for _ in range(40)), g, g, 0) for k in range(n) for g in [("xx", "yy", "zz")[k % 3]]]


def test_language_id(spark, odd, none):
    docs = spark.createDataFrame(letters_docs(), DOCS)
    model = langid.fit(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, model).collect()}
    assert len(und) == len({r[0] for r in ODD}) and und[3] == und[4] == und[5] == "und" and und[8] != "und"
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def grams(text, orders=(1, 2, 3, 4), n_buckets=1 << 16):
    """The hashed n-grams of a text, one at a time."""
    out, m = [], (1 << 64) - 1
    for word in re.split(r"[\x20\x09-\x0D]+", text.lower()):
        if word:
            points = [ord(c) for c in f" {word} "]
            for n in orders:
                for k in range(len(points) - n + 1):
                    h = 0
                    for p in points[k : k + n]:
                        h = (h * 0x9E3779B97F4A7C15 + p) & m
                    out.append(((((h + n) * 0xFF51AFD7ED558CCD) & m) >> 40) % n_buckets)
    return out


def test_language_id_by_hand(spark):
    rows = letters_docs(60)
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, DOCS), langid.fit(spark.createDataFrame(rows, DOCS))).collect()}
    counts = {g: collections.Counter() for g in ("xx", "yy", "zz")}
    for i, t, g, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not got[i]["held_out"]:
            counts[g].update(grams(t))
    total = {g: sum(c.values()) + 0.5 * (1 << 16) for g, c in counts.items()}
    for i, t, *_ in rows:
        logs = {g: sum(math.log((c[b] + 0.5) / total[g]) for b in grams(t)) for g, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-3)


def test_toxicity_by_hand(spark, labels):
    """Weights, drift and scores once more, a document and a word at a time."""
    r = random.Random(16)
    rows, marks = [], {}
    for k in range(300):
        w = ["".join(r.choice("thandeirs") for _ in range(r.randint(5, 9))) for _ in range(60)]  # no two texts share a pair of words
        marks[k] = int(k % 3 == 0)
        if marks[k]:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(60)] = r.choice(["vilest", "Nasty,", "foulest", "grimo" + r.choice("abcdefghijklmnop") + r.choice("xyz"), "onlyone"])
        elif r.random() < 0.3:
            w[r.randrange(60)] = "kindest"
        rows.append((k, " ".join(w), "en", "s", 0))
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, 1, t) for k, t in marks.items()], labels.schema))

    def seen(word):
        w = word.lower().strip(toxicity.EDGES)
        return [w, *(w[:n] + "~" for n in toxicity.STEMS if len(w) > n)]

    learnt = [(t, marks[i]) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5]
    size = collections.Counter(y for _, y in learnt)
    has = {y: collections.Counter(x for t, z in learnt if z == y for x in {s for w in t.split() for s in seen(w)}) for y in (0, 1)}
    stats = {}
    for token in has[0].keys() | has[1].keys():
        if has[0][token] + has[1][token] >= 3:
            mass = 50 * (has[0][token] + has[1][token]) / (size[0] + size[1])
            odds = [math.log((has[y][token] + mass) / (size[y] + 50 - has[y][token] - mass)) for y in (0, 1)]
            error = math.sqrt(sum(1 / (has[y][token] + mass) for y in (0, 1)))
            delta = odds[1] - odds[0]
            stats[token] = (math.copysign(abs(delta) - error, delta) if abs(delta) > error else 0.0, delta / error)
    bar = max(3.5, math.sqrt(2 * math.log(sum(has[1][t] >= 3 for t in stats))))
    weights = {t: w for t, (w, z) in stats.items() if z >= bar and w >= 1 and has[1][t] >= 3 or z <= -2 and t[-1] != "~"}
    words = {t for t in has[1] if t[-1] != "~" and weights.get(t, 0) <= 0}
    weights = {t: w for t, w in weights.items() if t[-1] != "~" or sum(x.startswith(t[:-1]) for x in words) >= 5}
    assert model.weights == pytest.approx(weights) and {"vilest", "grimo~"} <= set(weights) and "foul~" not in weights and weights["kindest"] < 0

    def weight(word, drift):
        return next((weights[s] for s in seen(word) if s in weights), drift)

    hits = [(sum(weight(w, 0) > 0 for t, y in learnt if y == z for w in t.split()) + 0.5) / (60 * size[z] + 1) for z in (0, 1)]
    drift = min(-1e-3, math.log((1 - hits[1]) / (1 - hits[0])))
    assert model.drift == pytest.approx(drift) and model.log_k == pytest.approx(math.log(-drift))
    for x in toxicity.score(spark.createDataFrame(rows[:60], DOCS), model).collect():
        w = [weight(t, drift) for t in rows[x["doc_id"]][1].split()]
        over, at = [], 0
        best = [(sum(w[i:j]), i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w[i] > 0 and w[j - 1] > 0]
        while best:  # the best segment, then the best of what doesn't touch it
            s, i, j = max(best, key=lambda b: (round(b[0], 9), b[1] - b[2]))
            over.append(s - model.log_k - math.log(len(w)))
            best = [b for b in best if b[2] <= i or b[1] >= j]
        beyond = [o for o in over if o > 0]
        excess = sum(beyond) if beyond else max(over) if over else -model.log_k - math.log(len(w))
        assert x["score"] == pytest.approx(math.exp(-math.exp(-(excess - model.location) / model.scale)), abs=1e-6)


def test_toxicity(spark, odd, none, labels):
    r = random.Random(6)
    rows, marks = [], []
    for k in range(400):
        w = ["".join(r.choice("thandeirs") for _ in range(r.randint(2, 6))) for _ in range(80)]
        toxic = k % 4 == 0
        if toxic:
            w[r.randrange(80)] = r.choice(["vilest", "Nasty,", "foul!"])
        rows.append((k, " ".join(w), "en", "s", 0))
        marks.append((k, 1, int(toxic)))
    docs, given = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, labels.schema)
    model = toxicity.fit(docs, given)
    got = toxicity.score(docs, model).join(given, "doc_id").where("held_out").collect()
    assert sum(x["predicted"] == x["toxic"] for x in got) >= 0.97 * len(got)
    assert {x["doc_id"] for x in toxicity.clean_documents(docs, model).collect()} == {x["doc_id"] for x in toxicity.score(docs, model).where("predicted = 0").collect()}
    for m in (model, toxicity.fit(none, labels), toxicity.fit(docs, labels)):
        out = toxicity.score(odd, m).collect()
        assert len(out) == len(ODD) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in out)
    assert toxicity.clean_documents(odd, model).columns == odd.columns and toxicity.score(none, model).count() == 0


def test_passages_after_the_first_occurrences():
    bad = ["vilest", "nasty", "foul", "rotten", "hateful"]
    model = toxicity.Model({w: 4.0 for w in bad}, -0.05, math.log(0.05), 3.0, 1.0)
    gap = ["plain"] * 400
    scattered = [x for w in bad for x in (w, *gap)]
    texts = [scattered, scattered + bad, bad + gap + bad + gap + bad, bad[:1] * 5, bad[:1]]
    found = toxicity._excesses(pa.array([" ".join(t) for t in texts]), model)
    assert [n for _, n in found] == [0, 1, 3, 1, 1] and found[3][0] > found[4][0] + 10
    value, _ = toxicity._chances(pa.array([" ".join(t) for t in texts]), model)
    assert list(value >= 0.5) == [False, True, True, True, True]


def test_segments_are_the_maximal_ones():
    import numpy as np

    def brute(w, base=0):
        """The best segment, then those to its left and right: what the recursive definition says."""
        best, at = 0.0, None
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                s = sum(w[i:j])
                if s > best + 1e-12 or at and abs(s - best) < 1e-12 and (j - i) < at[1] - at[0]:
                    best, at = s, (i, j)
        if at is None:
            return []
        return brute(w[: at[0]], base) + [(base + at[0], base + at[1], best)] + brute(w[at[1] :], base + at[1])

    r = random.Random(8)
    for _ in range(200):
        w = [r.uniform(-3, 2) for _ in range(r.randint(0, 14))]
        assert [(s, e, pytest.approx(v)) for s, e, v in brute(w)] == toxicity.segments(np.array(w))


def test_mixing(spark, odd, none):
    r = random.Random(10)
    rows = [(k, "w " * int(r.paretovariate(1.2) * 3) if k else "w " * 900, "en", r.choice(["a", "a", "a", "b", "c", None]), 0) for k in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    size = {k: t.count("w") for k, t, *_ in rows}
    total, sources = sum(size.values()), collections.Counter()
    for k, _, _, s, _ in rows:
        sources[s] += size[k]
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    target, free = {}, set(sources)
    while True:  # those over three times their size stop there, the others share the rest
        rest = total - sum(3 * sources[s] for s in sources if s not in free)
        target = {s: rest * weight[s] / sum(weight[x] for x in free) if s in free else 3.0 * sources[s] for s in sources}
        over = {s for s in free if target[s] > 3 * sources[s]}
        if not over:
            break
        free -= over
    taken = collections.Counter()
    for x in got:
        assert x["size"] == size[x["doc_id"]] and x["source_size"] == sources[x["source"]] and x["target"] == pytest.approx(target[x["source"]])
        assert x["taken"] in {n * x["size"] for n in range(4)}
        taken[x["source"]] += x["taken"]
    assert len(got) == len(rows)
    for s in sources:
        largest = max(size[k] for k, _, _, x, _ in rows if x == s)
        # one document can hold more words than the others can make up for
        assert abs(taken[s] - target[s]) <= (0.01 * target[s] + 5 if largest < 0.1 * target[s] else largest)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(x["copies"] for x in got if x["size"])
    odd_rows = mixing.mix(odd).collect()
    assert len(odd_rows) == len(ODD) and all(x["taken"] <= 3 * x["size"] for x in odd_rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(odd).columns == odd.columns
    copies, taken = collections.Counter(), collections.Counter()
    for x in odd_rows:
        taken[x["doc_id"], x["source"], x["size"]] += x["copies"] if x["size"] else 0
    for x in mixing.mixed_documents(odd).select("doc_id", "source", "text").collect():
        copies[x["doc_id"], x["source"], len(re.findall(r"[^\x20\x09-\x0D]+", x["text"]))] += 1
    assert copies == +taken
    repeated = spark.createDataFrame([(1, f"w{k % 3} x y", "en", "s", 0) for k in range(50)] + [(2, "a b", "en", "t", 0)], DOCS).repartition(4)
    assert mixing.mixed_documents(repeated).where("doc_id = 1").count() == sum(x["copies"] for x in mixing.mix(repeated).collect() if x["doc_id"] == 1)


def test_documents_are_taken_as_often_as_expected(spark):
    """Over many sources alike, mean copies are target / source_size, of large documents and small ones."""
    sizes, sources = [400, 90, 60, *[5] * 250, *[2] * 200], 90
    units = [(1000 * s + k, f"s{s:03}", n, 1) for s in range(sources) for k, n in enumerate(sizes)]
    by = collections.defaultdict(list)
    for x in mixing.mix_units(spark.createDataFrame(units, "id long, source string, size long, m long")).collect():
        by[x["source"]].append(x)
    seen, rates = collections.defaultdict(list), {}
    for s, rows in by.items():
        rate = rates.setdefault(int(s[1:]) % 3, rows[0]["target"] / rows[0]["source_size"])
        p = rate % 1
        # the last unit is a small one; what the largest document takes too much or too little, the others make up for as far as they can
        missing = max(0, max(p, 1 - p) * max(sizes) - min(p, 1 - p) * sum(x for x in sizes if x < 90))
        assert abs(sum(x["n"] * x["size"] for x in rows) - rows[0]["target"]) <= 5 + missing
        for x in rows:
            assert x["n"] in (math.floor(rate), math.ceil(rate))
            seen[int(s[1:]) % 3, x["size"]].append(x["n"])
    for (weight, size), n in seen.items():
        p = rates[weight] % 1
        # the odd copies of small documents of one source make up for its large ones, so the sources are the sample
        assert abs(sum(n) / len(n) - rates[weight]) <= 4 * math.sqrt(p * (1 - p) / (sources / 3)), (weight, size)


def test_whole_parts_and_copies_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 0)] * 7 + [(2, "a b", "en", "t", 0)], DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == 8 and sum(x["taken"] for x in got if x["source"] == "s") == pytest.approx(got[0]["target"] if got[0]["source"] == "s" else got[-1]["target"], abs=3)


def test_pipeline_stages(spark, none, labels, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(near_texts())] + [(5000 + k, near_texts()[k], "en", "s1", 1) for k in range(20)]
    for name, df in (("documents", spark.createDataFrame(rows, DOCS)), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        sizes.append(docs.count())
        assert name == "sentencepiece" or docs.columns == before.columns
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert sizes[0] == len(rows) and sizes[1] == len({normal(t) for _, t, *_ in rows})
    groups = near_join.similar(spark.createDataFrame(rows, DOCS)).select("class_id").distinct().count()
    assert sizes[2] == groups and sizes[4] == sizes[3] == corpus_pipeline.run(spark, str(tmp_path)).count()


def test_pipeline_against_brute_force(spark, labels, tmp_path):
    """Rows with nulls, repeats, ties and very long texts through all stages, and each document that should come out."""
    import public_tokenizers
    import sentencepiece

    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(near_texts())] + [(1000 + r[0] if r[0] is not None else None, *r[1:]) for r in ODD]
    for name, df in (("documents", spark.createDataFrame(rows, DOCS)), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    order = lambda r: (r[0] is None, r[0] or 0)
    by_text = {}
    for r in sorted(rows, key=order):
        by_text.setdefault(normal(r[1]), r)
    left, classes = list(by_text.values()), []
    for r in left:  # classes of linked texts
        met = [c for c in classes if any(jaccard(r[1], x[1]) >= 0.8 - 1e-9 for x in c)]
        classes = [c for c in classes if c not in met] + [[r, *(x for c in met for x in c)]]
    kept = [min(c, key=order) for c in classes]
    expected = {(r[0], r[1]): r for r in kept}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(str((r["doc_id"], r["text"])) for r in docs.collect()) == sorted(map(str, expected))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(registry.TOKENIZER))
    coded = {(i, tuple(sp.encode(t or ""))): source for (i, t), (_, _, _, source, _) in expected.items()}
    taken = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in out)
    assert set(taken) <= set(coded) and max(taken.values()) <= 3
    target = {r["source"]: r["target"] / r["source_size"] for r in mixing.mix(docs).collect() if r["source_size"]}
    for key, n in taken.items():
        assert n in (math.floor(target[coded[key]]), math.ceil(target[coded[key]]))
