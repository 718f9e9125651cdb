"""Block labelling on made-up pages, and nearest neighbours against brute force."""

import collections
import html
import math
import pathlib
import random
import re
import subprocess
import sys

import numpy as np
import pytest

from frameloom.llm import block_labeller, html_blocks, made_up_pages, neighbours

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>The  title &amp; more</h1><p><b>First
 paragraph, long enough to say something &lt;here&gt;.<br>It goes on.<p>Second <a href="x">linked</a> paragraph has words too.</p><div class="ad">Buy now</div><p>Third paragraph ends the article here.</p></article>
<aside class="sidebar"><h3>Related articles</h3><p>Something else to read today.</p></aside><section id="comments"><h2>Comments</h2><p>I agree with this.</p></section>
<form><label>Your email</label><button>Subscribe</button></form><footer>&copy; 2023 Example. All rights reserved.</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (None, None, "<p>"), (4, "u", "x" * 100_000), (4, "u", "<div>" * 5000 + "deep"), (5, "u", '<p title="unclosed>text</p>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = block_labeller.main_text(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = next(r["text"] for r in got if r["page_id"] == 1)
    assert text == "The title & more\n\nFirst paragraph, long enough to say something <here>. It goes on.\n\nSecond linked paragraph has words too.\n\nThird paragraph ends the article here."
    assert {r["text"] for r in got if r["page_id"] in (2, 3)} == {""}
    assert block_labeller.main_text(pages.limit(0)).count() == 0
    extra = block_labeller.extract(pages.withColumnRenamed("url", "path"))
    assert extra.columns == ["page_id", "path", "html", "text", "n_chars", "n_blocks"]


def test_features_read_whole_blocks_and_paths():
    start = "home news sport " * 20
    a, b = (html_blocks.features(html_blocks.blocks(f"<div>{start}{end}</div>"))[0] for end in ("rain fell over the hills " * 40, "call 555 1234 now. " * 40))
    words = slice(html_blocks.PATH_BUCKETS, html_blocks.PATH_BUCKETS + html_blocks.WORD_BUCKETS)
    assert np.abs(a[words] - b[words]).max() > 0.1 and b[-4] > a[-4] == 0
    plain, footer = (html_blocks.blocks(f"<{tag}>" + "<div>" * 100 + "text" + "</div>" * 100 + f"after</{tag}>end") for tag in ("section", "footer"))
    assert [(x.path != y.path).any() for x, y in zip(plain, footer)] == [True, True, False]
    # linear in the depth: unclosed elements, each with text, and closing tags that close nothing
    assert len(html_blocks.blocks("".join(f'<div class="c{chr(97 + k % 26)}x">t' for k in range(20_000)) + "</p>" * 20_000)) == 20_000


def test_labeller_on_pages_it_has_not_seen():
    rng = random.Random(4242)
    pages = [p for p in (made_up_pages.labelled_page(rng) for _ in range(200)) if p]
    w = block_labeller.weights()
    found = block_labeller.probabilities(w, [block_labeller.projected(w, block_labeller.sliced([b for b, _ in p])) for p in pages])
    right = [(q >= 0.5) == y for page, qs in zip(pages, found) for q, (_, y) in zip(qs, page)]
    assert np.mean(right) > 0.99


def test_batches_and_slices_do_not_change_labels():
    rng = random.Random(7)
    w = block_labeller.weights()
    blocks = [[b for b, _ in made_up_pages.labelled_page(rng)] for _ in range(20)]
    pages = [block_labeller.projected(w, block_labeller.sliced(b)) for b in blocks]
    alone = [block_labeller.probabilities(w, [p])[0] for p in pages]
    for cells in (1, 60, 1 << 15):
        for a, b in zip(alone, block_labeller.probabilities(w, pages, cells)):
            assert np.allclose(a, b, atol=1e-4)
    for b, p in zip(blocks, pages):
        assert np.allclose(p, block_labeller.projected(w, block_labeller.sliced(b, 3)), atol=1e-4)


def test_a_page_of_very_many_blocks_takes_bounded_memory():
    code = """
import resource, sys
from frameloom.llm import block_labeller as L, html_blocks
w = L.weights()
few = html_blocks.blocks("<p>One block.</p>")
many = html_blocks.blocks("<p>Short.</p>" * 200_000)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = L.probabilities(w, [L.projected(w, L.sliced(b)) for b in [few] * 63 + [many]])
assert len(found[-1]) == 200_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=pathlib.Path(__file__).parents[2])
    assert int(said.stdout.split()[-1]) < 500


def test_gradients():
    rng = np.random.default_rng(1)
    p = block_labeller.fresh(3)
    pages = [rng.normal(size=(n, html_blocks.WIDTH)) * 0.1 for n in (3, 5)]
    labels = [rng.integers(0, 2, n).astype(float) for n in (3, 5)]
    g, _ = block_labeller._gradients(p, pages, labels)
    for name in block_labeller.NAMES:
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        p[name][at] += 1e-4
        up = block_labeller._gradients(p, pages, labels)[1]
        p[name][at] -= 2e-4
        down = block_labeller._gradients(p, pages, labels)[1]
        p[name][at] += 1e-4
        assert g[name][at] == pytest.approx((up - down) / 2e-4, abs=2e-4)


def article(page):
    """What a reader marks as main text on the table's pages, each of which has one article: its blocks, a blank line apart."""
    inside = re.search(r"(?s)<article[^>]*>(.*?)</article>", page)[1]
    blocks = re.split(r"(?i)</?(?:h[1-6]|p|div|ul|ol|li|section|table|tr|td|blockquote)\b[^>]*>", inside)
    plain = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", b))).split()) for b in blocks]
    return "\n\n".join(b for b in plain if b)


def test_main_text_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in block_labeller.main_text(pages).collect()}
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want) and len(got) == len(want)
    words = lambda t: collections.Counter(t.split())
    both = sum(sum((words(got[k]) & words(want[k])).values()) for k in want)
    assert both >= 0.99 * max(sum(map(len, map(str.split, want.values()))), sum(map(len, map(str.split, got.values()))))


def exact(rows, k=20):
    good = [(i, v) for i, v in rows if i is not None and v and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    wide = max(len(v) for _, v in good)
    x = np.array([[*v, *[0.0] * (wide - len(v))] for _, v in good], dtype=np.float64)
    for r, (q, _) in enumerate(good):
        if q % 20 == 0:
            scores = x @ x[r]
            best = sorted((-float(scores[o]), i) for o, (i, _) in enumerate(good) if o != r)[:k]
            yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(best))


def test_search_against_brute_force(spark):
    r = random.Random(2)
    f = lambda: float(np.float32(r.gauss(0, 1)))
    same = [f() for _ in range(8)]
    rows = [(k, same if k % 3 == 0 else [f() for _ in range(8)]) for k in range(200)]
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [None] * 8), (380, [1.0] * 3), (None, same), (199, rows[199][1]), (400, []), (20, [f() for _ in range(8)]), (60, same), (60, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", __import__("pyspark").sql.functions.lit(1)).withColumn("x", __import__("pyspark").sql.functions.lit(1))
    got = sorted(tuple(x) for x in neighbours.search(df, recall=1.0, tested=200).collect())
    want = sorted(exact(rows))
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
    assert neighbours.search(df.limit(0)).count() == 0
    few = neighbours.search(df.where("vec_id < 5")).collect()
    assert len(few) == 4


def recall(spark, x, **how):
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(np.asarray(x, dtype=np.float32))]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **how).collect()
    want = {(q, i) for q, _, i, _ in exact(rows)}
    return len({(r["query_id"], r["vec_id"]) for r in got} & want) / len(want)


def test_recall_over_partitions(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    assert recall(spark, centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 8)), sample_rows=1000, part_rows=300) >= 0.93
    assert recall(spark, rng.normal(size=(2000, 16)), sample_rows=600, part_rows=150) >= 0.9  # no structure to learn


def test_fewer_partitions_are_visited_where_vectors_cluster(spark):
    rng = np.random.default_rng(5)
    centres = 4 * rng.normal(size=(16, 8))
    x = centres[rng.integers(0, 16, 2000)] + 0.3 * rng.normal(size=(2000, 8))
    router = neighbours.fit_router(x[:1000], 8)
    at = router.logits(x).argmax(axis=1)
    index = spark.createDataFrame([([float(c) for c in v], int(p)) for v, p in zip(x, at)], "x array<double>, part int").repartition(3)
    found = neighbours.set_probes(router, index, x[1000:1100], 20, 0.95)
    top = np.argsort(-(x[1000:1100] @ x.T), axis=1)[:, 1:21]
    visited = np.argsort(-router.logits(x[1000:1100]), axis=1)[:, : router.probes]
    true = np.mean([[p in v for p in at[row]] for row, v in zip(top, visited)])
    assert router.probes < 8 and found >= 0.95 and abs(true - found) < 0.01


def test_recall_on_the_table(spark):
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {(q, i) for q, _, i, _ in exact(rows)}
    got = neighbours.search(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)


def test_parts_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6))
    graph = neighbours.nearest(x, x, 8, np.arange(600))
    sizes = np.bincount(neighbours.balanced_parts(x, graph, 5), minlength=5)
    assert sizes.max() <= 133 and sizes.min() > 60
