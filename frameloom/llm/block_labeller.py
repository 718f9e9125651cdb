"""The recurrent block labeller: a bidirectional LSTM in numpy, its training on made-up pages, and text extraction."""

from __future__ import annotations

import random
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_blocks
from .common import packed

WEIGHTS = Path(__file__).with_name("block_labeller.npz")
HIDDEN = 24
NAMES = ("wf", "uf", "bf", "wb", "ub", "bb", "v", "c")


def fresh(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = html_blocks.WIDTH, HIDDEN
    p = {}
    for s in "fb":
        p["w" + s] = rng.normal(0, 0.08, (d, 4 * h))
        p["u" + s] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        p["b" + s] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])  # forget gates start open
    p["v"], p["c"] = rng.normal(0, 0.2, 2 * h), np.zeros(1)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(projected: np.ndarray, u: np.ndarray, mask: np.ndarray, kept: list | None = None) -> np.ndarray:
    """Hidden states over time (time, batch, hidden) for projected inputs; padded steps carry the state on."""
    t, n, _ = projected.shape
    h = u.shape[0]
    state, cell, out = np.zeros((n, h), projected.dtype), np.zeros((n, h), projected.dtype), np.zeros((t, n, h), projected.dtype)
    for k in range(t):
        z = projected[k] + state @ u
        gates = _sigmoid(z[:, : 3 * h])
        i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
        m = mask[k][:, None]
        new = f * cell + i * g
        tanh = np.tanh(new)
        if kept is not None:
            kept.append((i, f, o, g, cell, tanh, state, m))
        cell = np.where(m, new, cell)
        state = np.where(m, o * tanh, state)
        out[k] = state
    return out


def projected(p: dict[str, np.ndarray], rows) -> np.ndarray:
    """What both directions' gates get of each block of a page, given its feature rows in slices: features are dropped as
    soon as they are projected, so a page of any number of blocks takes 8 * HIDDEN numbers a block."""
    w, b = np.concatenate([p["wf"], p["wb"]], axis=1), np.concatenate([p["bf"], p["bb"]])
    parts = [x @ w + b for x in rows]
    return np.concatenate(parts) if parts else np.zeros((0, len(b)), dtype=b.dtype)


def sliced(found: list, most: int = 512):
    """Feature rows of a page's blocks, so many at a time."""
    return (html_blocks.features(found[s : s + most], s) for s in range(0, len(found), most))


def probabilities(p: dict[str, np.ndarray], pages: list[np.ndarray], cells: int = 1 << 15) -> list[np.ndarray]:
    """Per page of projected blocks, each block's probability of being main text. Pages of like length are batched, so many
    that padded blocks number about `cells`, or one page; each is read whole."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
    half = 4 * HIDDEN
    while order:
        rows = order[:1]
        while len(rows) < len(order) and len(pages[order[len(rows)]]) * (len(rows) + 1) <= cells:
            rows.append(order[len(rows)])
        order = order[len(rows) :]
        x, mask = _padded([pages[k] for k in rows])
        hf = _run(x[:, :, :half], p["uf"], mask)
        hb = _run(x[::-1, :, half:], p["ub"], mask[::-1])[::-1]
        y = _sigmoid(hf @ p["v"][:HIDDEN] + hb @ p["v"][HIDDEN:] + p["c"])
        for j, k in enumerate(rows):
            out[k] = y[: len(pages[k]), j]
    return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), pages[0].shape[1]), dtype=np.float32), np.zeros((t, len(pages)), dtype=bool)
    for j, page in enumerate(pages):
        x[: len(page), j] = page
        mask[: len(page), j] = True
    return x, mask


def _gradients(p: dict[str, np.ndarray], pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
    x, mask = _padded(pages)
    y = np.zeros(mask.shape)
    for j, label in enumerate(labels):
        y[: len(label), j] = label
    kept_f, kept_b = [], []
    hf = _run(x @ p["wf"] + p["bf"], p["uf"], mask, kept_f)
    hb = _run((x @ p["wb"] + p["bb"])[::-1], p["ub"], mask[::-1], kept_b)[::-1]
    both = np.concatenate([hf, hb], axis=2)
    q = _sigmoid(both @ p["v"] + p["c"])
    n = mask.sum()
    loss = -float((np.where(y > 0, np.log(q + 1e-9), np.log(1 - q + 1e-9)) * mask).sum() / n)
    delta = (q - y) * mask / n
    g = {"v": np.einsum("tn,tnh->h", delta, both), "c": np.array([delta.sum()])}
    back = delta[:, :, None] * p["v"]
    for s, kept, d, inputs in (("f", kept_f, back[:, :, :HIDDEN], x), ("b", kept_b, back[::-1, :, HIDDEN:], x[::-1])):
        u, gu, dz_all = p["u" + s], np.zeros_like(p["u" + s]), np.zeros((*x.shape[:2], 4 * HIDDEN))
        dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
        for k in range(len(kept) - 1, -1, -1):
            i, f, o, c, cell, tanh, state, m = kept[k]
            dh = dh + d[k]
            do = dh * tanh
            dn = dc + dh * o * (1 - tanh * tanh)
            dz = np.concatenate([dn * c * i * (1 - i), dn * cell * f * (1 - f), do * o * (1 - o), dn * i * (1 - c * c)], axis=1) * m
            gu += state.T @ dz
            dz_all[k] = dz
            dh = np.where(m, dz @ u.T, dh)
            dc = np.where(m, dn * f, dc)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        g["w" + s], g["u" + s], g["b" + s] = inputs.reshape(-1, inputs.shape[2]).T @ flat, gu, flat.sum(axis=0)
    return g, loss


def train(n_pages: int = 6000, epochs: int = 6, seed: int = 11, rate: float = 4e-3) -> dict[str, np.ndarray]:
    """Fit the labeller on made-up pages (llm/made_up_pages.py) with Adam; the same seed gives the same weights."""
    from .made_up_pages import labelled_page

    rng = random.Random(seed)
    data = [labelled_page(rng) for _ in range(n_pages)]
    data = [(html_blocks.features([b for b, _ in page]), np.array([y for _, y in page], dtype=float)) for page in data if page]
    p = fresh(seed)
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        rng.shuffle(data)
        data.sort(key=lambda d: len(d[0]) // 8)
        batches = [data[s : s + 32] for s in range(0, len(data), 32)]
        rng.shuffle(batches)
        for batch in batches:
            # blocks without their words, now and then: their place has to do
            seen = [x.copy() for x, _ in batch]
            for x in seen:
                x[[rng.random() < 0.3 for _ in x], html_blocks.PATH_BUCKETS : html_blocks.PATH_BUCKETS + html_blocks.WORD_BUCKETS] = 0
            g, _ = _gradients(p, seen, [y for _, y in batch])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            t += 1
            for k in p:
                a = g[k] * min(1, 1 / norm) + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                p[k] -= rate * 0.6**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as z:
        return {k: z[k].astype(np.float32) for k in NAMES}


def extract(pages: DataFrame, html_col: str = "html", threshold: float = 0.5, batch_chars: int = 4 << 20) -> DataFrame:
    """pages with columns text, n_chars, n_blocks: the main text's blocks in page order, two line feeds between them.

    The whole html is parsed, and every block is labelled in the context of the whole page; a page of very many blocks is
    labelled alone, on projected blocks, of which 200,000 take about 150 MB. A null or empty html, and one
    without main text, gives the empty text. Other columns stay as they are; columns named text, n_chars or n_blocks are
    replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights())
    rows = packed(pages, html_col, without=("text", "n_chars", "n_blocks"))
    column = 1

    def run(batches):
        p = shared.value
        for batch in batches:
            start = 0
            while start < len(batch):
                end, size = start, 0
                while end < len(batch) and (end == start or size < batch_chars and end < start + 256):
                    size += len(batch.column(column)[end].as_py() or "")
                    end += 1
                part = batch.slice(start, end - start)
                start = end
                found = [html_blocks.blocks(h) for h in part.column(column).to_pylist()]
                labels = probabilities(p, [projected(p, sliced(b)) for b in found])
                kept = [[b.text for b, y in zip(bs, ys) if y >= threshold] for bs, ys in zip(found, labels)]
                texts = ["\n\n".join(k) for k in kept]
                new = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, kept), pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *new], ["row", "text", "n_chars", "n_blocks"])

    schema = rows.select("row").schema.add("text", "string").add("n_chars", "long").add("n_blocks", "integer")
    return rows.mapInArrow(run, schema).select("row.*", "text", "n_chars", "n_blocks")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of every page; repeated rows and null ids give a row each."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return extract(rows).select("page_id", "url", "text", "n_chars", "n_blocks")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: a.astype(np.float16) for k, a in train().items()})
