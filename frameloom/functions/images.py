"""Measures of small grey images given as arrays of values 0 to 255: as columns, and over stacked images in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def average_hash(pixels: Column) -> Column:
    """64 bits of an 8 by 8 image, set where a pixel is over the whole mean."""
    mean = F.floor(F.aggregate(pixels, F.lit(0).cast("long"), lambda a, v: a + v) / 64)
    bits = F.transform(pixels, lambda v, i: F.when(v > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def entropy(pixels: Column) -> Column:
    """Shannon entropy of the values' distribution, in bits."""
    n = F.size(pixels)
    share = lambda v: F.size(F.filter(pixels, lambda p: p == v)) / n
    terms = F.transform(F.array_distinct(pixels), lambda v: -share(v) * F.log2(share(v)))
    return _sum(terms)


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity over the whole image."""
    n = F.size(a)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = _sum(a) / n, _sum(b) / n
    va, vb = _sum(F.transform(a, lambda v: (v - ma) * (v - ma))) / (n - 1), _sum(F.transform(b, lambda v: (v - mb) * (v - mb))) / (n - 1)
    cov = _sum(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb))) / (n - 1)
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def hash16(pixels: Column) -> Column:
    """The last 16 bits of the average hash."""
    return average_hash(pixels).bitwiseAND(0xFFFF)


def stacked_hash(x: np.ndarray) -> np.ndarray:
    """average_hash of images in rows, square ones of a side that eight divides brought down to 8 by 8 by block means."""
    n, size = x.shape
    side = int(round(size**0.5))
    if side > 8 and side * side == size and side % 8 == 0:
        x = np.floor(x.reshape(n, 8, side // 8, 8, side // 8).mean(axis=(2, 4))).reshape(n, 64)
    over = x[:, :64] > np.floor(x[:, :64].sum(axis=1, keepdims=True) / 64)
    return (over.astype(np.uint64) << np.arange(over.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def stacked_entropy(x: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(x), 256))
    np.add.at(counts, (np.repeat(np.arange(len(x)), x.shape[1]), x.astype(np.int64).ravel()), 1)
    share = counts / x.shape[1]
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)


def stacked_ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ssim of each row of a with that of b."""
    n = a.shape[1]
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = a.mean(axis=1), b.mean(axis=1)
    da, db = a - ma[:, None], b - mb[:, None]
    va, vb, cov = ((p * q).sum(axis=1) / (n - 1) for p, q in ((da, da), (db, db), (da, db)))
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
