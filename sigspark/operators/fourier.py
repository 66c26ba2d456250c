"""Fourier transforms of whole recordings in four steps: short transforms, twiddles, a transposing shuffle, short transforms.

A series of N = N1 N2 samples is a matrix of N1 rows.  Its columns are transformed in blocks, each by one task; every
block is cut into tiles that are sent to the rows they belong to; and rows are transformed in blocks.  A task holds about
``TILE`` numbers, or one column or row.  Where N has no factors of about its root, the transform is a convolution with a
chirp, of a length that has them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 1 << 18


def factors(n: int) -> tuple[int, int] | None:
    """Two factors of n, the lesser first, neither over sixteen times the other; None if there are none."""
    for a in range(math.isqrt(n), 0, -1):
        if 16 * a * a < n:
            return None
        if n % a == 0:
            return a, n // a
    return None


def _four_steps(samples: DataFrame, n1: int, n2: int, keys: Sequence[str], tile: int) -> DataFrame:
    kinds = dict(samples.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in keys)
    columns, rows = max(1, min(n2, tile // n1)), max(1, min(n1, tile // n2))

    def down(got: pd.DataFrame) -> pd.DataFrame:
        block = int(got["_block"].iloc[0])
        first, width = block * columns, min(columns, n2 - block * columns)
        x = np.zeros((n1, width), complex)
        at = got["idx"].to_numpy()
        x[at // n2, at % n2 - first] = got["re"].to_numpy() + 1j * got["im"].to_numpy()
        x = np.fft.fft(x, axis=0)
        # k1 n2 is below N, so the angle is exact enough in doubles for any length that fits.
        x *= np.exp(-2j * np.pi / (n1 * n2) * np.outer(np.arange(n1), first + np.arange(width)))
        tiles = [x[a : a + rows] for a in range(0, n1, rows)]
        return pd.DataFrame({**{k: [got[k].iloc[0]] * len(tiles) for k in keys}, "_row": range(len(tiles)), "_first": first, "re": [t.real.ravel() for t in tiles], "im": [t.imag.ravel() for t in tiles]})

    def across(got: pd.DataFrame) -> pd.DataFrame:
        first = int(got["_row"].iloc[0]) * rows
        height = min(rows, n1 - first)
        x = np.zeros((height, n2), complex)
        for at, re, im in zip(got["_first"], got["re"], got["im"], strict=True):
            part = (np.asarray(re) + 1j * np.asarray(im)).reshape(height, -1)
            x[:, at : at + part.shape[1]] = part
        x = np.fft.fft(x, axis=1)
        idx = first + np.arange(height)[:, None] + n1 * np.arange(n2)
        return pd.DataFrame({**{k: got[k].iloc[0] for k in keys}, "idx": idx.ravel(), "re": x.real.ravel(), "im": x.imag.ravel()})

    cut = samples.select(*keys, "idx", "re", "im", F.floor(F.col("idx") % n2 / columns).alias("_block"))
    tiles = cut.groupBy(*keys, "_block").applyInPandas(down, f"{head}_row long, _first long, re array<double>, im array<double>")
    return tiles.groupBy(*keys, "_row").applyInPandas(across, f"{head}idx long, re double, im double")


def _times(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    """A complex number turned by an angle."""
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def fft(samples: DataFrame, n: int, *, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """The transform of (keys, idx, re, im), idx from 0 to n - 1 and absent ones 0: the same columns, absent keys none."""
    found = factors(n)
    if found:
        return _four_steps(samples, *found, keys, tile)
    m = 1 << (2 * n - 1).bit_length()
    m1, m2 = factors(m)
    chirp = lambda i: F.lit(math.pi / n) * ((i * i) % (2 * n))
    spark, i = samples.sparkSession, F.col("idx")
    turned = _times(F.col("re"), F.col("im"), -chirp(i))
    ours = _four_steps(samples.select(*keys, "idx", turned[0].alias("re"), turned[1].alias("im")), m1, m2, keys, tile)
    both = spark.range(n).select(F.explode(F.array_distinct(F.array(F.col("id"), F.when(F.col("id") > 0, m - F.col("id")).otherwise(F.lit(0))))).alias("idx"))
    bent = chirp(F.least(i, m - i))
    kernel = _four_steps(both.select("idx", F.cos(bent).alias("re"), F.sin(bent).alias("im")), m1, m2, (), tile).select("idx", F.col("re").alias("_a"), F.col("im").alias("_b"))
    product = ours.join(kernel, "idx").select(*keys, "idx", (F.col("re") * F.col("_a") - F.col("im") * F.col("_b")).alias("re"), (-(F.col("re") * F.col("_b") + F.col("im") * F.col("_a"))).alias("im"))
    back = _four_steps(product, m1, m2, keys, tile).where(i < n)
    turned = _times(F.col("re") / m, -F.col("im") / m, -chirp(i))
    return back.select(*keys, "idx", turned[0].alias("re"), turned[1].alias("im"))


def magnitude_spectrum(trace: DataFrame, *, rec: str = "rec_id", tile: int = TILE) -> DataFrame:
    """The magnitude of every Fourier term of each recording, the root mean square over its channels: rec_id, bin, magnitude.

    Samples are counted from a recording's first to its last index; missing ones are 0.  The ends of recordings are all
    that comes to the driver.
    """
    out = None
    ends = trace.groupBy(rec).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count_distinct("channel").alias("c")).collect()
    for r in ends:
        n = r["b"] - r["a"] + 1
        mine = trace.where(F.col(rec).eqNullSafe(F.lit(r[rec]))).select("channel", (F.col("t") - r["a"]).alias("idx"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
        power = fft(mine, n, keys=("channel",), tile=tile).groupBy("idx").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
        part = power.select(F.lit(r[rec]).alias(rec), F.col("idx").alias("bin"), F.sqrt(F.col("p") / r["c"]).alias("magnitude"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else trace.select(rec, F.col("t").alias("bin"), F.col("v").alias("magnitude")).limit(0)
