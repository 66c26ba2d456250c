"""Snippets, principal components, clusters and first waveforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sigspark.operators import aggregates, windows
from sigspark.operators.joins import band_join
from sigspark.operators.tables import kept

KEYS = ("rec_id", "channel")


def pchip(y: np.ndarray, factor: int) -> np.ndarray:
    """Monotone cubic interpolation of evenly spaced rows of ``y`` at ``factor`` times the rate."""
    d = np.diff(y, axis=0)
    slope = np.zeros_like(y)
    a, b = d[:-1], d[1:]
    same = a * b > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        slope[1:-1] = np.where(same, 2 * a * b / (a + b), 0.0)
    for end, (p, q) in ((0, (d[0], d[1])), (-1, (d[-1], d[-2]))) if len(d) > 1 else ((0, (d[0], d[0])), (-1, (d[0], d[0]))):
        s = (3 * p - q) / 2
        s = np.where(s * p <= 0, 0.0, s)
        slope[end] = np.where((p * q < 0) & (np.abs(s) > 3 * np.abs(p)), 3 * p, s)
    x = np.arange((len(y) - 1) * factor + 1) / factor
    k = np.minimum(x.astype(int), len(y) - 2)
    t = (x - k).reshape(-1, *[1] * (y.ndim - 1))
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * slope[k] + t**2 * (3 - 2 * t) * y[k + 1] + t**2 * (t - 1) * slope[k + 1]


def spline(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through y at 0, 1, ...; 0 outside."""
    n = len(y)
    if n < 4:
        return np.where((x >= 0) & (x <= n - 1), np.interp(x, np.arange(n), y), 0.0)
    A, r = np.zeros((n, n)), np.zeros(n)
    i = np.arange(1, n - 1)
    A[i, i - 1], A[i, i], A[i, i + 1] = 1, 4, 1
    r[1:-1] = 6 * (y[2:] - 2 * y[1:-1] + y[:-2])
    A[0, :3], A[-1, -3:] = (1, -2, 1), (1, -2, 1)
    m = np.linalg.solve(A, r)
    k = np.clip(np.floor(x).astype(int), 0, n - 2)
    t = x - k
    s = y[k] * (1 - t) + y[k + 1] * t + ((1 - t) ** 3 - (1 - t)) * m[k] / 6 + (t**3 - t) * m[k + 1] / 6
    return np.where((x >= 0) & (x <= n - 1), s, 0.0)


def align(snippet: np.ndarray, length: int, factor: int = 5, smooth: int = 5, polarity: str = "maxrms") -> np.ndarray:
    """A time x channel snippet upsampled, centred on its extremum, brought back to its rate and cut to ``length``."""
    fine = pchip(snippet, factor)
    whole = {"maxrms": lambda z: np.sqrt((z**2).sum(axis=1)), "maxabs": lambda z: np.abs(z).max(axis=1), "max": lambda z: z.max(axis=1), "min": lambda z: -z.min(axis=1)}[polarity](fine)
    level = np.convolve(whole, np.ones(smooth) / smooth, "same")
    middle = len(fine) // 2
    reach = min(middle, factor * (length // 2))
    at = middle - reach + int(level[middle - reach : middle + reach + 1].argmax())
    want = at + factor * (np.arange(length) - length // 2)
    out = np.zeros((length, snippet.shape[1]))
    inside = (want >= 0) & (want < len(fine))
    out[inside] = fine[want[inside]]
    return out


def aligned_snippets(trace: DataFrame, peaks: DataFrame, length: int, channels: Sequence[int], *, factor: int = 5, smooth: int = 5, polarity: str = "maxrms", rec: str = "rec_id") -> DataFrame:
    """The aligned window of each peak, channel after channel: rec_id, t, features.

    Windows come from a band join of samples and peaks; a task aligns the windows of its own peaks.
    """
    half = length
    marks = peaks.select(rec, F.col("t").alias("trigger_t"))
    pairs = band_join(trace.select(rec, "channel", "t", "v"), marks, -half, half, keys=(rec,))
    wide = pairs.groupBy(rec, "trigger_t").agg(F.collect_list(F.struct("channel", "dt", "v")).alias("x"))
    wide = wide.select(rec, "trigger_t", *(F.col(f"x.{c}").alias(c) for c in ("channel", "dt", "v")))  # plain arrays are small in Python
    column = {c: i for i, c in enumerate(channels)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for channel, dt, v in zip(rows["channel"], rows["dt"], rows["v"], strict=True):
                w = np.zeros((2 * half + 1, len(column)))
                w[dt + half, [column[c] for c in channel]] = v
                out.append(align(w, length, factor, smooth, polarity).T.ravel())
            yield pd.DataFrame({rec: rows[rec], "t": rows["trigger_t"], "features": out})

    return wide.mapInPandas(run, f"{rec} string, t long, features array<double>")


def components(vectors: DataFrame, size: int, percent: float, at_least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Uncentred principal components that together pass ``percent`` of the squares: eigenvalues and columns.

    The Gram matrix is summed on the executors, and only its size squared numbers come to the driver.  Signs are
    fixed by the greatest element of each column.
    """
    g = np.zeros((size, size))
    for r in aggregates.gram(vectors, size).collect():
        g[r["i"], r["j"]] = r["g"]
    value, vector = np.linalg.eigh((g + g.T) / 2)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    share = 100 * np.cumsum(value) / value.sum()
    keep = min(size, max(at_least, int(np.argmax(share > percent)) + 1))
    vector = vector[:, :keep]
    return value[:keep], vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(keep)])


def project(vectors: DataFrame, columns: np.ndarray, *, features: str = "features", out: str = "scores") -> DataFrame:
    """Coordinates on given components, as an expression of array products."""
    x = F.col(features)
    dots = [F.aggregate(F.zip_with(x, F.array(*(F.lit(float(k)) for k in c)), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) for c in columns.T]
    return vectors.withColumn(out, F.array(*dots))


def packed_points(vectors: DataFrame, features: str) -> RDD:
    """The vectors that aren't null, in memory or on disk of the executors: pairs of their hashes and a matrix of 2 MB at most.

    Rows are packed once and written; a pass then copies bytes to Python, where rows of arrays cost more than the sums.
    The caller unpersists them.
    """
    spark = vectors.sparkSession
    points = vectors.select(F.col(features).cast("array<double>").alias("_x")).where("_x is not null").withColumn("_h", F.xxhash64("_x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, x = batch.column(1).to_numpy(), batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step = max(1, (1 << 21) // max(1, x[0].nbytes))
            at = range(0, len(h), step)
            yield pa.RecordBatch.from_pydict({"h": [h[i : i + step].tobytes() for i in at], "x": [x[i : i + step].tobytes() for i in at]})

    def arrays(row: Row) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(row["h"], np.int64)
        return h, np.frombuffer(row["x"]).reshape(len(h), -1)

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    blocks = kept(points.repartition(parts).mapInArrow(pack, "h binary, x binary"), "points")
    n, cores = blocks.count(), spark.sparkContext.defaultParallelism  # the cores as they are after a job
    if not n:
        raise ValueError("a cluster is empty; use fewer waveforms")
    return blocks.repartition(cores * -(-n // (128 * cores))).rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)  # even tasks of 256 MB at most


def merged(found: RDD, f: Callable) -> object:
    """The parts of ``found`` merged by ``f``; on executors first, where they are many."""
    return found.treeReduce(f, depth=1 if found.getNumPartitions() <= 64 else 2)


def first_centres(points: RDD, k: int, starts: int, seed: int) -> np.ndarray:
    """``k`` distinct points of ``packed_points`` for each start, those whose hash mixed with the start's own is least."""

    def mixed(h: np.ndarray, start: int) -> np.ndarray:
        z = h.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + start + 1)) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    def least(h: np.ndarray) -> np.ndarray:
        """The places of the distinct hashes that some start takes: a row for each start."""
        return np.array([np.argsort(mixed(h, i), kind="stable")[:k] for i in range(starts)])

    def taken(*found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([x[0] for x in found]), return_index=True)
        x = np.concatenate([x[1] for x in found])
        i = np.unique(least(h))
        return h[i], x[at[i]]

    def run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held = None
        for block in blocks:
            held = taken(block) if held is None else taken(held, block)
        if held is not None:
            yield held

    h, x = merged(points.mapPartitions(run), taken)
    if len(h) < k:
        raise ValueError("a cluster is empty; use fewer waveforms")
    return x[least(h)]


def lloyd_step(points: RDD, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each start's nearest points, by centre: their sums and numbers, and the cost of each start.

    One pass of one stage for all starts.  Each task adds up matrix products of its blocks and hands on one small matrix.
    """
    starts, k, size = centres.shape
    flat = centres.transpose(1, 0, 2).reshape(-1, size)  # starts lie side by side, so that comparisons run along them
    norms = (flat**2).sum(axis=1)

    def run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        total = np.zeros((k * starts, size + 2))
        for _, whole in blocks:
            for i in range(0, len(whole), 1024):
                x = whole[i : i + 1024]
                far = (norms - 2 * (x @ flat.T)).reshape(len(x), k, starts)
                least = far.min(axis=1)
                near, free = np.zeros_like(far), np.ones(least.shape, bool)
                for j in range(k):  # the first of equal ones
                    near[:, j] = free & (far[:, j] == least)
                    free &= far[:, j] != least
                near = near.reshape(len(x), -1)
                total[:, :size] += near.T @ x
                total[:, size] += near.sum(axis=0)
                total[:starts, size + 1] += least.sum(axis=0) + np.vdot(x, x)
        yield total

    total = merged(points.mapPartitions(run), np.add).reshape(k, starts, -1).transpose(1, 0, 2)
    return total[:, :, :size], total[:, :, size], total[:, :, size + 1].sum(axis=1)


def cluster(vectors: DataFrame, k: int, *, features: str = "scores", restarts: int = 25, max_iter: int = 1000, seed: int = 1, tol: float = 1e-4) -> DataFrame:
    """k-means of least cost over random restarts: adds ``label``.  An empty cluster is an error.

    All restarts that still move share each pass over the points, so there are as many passes as the longest one needs; a
    restart ends when none of its centres moves by more than ``tol``.  Draws go by hashes of the points and not by how
    they are partitioned.  The centres of all restarts come to the driver.
    """
    points = packed_points(vectors, features)
    try:
        centres = first_centres(points, k, restarts, seed)
        moving = np.arange(restarts)
        for _ in range(max_iter):
            sums, counts, _ = lloyd_step(points, centres[moving])
            new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres[moving])
            moved = np.sqrt(((new - centres[moving]) ** 2).sum(axis=2)).max(axis=1)
            centres[moving] = new
            moving = moving[moved > tol]
            if not len(moving):
                break
        _, counts, cost = lloyd_step(points, centres)
    finally:
        points.unpersist()
    best = int(cost.argmin())
    if counts[best].min() == 0:
        raise ValueError("a cluster is empty; use fewer waveforms")
    x = F.col(features)
    far = [F.aggregate(F.zip_with(x, F.array(*(F.lit(float(v)) for v in c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y) for c in centres[best]]
    nearest = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("label")) for i, d in enumerate(far))))
    return vectors.withColumn("label", F.when(x.isNotNull(), nearest["label"]))


def first_waveforms(trace: DataFrame, params: object, channels: Sequence[int], polarity: str = "maxrms") -> tuple[DataFrame, list[np.ndarray]]:
    """Labelled snippets and their mean waveforms, strongest first: peaks, alignment, components, clusters."""
    c, length = params.clustering, params.general.waveform_len
    level = trace.groupBy("rec_id", "t").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))
    peaks = windows.local_peaks(level, c.spike_threshold, length // 2, length, keys=("rec_id",))
    snippets = kept(aligned_snippets(trace, peaks, length, channels, factor=c.upsample, smooth=c.smooth_len, polarity=polarity), "snippets")
    _, pcs = components(snippets, length * len(channels), c.percent_variance)
    labelled = cluster(project(snippets, pcs), c.num_waveforms, restarts=c.restarts, max_iter=c.max_iter)
    means = np.zeros((c.num_waveforms, length * len(channels)))
    for r in aggregates.centroids(labelled).collect():
        means[r["label"], r["pos"]] = r["x"]
    order = np.argsort(-np.linalg.norm(means, axis=1), kind="stable").tolist()
    return aggregates.relabel(labelled, order), [means[i].reshape(len(channels), length).T for i in order]
