"""SQL functions to register on a session: scalar Arrow UDFs, aggregates and table functions."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType

from sigspark.functions.stats import chi2_cdf as _chi2_cdf
from sigspark.functions.stats import kde_threshold as _kde_threshold


@pandas_udf(DoubleType())
def chi2_cdf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(_chi2_cdf(x.to_numpy(float), k.to_numpy(float)))


@pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


@pandas_udf(ArrayType(DoubleType()))
def acf(t: pd.Series, v: pd.Series) -> list[float]:
    """Autocorrelation of a group's values in the order of t, less their mean, at lags 0..10, scaled to 1 at lag 0."""
    x = v.to_numpy(float)[np.argsort(t.to_numpy(), kind="stable")]
    x = x - x.mean()
    full = [float(x[: len(x) - k] @ x[k:]) for k in range(min(11, len(x)))]
    return [f / full[0] if full[0] else 0.0 for f in full]


@pandas_udf(DoubleType())
def kde_threshold(v: pd.Series) -> float:
    """The automatic amplitude threshold of a group's amplitudes."""
    v = v.dropna().to_numpy(float)
    if not len(v):
        return float("-inf")
    counts, _ = np.histogram(v, 256, (v.min(), max(v.max(), v.min() + 1e-12)))
    return _kde_threshold(counts.astype(float), v.min(), v.max(), len(np.unique(v)))


# Table functions take a table argument, PARTITION BY a train or recording and ORDER BY t: each partition comes row by row
# in order, and no more of it is held than a run's ends or one window of events.


@udtf(returnType="key: string, start: long, end: long, len: long")
class Islands:
    """Runs of consecutive t of a partition: ``islands(TABLE(...) PARTITION BY key ORDER BY t)``, of columns key and t."""

    def __init__(self) -> None:
        self.key: str | None = None
        self.start = self.end = 0
        self.any = False

    def eval(self, row: Row) -> Iterator[tuple[str | None, int, int, int]]:
        t = row["t"]
        if self.any and t > self.end + 1:
            yield from self.terminate()
        if not self.any:
            self.key, self.start, self.any = row["key"], t, True
        self.end = t

    def terminate(self) -> Iterator[tuple[str | None, int, int, int]]:
        if self.any:
            self.any = False
            yield self.key, self.start, self.end, self.end - self.start + 1


@udtf(returnType="key: string, est_id: long, true_id: long")
class GreedyMatch:
    """Greedy one-to-one matches of a partition's two sides, low <= true - est <= high: ``greedy_match(TABLE(...) PARTITION BY
    key ORDER BY (t, side, id), low, high)``, of columns key, side (0 estimate, 1 true), id and t."""

    def __init__(self) -> None:
        self.key: str | None = None
        self.est: deque[tuple[int, int]] = deque()
        self.true: deque[tuple[int, int]] = deque()

    def eval(self, row: Row, low: int, high: int) -> Iterator[tuple[str | None, int, int]]:
        self.key, self.low, self.high = row["key"], low, high
        (self.true if row["side"] == 1 else self.est).append((row["t"], row["id"]))
        yield from self._settle(row["t"] - high)

    def _settle(self, upto: float) -> Iterator[tuple[str | None, int, int]]:
        """Estimates before ``upto`` have seen all that they could take."""
        while self.est and self.est[0][0] < upto:
            t, i = self.est.popleft()
            while self.true and self.true[0][0] < t + self.low:
                self.true.popleft()
            if self.true and self.true[0][0] <= t + self.high:
                yield self.key, i, self.true.popleft()[1]

    def terminate(self) -> Iterator[tuple[str | None, int, int]]:
        if self.est:
            yield from self._settle(math.inf)


@udtf(returnType="key: string, bin: int, n: long")
class Correlogram:
    """Counts of event - trigger on evenly spaced centres of [low, high]: ``correlogram(TABLE(...) PARTITION BY key ORDER BY (t),
    low, high, bins)``, of columns key, side (0 event, 1 trigger) and t; the last bin is doubled, as it is half as wide."""

    def __init__(self) -> None:
        self.key: str | None = None
        self.held: tuple[deque[int], deque[int]] = (deque(), deque())
        self.counts: np.ndarray | None = None

    def eval(self, row: Row, low: int, high: int, bins: int) -> None:
        if self.counts is None:
            self.counts, self.key = np.zeros(bins, np.int64), row["key"]
        side, t = row["side"], row["t"]
        # An event meets the triggers before it that are within high, and a trigger the events before it within -low.
        reach, others = (high, self.held[1]) if side == 0 else (-low, self.held[0])
        while others and others[0] < t - reach:
            others.popleft()
        gaps = (t - np.array(others)) if side == 0 else (np.array(others) - t)
        gaps = gaps[(gaps >= low) & (gaps <= high)] if len(others) else gaps
        if len(gaps):
            at = np.clip(np.floor((gaps - low) / ((high - low) / (bins - 1)) + 0.5), 0, bins - 1).astype(int)
            self.counts += np.bincount(at, minlength=bins)
        self.held[side].append(t)
        own_reach = -low if side == 0 else high
        while self.held[side] and self.held[side][0] < t - own_reach:
            self.held[side].popleft()

    def terminate(self) -> Iterator[tuple[str | None, int, int]]:
        if self.counts is not None:
            for b in np.flatnonzero(self.counts).tolist():
                yield self.key, b, int(self.counts[b] * (2 if b == len(self.counts) - 1 else 1))


def register(spark: SparkSession) -> None:
    """Make all functions callable from SQL on this session."""
    for name, f in {"chi2_cdf": chi2_cdf, "erfc": erfc, "acf": acf, "kde_threshold": kde_threshold}.items():
        spark.udf.register(name, f)
    for name, t in {"islands": Islands, "greedy_match": GreedyMatch, "correlogram": Correlogram}.items():
        spark.udtf.register(name, t)


__all__ = ["Correlogram", "GreedyMatch", "Islands", "acf", "chi2_cdf", "erfc", "kde_threshold", "register"]
