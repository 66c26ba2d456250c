"""Filters, whitening and spectra of traces: small matrices on the driver, samples in blocks on the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sigspark.operators import aggregates
from sigspark.operators.blocks import with_halo
from sigspark.operators.tables import kept

KEYS = ("rec_id", "channel")
BLOCK = 1 << 15  # samples of a channel in a row of a packed trace


def fir_taps(freq: Sequence[float], dt: float, order: int) -> np.ndarray:
    """A Hamming-windowed filter: high-pass for one cutoff (or an upper one beyond half the rate), else band-pass.

    The pass band has gain 1 at its middle (high-pass: at half the rate).
    """
    nyquist = 1 / (2 * dt)
    edges = [f / nyquist for f in freq]
    n = order + order % 2  # a high-pass needs an even order
    k = np.arange(n + 1) - n / 2
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n + 1) / n)

    def low(w: float) -> np.ndarray:
        return w * np.sinc(w * k)

    top = 1.0 if len(edges) == 1 or edges[1] >= 1 else edges[1]
    taps = (low(top) - low(edges[0])) * window
    middle = 1.0 if top == 1.0 else (edges[0] + top) / 2
    return taps / abs(np.sum(taps * np.exp(-1j * np.pi * middle * k)))


def butterworth(freq: Sequence[float], dt: float, order: int) -> np.ndarray:
    """The taps of the impulse response of a Butterworth high-pass or band-pass filter, cut where it has died down.

    The analog prototype's poles are moved to the band and to the unit disc (bilinear transform); the response is the
    inverse transform of the transfer function on a circle of enough points, and the cut leaves under 1e-9 of its squares.
    """
    edges = [2 / dt * np.tan(np.pi * f * dt) for f in freq if f * dt < 0.5]
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if len(edges) == 1:
        poles, zeros = edges[0] / poles, np.zeros(order, complex)
    else:
        low, high = edges
        scaled = poles * (high - low) / 2
        root = np.sqrt(scaled**2 - low * high)
        poles, zeros = np.r_[scaled + root, scaled - root], np.zeros(order, complex)
    disc, flat = (2 / dt + poles) / (2 / dt - poles), (2 / dt + zeros) / (2 / dt - zeros)
    flat = np.r_[flat, np.full(len(disc) - len(flat), -1)]
    n = 1 << int(np.ceil(np.log2(max(64, 24 / (1 - np.abs(disc).max())))))
    z = np.exp(2j * np.pi * np.arange(n) / n)
    gain = lambda at: np.prod(at[:, None] - flat, axis=1) / np.prod(at[:, None] - disc, axis=1)
    middle = -1.0 if len(edges) == 1 else np.exp(2j * np.arctan(np.sqrt(edges[0] * edges[1]) * dt / 2))
    taps = np.fft.ifft(gain(z) / np.abs(gain(np.array([middle])))).real
    left = np.cumsum(taps[::-1] ** 2)[::-1]
    return taps[: max(1, int(np.argmax(left < 1e-9 * left[0])) or n)]


def filter_trace(trace: DataFrame, taps: Sequence[float], *, compensate: bool = True, keys: Sequence[str] = KEYS, pad_edges: bool = True) -> DataFrame:
    """FIR per channel: keys, t, v.  ``compensate`` takes back the delay of half the order; edges repeat the end samples.

    Blocks with halo are filtered by numpy; a task holds one block.
    """
    taps = np.asarray(taps, float)
    order = len(taps) - 1
    advance = order // 2 if compensate else 0
    wide = with_halo(trace.select(*keys, "t", "v"), order - advance, advance)
    names, types = list(keys), dict(trace.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t", kind="stable")
        v = rows["v"].to_numpy()
        fill = (v[0], v[-1]) if pad_edges else (0.0, 0.0)
        padded = np.r_[np.full(order - advance, fill[0]), v, np.full(advance, fill[1])]
        return rows.assign(v=np.convolve(padded, taps, "valid"))[rows["_core"]][[*names, "t", "v"]]

    schema = ", ".join(f"{k} {types[k]}" for k in names) + ", t long, v double"
    return wide.groupBy(*keys, "_block").applyInPandas(run, schema)


def standardise(trace: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each channel less its mean, and all divided by the greatest magnitude."""
    means = trace.groupBy(*keys).agg(F.avg("v").alias("m"))
    flat = trace.join(means, list(keys)).withColumn("v", F.col("v") - F.col("m")).drop("m")
    most = flat.agg(F.max(F.abs("v")).alias("m")).first()["m"] or 1.0
    return flat.withColumn("v", F.col("v") / F.lit(most))


def history(trace: DataFrame) -> list[dict[str, object]]:
    """What was done to a trace, in order: operation and params, from the metadata of its column v."""
    return json.loads(trace.schema["v"].metadata.get("processing", "[]"))


def recorded(trace: DataFrame, source: DataFrame, operation: str, **params: object) -> DataFrame:
    """``trace`` with the history of ``source`` and one more operation."""
    done = [*history(source), {"operation": operation, "params": params}]
    return trace.withMetadata("v", {"processing": json.dumps(done)})


def filter_recording(trace: DataFrame, freq: Sequence[float], dt: float, order: int, *, kind: str = "fir", keys: Sequence[str] = KEYS) -> DataFrame:
    """A recording filtered (``fir``, or ``butter`` without taking back a delay), each channel less its mean, and all divided
    by the greatest magnitude.  No frequencies: the filter is left out, all else is done.  The history tells of it."""
    out = trace
    if len(freq):
        taps = fir_taps(freq, dt, order) if kind == "fir" else butterworth(freq, dt, order)
        out = filter_trace(trace, taps, compensate=kind == "fir", keys=keys)
    return recorded(standardise(out, keys=keys), trace, "filtering", freq=list(freq), order=order, kind=kind)


def numbered(rows: DataFrame, order: Sequence[str], *, keys: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """``rows`` with their 0-based place t in ``order`` by keys; the first column of ``order`` is a whole number.

    Rows are numbered in blocks of that column's values, on top of the counts of the blocks before, which are one row each.
    """
    cut = rows.withColumn("_block", F.floor(F.col(order[0]) / block))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_block").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1
    return cut.withColumn("_at", inside).join(counts, [*keys, "_block"]).withColumn("t", (F.col("_base") + F.col("_at")).cast("long")).drop("_block", "_base", "_at")


def inverse_root(matrix: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    """The inverse square root of a symmetric matrix, its eigenvalues taken by magnitude and not under a floor."""
    value, vector = np.linalg.eigh((matrix + matrix.T) / 2)
    value = np.maximum(np.abs(value), floor * np.abs(value).max())
    return (vector / np.sqrt(value)) @ vector.T


def whitening_filter(acf: Sequence[float]) -> np.ndarray:
    """The middle column of the inverse root of the Toeplitz matrix of an autocorrelation: an odd, centred filter."""
    acf = np.asarray(acf, float)
    if len(acf) % 2 == 0:
        raise ValueError("whitening needs an even number of lags (an odd number of values)")
    n = len(acf)
    matrix = acf[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    return inverse_root(matrix, 1e-6)[:, n // 2]


def packed(trace: DataFrame, reach: int, *, rec: str = "rec_id", block: int = BLOCK) -> DataFrame:
    """The trace in blocks of time, a row each, with ``reach`` samples of both neighbours: rec_id, _block, and arrays channel, at, t, v.

    Tasks cut their batches into pieces of one channel and block, so what is shuffled are the bytes of samples; ``at`` is a
    piece's first place in its block, and ``t`` has all of its places where they don't follow one another.
    """
    types = dict(trace.dtypes)
    names = ("rec", "_block", "channel", "at", "t", "v")
    kinds = [to_arrow_type(trace.schema[rec].dataType), pa.int64(), to_arrow_type(trace.schema["channel"].dataType), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, channels = (batch.column(i).dictionary_encode(null_encoding="encode") for i in (0, 1))
            r, c = recs.indices.to_numpy(), channels.indices.to_numpy()
            t, v = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            own = t // block
            inside = t - own * block
            before, after = np.flatnonzero(inside < reach), np.flatnonzero(inside >= block - reach)
            at = np.r_[np.arange(len(t)), before, after]
            b = np.r_[own, own[before] - 1, own[after] + 1]
            order = np.lexsort((t[at], c[at], b, r[at]))
            at, b = at[order], b[order]
            place = (t[at] - b * block + reach).astype("<i4")
            cuts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (c[at][1:] != c[at][:-1]) | (r[at][1:] != r[at][:-1])]).tolist()
            rows = []
            for x, y in zip(cuts, [*cuts[1:], len(at)], strict=True):
                tight = place[y - 1] - place[x] + 1 == y - x
                rows.append((recs.dictionary[r[at[x]]].as_py(), b[x], channels.dictionary[c[at[x]]].as_py(), place[x], b"" if tight else place[x:y].tobytes(), v[at[x:y]].astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    pieces = trace.select(rec, "channel", F.col("t").cast("long"), F.col("v").cast("double")).mapInArrow(run, f"rec {types[rec]}, _block long, channel {types['channel']}, at int, t binary, v binary")
    rows = pieces.groupBy("rec", "_block").agg(F.collect_list(F.struct("channel", "at", "t", "v")).alias("_x"))
    return kept(rows.select(F.col("rec").alias(rec), "_block", *(F.col(f"_x.{c}").alias(c) for c in ("channel", "at", "t", "v"))), "packed")


class Whitener:
    """Whitening by the noise of all recordings' quiet zones, over the blocks of ``packed``; what it learns is of the channels' size.

    A zone is a run of more than ``min_zone`` samples where the magnitude over channels stays below ``threshold``.  Whether
    a sample is in one shows in so many samples around it, so zones and filters are found inside a block and its
    neighbours' samples.  Samples that are null or NaN count in no sum, and whatever a filter makes of them is null.
    """

    def __init__(self, trace: DataFrame, threshold: float, min_zone: int, lags: int, reg: float, rec: str) -> None:
        self.threshold, self.min_zone, self.lags, self.block = threshold, min_zone, lags, max(BLOCK, min_zone, 2 * lags)
        self.reach = max(min_zone, lags + lags // 2)
        self.types, self.rec = trace.schema, rec
        self.taps: dict[object, np.ndarray] = {}
        self.channels: list[object] = []
        self.root = np.zeros((0, 0))
        self.table = packed(trace, self.reach, rec=rec, block=self.block)
        self.before = self.noise(("before",))
        self.taps = {c: whitening_filter([x for _, x in sorted(v)]) for c, v in sorted(self.before["before"][0].items())}
        if not self.taps:
            raise ValueError("no noise zone to whiten by")
        self.channels, cov = self.noise(("filtered",))["filtered"][1]
        self.root = inverse_root(cov + reg * np.eye(len(self.channels)))

    def grid(self, row: dict[str, object]) -> tuple[dict[object, np.ndarray], dict[object, np.ndarray], np.ndarray]:
        """Values and presence of each channel of a block, and the zone of each place, -1 for none."""
        n = self.block + 2 * self.reach
        v: dict[object, np.ndarray] = {}
        has: dict[object, np.ndarray] = {}
        for c, at, t, x in zip(row["channel"], row["at"], row["t"], row["v"], strict=True):
            x = np.frombuffer(x, "<f8")
            where = np.frombuffer(t, "<i4") if t else slice(at, at + len(x))
            v.setdefault(c, np.zeros(n))[where] = x
            has.setdefault(c, np.zeros(n, bool))[where] = True
        known = [has[c] & ~np.isnan(v[c]) for c in v]
        level = np.sqrt(sum(np.where(k, x, 0.0) ** 2 for k, x in zip(known, v.values(), strict=True)))
        quiet = np.logical_or.reduce(known) & (level < self.threshold)
        edges = np.flatnonzero(np.diff(np.r_[False, quiet, False].astype(np.int8)))
        length = edges[1::2] - edges[::2]
        zone = np.full(n, -1)
        zone[quiet] = np.repeat(np.where(length > self.min_zone, np.arange(len(length)), -1), length)
        return v, has, zone

    def filtered(self, v: dict[object, np.ndarray], has: dict[object, np.ndarray]) -> dict[object, np.ndarray]:
        """Each channel whitened in time, NaN where it has no sample."""
        return {c: np.where(has[c], np.convolve(v[c], self.taps[c], "same"), np.nan) for c in self.taps if c in v}

    def white(self, v: dict[object, np.ndarray], has: dict[object, np.ndarray]) -> tuple[dict[object, np.ndarray], np.ndarray]:
        """Each channel whitened in time and over channels, NaN where nothing is known, and where any has a sample."""
        part = self.filtered(v, has)
        there = np.logical_or.reduce([np.zeros(self.block + 2 * self.reach, bool), *(has[c] for c in part)])
        known = np.logical_or.reduce([~there, *(~np.isnan(x) for x in part.values())]) & there
        sums = {c: sum((np.nan_to_num(part[d]) * self.root[i, j] for j, d in enumerate(self.channels) if d in part), np.zeros(len(there))) for i, c in enumerate(self.channels)}
        return {c: np.where(known, x, np.nan) for c, x in sums.items()}, there

    def noise(self, stages: Sequence[str]) -> dict[str, tuple[dict[object, list[tuple[int, float]]], tuple[list[object], np.ndarray]]]:
        """In the zones of the trace, at each stage (before, filtered, after): lags by channel, and the covariance of channels."""
        kind, core, lags, channel = to_arrow_type(self.types["channel"].dataType), slice(self.reach, self.reach + self.block), self.lags, self.types["channel"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    v, has, zone = self.grid(batch.slice(i, 1).to_pylist()[0])
                    out = []
                    for stage in stages:
                        series = {"before": lambda: {c: np.where(has[c], x, np.nan) for c, x in v.items()}, "filtered": lambda: self.filtered(v, has), "after": lambda: self.white(v, has)[0]}[stage]()
                        mine = zone[core]
                        for c, x in series.items():
                            for k in range(lags + 1) if stage != "filtered" else ():
                                later = slice(core.start + k, core.stop + k)
                                product = x[core] * x[later]
                                good = (mine >= 0) & (zone[later] == mine) & ~np.isnan(product)
                                if good.any():
                                    out.append((stage, c, None, k, good.sum(), 0.0, 0.0, product[good].sum()))
                            for d, y in series.items():
                                good = (mine >= 0) & ~np.isnan(x[core]) & ~np.isnan(y[core])
                                if good.any():
                                    p, q = x[core][good], y[core][good]
                                    out.append((stage, c, d, None, good.sum(), p.sum(), q.sum(), p @ q))
                    columns = list(zip(*out, strict=True)) or [()] * 8
                    yield pa.RecordBatch.from_arrays([pa.array(col, x) for col, x in zip(columns, [pa.string(), kind, kind, pa.int32(), pa.int64(), *[pa.float64()] * 3], strict=True)], names=["stage", "one", "two", "lag", "n", "a", "b", "s"])

        sums = self.table.mapInArrow(run, f"stage string, one {channel}, two {channel}, lag int, n long, a double, b double, s double")
        sums = kept(sums.groupBy("stage", "one", "two", "lag").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "s"))), "noise")
        pairs = {(r["stage"], r["one"], r["two"]): (r["s"] - r["a"] * r["b"] / r["n"]) / r["n"] for r in sums.where("lag is null").collect()}
        acf: dict[tuple[str, object], list[tuple[int, float]]] = {}
        products = sums.where("lag is not null").select("stage", "one", "lag", "s")
        for r in aggregates.autocorrelation(products, keys=("stage", "one")).collect():
            acf.setdefault((r["stage"], r["one"]), []).append((r["lag"], r["acf"]))
        found = {}
        for stage in stages:
            channels = sorted(c for s, c, d in pairs if s == stage and c == d)
            found[stage] = ({c: v for (s, c), v in acf.items() if s == stage}, (channels, np.array([[pairs.get((stage, a, b), 0.0) for b in channels] for a in channels])))
        return found

    def trace(self) -> DataFrame:
        """The whitened trace: rec_id, channel, t, v."""
        names = [self.rec, "channel", "t", "v"]
        rec_kind, kind = (to_arrow_type(self.types[c].dataType) for c in names[:2])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    white, there = self.white(*self.grid(row)[:2])
                    at = np.flatnonzero(there[self.reach : self.reach + self.block])
                    for c, x in white.items():
                        v = pa.array(x[at + self.reach], pa.float64(), from_pandas=True)
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(row[self.rec], rec_kind), len(at)), pa.repeat(pa.scalar(c, kind), len(at)), pa.array(at + row["_block"] * self.block, pa.int64()), v], names=names)

        return self.table.mapInArrow(run, f"{self.rec} {self.types[self.rec].dataType.simpleString()}, channel {self.types['channel'].dataType.simpleString()}, t long, v double")

    def __getstate__(self) -> dict[str, object]:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "before")}


def whiten(trace: DataFrame, threshold: float, min_zone: int, lags: int, *, reg: float = 0.0, rec: str = "rec_id") -> DataFrame:
    """Whiten each channel in time, then all channels together, by the noise of all recordings' quiet zones: rec_id, channel, t, v.

    The trace is shuffled and written once, in blocks; lags by channel and the covariance of channels are all that comes
    to the driver.
    """
    white = Whitener(trace, threshold, min_zone, lags, reg, rec).trace()
    return recorded(white, trace, "whitening", threshold=threshold, min_zone=min_zone, lags=lags, reg=reg)


def whitening_report(trace: DataFrame, threshold: float, min_zone: int, lags: int, *, reg: float = 0.0, rec: str = "rec_id") -> DataFrame:
    """Noise before and after whitening, over the zones of the trace before: stage, kind (``acf`` by channel and lag, ``cov`` by
    two channels), one, two, value.  Its size is that of the channels and lags."""
    whitener = Whitener(trace, threshold, min_zone, lags, reg, rec)
    rows = []
    for stage, (acf, (channels, cov)) in (whitener.before | whitener.noise(("after",))).items():
        rows += [(stage, "acf", c, lag, x) for c, values in acf.items() for lag, x in values]
        rows += [(stage, "cov", a, b, float(cov[i, j])) for i, a in enumerate(channels) for j, b in enumerate(channels)]
    return trace.sparkSession.createDataFrame(rows, "stage string, kind string, one int, two int, value double")
