"""Aggregates of traces, trains and vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.columns import bin_of
from sigspark.operators.blocks import in_blocks, running_sums
from sigspark.operators.joins import band_join
from sigspark.operators.tables import kept


def centered(wide: DataFrame, channels: Sequence[str], digits: int | None = None) -> DataFrame:
    """Each channel less its mean; the means, one number for each channel, come to the driver.

    With ``digits`` values are summed as decimals of so many digits, so a mean doesn't depend on the order of its sum.
    """
    mean = F.avg if digits is None else lambda c: F.sum(F.col(c).cast(f"decimal(38,{digits})")).cast("double") / F.count(c)
    means = wide.agg(*(mean(c).alias(f"_m_{c}") for c in channels)).first()
    return wide.withColumns({c: F.col(c) - F.lit(means[f"_m_{c}"]) for c in channels})


def rescaled(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    """All channels divided by the greatest magnitude among them."""
    most = wide.agg(F.greatest(*(F.max(F.abs(c)) for c in channels)).alias("m")).first()["m"]
    return wide.withColumns({c: F.col(c) / F.lit(most) for c in channels})


def cross_magnitude(wide: DataFrame, channels: Sequence[str]) -> Column:
    """The L2 norm over channels of a sample."""
    return F.sqrt(sum((F.col(c) * F.col(c) for c in channels), F.lit(0.0)))


def covariance(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Population covariances of all pairs of channels, in one pass: one, two, cov."""
    pairs = [(a, b) for a in channels for b in channels]
    row = wide.agg(*(F.covar_pop(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    stacked = ", ".join(f"'{a}', '{b}', `{i}`" for i, (a, b) in enumerate(pairs))
    return row.select(F.expr(f"stack({len(pairs)}, {stacked}) as (one, two, cov)"))


def lag_products(trace: DataFrame, lags: int, *, keys: Sequence[str] = ("rec_id", "channel"), zone: str | None = None) -> DataFrame:
    """Sums of v(t) v(t + lag) for lags 0..lags: keys, lag, s.  With ``zone`` both samples must lie in one zone.

    A sample's later neighbours come as columns of one ordered pass in blocks, each with the samples behind its border,
    so no sample is sent to each of its lags, and tasks hand on one row of sums for a key.
    """
    carried = ["v", *([zone] if zone else [])]
    order = Window.partitionBy(*keys, "_block").orderBy("t")
    later = {f"_p{k}": (lambda _, k=k: F.first(F.struct(*carried)).over(order.rangeBetween(k, k))) for k in range(1, lags + 1)}
    wide = in_blocks(trace.select(*keys, "t", *carried), later, 0, lags, keys=keys)
    alike = (lambda k: F.col(f"_p{k}")[zone].eqNullSafe(F.col(zone))) if zone else (lambda k: F.lit(True))
    products = [F.col("v") * F.col("v"), *(F.when(alike(k), F.col("v") * F.col(f"_p{k}")["v"]) for k in range(1, lags + 1))]
    sums = wide.groupBy(*keys).agg(*(F.sum(p).alias(f"_s{k}") for k, p in enumerate(products)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in range(lags + 1)))).alias("x")
    return sums.select(*keys, rows).select(*keys, "x.lag", "x.s").where("s is not null")


def autocorrelation(products: DataFrame, *, keys: Sequence[str] = ("rec_id", "channel")) -> DataFrame:
    """Lag products less that of the last lag, scaled to 1 at most in magnitude: keys, lag, acf."""
    ordered = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    less = products.withColumn("d", F.col("s") - F.last("s").over(ordered))
    most = F.max(F.abs("d")).over(Window.partitionBy(*keys))
    return less.select(*keys, "lag", (F.col("d") / most).alias("acf"))


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of evenly spaced bin centres; outer bins are open: keys, bin, center, n."""
    width = (high - low) / (bins - 1)
    return values.where(F.col(column).isNotNull()).groupBy(*keys, bin_of(F.col(column), low, high, bins).alias("bin")).agg(F.count("*").alias("n")).withColumn("center", low + F.col("bin") * width)


def correlogram(events: DataFrame, triggers: DataFrame, low: int, high: int, bins: int = 50, *, keys: Sequence[str] = (), auto: bool = False) -> DataFrame:
    """Counts of event - trigger on evenly spaced centres of [low, high]; zero lags are left out of an auto-correlogram.

    The last bin is doubled: it is half a bin wide inside the band, as the first is, whose other half lies before it.
    """
    pairs = band_join(events, triggers, low, high, keys=keys)
    return pair_correlogram(pairs.where("dt <> 0") if auto else pairs, low, high, bins, keys=keys)


def pair_correlogram(pairs: DataFrame, low: int, high: int, bins: int = 50, *, keys: Sequence[str] = ()) -> DataFrame:
    """A correlogram from the gaps ``dt`` of pairs within the band, wherever they were found."""
    counts = histogram(pairs, "dt", low, high, bins, keys=keys)
    return counts.withColumn("n", F.when(F.col("bin") == bins - 1, 2 * F.col("n")).otherwise(F.col("n")))


def elements(vectors: DataFrame, *, features: str = "features") -> DataFrame:
    """A row for each element of each vector: pos, x."""
    return vectors.select("*", F.posexplode(features).alias("pos", "x")).drop(features)


def centroids(vectors: DataFrame, *, label: str = "label") -> DataFrame:
    """Mean vectors by label, in long form: label, pos, x."""
    return elements(vectors).groupBy(label, "pos").agg(F.avg("x").alias("x"))


def centroid_distances(means: DataFrame, *, label: str = "label") -> DataFrame:
    """Root mean square distances of all pairs of centroids; a centroid's pair with itself has its own norm."""
    other = means.select(F.col(label).alias("two"), "pos", F.col("x").alias("y"))
    both = means.withColumnRenamed(label, "one").join(other, "pos")
    gap = F.when(F.col("one") == F.col("two"), F.col("x")).otherwise(F.col("x") - F.col("y"))
    return both.groupBy("one", "two").agg(F.sqrt(F.avg(gap * gap)).alias("distance"))


def gram(vectors: DataFrame, size: int, *, features: str = "features") -> DataFrame:
    """X'X of vectors of ``size`` elements: i, j, g.  Each task adds up matrix products of its batches; no vector is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = batch.column(0).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            total += x.T @ x
        i, j = np.indices((size, size), np.int32)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    parts = vectors.select(F.col(features).cast("array<double>").alias("x")).mapInArrow(run, "i int, j int, g double")
    return parts.groupBy("i", "j").agg(F.sum("g").alias("g"))


def relabel(rows: DataFrame, order: Sequence[int], *, label: str = "label") -> DataFrame:
    """Labels renamed by a permutation: the label order[i] becomes i (both from 0)."""
    new = F.create_map(*(F.lit(x) for i, old in enumerate(order) for x in (old, i)))
    return rows.withColumn(label, F.element_at(new, F.col(label)))


def triggered_average(trace: DataFrame, events: DataFrame, half: int, *, keys: Sequence[str] = ("rec_id", "channel")) -> DataFrame:
    """The mean of the trace at each lag around the events; samples outside of it count as 0: keys, lag, avg_v."""
    from sigspark.operators.joins import gather

    n = events.groupBy(*keys).agg(F.count("*").alias("n"))
    sums = gather(trace, events, half, keys=keys).groupBy(*keys, "lag").agg(F.sum("v").alias("s"))
    return sums.join(n, list(keys)).select(*keys, "lag", (F.col("s") / F.col("n")).alias("avg_v"))


def interpolated_average(trace: DataFrame, times: DataFrame, half: int, *, kind: str = "spline", margin: int = 6, keys: Sequence[str] = ("rec_id", "channel")) -> DataFrame:
    """The mean of the trace at each lag around times between samples (keys, t): keys, lag, avg_v.

    Samples within half + ``margin`` of a time are gathered by a band join; each time's few values are interpolated by a
    straight line or a cubic spline through them, and are 0 where the trace doesn't reach on both sides.
    """
    from sigspark.operators.learning import spline

    reach = half + margin
    marks = times.select(*keys, F.col("t").alias("at"), F.floor("t").alias("trigger_t"))
    pairs = band_join(trace.select(*keys, "t", "v"), marks, -reach, reach, keys=keys)
    windows_of = pairs.groupBy(*keys, "at", "trigger_t").agg(F.sort_array(F.collect_list(F.struct("dt", "v"))).alias("w"))
    lags = np.arange(-half, half + 1)

    @F.pandas_udf("array<double>")
    def around(first: pd.Series, values: pd.Series, part: pd.Series) -> pd.Series:
        out = []
        for dt, v, x in zip(first, values, part, strict=True):
            v = v.astype(float)
            at = lags + x - dt
            inside = (at >= 0) & (at <= len(v) - 1)
            out.append(np.where(inside, spline(v, at) if kind == "spline" else np.interp(at, np.arange(len(v)), v), 0.0))
        return pd.Series(out)

    values = windows_of.select(*keys, F.posexplode(around(F.col("w.dt")[0], F.col("w.v"), F.col("at") - F.col("trigger_t"))).alias("i", "x"))
    n = times.groupBy(*keys).agg(F.count("*").alias("n"))
    sums = values.groupBy(*keys, (F.col("i") - half).cast("long").alias("lag")).agg(F.sum("x").alias("s"))
    return sums.join(n, list(keys)).select(*keys, "lag", (F.col("s") / F.col("n")).alias("avg_v"))


def fir(trace: DataFrame, taps: Sequence[float], *, keys: Sequence[str] = ("rec_id", "channel"), advance: int = 0) -> DataFrame:
    """Causal filter: y(t) = sum taps[k] v(t - k), zeros before the start; ``advance`` takes a delay back.

    Taps become one expression over lags in blocks with halo, all in the JVM.
    """
    from sigspark.operators.blocks import with_halo

    left, right = max(0, len(taps) - 1 - advance), advance
    wide = with_halo(trace, left, right)
    ordered = Window.partitionBy(*keys, "_block").orderBy("t")
    terms = []
    for k, tap in enumerate(taps):
        at = k - advance
        moved = F.lag("v", at, 0.0).over(ordered) if at > 0 else F.lead("v", -at, 0.0).over(ordered) if at < 0 else F.col("v")
        terms.append(F.lit(float(tap)) * moved)
    y = terms[0]
    for term in terms[1:]:
        y = y + term
    return wide.withColumn("y", y).where("_core").select(*keys, "t", "y")


def spectrum(trace: DataFrame, freqs: Sequence[float], dt: float, *, keys: Sequence[str] = ("rec_id", "channel")) -> DataFrame:
    """Magnitudes of a few Fourier terms, in one pass: keys, freq, magnitude."""
    aggregates = []
    for i, f in enumerate(freqs):
        angle = F.col("t") * F.lit(2 * 3.141592653589793 * f * dt)
        aggregates += [F.sum(F.col("v") * F.cos(angle)).alias(f"c{i}"), F.sum(F.col("v") * F.sin(angle)).alias(f"s{i}")]
    rows = trace.groupBy(*keys).agg(*aggregates)
    parts = F.array(*(F.struct(F.lit(f).alias("freq"), F.sqrt(F.col(f"c{i}") ** 2 + F.col(f"s{i}") ** 2).alias("magnitude")) for i, f in enumerate(freqs)))
    return rows.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.freq", "x.magnitude")


def relative_change(rows: DataFrame, old: str, new: str) -> DataFrame:
    """100 times the mean squared change over the variance of the old values: change."""
    return rows.agg((F.avg((F.col(new) - F.col(old)) ** 2) / F.var_samp(old) * 100).alias("change"))


def objective_terms(residuals: DataFrame, spikes: DataFrame, sigma: float, penalty: float) -> DataFrame:
    """Fit and sparsity terms of the inference objective: fit, spikes, sparsity (penalty is -log of the rate, weighted)."""
    fit = residuals.agg((F.sum(F.col("v") * F.col("v")) / (2 * sigma * sigma)).alias("fit"))
    count = spikes.agg(F.sum(F.when(F.col("amp") > 0, 1).otherwise(0)).cast("long").alias("spikes"))
    return fit.crossJoin(count).withColumn("sparsity", F.col("spikes") * penalty)


def noise_likelihood(values: DataFrame, column: str = "v") -> DataFrame:
    """Mean log likelihoods of standardised values under a Gaussian and a Laplacian: gaussian, laplacian."""
    x = F.col(column)
    stats = values.agg(F.avg(x).alias("m"), F.var_pop(x).alias("var")).first()
    z = x - F.lit(stats["m"])
    sd = stats["var"] ** 0.5
    gaussian = F.avg(-z * z / (2 * stats["var"])) - F.log(F.lit((2 * 3.141592653589793) ** 0.5 * sd))
    laplacian = F.avg(-F.abs(z) * (2**0.5) / sd) - F.log(F.lit(2**0.5 * sd))
    return values.agg(gaussian.alias("gaussian"), laplacian.alias("laplacian"))


def matvec(triples: DataFrame, x: DataFrame) -> DataFrame:
    """A sparse matrix (i, j, v) times a vector (j, x): i, y."""
    return triples.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def transpose(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def flatten_spikes(snippets: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Ragged results (center, found: array of cell_id, offset, amp) as trains in absolute time, above a threshold."""
    rows = snippets.select("snip_id", "center", F.explode("found").alias("f"))
    return rows.select("snip_id", F.col("f.cell_id").alias("cell_id"), (F.col("center") + F.col("f.offset")).alias("t"), F.col("f.amp").alias("amp")).where(F.col("amp") > threshold)


def first_last(rows: DataFrame, order: str, n: int, *, keys: Sequence[str]) -> DataFrame:
    """The first and the last ``n`` rows by keys in ``order``: their columns, side (``first`` or ``last``) and place from 1.

    Spark drops all but ``n`` rows of a key in each task before it shuffles, so a key of any size is cheap.
    """
    out = []
    for side, by in (("first", F.col(order)), ("last", F.desc(order))):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(by))
        out.append(rows.withColumn("place", place).where(F.col("place") <= n).withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1]).withColumn("place", F.col("place").cast("long"))


def sample_without_replacement(rows: DataFrame, n: int, identity: Sequence[str], *, keys: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """``n`` rows of each key (all, if there are fewer): those whose hash of ``identity`` and seed is least.

    The same seed draws the same rows however they are partitioned.  Each task keeps its ``n`` least, then keys merge them.
    """
    drawn = F.xxhash64(F.lit(seed), *(F.col(c) for c in identity))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(drawn, *identity))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def pooled(rows: DataFrame, value: str, tie: str, size: int, *, keys: Sequence[str]) -> DataFrame:
    """All values of a key in ascending order, as a ragged array in blocks of ``size``: keys, block, start, n, values.

    A block holds structs of value and tie; its ``start`` is the number of values before it.  No row grows with a key.
    """
    flat = rows.select(*keys, value, tie, F.lit(1).alias("_one"), F.struct(value, tie).alias("_order"))
    placed = running_sums(flat, ("_one",), "_order", keys=keys).withColumn("_at", F.col("sum__one") - 1)
    blocks = placed.groupBy(*keys, F.floor(F.col("_at") / size).alias("block")).agg(F.min("_at").alias("start"), F.count("*").alias("n"), F.sort_array(F.collect_list("_order")).alias("values"))
    return blocks.select(*keys, "block", "start", "n", "values")


def exact_quantiles(rows: DataFrame, value: str, shares: Sequence[float], *, keys: Sequence[str] = (), bins: int = 1 << 12) -> DataFrame:
    """Quantiles of each key, interpolated between neighbours as ``percentile`` does, without a buffer of its values.

    keys, share, quantile.  Each quantile needs one or two order statistics.  Values are counted in ``bins`` equal bins
    between the bounds of the search for each of them, which shrinks to the bin that holds it, until that bin has few
    values or just one; a pass brings down a table of fixed size for each key, and the last one takes the few values.
    """
    data = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = data.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = F.array(*(F.struct(F.lit(float(q)).alias("share"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("at")) for q in shares))
    ranks = ends.select(*keys, "_lo", "_hi", "_n", F.explode(places).alias("_p")).select(*keys, "_lo", "_hi", "_n", "_p.share", "_p.at")
    # The order statistic of rank k lies in [_lo, _hi]; _below values are less than _lo, _n are in between.
    search = ranks.select(*keys, "share", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"))
    found = kept(search, "quantile-search")
    on = list(keys)
    for _ in range(8):
        wide = found.where((F.col("_in") > bins) & (F.col("_hi") > F.col("_lo")))
        if wide.isEmpty():
            break
        spans = wide.select(*keys, "_lo", "_hi").distinct()
        inside = (data.join(F.broadcast(spans), on) if on else data.crossJoin(F.broadcast(spans))).where("_v between _lo and _hi")
        at = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        counts = inside.groupBy(*keys, "_lo", "_hi", at.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_less", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        nearer = wide.join(counts, [*on, "_lo", "_hi"]).where("rank >= _below + _less and rank < _below + _less + _c")
        nearer = nearer.select(*keys, "share", "at", "rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_below") + F.col("_less")).alias("_below"), F.col("_c").alias("_in"))
        found = kept(nearer.unionByName(found.where((F.col("_in") <= bins) | (F.col("_hi") == F.col("_lo")))), "quantile-search")
    done = found.where("_hi = _lo").select(*keys, "share", "at", "rank", F.col("_lo").alias("x"))
    few = found.where("_hi > _lo")
    rest = (data.join(F.broadcast(few), on) if on else data.crossJoin(F.broadcast(few))).where("_v between _lo and _hi")
    ordered = Window.partitionBy(*keys, "share", "rank").orderBy("_v")
    picked = rest.withColumn("_k", F.row_number().over(ordered) - 1 + F.col("_below")).where("_k = rank").select(*keys, "share", "at", "rank", F.col("_v").alias("x"))
    low, high = F.min_by("x", "rank"), F.max_by("x", "rank")
    return done.unionByName(picked).groupBy(*keys, "share", "at").agg((low + (high - low) * (F.col("at") - F.floor("at"))).alias("quantile")).drop("at")
