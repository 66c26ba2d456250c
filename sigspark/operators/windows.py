"""Peaks, smoothing, norms, islands, silence and partitions of traces (rec_id, channel, t, v)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.tables import kept
from sigspark.operators.blocks import BLOCK, following, in_blocks

KEYS = ("rec_id", "channel")


def extent(trace: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First and last sample of each series; one row a series."""
    return trace.groupBy(*keys).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def local_peaks(trace: DataFrame, threshold: float, reach: int, border: int = 0, *, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Samples above ``threshold`` that no sample within ``reach`` exceeds; all of equal neighbours count.

    The first ``border`` samples and the last ``border`` + 1 are left out (none of either for border 0).
    """
    seen = in_blocks(trace, {"most": lambda w: F.max("v").over(w)}, reach, reach, keys=keys, block=block)
    peaks = seen.where((F.col("v") > threshold) & (F.col("v") >= F.col("most"))).drop("most")
    if border:
        ends = extent(trace, keys)
        peaks = peaks.join(F.broadcast(ends) if not keys else ends, list(keys)).where((F.col("t") >= F.col("t_first") + border) & (F.col("t") < F.col("t_last") - border)).drop("t_first", "t_last")
    return peaks


def moving_average(trace: DataFrame, span: int, *, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """The mean over an odd span that shrinks evenly on both sides at the ends of a series: adds ``smooth``."""
    half = span // 2
    if span % 2 == 0 or half < 1:
        raise ValueError("span must be odd and at least 3")
    seen = in_blocks(trace, {"smooth": lambda w: F.avg("v").over(w)}, half, half, keys=keys, block=block)
    seen = seen.join(extent(trace, keys), list(keys)).withColumn("side", F.least(F.col("t") - F.col("t_first"), F.col("t_last") - F.col("t")))
    inner = seen.where(F.col("side") >= half).drop("side", "t_first", "t_last")
    # The ends are 2 * half samples of each series, with their neighbours.
    ends = seen.where(F.col("side") < half)
    source = seen.where(F.col("side") < 2 * half).select(*keys, F.col("t").alias("near"), F.col("v").alias("near_v"), (F.col("t") - F.col("t_first") >= F.col("t_last") - F.col("t")).alias("late"))
    ends = ends.withColumn("late", F.col("t") - F.col("t_first") >= F.col("t_last") - F.col("t"))
    short = ends.select(*keys, "t", "late", "side").join(source, [*keys, "late"]).where(F.abs(F.col("near") - F.col("t")) <= F.col("side"))
    means = short.groupBy(*keys, "t").agg(F.avg("near_v").alias("smooth"))
    outer = ends.drop("smooth", "side", "late", "t_first", "t_last").join(means, [*keys, "t"]).select(*inner.columns)
    return inner.unionByName(outer)


def sliding_norm(trace: DataFrame, width: int, step: int | None = None, *, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """The L2 norm of each window of ``width`` samples, at its last sample, from the first whole window on every ``step`` (width / 8)."""
    step = step or max(1, width // 8)
    seen = in_blocks(trace, {"norm": lambda w: F.sqrt(F.sum(F.col("v") * F.col("v")).over(w))}, width - 1, 0, keys=keys, block=block)
    seen = seen.join(extent(trace, keys).drop("t_last"), list(keys))
    at = F.col("t") - F.col("t_first") - (width - 1)
    return seen.where((at >= 0) & (at % step == 0)).select(*keys, "t", "norm")


def shifted(trace: DataFrame, k: int, *, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """The trace moved right, as it is, and moved left by k, zeros coming in: adds before, here and after."""
    columns = {"before": F.lag("v", k, 0.0), "after": F.lead("v", k, 0.0)}
    return in_blocks(trace, columns, k, k, keys=keys, block=block).withColumn("here", F.col("v"))


def padded(trace: DataFrame, n: int, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """The trace with ``n`` copies of its first value before it and of its last one behind it: keys, t, v."""
    ends = trace.groupBy(*keys).agg(F.min(F.struct("t", "v")).alias("a"), F.max(F.struct("t", "v")).alias("b"))
    k = F.sequence(F.lit(1), F.lit(n))
    spare = F.explode(F.concat(F.transform(k, lambda i: F.struct((F.col("a.t") - i).alias("t"), F.col("a.v").alias("v"))), F.transform(k, lambda i: F.struct((F.col("b.t") + i).alias("t"), F.col("b.v").alias("v")))))
    return trace.select(*keys, "t", "v").unionByName(ends.select(*keys, spare.alias("x")).select(*keys, "x.t", "x.v"))


def rotated(trace: DataFrame, k: int, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """The trace moved right by k with its end coming in at its start; no sample is ordered or shuffled by time."""
    n = F.col("t_last") - F.col("t_first") + 1
    return trace.join(extent(trace, keys), list(keys)).withColumn("t", F.col("t_first") + F.pmod(F.col("t") - F.col("t_first") + k, n)).drop("t_first", "t_last")


def prefix_index(rows: DataFrame, order: str, count: str, *, block: int = 1 << 16) -> DataFrame:
    """``rows`` with ``start``, the sum of ``count`` over the rows before in ``order`` (whole numbers, each once), in blocks of it."""
    cut = rows.withColumn("_block", F.floor(F.col(order) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    base = cut.groupBy("_block").agg(F.sum(count).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.sum(count).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("_in", F.coalesce(inside, F.lit(0))).join(base, "_block").withColumn("start", F.col("_base") + F.col("_in")).drop("_block", "_base", "_in")


def islands(trace: DataFrame, mask: Column, *, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Runs of samples where ``mask`` holds: start, end and len of each.

    Runs are found inside blocks, and those that touch a block's border, two a block at most, are then chained: no
    task orders more than a block, or the borders of one series.
    """
    inside = trace.where(mask).select(*keys, "t", F.floor(F.col("t") / block).alias("_block"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("t"))
    parts = inside.withColumn("_run", F.col("t") - rank).groupBy(*keys, "_block", "_run").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return chained_runs(parts, keys=keys, block=block)


def chained_runs(parts: DataFrame, *, keys: Sequence[str], block: int) -> DataFrame:
    """Runs (keys, start, end) that were found inside blocks, with those that meet at a block's border made one: start, end, len."""
    at_border = (F.pmod("start", F.lit(block)) == 0) | (F.pmod(F.col("end") + 1, F.lit(block)) == 0)
    whole = parts.where(~at_border).select(*keys, "start", "end")
    ordered = Window.partitionBy(*keys).orderBy("start")
    fresh = F.when(F.col("start") - F.lag("end").over(ordered) == 1, 0).otherwise(1)
    chained = parts.where(at_border).withColumn("_new", fresh).withColumn("_chain", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    chained = chained.groupBy(*keys, "_chain").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end")
    return whole.unionByName(chained).withColumn("len", F.col("end") - F.col("start") + 1)


def quiet_zones(trace: DataFrame, threshold: float, min_len: int, *, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Runs below ``threshold`` of strictly more than ``min_len`` samples."""
    return islands(trace, F.col("v") < threshold, keys=keys, block=block).where(F.col("len") > min_len)


def silence_runs(trace: DataFrame, threshold: float, min_silence: int, *, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Runs not above ``threshold`` of at least ``min_silence`` samples, at the ends of a series too."""
    return islands(trace, ~(F.col("v") > threshold), keys=keys, block=block).where(F.col("len") >= min_silence)


def active_partition(trace: DataFrame, threshold: float, min_silence: int, pad: int, min_snippet: int = 1, *, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Snippets: what lies between silences, padded, made odd, and at least ``min_snippet`` long where the series allows.

    Returns start, end, len, center.  Padding stays in the series; an even length takes one more sample at the end, or,
    at the end of the series, one more at the start.
    """
    quiet = silence_runs(trace, threshold, min_silence, keys=keys, block=block)
    ends = extent(trace, keys)
    # Activity is the gap between neighbouring silences; a series without silence is one gap.
    marks = quiet.select(*keys, "start", "end").unionByName(ends.select(*keys, (F.col("t_first") - 1).alias("start"), (F.col("t_first") - 1).alias("end"))).unionByName(ends.select(*keys, (F.col("t_last") + 1).alias("start"), (F.col("t_last") + 1).alias("end")))
    gaps = following(marks, "start", ["end", "start"], keys=keys, block=block).withColumn("s", F.col("end") + 1).withColumn("e", F.col("_next") - 1).where("e >= s").join(ends, list(keys))
    extra = F.greatest(F.lit(0), F.lit(min_snippet) - (F.col("e") - F.col("s") + 1 + 2 * pad))
    grown = gaps.withColumn("a", F.greatest(F.col("t_first"), F.col("s") - pad - F.ceil(extra / 2))).withColumn("b", F.least(F.col("t_last"), F.col("e") + pad + F.ceil(extra / 2)))
    even = (F.col("b") - F.col("a")) % 2 == 1
    grown = grown.withColumn("odd_b", F.when(even & (F.col("b") < F.col("t_last")), F.col("b") + 1).otherwise(F.col("b")))
    grown = grown.withColumn("odd_a", F.when((F.col("odd_b") - F.col("a")) % 2 == 1, F.greatest(F.col("a") - 1, F.col("t_first"))).otherwise(F.col("a")))
    out = grown.select(*keys, F.col("odd_a").alias("start"), F.col("odd_b").alias("end"))
    return out.withColumn("len", F.col("end") - F.col("start") + 1).withColumn("center", F.floor((F.col("start") + F.col("end")) / 2))


def partition_signal(trace: DataFrame, *, smooth_len: int, stds: float, min_silence: int, pad: int, min_snippet: int = 1, rec: str = "rec_id", block: int = BLOCK) -> DataFrame:
    """Snippets of all channels together, where their magnitude is loud: rec_id, start, end, len, center.

    The magnitude over channels is smoothed over ``smooth_len`` samples, and loud is what exceeds ``stds`` of its standard
    deviations.  One number for each recording comes to the driver.
    """
    level = trace.groupBy(rec, "t").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))
    if smooth_len > 1:
        level = moving_average(level, smooth_len, keys=(rec,), block=block).select(rec, "t", F.col("smooth").alias("v"))
    smooth = kept(level, "smoothed")  # its deviation comes first, then its runs
    out = None
    for r in smooth.groupBy(rec).agg(F.stddev_samp("v").alias("s")).collect():
        mine = smooth.where(F.col(rec).eqNullSafe(F.lit(r[rec])))
        part = active_partition(mine, stds * (r["s"] or 0.0), min_silence, pad, min_snippet, keys=(rec,), block=block)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else active_partition(smooth, 0.0, min_silence, pad, min_snippet, keys=(rec,), block=block)


def partition_breaks(snippets: DataFrame, *, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """The gaps between neighbouring snippets: start, end, len; overlapping neighbours leave none."""
    gaps = following(snippets.select(*keys, "start", "end"), "start", ["start"], keys=keys, block=block).select(*keys, (F.col("end") + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"))
    return gaps.where("gap_end >= gap_start").select(*keys, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"), (F.col("gap_end") - F.col("gap_start") + 1).alias("len"))


def cumulative_cutoff(values: DataFrame, percent: float, at_least: int = 2, *, rank: str = "rank", value: str = "value") -> DataFrame:
    """The smallest rank whose running share of the total exceeds ``percent``; for short tables such as eigenvalues."""
    ordered = Window.orderBy(rank)
    total = F.sum(value).over(Window.partitionBy())
    share = 100 * F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) / total
    return values.withColumn("share", share).where(F.col("share") > percent).agg(F.greatest(F.min(rank), F.lit(at_least)).alias("kept"))


def sessions(points: DataFrame, gap: int, *, keys: Sequence[str], t: str = "t", blocks: int = 4096) -> DataFrame:
    """Runs of points less than ``gap`` apart: start, end, n.  The batch twin of a session window.

    Runs are found inside blocks of ``blocks`` gaps of time; those within a gap of a block's border, two a block at most,
    are then chained, so no task orders all points of a key.
    """
    width = gap * blocks
    cut = points.select(*keys, F.col(t).alias("_t"), F.floor(F.col(t) / width).alias("_block"))
    ordered = Window.partitionBy(*keys, "_block").orderBy("_t")
    fresh = F.when(F.col("_t") - F.lag("_t").over(ordered) < gap, 0).otherwise(1)
    numbered = cut.withColumn("_new", fresh).withColumn("_session", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*keys, "_block", "_session").agg(F.min("_t").alias("start"), F.max("_t").alias("end"), F.count("*").alias("n"))
    at_border = (F.col("start") - F.col("_block") * width < gap) | ((F.col("_block") + 1) * width - F.col("end") < gap)
    border = Window.partitionBy(*keys).orderBy("start")
    chained = parts.where(at_border).withColumn("_new", F.when(F.col("start") - F.lag("end").over(border) < gap, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(border.rowsBetween(Window.unboundedPreceding, 0)))
    chained = chained.groupBy(*keys, "_chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return parts.where(~at_border).select(*keys, "start", "end", "n").unionByName(chained.select(*keys, "start", "end", "n"))
