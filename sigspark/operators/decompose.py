"""Templates in a trace: snippets, greedy pursuit of spikes, their reconstruction, and waveforms fitted again.

The pursuit is a row of Spark jobs over the whole trace: filters in blocks, local peaks, and a join that takes the found
templates away.  No snippet is solved by a local program.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.operators import aggregates, windows
from sigspark.operators.joins import band_join


def template_gains(trace: DataFrame, waveforms: list[np.ndarray], channels: Sequence[int]) -> DataFrame:
    """At each sample the template (time x channel, of one odd length) that takes most of the squares away: rec_id, t, cell_id, amp, gain.

    ``amp`` is the least-squares amplitude of the template centred there, and ``gain`` the squares that it explains; only
    positive amplitudes count.  A channel is filtered once for each template, in blocks.
    """
    half = len(waveforms[0]) // 2
    found = None
    for cell, w in enumerate(waveforms):
        parts = [aggregates.fir(trace.where(F.col("channel") == c), w[::-1, i].tolist(), advance=half) for i, c in enumerate(channels)]
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        power = float((w**2).sum())
        one = both.groupBy("rec_id", "t").agg((F.sum("y") / power).alias("amp")).select("rec_id", "t", F.struct((F.greatest("amp", F.lit(0.0)) ** 2 * power).alias("gain"), F.lit(-cell).alias("least"), "amp").alias("x"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("rec_id", "t").agg(F.max("x").alias("x"))
    return best.select("rec_id", "t", F.negative("x.least").alias("cell_id"), "x.amp", "x.gain")


def pursue(trace: DataFrame, waveforms: list[np.ndarray], threshold: float, rounds: int, channels: Sequence[int], keep: object = None) -> DataFrame:
    """Spikes by matching pursuit: rec_id, cell_id, t, amp, round.

    In each round the samples whose gain no other within a template's length exceeds, and whose amplitude is over
    ``threshold``, are spikes, all at once; their templates are taken from the trace, and the next round goes on with what is
    left.  ``keep`` writes a DataFrame and reads it back, so that lineage ends with each round (none: it grows).
    """
    keep = keep or (lambda df: df)
    left, spikes = trace.select("rec_id", "channel", "t", "v"), None
    for k in range(rounds):
        gains = template_gains(left, waveforms, channels).withColumnRenamed("gain", "v")
        peaks = windows.local_peaks(gains, 0.0, len(waveforms[0]), keys=("rec_id",)).where(F.col("amp") > threshold)
        found = keep(peaks.select("rec_id", "cell_id", "t", "amp", F.lit(k).alias("round")))
        spikes = found if spikes is None else spikes.unionByName(found)
        if k + 1 < rounds:
            model = reconstruct(found, waveforms, len(waveforms[0])).withColumnRenamed("v", "m")
            left = keep(left.join(model, ["rec_id", "channel", "t"], "left").select("rec_id", "channel", "t", (F.col("v") - F.coalesce("m", F.lit(0.0))).alias("v")))
    return spikes


def reconstruct(spikes: DataFrame, waveforms: list[np.ndarray], length: int) -> DataFrame:
    """The trace that spikes make, sum of amp times waveform at the nearest sample: rec_id, channel, t, v."""
    half = length // 2
    rows = [(k, c, lag - half, float(w[lag, c])) for k, w in enumerate(waveforms) for lag in range(len(w)) for c in range(w.shape[1])]
    shape = spikes.sparkSession.createDataFrame(rows, "cell_id int, channel int, lag int, w double")
    return spikes.join(shape, "cell_id").groupBy("rec_id", "channel", (F.round("t") + F.col("lag")).cast("long").alias("t")).agg(F.sum(F.col("amp") * F.col("w")).alias("v"))


def refit_waveforms(trace: DataFrame, spikes: DataFrame, thresholds: DataFrame, half: int) -> DataFrame:
    """Waveforms as means of the trace around each cell's spikes above its threshold, 0 outside of the trace: cell_id, channel, lag, w.

    ``spikes`` has rec_id, cell_id, t and amp; a cell without a row in ``thresholds`` (cell_id, threshold) keeps all.
    """
    kept = spikes.join(thresholds, "cell_id", "left").where(F.col("amp") > F.coalesce("threshold", F.lit(float("-inf"))))
    marks = kept.select("rec_id", "cell_id", F.round("t").cast("long").alias("trigger_t"))
    n = marks.groupBy("cell_id").agg(F.count("*").alias("n"))
    sums = band_join(trace.select("rec_id", "channel", "t", "v"), marks, -half, half, keys=("rec_id",)).groupBy("cell_id", "channel", F.col("dt").alias("lag")).agg(F.sum("v").alias("s"))
    return sums.join(n, "cell_id").select("cell_id", "channel", "lag", (F.col("s") / F.col("n")).alias("w"))


__all__ = ["pursue", "reconstruct", "refit_waveforms", "template_gains"]
