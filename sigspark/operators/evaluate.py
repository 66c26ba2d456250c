"""Scores of estimated against true trains, thresholds, and their sweep."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.stats import kde_threshold
from sigspark.operators.blocks import running_sums
from sigspark.operators.joins import best_unit_ordering, greedy_match, merged_runs
from sigspark.operators.matching import windows_of


def prune(spikes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Spikes strictly above their cell's threshold; a cell without one keeps all."""
    return spikes.join(thresholds, "cell_id", "left").where(F.col("threshold").isNull() | F.col("amp").isNull() | (F.col("amp") > F.col("threshold"))).drop("threshold")


def score(est: DataFrame, true: DataFrame, slack: float, thresholds: DataFrame | None = None) -> DataFrame:
    """By cell: n_true, n_est, hits, misses, false_positives.  A true cell that no estimate has counts as all missed."""
    est = prune(est, thresholds) if thresholds is not None else est
    hits = greedy_match(est, true, -slack, slack).groupBy("cell_id").agg(F.count("*").alias("hits"))
    n_est = est.groupBy("cell_id").agg(F.count("*").alias("n_est"))
    n_true = true.groupBy("cell_id").agg(F.count("*").alias("n_true"))
    rows = n_true.join(n_est, "cell_id", "full").join(hits, "cell_id", "left").na.fill(0, ["n_true", "n_est", "hits"])
    return rows.withColumn("misses", F.col("n_true") - F.col("hits")).withColumn("false_positives", F.col("n_est") - F.col("hits"))


def summary(scores: DataFrame) -> DataFrame:
    """One row: misses, n_true, miss_percent, false_positives, n_est, fp_percent and a sentence."""
    total = scores.agg(*(F.sum(c).cast("long").alias(c) for c in ("misses", "n_true", "false_positives", "n_est")))
    total = total.withColumn("miss_percent", F.round(100 * F.col("misses") / F.col("n_true"), 1)).withColumn("fp_percent", F.round(100 * F.col("false_positives") / F.col("n_est"), 1))
    return total.withColumn("line", F.format_string("misses: %d of %d (%.1f %%), false positives: %d of %d (%.1f %%)", "misses", "n_true", "miss_percent", "false_positives", "n_est", "fp_percent"))


def auto_thresholds(spikes: DataFrame, *, points: int = 32, low: float = 0.3, high: float = 1.0, width: int = 5, mesh: int = 1 << 10) -> DataFrame:
    """An amplitude threshold for each cell: the last local minimum of its density on [low, high]: cell_id, threshold.

    Amplitudes are binned in Spark; a group holds a cell's ``mesh`` counts and never its spikes.  No minimum gives 0.
    """
    spread = spikes.where(F.col("amp").isNotNull()).groupBy("cell_id").agg(F.min("amp").alias("a"), F.max("amp").alias("b"), F.count_distinct("amp").alias("n"))
    at = (F.col("amp") - F.col("a")) / F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1.0)
    binned = spikes.join(spread, "cell_id").groupBy("cell_id", "a", "b", "n", F.least(F.floor(at * (mesh - 1) + 0.5), F.lit(mesh - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(mesh)
        counts[rows["bin"]] = rows["count"]
        first = rows.iloc[0]
        return pd.DataFrame({"cell_id": [first["cell_id"]], "threshold": [kde_threshold(counts, first["a"], first["b"], int(first["n"]), points, low, high, width)]})

    return binned.groupBy("cell_id").applyInPandas(run, f"cell_id {dict(spikes.dtypes)['cell_id']}, threshold double")


def threshold_roc(est: DataFrame, true: DataFrame, slack: float, *, levels: Sequence[float]) -> DataFrame:
    """Misses and false positives of each cell at each threshold: cell_id, threshold, n_est, hits, misses, false_positives.

    Thresholds are keys of the match, so all levels of all cells match at once.
    """
    points = F.explode(F.array(*(F.lit(float(x)) for x in levels)))
    kept = est.withColumn("threshold", points).where(F.col("amp") > F.col("threshold"))
    truth = true.withColumn("threshold", points)
    hits = greedy_match(kept, truth, -slack, slack, keys=("cell_id", "threshold")).groupBy("cell_id", "threshold").agg(F.count("*").alias("hits"))
    n_est = kept.groupBy("cell_id", "threshold").agg(F.count("*").alias("n_est"))
    n_true = truth.groupBy("cell_id", "threshold").agg(F.count("*").alias("n_true"))
    rows = n_true.join(n_est, ["cell_id", "threshold"], "left").join(hits, ["cell_id", "threshold"], "left").na.fill(0, ["n_est", "hits"])
    return rows.withColumn("misses", F.col("n_true") - F.col("hits")).withColumn("false_positives", F.col("n_est") - F.col("hits"))


def gains(first: np.ndarray, last: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which estimates, taken in ``order``, let the number of matches grow; estimate i fits true events [first, last).

    A greedy match in time is a largest one, and sets of estimates that can all be matched are independent as in a
    matroid, so among the estimates taken so far there are as many matches as gains.  A tree over the estimates in time
    holds for each span the place that its last match takes, max(before + a, b), and the latest place before it, c, from
    which all of its own are in time.
    """
    size = 1 << max(0, len(first) - 1).bit_length()
    far = 1 << 60
    a, b, c = (array("q", [x]) * (2 * size) for x in (0, -far, far))  # 48 bytes an estimate; lists of ints take several times that
    out = np.zeros(len(first), bool)
    for i in map(int, order):
        lo, hi = int(first[i]), int(last[i])
        if lo >= hi:
            continue
        at, undo = size + i, []
        new = (1, lo, hi - 2)
        while at:
            undo.append((at, a[at], b[at], c[at]))
            a[at], b[at], c[at] = new
            at >>= 1
            if at:
                x, y = 2 * at, 2 * at + 1
                new = (a[x] + a[y], max(b[x] + a[y], b[y]), min(c[x], c[y] - a[x]) if b[x] <= c[y] else -far)
        if c[1] >= -1:
            out[i] = True
        else:
            for at, *old in undo:
                a[at], b[at], c[at] = old
    return out


def amplitude_roc(est: DataFrame, true: DataFrame, slack: float) -> DataFrame:
    """Scores of each cell at 0 and at each of its amplitudes but the greatest, as thresholds: cell_id, rank, threshold,
    n_est, hits, misses, false_positives, miss_rate, fp_rate.

    Rank is the threshold's place in ascending order, from 1; equal amplitudes are as many rows.  An estimate passes if
    its amplitude is over the threshold.  fp_rate divides by the estimates from that place on, miss_rate by all true ones.
    Each run of neighbours in reach is matched once, in falling order of amplitude: an estimate that lets its run's
    matches grow is a gain at its amplitude, and the matches over a threshold are the gains over it, a running sum.
    """
    runs = merged_runs(est, true, slack, keys=("cell_id",))
    sides = Window.partitionBy("cell_id", "_run")
    runs = runs.withColumn("_sides", F.min("_side").over(sides) + 2 * F.max("_side").over(sides)).where("_sides = 2").drop("_sides")

    def gained_in(rows: pd.DataFrame) -> pd.DataFrame:
        """The gains of whole runs, one behind another."""
        cells, tags = rows["cell_id"].to_numpy(), rows["_run"].to_numpy()
        side, t, amp = rows["_side"].to_numpy(), rows["t"].to_numpy(), rows["amp"].to_numpy(float)
        starts = np.flatnonzero(np.r_[True, (tags[1:] != tags[:-1]) | (cells[1:] != cells[:-1])]).tolist()
        hit = np.zeros(len(rows), bool)
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            est_at = a + np.flatnonzero(side[a:b] == 0)
            windows = windows_of(t[est_at], t[a:b][side[a:b] == 1], -slack, slack, True)
            hit[est_at] = gains(*windows, np.argsort(-amp[est_at], kind="stable"))
        return pd.DataFrame({"cell_id": cells[hit], "amp": amp[hit]})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last run so far
        for batch in batches:
            tag = batch[["cell_id", "_run"]]
            last = (tag == tag.iloc[-1]).all(axis=1)
            if held and not (tag.iloc[0] == held[-1][["cell_id", "_run"]].iloc[-1]).all():
                yield gained_in(pd.concat(held))
                held = []
            if not last.all():
                yield gained_in(pd.concat([*held, batch[~last]]))
                held = []
            held.append(batch[last])
        if held:
            yield gained_in(pd.concat(held))

    cell = dict(est.dtypes)["cell_id"]
    runs = runs.sortWithinPartitions("cell_id", "_run", "t", "id").select("cell_id", "_run", "_side", "t", "amp")
    gained = runs.mapInPandas(stream, f"cell_id {cell}, amp double")
    both = est.select("cell_id", "amp", F.lit(1).alias("n"), F.lit(0).alias("gain")).unionByName(gained.select("cell_id", "amp", F.lit(0).alias("n"), F.lit(1).alias("gain")))
    steps = running_sums(both.groupBy("cell_id", "amp").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain")), ("n", "gain"), "amp", keys=("cell_id",))
    positive = F.col("amp") > 0
    totals = steps.groupBy("cell_id").agg(F.max("sum_n").alias("all_n"), F.max("sum_gain").alias("all_gain"), F.coalesce(F.sum(F.when(positive, F.col("n"))), F.lit(0)).alias("n_est"), F.coalesce(F.sum(F.when(positive, F.col("gain"))), F.lit(0)).alias("hits"))
    over = steps.join(totals.drop("n_est", "hits"), "cell_id").select("cell_id", F.col("amp").alias("threshold"), (F.col("all_n") - F.col("sum_n")).alias("n_est"), (F.col("all_gain") - F.col("sum_gain")).alias("hits"), "all_n", F.explode(F.sequence(F.col("sum_n") - F.col("n") + 2, F.col("sum_n") + 1)).alias("rank")).where("rank <= all_n")
    rows = over.unionByName(totals.select("cell_id", F.lit(0.0).alias("threshold"), "n_est", "hits", "all_n", F.lit(1).cast("long").alias("rank")))
    n_true = true.groupBy("cell_id").agg(F.count("*").alias("n_true"))
    scored = rows.join(n_true, "cell_id", "left").na.fill(0, ["n_true"]).withColumn("misses", F.col("n_true") - F.col("hits")).withColumn("false_positives", F.col("n_est") - F.col("hits"))
    rates = scored.withColumn("miss_rate", F.when(F.col("n_true") > 0, F.col("misses") / F.col("n_true"))).withColumn("fp_rate", F.col("false_positives") / (F.col("all_n") - F.col("rank") + 1))
    return rates.select("cell_id", "rank", "threshold", "n_est", "hits", "misses", "false_positives", "miss_rate", "fp_rate")


def score_best_order(est: DataFrame, true: DataFrame, slack: float, thresholds: DataFrame | None = None) -> DataFrame:
    """``score`` after estimated units took the names of the true units they fit best; thresholds go by estimated unit.

    One pair of names for each unit comes to the driver.  An estimated unit without a partner keeps its name, marked, and
    counts as false positives.
    """
    pairs = [(a, b) for b, a in best_unit_ordering(est, true, slack) if a is not None]
    kept = prune(est, thresholds) if thresholds is not None else est
    names = est.sparkSession.createDataFrame([(a, b if b is not None else f"unpaired {a}") for a, b in pairs], "cell_id string, _to string")
    return score(kept.join(F.broadcast(names), "cell_id").withColumn("cell_id", F.col("_to")).drop("_to"), true, slack)


def reorder_truth(est: DataFrame, true: DataFrame, slack: float) -> DataFrame:
    """``true`` with each unit named like the estimated unit that it fits best; one without a partner keeps its name."""
    pairs = [(b, a if a is not None else b) for b, a in best_unit_ordering(est, true, slack) if b is not None]
    names = true.sparkSession.createDataFrame(pairs, "cell_id string, _to string")
    return true.join(F.broadcast(names), "cell_id").withColumn("cell_id", F.col("_to")).drop("_to")


def rank_by_norm(means: DataFrame, *, label: str = "label") -> DataFrame:
    """Centroids (label, pos, x) by falling L2 norm: label, norm, rank from 0; centroids number a few."""
    norms = means.groupBy(label).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return norms.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("norm"), label)) - 1)


__all__ = ["amplitude_roc", "auto_thresholds", "gains", "prune", "rank_by_norm", "reorder_truth", "score", "score_best_order", "summary", "threshold_roc"]
