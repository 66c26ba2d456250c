"""Matching of point processes and intervals: band, nearest and greedy one-to-one joins, and their complements."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.matching import run_block, scan_match, windows_of


def band_join(events: DataFrame, triggers: DataFrame, low: int, high: int, *, keys: Sequence[str] = (), t: str = "t", trigger_t: str = "trigger_t") -> DataFrame:
    """All pairs with low <= event - trigger <= high (both ends in).

    A trigger is repeated in the two or three buckets, as wide as the band, that its partners can lie in, which makes the
    range an equality and the join one by hash or merge.
    """
    width = max(1, high - low)
    left = events.withColumn("_bucket", F.floor(F.col(t) / width))
    first, last = F.floor((F.col(trigger_t) + low) / width), F.floor((F.col(trigger_t) + high) / width)
    right = triggers.withColumn("_bucket", F.explode(F.sequence(first, last)))
    gap = F.col(t) - F.col(trigger_t)
    return left.join(right, [*keys, "_bucket"]).where((gap >= low) & (gap <= high)).withColumn("dt", gap).drop("_bucket")


def nearest_join(points: DataFrame, intervals: DataFrame, *, keys: Sequence[str] = (), t: str = "t", center: str = "center", width: str = "width", block: int = 1 << 16) -> DataFrame:
    """Each point with the nearest interval centre, kept where the distance is at most 0.5 + width / 2; the lesser of ties.

    One pass over the union in time order carries the last centre from either side; it runs apart in blocks of time, and
    each block also gets the nearest centres outside of it.
    """
    c = intervals.select(*keys, F.col(center).alias("_c"), F.col(width).alias("_w"))
    c = c.withColumn("_block", F.floor(F.col("_c") / block))
    p = points.withColumn("_block", F.floor(F.col(t) / block))
    # Of each block its first and last centre; blocks without one take those of their neighbours in turn.
    edges = c.groupBy(*keys, "_block").agg(F.min(F.struct("_c", F.negative("_w").alias("_n"))).alias("lo"), F.max(F.struct("_c", "_w")).alias("hi"))
    shown = p.select(*keys, "_block").distinct().join(edges, [*keys, "_block"], "left")
    shown = shown.unionByName(edges.join(shown, [*keys, "_block"], "left_anti"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)  # frames grow, whichever way they look
    carried = shown.withColumn("b", F.last("hi", ignorenulls=True).over(before)).withColumn("a", F.last("lo", ignorenulls=True).over(after))
    outside = carried.select(*keys, "_block", F.explode(F.array_compact(F.array(F.col("b"), F.when(F.col("a").isNotNull(), F.struct(F.col("a._c").alias("_c"), (-F.col("a._n")).alias("_w")))))).alias("x")).select(*keys, "_block", "x._c", "x._w")
    marks = c.unionByName(outside).select(*keys, "_block", F.col("_c").alias("_at"), F.lit(0).alias("_kind"), F.struct("_c", "_w").alias("_mark"))
    both = marks.unionByName(p.withColumn("_at", F.col(t)).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    ordered = Window.partitionBy(*keys, "_block").orderBy("_at", "_kind")
    turned = Window.partitionBy(*keys, "_block").orderBy(F.desc("_at"), F.desc("_kind"))
    left = F.last("_mark", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    right = F.last("_mark", ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("_l", left).withColumn("_r", right).where("_kind = 1")
    use_left = F.col("_r").isNull() | (F.abs(F.col(t) - F.col("_l._c")) <= F.abs(F.col("_r._c") - F.col(t)))
    seen = seen.withColumn("_m", F.when(F.col("_l").isNotNull() & use_left, F.col("_l")).otherwise(F.col("_r")))
    near = F.abs(F.col(t) - F.col("_m._c")) <= 0.5 + F.col("_m._w") / 2
    return seen.withColumn(center, F.when(near, F.col("_m._c"))).drop("_block", "_at", "_kind", "_mark", "_l", "_r", "_m")


def match_sorted(est: np.ndarray, true: np.ndarray, low: float, high: float, closed: bool = True) -> np.ndarray:
    """For each sorted ``est`` the index of its match in sorted ``true``, or -1.

    In ascending order each takes the first unused true time with low <= true - est <= high (strictly if not closed).
    """
    return run_block(*windows_of(est, true, low, high, closed), 0)[0]


def match_by_amplitude(est: np.ndarray, amps: np.ndarray, true: np.ndarray, slack: float) -> np.ndarray:
    """For each true time the index of the unused estimate within ``slack`` (strictly) of the greatest amplitude, or -1."""
    out = np.full(len(true), -1, np.int64)
    used = np.zeros(len(est), bool)
    for j, x in enumerate(true):
        a, b = np.searchsorted(est, x - slack, "right"), np.searchsorted(est, x + slack, "left")
        free = [i for i in range(a, b) if not used[i]]
        if free:
            best = max(free, key=lambda i: (amps[i], -i))
            out[j] = best
            used[best] = True
    return out


def merged_runs(est: DataFrame, true: DataFrame, reach: float, *, keys: Sequence[str], blocks: int = 4096) -> DataFrame:
    """Both trains with _side and _run, the time that a run starts at: a gap of over ``reach`` in the merged times starts one.

    No match crosses such a gap, so runs match apart.  Starts are found in blocks of ``blocks`` reaches of time, to which
    the last time and start before each block are carried, so a train of any length spreads over tasks; one row for each
    block is all that is ordered for a whole train.
    """
    both = est.select(*keys, F.col("id"), F.col("t"), F.col("amp"), F.lit(0).alias("_side")).unionByName(true.select(*keys, F.col("id"), F.col("t"), F.lit(None).cast("double").alias("amp"), F.lit(1).alias("_side")))
    both = both.withColumn("_block", F.floor(F.col("t") / max(1, blocks * reach)))
    trains = Window.partitionBy(*keys).orderBy("_block")
    last = both.groupBy(*keys, "_block").agg(F.max("t").alias("_last")).withColumn("_last", F.lag("_last").over(trains))
    ordered = Window.partitionBy(*keys, "_block").orderBy("t", "_side", "id")
    gap = F.col("t") - F.coalesce(F.lag("t").over(ordered), F.col("_last"))
    marked = both.join(last, [*keys, "_block"]).withColumn("_start", F.when(gap.isNull() | (gap > reach), F.col("t"))).drop("_last")
    before = marked.groupBy(*keys, "_block").agg(F.max("_start").alias("_before"))
    before = before.withColumn("_before", F.last("_before", ignorenulls=True).over(trains.rowsBetween(Window.unboundedPreceding, -1)))
    run = F.coalesce(F.last("_start", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    return marked.join(before, [*keys, "_block"]).withColumn("_run", run).drop("_start", "_before", "_block")


def greedy_match(est: DataFrame, true: DataFrame, low: float, high: float, *, keys: Sequence[str] = ("cell_id",), closed: bool = True, by_amplitude: bool = False) -> DataFrame:
    """One-to-one matches of two trains (keys, id, t and amp): keys, est_id, true_id.

    Greedy in ascending order of time; ``by_amplitude`` matches each true time with the largest estimate within
    ``high`` instead.  Unmatched events have no row; their anti-join gives misses and false positives.
    """
    return _match_amplitudes(est, true, high, keys) if by_amplitude else scan_match(est, true, low, high, keys=keys, closed=closed)


def _match_amplitudes(est: DataFrame, true: DataFrame, slack: float, keys: Sequence[str]) -> DataFrame:
    """Runs match apart: which of a run's estimates are taken depends on all before them, so a run is one task's."""
    runs = merged_runs(est, true, slack, keys=keys)
    # Runs with one side only can't match and never reach Python.  This window also brings each run into one task.
    sides = Window.partitionBy(*keys, "_run")
    runs = runs.withColumn("_sides", F.min("_side").over(sides) + 2 * F.max("_side").over(sides)).where("_sides = 2").drop("_sides")
    types = dict(est.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"est_id {types['id']}", f"true_id {types['id']}"])
    names = list(keys)

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        """Whole runs of one train, in order of time; what is out of reach is never taken, so runs need not be told apart."""
        side = rows["_side"].to_numpy()
        t, ids = rows["t"].to_numpy(), rows["id"].to_numpy()
        got = match_by_amplitude(t[side == 0], rows["amp"].to_numpy()[side == 0], t[side == 1], slack)
        hit = np.flatnonzero(got >= 0)
        out = pd.DataFrame({"est_id": ids[side == 0][got[hit]], "true_id": ids[side == 1][hit]})
        for k in reversed(names):
            out.insert(0, k, rows[k].iloc[0])
        return out

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # batches of the last run so far
        for batch in batches:
            tag = batch[[*names, "_run"]]
            last = (tag == tag.iloc[-1]).all(axis=1)
            if held and not (tag.iloc[0] == held[-1][[*names, "_run"]].iloc[-1]).all():
                yield match(pd.concat(held))
                held = []
            if last.all():
                held.append(batch)
                continue
            done = pd.concat([*held, batch[~last]])
            held = [batch[last]]
            yield pd.concat([match(g) for _, g in done.groupby(names, sort=False)])
        if held:
            yield match(pd.concat(held))

    return runs.sortWithinPartitions(*keys, "_run", "t", "id").mapInPandas(stream, schema)


def misses(true: DataFrame, matches: DataFrame) -> DataFrame:
    """True events without a match."""
    return true.join(matches.select(F.col("true_id").alias("id")), "id", "left_anti")


def false_positives(est: DataFrame, matches: DataFrame) -> DataFrame:
    """Estimated events without a match."""
    return est.join(matches.select(F.col("est_id").alias("id")), "id", "left_anti")


def gather(trace: DataFrame, peaks: DataFrame, half: int, *, keys: Sequence[str] = ("rec_id", "channel")) -> DataFrame:
    """The samples within ``half`` of each peak: keys, peak, lag, v."""
    marks = peaks.select(*keys, F.col("t").alias("trigger_t"))
    pairs = band_join(trace.select(*keys, "t", "v"), marks, -half, half, keys=keys)
    return pairs.select(*keys, F.col("trigger_t").alias("peak"), F.col("dt").alias("lag"), "v")


def gather_intervals(trace: DataFrame, intervals: DataFrame, *, keys: Sequence[str] = ("rec_id", "channel"), width: int = 1 << 12) -> DataFrame:
    """The samples of each interval (both ends in): keys, start, t, v.  An interval is repeated in the buckets of time that it meets."""
    spans = intervals.select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_b"))
    near = trace.withColumn("_b", F.floor(F.col("t") / width)).join(spans, [*keys, "_b"])
    return near.where("t between start and end").select(*keys, "start", "t", "v")


def best_assignment(cost: np.ndarray) -> tuple[int, ...]:
    """The order of estimated units that costs least, the first in lexicographic order of equals; costs are whole numbers.

    Shortest augmenting paths with potentials find one best order; the entries without slack are those of all best orders,
    and among them each unit in turn takes the least partner that leaves the others a whole order.
    """
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)  # of each column, from 1; column 0 holds the row that looks for one
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, came, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[at]:
            done[at] = True
            i = owner[at]
            slack = cost[i - 1] - u[i] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], at
            open_to = np.where(done, np.inf, least)
            open_to[0] = np.inf
            nxt = int(open_to.argmin())
            step = least[nxt]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = nxt
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    tight = np.abs(cost - u[1:, None] - v[None, 1:]) < 1e-6
    column = np.empty(n, int)
    column[owner[1:] - 1] = np.arange(n)
    for i in range(n):
        for j in np.flatnonzero(tight[i, : column[i]]).tolist():
            moved = _reassigned(tight, column, i, j)
            if moved is not None:
                column = moved
                break
    return tuple(column.tolist())


def _reassigned(tight: np.ndarray, column: np.ndarray, i: int, j: int) -> np.ndarray | None:
    """``column`` with j for row i, where rows from i on can be moved along entries of ``tight`` to free it."""
    first = int(np.flatnonzero(column == j)[0])
    if first < i:
        return None
    came, todo = {first: (i, j)}, [first]
    while todo:
        row = todo.pop()
        for k in np.flatnonzero(tight[row]).tolist():
            if k == column[i]:
                moved = column.copy()
                while row != i:
                    moved[row], (row, k) = k, came[row]
                moved[i] = j
                return moved
            holder = int(np.flatnonzero(column == k)[0])
            if holder > i and holder not in came:
                came[holder] = (row, k)
                todo.append(holder)
    return None


def best_unit_ordering(est: DataFrame, true: DataFrame, slack: float) -> list[tuple[object, object]]:
    """The pairing of estimated with true units of least misses plus false positives.

    Costs of all pairs of units come from one distributed match; units number a few, and only their table of costs is
    brought to the driver.
    """
    n_est = {r["cell_id"]: r["n"] for r in est.groupBy("cell_id").agg(F.count("*").alias("n")).collect()}
    n_true = {r["cell_id"]: r["n"] for r in true.groupBy("cell_id").agg(F.count("*").alias("n")).collect()}
    a, b = sorted(n_est), sorted(n_true)
    e = est.withColumnRenamed("cell_id", "est_cell").withColumn("true_cell", F.explode(F.array(*map(F.lit, b))))
    t = true.withColumnRenamed("cell_id", "true_cell").withColumn("est_cell", F.explode(F.array(*map(F.lit, a))))
    hits = greedy_match(e, t, -slack, slack, keys=("est_cell", "true_cell")).groupBy("est_cell", "true_cell").agg(F.count("*").alias("hits"))
    got = {(r["est_cell"], r["true_cell"]): r["hits"] for r in hits.collect()}
    size = max(len(a), len(b))
    cost = np.zeros((size, size))
    for i in range(size):
        for j in range(size):
            k = got.get((a[i], b[j]), 0) if i < len(a) and j < len(b) else 0
            cost[j, i] = (n_est[a[i]] if i < len(a) else 0) + (n_true[b[j]] if j < len(b) else 0) - 2 * k
    order = best_assignment(cost)
    return [(b[j] if j < len(b) else None, a[i] if i < len(a) else None) for j, i in enumerate(order)]
