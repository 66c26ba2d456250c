"""Greedy one-to-one matching of trains of any density, as a prefix scan of transfer functions.

In ascending order each estimate takes the first true event that is left in its window, so matches never cross, and all
that the past leaves to the future is one pointer: the last true event that is used up.  A train is cut into blocks of
time.  Each block, by itself, maps every pointer that it may be given to the pointer that it hands on, a step function
which soon becomes constant; the functions of neighbouring blocks compose as a tree, which gives every block its pointer;
and a second pass over the blocks emits matches.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.tables import kept

ROWS = 1 << 15  # of both trains in a block, but for what one window holds
FAN = 1024
NONE = (float("-inf"), 0)  # the pointer before any true event

Pointer = tuple[float, int]  # time of a true event, and its rank among those of the same time


def windows_of(est: np.ndarray, true: np.ndarray, low: float, high: float, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each estimate the true events [first, last) in its window, both ascending."""
    if closed:
        return np.searchsorted(true, est + low, "left"), np.searchsorted(true, est + high, "right")
    return np.searchsorted(true, est + low, "right"), np.searchsorted(true, est + high, "left")


def run_block(first: np.ndarray, last: np.ndarray, used: int) -> tuple[np.ndarray, int]:
    """Matches of a block's estimates (places of true events, or -1) if ``used`` true events are gone, and how many are then."""
    out = np.full(len(first), -1, np.int64)
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        used = max(used, a)
        if used < b:
            out[i] = used
            used += 1
    return out, used


def transfer(first: np.ndarray, last: np.ndarray, most: int) -> np.ndarray:
    """For each number of true events, 0 to ``most``, that may be gone before a block, how many are gone after it.

    All numbers run at once; those that have met stay together, so few are left after a while.
    """
    now, of = np.arange(most + 1), np.arange(most + 1)
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if len(now) == 1:
            _, used = run_block(first[i:], last[i:], int(now[0]))
            return np.full(most + 1, used)
        now = np.maximum(now, a)
        now += now < b
        if now[0] == now[-1] or i % 64 == 63:
            now, back = np.unique(now, return_inverse=True)
            of = back[of]
    return now[of]


def apply(steps: Sequence[tuple[Pointer, Pointer]], pointer: Pointer) -> Pointer:
    """A step function, given by the least pointer of each step and its result."""
    at = bisect.bisect_right(steps, pointer, key=lambda s: s[0]) - 1
    return max(steps[at][1], pointer) if steps[at][1] == NONE else steps[at][1]


def compose(functions: Sequence[Sequence[tuple[Pointer, Pointer]]]) -> list[tuple[Pointer, Pointer]]:
    """The step function of several in a row."""
    steps = list(functions[0])
    for f in functions[1:]:
        steps = [(start, apply(f, result)) for start, result in steps]
        steps = [s for i, s in enumerate(steps) if i == 0 or s[1] != steps[i - 1][1]]
    return steps


def _ranks(t: np.ndarray) -> np.ndarray:
    """The place of each of some ascending times among its equals."""
    new = np.r_[True, t[1:] != t[:-1]]
    return np.arange(len(t)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(t) else np.zeros(0, np.int64)


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    rows = rows.sort_values(["t", "id"], kind="stable")
    return rows[rows["_side"] == 0], rows[rows["_side"] == 1]


def blocked(est: DataFrame, true: DataFrame, reach: float, *, keys: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Both trains (keys, id, t, _side, _cell) dealt to blocks (_block, its first cell); true events go to each block in reach.

    A cell is as wide as the reach, and a block is a run of cells with about ``rows`` events.  Cells are counted before
    they are put in order, 4096 of them at a time, so no task orders a train.
    """
    width = max(reach, 1e-9) * 1.0001  # no window reaches beyond the next cell, for all rounding
    cell = F.floor(F.col("t") / F.lit(width))
    e, t = (x.select(*keys, "id", "t", F.lit(side).alias("_side"), cell.alias("_cell")) for side, x in enumerate((est, true)))
    coarse = F.floor(F.col("_cell") / 4096)
    counts = e.unionByName(t).groupBy(*keys, "_cell").agg(F.count("*").alias("_n")).withColumn("_coarse", coarse)
    before = Window.partitionBy(*keys, "_coarse").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("_part", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows))
    cells = cut.select(*keys, "_cell", F.min("_cell").over(Window.partitionBy(*keys, "_coarse", "_part")).alias("_block"))
    near = cells.select(*keys, F.explode(F.array(*(F.col("_cell") + d for d in (-1, 0, 1)))).alias("_cell"), "_block").distinct()
    return e.join(cells, [*keys, "_cell"]).unionByName(t.join(near, [*keys, "_cell"]))


def pointers(blocks: DataFrame, low: float, high: float, *, keys: Sequence[str], closed: bool, fan: int = FAN) -> DataFrame:
    """The pointer that each block with estimates is given: keys, _block, _t, _k."""
    kinds = dict(blocks.dtypes)
    names = [*keys, "_block"]
    head = ", ".join(f"{k} {kinds[k]}" for k in names)
    steps = "array<struct<t: double, k: bigint, out_t: double, out_k: bigint>>"

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        est, true = _sides(rows)
        if not len(est):
            return pd.DataFrame({n: [] for n in [*names, "_steps"]}, dtype=object)
        t, k = true["t"].to_numpy(), _ranks(true["t"].to_numpy())
        marks = [NONE, *zip(t.astype(float).tolist(), k.tolist(), strict=True)]
        first, last = windows_of(est["t"].to_numpy(), t, low, high, closed)
        most = int((true["_cell"] <= rows["_block"].iloc[0]).sum())
        got = transfer(first, last, most)
        at = np.flatnonzero(np.r_[True, got[1:] != got[:-1]]).tolist()
        found = [(*marks[i], *marks[got[i]]) for i in at]
        return pd.DataFrame({**{n: [rows[n].iloc[0]] for n in names}, "_steps": [found]})

    def read(found: np.ndarray) -> list[tuple[Pointer, Pointer]]:
        return [((s["t"], s["k"]), (s["out_t"], s["out_k"])) for s in found]

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        whole = compose([read(x) for x in rows.sort_values("_block")["_steps"]])
        return pd.DataFrame({**{n: [rows[n].iloc[0]] for n in keys}, "_block": [rows["_up"].iloc[0]], "_steps": [[(*a, *b) for a, b in whole]]})

    def spread(above: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        now: Pointer = (above["_t"].iloc[0], above["_k"].iloc[0]) if len(above) else NONE
        rows, given = rows.sort_values("_block"), []
        for x in rows["_steps"]:
            given.append(now)
            now = apply(read(x), now)
        return pd.DataFrame({**{n: rows[n] for n in names}, "_t": [p[0] for p in given], "_k": [p[1] for p in given]})

    levels = [kept(blocks.groupBy(*names).applyInPandas(measure, f"{head}, _steps {steps}"), "match-steps")]
    up = F.floor(F.col("_block") / fan).alias("_up")
    while (levels[-1].groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > fan:
        levels.append(kept(levels[-1].withColumn("_up", up).groupBy(*keys, "_up").applyInPandas(joined, f"{head}, _steps {steps}"), "match-steps"))
    given = levels[-1].groupBy(*keys).applyInPandas(lambda rows: spread(rows.iloc[:0].assign(_t=0.0, _k=0), rows), f"{head}, _t double, _k bigint")
    for below in reversed(levels[:-1]):
        above = given.withColumnRenamed("_block", "_up")
        given = above.groupBy(*keys, "_up").cogroup(below.withColumn("_up", up).groupBy(*keys, "_up")).applyInPandas(spread, f"{head}, _t double, _k bigint")
    return given


def scan_match(est: DataFrame, true: DataFrame, low: float, high: float, *, keys: Sequence[str], closed: bool = True, rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """Greedy one-to-one matches: keys, est_id, true_id.  Times are whole numbers up to 2^53, or doubles."""
    kinds = dict(est.dtypes)
    dealt = kept(blocked(est, true, max(abs(low), abs(high)), keys=keys, rows=rows), "match-blocks")
    given = pointers(dealt, low, high, keys=keys, closed=closed, fan=fan)

    def emit(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        est, true = _sides(rows)
        t = true["t"].to_numpy()
        used = 0
        if len(given):
            mark, k = given["_t"].iloc[0], given["_k"].iloc[0]
            used = int(np.searchsorted(t, mark, "left"))
            used += min(int(k) + 1, int(np.searchsorted(t, mark, "right")) - used)
        matches, _ = run_block(*windows_of(est["t"].to_numpy(), t, low, high, closed), used)
        hit = np.flatnonzero(matches >= 0)
        out = pd.DataFrame({"est_id": est["id"].to_numpy()[hit], "true_id": true["id"].to_numpy()[matches[hit]]})
        for n in reversed(keys):
            out.insert(0, n, rows[n].iloc[0] if len(rows) else None)
        return out

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"est_id {kinds['id']}", f"true_id {kinds['id']}"])
    names = [*keys, "_block"]
    return dealt.groupBy(*names).cogroup(given.groupBy(*names)).applyInPandas(emit, schema)
