"""Matching as a scan of transfer functions: the kernels, and trains of all densities against the plain loop."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import evaluate, joins, matching
from sigspark.plans import catalog


def plain(est, true, low, high, closed=True):
    used, out = set(), []
    for t in est:
        fits = (lambda s: low <= s - t <= high) if closed else (lambda s: low < s - t < high)  # noqa: B023
        k = next((j for j, s in enumerate(true) if j not in used and fits(s)), -1)
        used.add(k)
        out.append(k)
    return out


@pytest.mark.parametrize("closed", [True, False])
def test_transfer_functions_say_what_a_run_does(closed):
    rng = np.random.default_rng(4)
    for _ in range(60):
        est, true = np.sort(rng.integers(0, 60, 40)), np.sort(rng.integers(-5, 70, 45))
        first, last = matching.windows_of(est, true, -4, 7, closed)
        got = matching.transfer(first, last, 20)
        assert got.tolist() == [matching.run_block(first, last, k)[1] for k in range(21)]
        assert matching.run_block(first, last, 0)[0].tolist() == plain(est, true, -4, 7, closed)


def test_composition_is_application_in_turn():
    rng = np.random.default_rng(1)
    points = [(float(t), k) for t in range(12) for k in range(2)]
    for _ in range(100):
        functions = []
        for _ in range(3):
            starts = [matching.NONE, *sorted(points[i] for i in rng.choice(len(points), 4, replace=False))]
            results = sorted(points[i] for i in rng.choice(len(points), 5))
            functions.append(list(zip(starts, results, strict=True)))
        whole = matching.compose(functions)
        for p in [matching.NONE, *points]:
            direct = p
            for f in functions:
                direct = matching.apply(f, direct)
            assert matching.apply(whole, p) == direct


def frames(spark, trains):
    rows = [[(c, i, t) for c, sides in trains.items() for i, t in enumerate(sides[side])] for side in (0, 1)]
    return [spark.createDataFrame(x, "cell_id string, id long, t long") for x in rows]


@pytest.mark.parametrize(("rows", "fan"), [(7, 64), (40, 4096), (1 << 15, 1024)])
@pytest.mark.parametrize("closed", [True, False])
def test_dense_trains_match_like_the_plain_loop(spark, rows, fan, closed):
    rng = np.random.default_rng(rows)
    trains = {c: [np.sort(rng.integers(0, span, n)).tolist() for n in sizes] for c, span, sizes in (("dense", 300, (250, 260)), ("sparse", 20_000, (60, 50)), ("ties", 12, (40, 30)), ("no truth", 50, (9, 0)), ("no estimate", 50, (0, 9)), ("far", 10**12, (30, 30)))}
    trains["far"][1] = [t + 2 for t in trains["far"][0]]
    est, true = frames(spark, trains)
    got = {(r["cell_id"], r["est_id"]): r["true_id"] for r in matching.scan_match(est, true, -9, 6, keys=("cell_id",), closed=closed, rows=rows, fan=fan).collect()}
    expected = {(c, i): j for c, (e, t) in trains.items() for i, j in enumerate(plain(e, t, -9, 6, closed)) if j >= 0}
    assert got == expected


@pytest.mark.parametrize("faster", [10, 100])
def test_no_task_holds_more_than_a_block_of_a_dense_train(spark, sf_dir, faster):
    est, true = (x.withColumn("t", F.floor(F.col("t") / faster)) for x in catalog.est_true(spark, sf_dir))
    rows = 64
    sizes = matching.blocked(est, true, catalog.SLACK, keys=("cell_id",), rows=rows).groupBy("cell_id", "_block").count().collect()
    cell = F.floor(F.col("t") / catalog.SLACK)
    window = max(r["count"] for x in (est, true) for r in x.groupBy("cell_id", cell).count().collect())
    assert max(r["count"] for r in sizes) <= rows + 6 * window  # a block, and the cells that reach into it
    got = {tuple(r) for r in matching.scan_match(est, true, -catalog.SLACK, catalog.SLACK, keys=("cell_id",), rows=rows, fan=8).collect()}
    expected = set()
    for cell_id in {r["cell_id"] for r in est.collect()}:
        e, t = (sorted((r["t"], r["id"]) for r in x.where(F.col("cell_id") == cell_id).collect()) for x in (est, true))
        hits = joins.match_sorted(np.array([x[0] for x in e]), np.array([x[0] for x in t]), -catalog.SLACK, catalog.SLACK)
        expected |= {(cell_id, e[i][1], t[j][1]) for i, j in enumerate(hits.tolist()) if j >= 0}
    assert got == expected


def test_empty_trains(spark):
    est, true = frames(spark, {"c": [[1, 2], [2]]})
    for a, b in itertools.product((est, est.limit(0)), (true, true.limit(0))):
        assert matching.scan_match(a, b, -1, 1, keys=("cell_id",)).count() == (a is est and b is true)


def test_gains_count_the_largest_matches():
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 33):
        for _ in range(20):
            est, true, amps = np.sort(rng.integers(0, 3 * n, n)), np.sort(rng.integers(0, 3 * n, n)), rng.integers(1, 9, n)
            gained = evaluate.gains(*matching.windows_of(est, true, -3, 3, True), np.argsort(-amps, kind="stable"))
            for level in range(10):
                assert gained[amps > level].sum() == sum(j >= 0 for j in plain(est[amps > level], true, -3, 3))


def test_sweep_over_all_amplitudes_is_the_plain_loop(spark, sf_dir):
    est, true = catalog.est_true(spark, sf_dir)
    est = est.withColumn("amp", F.round("amp", 0))  # with ties
    got = evaluate.amplitude_roc(est, true, 20 * catalog.SLACK)
    rows = {(r["cell_id"], r["rank"]): r for r in got.collect()}
    for cell_id in ("click", "purchase"):
        e, t = (sorted((r["t"], r["id"], r["amp"]) for r in x.where(F.col("cell_id") == cell_id).collect()) for x in (est, true))
        amps = np.array([x[2] for x in e])
        assert sum(c == cell_id for c, _ in rows) == len(amps)
        for i, level in enumerate([0.0, *np.sort(amps)[:-1].tolist()]):
            hits = (joins.match_sorted(np.array([x[0] for x in e])[amps > level], np.array([x[0] for x in t]), -20 * catalog.SLACK, 20 * catalog.SLACK) >= 0).sum()
            n = (amps > level).sum()
            r = rows[cell_id, i + 1]
            assert tuple(r)[2:7] == (level, n, hits, len(t) - hits, n - hits)
            assert r["miss_rate"] == pytest.approx((len(t) - hits) / len(t)) and r["fp_rate"] == pytest.approx((n - hits) / (len(amps) - i))


def test_gains_of_a_long_run_take_little_memory():
    import tracemalloc

    n = 1 << 15
    first = np.arange(n) // 2
    order = np.random.default_rng(1).permutation(n)
    tracemalloc.start()
    got = evaluate.gains(first, first + 2, order)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 * n
    assert got.sum() == n // 2 + 1
