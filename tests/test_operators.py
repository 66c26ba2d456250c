"""Small cases with known answers, block borders, and numeric kernels against numpy."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import registry, stats
from sigspark.operators import aggregates, decompose, joins, learning, signal, windows
from sigspark.params import General, Params
from sigspark.plans import catalog, numeric
from sigspark.sources import recordings

SCHEMA = "rec_id string, channel int, t long, v double"


def trace(spark, values):
    return spark.createDataFrame([("r", 0, i, float(v)) for i, v in enumerate(values)], SCHEMA)


@pytest.mark.parametrize("block", [2, 3, 1 << 18])
def test_islands_are_the_same_in_any_block(spark, block):
    mask = trace(spark, [1, 1, 0, 1, 1, 1, 0, 1])
    got = windows.islands(mask, F.col("v") > 0, block=block).orderBy("start").select("start", "end", "len").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2), (3, 5, 3), (7, 7, 1)]
    assert [tuple(r) for r in windows.quiet_zones(trace(spark, [0, 0, 9, 0, 0, 0, 9, 0]), 5.0, 2, block=block).select("start", "end", "len").collect()] == [(3, 5, 3)]


def test_peaks_keep_ties(spark):
    got = windows.local_peaks(trace(spark, [0, 2, 0, 3, 3, 0]), 1.0, 1).orderBy("t").collect()
    assert [r["t"] for r in got] == [1, 3, 4]


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_frames_cross_block_borders(spark, block):
    v = np.random.default_rng(0).normal(size=23)
    got = windows.sliding_norm(trace(spark, v), 4, 1, block=block).orderBy("t").collect()
    assert np.allclose([r["norm"] for r in got], [np.linalg.norm(v[i - 3 : i + 1]) for i in range(3, 23)])
    smooth = windows.moving_average(trace(spark, v), 5, block=block).orderBy("t").collect()
    half = [min(2, i, 22 - i) for i in range(23)]
    assert np.allclose([r["smooth"] for r in smooth], [v[i - h : i + h + 1].mean() for i, h in enumerate(half)])
    assert [r["t"] for r in smooth] == list(range(23))


@pytest.mark.parametrize("est,true,closed,pairs", [([0, 3], [0], True, {(0, 0)}), ([3], [0], True, {(0, 0)}), ([3], [0], False, set()), ([0, 1, 2], [1, 1], True, {(0, 0), (1, 1)})])
def test_greedy_match(spark, est, true, closed, pairs):
    make = lambda times: spark.createDataFrame([("c", i, t, 1.0) for i, t in enumerate(times)], "cell_id string, id long, t long, amp double")
    got = {(r["est_id"], r["true_id"]) for r in joins.greedy_match(make(est), make(true), -3, 3, closed=closed).collect()}
    assert got == pairs


def test_greedy_match_is_the_plain_loop():
    rng = np.random.default_rng(3)
    for _ in range(50):
        est, true = np.sort(rng.integers(0, 200, 30)).astype(float), np.sort(rng.integers(0, 200, 30)).astype(float)
        used, expected = set(), []
        for t in est:
            k = next((j for j, s in enumerate(true) if j not in used and -4 <= s - t <= 6), -1)
            used.add(k)
            expected.append(k)
        assert joins.match_sorted(est, true, -4, 6).tolist() == expected


def test_nearest_interval_is_kept_within_its_reach(spark):
    points = spark.createDataFrame([(10,), (50,)], "t long")
    spans = spark.createDataFrame([(4, 5), (13, 5)], "center long, width long")
    assert {r["t"]: r["center"] for r in joins.nearest_join(points, spans).collect()} == {10: 13, 50: None}


def test_band_join_is_brute_force(spark):
    rng = np.random.default_rng(5)
    e, g = rng.integers(-100, 100, 60).tolist(), rng.integers(-100, 100, 40).tolist()
    got = joins.band_join(spark.createDataFrame([(x,) for x in e], "t long"), spark.createDataFrame([(x,) for x in g], "trigger_t long"), -7, 3)
    assert sorted((r["t"], r["trigger_t"]) for r in got.collect()) == sorted((x, y) for x in e for y in g if -7 <= x - y <= 3)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_statistics():
    assert stats.chi2_cdf(3.841458820694124, 1) == pytest.approx(0.95, abs=1e-9)
    assert stats.chi2_cdf(40.0, 40) == pytest.approx(1 - 0.470257, abs=1e-5)
    x = np.random.default_rng(0).normal(size=16)
    assert np.allclose(stats.inverse_dct(stats.dct(x)), x)


def test_whitening_filter_flattens_noise():
    rng = np.random.default_rng(0)
    noise = np.convolve(rng.normal(size=50_000), [1, 0.6, 0.2], "same")
    acf = np.array([np.dot(noise[: len(noise) - k], noise[k:]) for k in range(9)]) / np.dot(noise, noise)
    white = np.convolve(noise, signal.whitening_filter(acf), "same")
    after = [np.dot(white[: len(white) - k], white[k:]) / np.dot(white, white) for k in (1, 2, 3)]
    assert max(map(abs, after)) < 0.1 < abs(acf[1])


def test_components_are_those_of_numpy(spark, sf_dir):
    v = recordings.vectors(spark, sf_dir)
    value, _ = learning.components(v, 64, 90.0)
    x = np.array([r["features"] for r in v.collect()])
    assert np.allclose(value, np.sort(np.linalg.eigvalsh(x.T @ x))[::-1][: len(value)], rtol=1e-6)  # uncentred


def test_streams_have_all_rows_in_any_order_of_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = events.agg(F.percentile_approx(micros, 0.5)).first()[0]
    for part in (micros >= middle, micros < middle):  # the later half is the first file
        events.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert len(spark.read.parquet(f"{tmp_path}/events.parquet").inputFiles()) == 2
    for batch, stream in (("session_activity", "stream_sessions"), ("greedy_match", "stream_greedy_match")):
        expected = numeric.QUERIES[batch](spark, sf_dir)
        got = numeric.QUERIES[stream](spark, str(tmp_path)).select(*expected.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    counts = [sorted(map(tuple, numeric.stream_window_counts(spark, str(d)).select("event_type", "start", "n").collect())) for d in (sf_dir, tmp_path)]
    assert counts[0] == counts[1] and sum(r[2] for r in counts[0]) == events.count()


def test_sql_functions(spark):
    registry.register(spark)
    got = spark.sql("SELECT chi2_cdf(3.841458820694124D, 1D) AS p, erfc(0D) AS e").first()
    assert got["p"] == pytest.approx(0.95) and got["e"] == pytest.approx(1.0)


@pytest.mark.parametrize("reach,blocks", [(3, 1), (3, 2), (5, 4096)])
def test_runs_are_the_same_in_any_block(spark, reach, blocks):
    rng = np.random.default_rng(8)
    times = [np.sort(rng.integers(0, 400, 60)).tolist() for _ in range(2)]
    est, true = (spark.createDataFrame([("c", i, t, 1.0) for i, t in enumerate(x)], "cell_id string, id long, t long, amp double") for x in times)
    merged = sorted(times[0] + times[1])
    starts = [t for k, t in enumerate(merged) if k == 0 or t - merged[k - 1] > reach]
    for r in joins.merged_runs(est, true, reach, keys=("cell_id",), blocks=blocks).collect():
        assert r["_run"] == max(s for s in starts if s <= r["t"])


def test_assignment_is_the_first_best_permutation():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        cost = rng.integers(0, 4, (n, n)).astype(float)
        best = min(itertools.permutations(range(n)), key=lambda p: sum(cost[i][p[i]] for i in range(n)))
        assert joins.best_assignment(cost) == best
    assert len(joins.best_assignment(rng.integers(0, 1000, (60, 60)).astype(float))) == 60


def test_greedy_match_by_amplitude_is_the_plain_loop(spark, sf_dir):
    est, true = catalog.est_true(spark, sf_dir)
    rows = {c: ([], []) for c in ("click", "purchase", "view")}
    for side, x in enumerate((est, true)):
        for r in x.orderBy("t", "id").collect():
            rows.setdefault(r["cell_id"], ([], []))[side].append(r)
    expected = set()
    for cell, (e, t) in rows.items():
        used = set()
        for x in t:
            near = [y for y in e if abs(y["t"] - x["t"]) < catalog.SLACK and y["id"] not in used]
            if near:
                best = max(near, key=lambda y: y["amp"])
                used.add(best["id"])
                expected.add((cell, best["id"], x["id"]))
    assert {tuple(r) for r in numeric.QUERIES["greedy_match_amplitude"](spark, sf_dir).collect()} == expected


def test_pursuit_finds_planted_spikes(spark):
    waves = [np.r_[0, 1, 3, 1, 0][:, None].astype(float), np.r_[-1, -2, 0, 2, 1][:, None].astype(float)]
    v = np.zeros(200)
    planted = [(0, 20, 5.0), (1, 60, 4.0), (0, 100, 6.0), (1, 104, 2.0), (0, 150, 3.0)]
    for cell, t, amp in planted:
        v[t - 2 : t + 3] += amp * waves[cell][:, 0]
    found = decompose.pursue(trace(spark, v), waves, 1.0, 3, [0]).collect()
    assert {(r["cell_id"], r["t"]) for r in found} == {(c, t) for c, t, _ in planted}
    assert all(abs(r["amp"] - amp) < 0.6 for r in found for c, t, amp in planted if (c, t) == (r["cell_id"], r["t"]))


@pytest.mark.parametrize("freq", [(1000.0,), (400.0, 2000.0), (400.0, 20_000.0)])
def test_butterworth_has_its_magnitudes(freq):
    dt, order = 1 / 25_000, 3
    taps = signal.butterworth(freq, dt, order)
    f = np.array([100.0, 400.0, 700.0, 1000.0, 2000.0, 5000.0, 12_000.0])
    warp = lambda x: np.tan(np.pi * np.asarray(x) * dt)
    inside = [x for x in freq if x * dt < 0.5]
    ratio = warp(inside[0]) / warp(f) if len(inside) == 1 else (warp(f) ** 2 - warp(inside[0]) * warp(inside[1])) / (warp(f) * (warp(inside[1]) - warp(inside[0])))
    got = [abs(np.sum(taps * np.exp(-2j * np.pi * x * dt * np.arange(len(taps))))) for x in f]
    assert np.allclose(got, 1 / np.sqrt(1 + ratio ** (2 * order)), atol=1e-3)


def scored(est, true, slack):
    """Hits of the greedy match of two lists of times."""
    used, hits = set(), 0
    for t in sorted(est):
        k = next((j for j, s in enumerate(true) if j not in used and abs(s - t) <= slack), None)
        if k is not None:
            used.add(k)
            hits += 1
    return hits


def test_best_ordering_and_what_follows_from_it(spark, sf_dir):
    import itertools

    est, true = catalog.est_true(spark, sf_dir)
    names = {"click": "purchase", "purchase": "view", "view": "click"}
    by_cell = lambda df: {c: sorted(r["t"] for r in df.collect() if r["cell_id"] == c) for c in sorted({r["cell_id"] for r in df.collect()})}
    e, t = by_cell(est.replace(names, subset=["cell_id"])), by_cell(true)
    a, b = list(e), list(t)
    cost = {(i, j): len(e[i]) + len(t[j]) - 2 * scored(e[i], t[j], catalog.SLACK) for i in a for j in b}
    best = min(itertools.permutations(a), key=lambda p: sum(cost[i, j] for i, j in zip(p, b, strict=True)))
    pairing = dict(zip(b, best, strict=True))
    moved = {(r["id"], r["cell_id"]) for r in numeric.QUERIES["reorder_truth"](spark, sf_dir).collect()}
    assert moved == {(r["id"], pairing[r["cell_id"]]) for r in true.collect()}
    limits = {"purchase": 60.0, "view": 80.0, "click": 20.0}
    rows = {r["cell_id"]: r for r in numeric.QUERIES["evaluate_best_order"](spark, sf_dir).collect()}
    for j in b:
        left = sorted(r["t"] for r in est.replace(names, subset=["cell_id"]).collect() if r["cell_id"] == pairing[j] and r["amp"] > limits.get(pairing[j], -1))
        assert (rows[j]["n_est"], rows[j]["hits"]) == (len(left), scored(left, t[j], catalog.SLACK))


def test_spline_average_is_that_of_a_plain_spline(spark):
    v = np.sin(np.arange(60) / 4.0) * 5
    times = spark.createDataFrame([("r", 0, 20.25), ("r", 0, 31.5), ("r", 0, 2.5)], "rec_id string, channel int, t double")
    got = {r["lag"]: r["avg_v"] for r in aggregates.interpolated_average(trace(spark, v), times, 4).collect()}
    x = {k: [20.25 + k, 31.5 + k, 2.5 + k] for k in range(-4, 5)}
    for k, at in x.items():  # a smooth curve, so the spline is close to it; 0 before the trace begins
        assert got[k] == pytest.approx(np.mean([5 * np.sin(y / 4.0) if y >= 0 else 0.0 for y in at]), abs=0.02)


def test_first_waveforms_are_the_planted_ones(spark):
    rng = np.random.default_rng(6)
    t = np.arange(-10, 11)
    shapes = [12 * np.exp(-((t / 3.0) ** 2)), 20 * np.exp(-((t / 1.5) ** 2))]
    v = rng.normal(0, 0.1, 3000)
    for k, at in enumerate(range(60, 2900, 70)):
        v[at - 10 : at + 11] += shapes[k % 2]
    c = dataclasses.replace(Params().clustering, num_waveforms=2, restarts=3, max_iter=50)
    params = dataclasses.replace(Params(), general=General(21), clustering=c)
    labelled, found = learning.first_waveforms(trace(spark, v), params, [0])
    assert sorted(r["count"] for r in labelled.groupBy("label").count().collect()) == [20, 21]
    norms = [float(np.linalg.norm(w)) for w in found]
    assert norms == sorted(norms, reverse=True)
    assert all(min(np.abs(w[:, 0] - s).max() for s in shapes) < 0.5 for w in found)


@pytest.mark.parametrize("query", ["sql_islands", "sql_correlogram"])
def test_table_functions_spread_a_key_over_blocks(spark, tmp_path, query):
    rows = spark.range(200_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("value"))
    kind = F.when(F.col("id") % 2 == 0, catalog.KINDS[0]).otherwise(catalog.KINDS[1])
    value = F.when(F.col("id").between(65_500, 131_100), 1.0).otherwise(F.col("value"))  # one quiet run over three blocks
    rows.select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 7_000_000).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), kind.alias("event_type"), value.alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    twin = {"sql_islands": "quiet_zones", "sql_correlogram": "cross_correlogram"}[query]
    got, expected = numeric.QUERIES[query](spark, str(tmp_path)), numeric.QUERIES[twin](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select(*got.columns).collect()))
    view = {"sql_islands": "quiet_samples", "sql_correlogram": "two_trains"}[query]
    most = spark.table(view).groupBy("key", "block").count().agg(F.max("count")).first()[0]
    assert most <= 1 << 16  # what one task takes at least


def test_interpolation_takes_plain_arrays_to_python(spark):
    times = spark.createDataFrame([("r", 0, 20.25)], "rec_id string, channel int, t double")
    got = aggregates.interpolated_average(trace(spark, np.arange(60.0)), times, 4, kind="linear")
    inputs = got._jdf.queryExecution().optimizedPlan().toString()
    assert ".v" in inputs.split("around(", 1)[1].split(")#", 1)[0]  # an array of structs is a dict for each sample in Python
    assert {r["lag"]: r["avg_v"] for r in got.collect()} == {k: 20.25 + k for k in range(-4, 5)}
