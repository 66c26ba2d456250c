"""Recordings as a source, spectra, filters with their history, whitening reports, and aggregates in bounded pieces."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import columns, stats
from sigspark.operators import aggregates, blocks, fourier, learning, signal, windows
from sigspark.params import Params
from sigspark.plans import numeric
from sigspark.sources import datasource, recordings

SCHEMA = "rec_id string, channel int, t long, v double"


def trace(spark, values, channel=0):
    return spark.createDataFrame([("r", channel, i, float(v)) for i, v in enumerate(values)], SCHEMA)


# The data source


@pytest.fixture
def two_channels(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("sample"), (F.col("id") * 0.5).alias("left"), (-F.col("id")).alias("right"), F.lit("unused").alias("note"))
    rows.coalesce(1).write.option("parquet.block.size", 1024).option("parquet.page.row.count.limit", 100).parquet(f"{tmp_path}/rec")
    return f"{tmp_path}/rec"


def test_source_reads_channels_columns_and_ranges(spark, two_channels):
    datasource.register_source(spark)
    reader = spark.read.format("recording").options(path=two_channels, rec_id="a", t="sample", channels="left, right")
    whole = reader.load()
    assert whole.dtypes == [("rec_id", "string"), ("channel", "int"), ("t", "bigint"), ("v", "double")]
    assert sorted(map(tuple, whole.collect()))[998:1002] == [("a", 0, 998, 499.0), ("a", 0, 999, 499.5), ("a", 1, 0, 0.0), ("a", 1, 1, -1.0)]
    some = whole.where("t >= 10 and t < 13 and channel = 1 and v < -10.5")
    assert sorted(r["t"] for r in some.collect()) == [11, 12]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "v" in plan.split("Filter")[1].split("\n")[0] and "channel" not in plan.split("Filter")[1].split("\n")[0]  # only the filter on v is Spark's
    assert [tuple(r) for r in reader.schema("t long").load().where("t = 7").collect()] == [(7,), (7,)]
    with pytest.raises(Exception, match="no columns"):
        reader.schema("t long, w double").load().collect()


def test_source_skips_row_groups(two_channels):
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan
    from pyspark.sql.types import LongType, StructField, StructType

    reader = datasource.RecordingReader(StructType([StructField("t", LongType())]), {"path": two_channels, "t": "sample", "channels": "left,right"}, False)
    groups = lambda: sum(len(p.value[1]) for p in reader.partitions())
    every = groups()
    assert list(reader.pushFilters([GreaterThanOrEqual(("t",), 5), LessThan(("t",), 8)])) == []
    assert every >= 1 and groups() == 1
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6
    assert list(reader.pushFilters([In(("channel",), (5,))])) == [] and reader.partitions() == []


def test_recordings_by_id(spark, two_channels):
    recordings.register("slow", recordings.Dataset(two_channels, 0.01, t="sample", channels=("left",), adjust=lambda p: "adjusted"))
    with pytest.warns(UserWarning, match="under 5 kHz"):
        found, truth, params = recordings.load_recording(spark, "slow", Params())
    assert (found.count(), truth, params) == (1000, None, "adjusted")
    with pytest.raises(KeyError, match="unheard"):
        recordings.load_recording(spark, "unheard", Params())


# Spectra


@pytest.mark.parametrize(("n", "tile"), [(1, 8), (2, 8), (7, 8), (12, 4), (360, 64), (97, 16), (1009, 1 << 18), (1024, 1 << 10)])
def test_four_step_transform_is_that_of_numpy(spark, n, tile):
    rng = np.random.default_rng(n)
    x = {k: rng.normal(size=n) + 1j * rng.normal(size=n) for k in "ab"}
    rows = [(k, i, float(z.real), float(z.imag)) for k, v in x.items() for i, z in enumerate(v)]
    got = fourier.fft(spark.createDataFrame(rows, "k string, idx long, re double, im double"), n, keys=("k",), tile=tile).collect()
    assert len(got) == 2 * n
    for k, v in x.items():
        full = np.zeros(n, complex)
        for r in got:
            if r["k"] == k:
                full[r["idx"]] = r["re"] + 1j * r["im"]
        assert np.allclose(full, np.fft.fft(v), atol=1e-8 * n)


def test_magnitudes_are_root_mean_squares_over_channels(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(2, 60))
    both = trace(spark, v[0]).unionByName(trace(spark, v[1], 1)).withColumn("t", F.col("t") + 500)
    got = {r["bin"]: r["magnitude"] for r in fourier.magnitude_spectrum(both).collect()}
    expected = np.sqrt((np.abs(np.fft.fft(v, axis=1)) ** 2).mean(axis=0))
    assert np.allclose([got[k] for k in range(60)], expected)


# Filters, whitening, partition


def test_filter_keeps_its_history(spark):
    v = np.random.default_rng(1).normal(size=400)
    once = signal.filter_recording(trace(spark, v), (400.0, 5000.0), 1 / 25_000, 20)
    twice = signal.filter_recording(once, (), 1 / 25_000, 20)
    assert [h["params"]["freq"] for h in signal.history(twice)] == [[400.0, 5000.0], []]
    got = np.array([r["v"] for r in once.orderBy("t").collect()])
    taps = signal.fir_taps((400.0, 5000.0), 1 / 25_000, 20)
    plain = np.convolve(np.r_[np.full(10, v[0]), v, np.full(10, v[-1])], taps, "valid")
    plain -= plain.mean()
    assert np.allclose(got, plain / np.abs(plain).max())
    assert np.allclose([r["v"] for r in twice.orderBy("t").collect()], got / np.abs(got).max())


def test_whitened_noise_has_unit_covariance(spark, sf_dir):
    rows = numeric.QUERIES["whiten_report"](spark, sf_dir).collect()
    cov = {(r["stage"], r["one"], r["two"]): r["value"] for r in rows if r["kind"] == "cov"}
    channels = sorted({k[1] for k in cov})
    assert len(channels) == 4
    for a in channels:
        for b in channels:
            assert cov["after", a, b] == pytest.approx(1.0 if a == b else 0.0, abs=0.01)
    assert max(abs(cov["before", a, a] - 1) for a in channels) > 0.05
    assert {(r["stage"], r["one"], r["two"]) for r in rows if r["kind"] == "acf"} == {(s, c, k) for s in ("before", "after") for c in channels for k in range(5)}
    white = numeric.QUERIES["whiten_trace"](spark, sf_dir)
    assert white.select("rec_id", "channel", "t").distinct().count() == white.count() == 4 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_partition_of_several_channels(spark):
    v = np.zeros((2, 200))
    v[0, 50:53], v[1, 51:54], v[0, 120:140] = 9, 9, 7
    both = trace(spark, v[0]).unionByName(trace(spark, v[1], 1))
    level = np.sqrt((v**2).sum(axis=0))
    got = windows.partition_signal(both, smooth_len=1, stds=1.0, min_silence=10, pad=2).orderBy("start").collect()
    assert level.std(ddof=1) < 9
    assert [(r["start"], r["end"], r["len"], r["center"]) for r in got] == [(48, 56, 9, 52), (118, 142, 25, 130)]


# Aggregates in bounded pieces


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_running_sums_over_ranges(spark, parts):
    rows = [(k, i, (7 * i) % 11) for k, n in (("a", 100), ("b", 3), ("c", 1)) for i in range(n)]
    got = {(r["k"], r["i"]): r["sum_x"] for r in blocks.running_sums(spark.createDataFrame(rows, "k string, i long, x long"), ("x",), "i", keys=("k",), parts=parts).collect()}
    assert got == {(k, i): sum((7 * j) % 11 for j in range(i + 1)) for k, i, _ in rows}


@pytest.mark.parametrize("bins", [2, 16, 1 << 12])
def test_quantiles_without_a_buffer(spark, bins):
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=500), "b": np.r_[np.zeros(300), 1e9, rng.integers(0, 3, 99)], "c": np.array([5.0]), "d": np.exp(rng.normal(0, 8, 200))}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("a", math.nan)]
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = aggregates.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), "x", shares, keys=("k",), bins=bins)
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString().lower()
    found = {(r["k"], r["share"]): r["quantile"] for r in got.collect()}
    assert set(found) == {(k, q) for k in data for q in shares}
    for (k, q), x in found.items():
        assert x == pytest.approx(np.quantile(data[k], q), rel=1e-12)


def test_samples_are_the_same_from_any_partitioning(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    draws = [sorted(map(tuple, aggregates.sample_without_replacement(rows.repartition(n), 20, ["id"], keys=("k",), seed=s).collect())) for n, s in ((1, 1), (9, 1), (9, 2))]
    assert draws[0] == draws[1] != draws[2]
    assert {k: sum(x[0] == k for x in draws[0]) for k in range(3)} == {0: 20, 1: 20, 2: 20}
    assert aggregates.sample_without_replacement(rows.limit(5), 20, ["id"]).count() == 5


def test_pooled_blocks_are_the_sorted_values(spark):
    rows = [(k, float((13 * i) % 17), i) for k, n in (("a", 53), ("b", 4)) for i in range(n)]
    got = aggregates.pooled(spark.createDataFrame(rows, "k string, x double, id long"), "x", "id", 10, keys=("k",)).orderBy("k", "block").collect()
    for k in "ab":
        mine = [r for r in got if r["k"] == k]
        assert [r["start"] for r in mine] == [10 * i for i in range(len(mine))] and all(r["n"] == len(r["values"]) <= 10 for r in mine)
        assert [tuple(v) for r in mine for v in r["values"]] == sorted((x, i) for c, x, i in rows if c == k)


def test_lag_products_see_over_missing_samples(spark):
    v = {t: float(t % 7 - 3) for t in range(60) if t not in (5, 6, 20, 41)}
    rows = spark.createDataFrame([("r", 0, t, x) for t, x in v.items()], SCHEMA)
    got = {r["lag"]: r["s"] for r in aggregates.lag_products(rows, 8).collect()}
    assert got == pytest.approx({k: sum(x * v[t + k] for t, x in v.items() if t + k in v) for k in range(9)})
    zoned = rows.withColumn("zone", F.floor(F.col("t") / 10))
    got = {r["lag"]: r["s"] for r in aggregates.lag_products(zoned, 8, zone="zone").collect()}
    assert got == pytest.approx({k: sum(x * v[t + k] for t, x in v.items() if t + k in v and t // 10 == (t + k) // 10) for k in range(9)})


def test_grids_have_one_dimension_or_two(spark):
    row = spark.range(1).select(columns.uniform_grid([F.lit(7)], [F.lit(2)]).alias("line"), columns.uniform_grid([F.lit(5), F.lit(2)], [F.lit(2), F.lit(1)]).alias("plane")).first()
    assert row["line"] == [[-3], [-1], [1], [3]]
    assert row["plane"] == [[x, y] for x in (-2, 0, 2) for y in (-1, 0, 1)]
    with pytest.raises(ValueError, match="one dimension or two"):
        columns.uniform_grid([F.lit(1)] * 3, [F.lit(1)] * 3)


# Thresholds, clusters, projections


def test_threshold_lies_between_two_humps(spark):
    rng = np.random.default_rng(5)
    amps = np.r_[rng.normal(0.45, 0.03, 300), rng.normal(0.95, 0.06, 300)]
    from sigspark.operators import evaluate

    rows = spark.createDataFrame([("c", float(x)) for x in amps], "cell_id string, amp double")
    assert 0.52 < evaluate.auto_thresholds(rows).first()["threshold"] < 0.75
    assert stats.kde_threshold(np.zeros(10), 0, 1, 5) == float("-inf")


def test_projection_and_clusters_are_those_of_numpy(spark, sf_dir):
    v = recordings.vectors(spark, sf_dir)
    x = np.array([r["features"] for r in v.orderBy("snip_id").collect()])
    value, vector = np.linalg.eigh(x.T @ x)
    got = numeric.QUERIES["pca_project"](spark, sf_dir).orderBy("snip_id").collect()
    scores = np.array([r["scores"] for r in got])
    plain = x @ vector[:, ::-1][:, : scores.shape[1]]
    assert np.allclose(np.abs(scores), np.abs(plain), atol=1e-3)
    counts = [r["n"] for r in numeric.QUERIES["kmeans_clusters"](spark, sf_dir).collect()]
    assert sum(counts) == len(x) and len(counts) == Params().clustering.num_waveforms and min(counts) > 0


def test_session_functions_are_those_of_numpy(spark, sf_dir):
    groups = {}
    for r in recordings.events_trains(spark, sf_dir).collect():
        groups.setdefault(r["cell_id"], []).append(r["amp"])
    for r in numeric.QUERIES["session_functions"](spark, sf_dir).collect():
        amps = np.array(groups[r["cell_id"]])
        assert r["p"] == pytest.approx(float(stats.chi2_cdf(amps.mean(), 40.0)), abs=1e-4) and r["e"] == pytest.approx(math.erfc(amps.min()), abs=1e-4)


def test_auto_point_scores_what_is_over_the_thresholds(spark, sf_dir):
    from sigspark.operators import evaluate, joins
    from sigspark.plans import catalog

    est, true = catalog.est_true(spark, sf_dir)
    most = {r["cell_id"]: r["m"] for r in est.groupBy("cell_id").agg(F.max("amp").alias("m")).collect()}
    scaled = est.join(est.groupBy("cell_id").agg(F.max("amp").alias("m")), "cell_id").withColumn("amp", 0.3 + 0.7 * F.col("amp") / F.col("m")).drop("m")
    limits = {r["cell_id"]: r["threshold"] for r in evaluate.auto_thresholds(scaled).collect()}
    hits = n_est = n_true = 0
    for c in most:
        e = sorted(r["t"] for r in est.where(F.col("cell_id") == c).collect() if 0.3 + 0.7 * r["amp"] / most[c] > limits[c])
        t = sorted(r["t"] for r in true.where(F.col("cell_id") == c).collect())
        hits += int((joins.match_sorted(np.array(e), np.array(t), -catalog.SLACK, catalog.SLACK) >= 0).sum())
        n_est, n_true = n_est + len(e), n_true + len(t)
    r = numeric.QUERIES["roc_auto_point"](spark, sf_dir).first()
    assert (r["n_est"], r["n_true"], r["misses"], r["false_positives"]) == (n_est, n_true, n_true - hits, n_est - hits)


@pytest.mark.parametrize("blocks", [1, 2, 5, 4096])
def test_sessions_are_the_same_in_any_block(spark, blocks):
    rng = np.random.default_rng(blocks)
    trains = {k: np.sort(rng.integers(-300, 300, n)).tolist() for k, n in (("a", 120), ("b", 30), ("c", 1))}
    expected = set()
    for k, times in trains.items():
        starts = [i for i, t in enumerate(times) if i == 0 or t - times[i - 1] >= 10]
        expected |= {(k, times[a], times[b - 1], b - a) for a, b in zip(starts, [*starts[1:], len(times)], strict=True)}
    rows = spark.createDataFrame([(k, t) for k, v in trains.items() for t in v], "k string, t long")
    assert {tuple(r) for r in windows.sessions(rows, 10, keys=("k",), blocks=blocks).collect()} == expected


@pytest.mark.parametrize("block", [3, 50, 1 << 18])
def test_partition_is_the_same_in_any_block(spark, block):
    v = np.where(np.random.default_rng(7).random(200) < 0.08, 9.0, 0.0)
    found = [windows.active_partition(trace(spark, v), 5.0, 4, 1, block=b) for b in (block, 1 << 18)]
    rows = [sorted((r["start"], r["end"], r["len"]) for r in x.collect()) for x in found]
    assert rows[0] == rows[1]
    gaps = sorted((r["start"], r["end"]) for r in windows.partition_breaks(found[0], block=block).collect())
    spans = sorted((a, b) for a, b, _ in rows[0])
    assert gaps == [(b + 1, c - 1) for (_, b), (c, _) in zip(spans, spans[1:]) if c - 1 >= b + 1]


def test_restarts_share_passes_and_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1.0, (60, 4)) for m in (0.0, 8.0, 16.0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, scores array<double>")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    found = learning.cluster(rows.repartition(1), 3, restarts=25)
    assert jobs() - before < 100  # a restart by itself took several jobs
    labels = {r["i"]: r["label"] for r in found.collect()}
    assert all(len({labels[i] for i in range(a, a + 60)}) == 1 for a in (0, 60, 120)) and len(set(labels.values())) == 3
    assert labels == {r["i"]: r["label"] for r in learning.cluster(rows.repartition(7), 3, restarts=25).collect()}
    with pytest.raises(ValueError, match="empty"):
        learning.cluster(rows.where("i < 1").unionByName(rows.where("i < 1")), 3, restarts=2)


def test_kmeans_takes_a_job_of_one_stage_for_a_pass_and_is_that_of_numpy(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(700, None)], "i long, scores array<double>")
    step, starts = learning.lloyd_step, []
    monkeypatch.setattr(learning, "lloyd_step", lambda points, centres: starts.append(centres.copy()) or step(points, centres))
    context = spark.sparkContext
    context.setJobGroup("kmeans", "passes of k-means")
    try:
        found = learning.cluster(rows, 3, restarts=4)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for i in tracker.getJobIdsForGroup("kmeans") for s in tracker.getJobInfo(i).stageIds}
    ran = [s for s in stages if (stage := tracker.getStageInfo(s)) and stage.numCompletedTasks]
    assert len(starts) > 20 and len(starts) < len(ran) <= len(starts) + 12  # a pass took two stages

    def far(c):
        return ((x[:, None] - c) ** 2).sum(axis=2)

    ends = []
    for c in starts[0]:
        moved = 1.0
        while moved > 1e-4:
            label = far(c).argmin(axis=1)
            new = np.array([x[label == j].mean(axis=0) for j in range(3)])
            moved, c = np.sqrt(((new - c) ** 2).sum(axis=1)).max(), new
        ends.append(c)
    best = min(ends, key=lambda c: far(c).min(axis=1).sum())
    assert {r["i"]: r["label"] for r in found.collect()} == {**dict(enumerate(far(best).argmin(axis=1).tolist())), 700: None}


@pytest.mark.parametrize("n", [0, 2])
def test_fewer_points_than_clusters_are_an_error(spark, n):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(n)], "i long, scores array<double>")
    with pytest.raises(ValueError, match="empty"):
        learning.cluster(rows, 3, restarts=2)


@pytest.mark.parametrize("block", [1 << 15, 16])
def test_whitening_shuffles_its_trace_once(spark, monkeypatch, block):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(2, 300)) + np.r_[np.zeros(100), np.full(20, 9.0), np.zeros(180)]
    v[1] += 0.5 * v[0]
    rows = trace(spark, v[0]).unionByName(trace(spark, v[1], 1)).where("t <> 77").repartition(3)
    monkeypatch.setattr(signal, "BLOCK", block, raising=False)
    got = signal.whiten(rows, 3.0, 5, 4, reg=1e-3)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    there = np.arange(300) != 77
    x = np.where(there, v, 0.0)
    quiet = there & (np.sqrt((x**2).sum(axis=0)) < 3.0)
    zone, at = np.full(300, -1), 0
    while at < 300:
        end = at
        while end < 300 and quiet[end]:
            end += 1
        if end - at > 5:
            zone[at:end] = at
        at = max(end, at + 1)
    filtered = []
    for c in x:
        s = np.array([sum(c[t] * c[t + k] for t in range(300 - k) if zone[t] >= 0 and zone[t] == zone[t + k]) for k in range(5)])
        d = s - s[-1]
        filtered.append(np.convolve(c, signal.whitening_filter(d / np.abs(d).max()), "same"))
    y = np.array(filtered)
    plain = signal.inverse_root(np.cov(y[:, zone >= 0], bias=True) + 1e-3 * np.eye(2)) @ y
    found = {(r["channel"], r["t"]): r["v"] for r in got.collect()}
    assert set(found) == {(c, t) for c in (0, 1) for t in range(300) if t != 77}
    assert np.allclose([found[k] for k in sorted(found)], [plain[c, t] for c, t in sorted(found)])
