"""Queries without a SQL form: matrices, pursuits and streams.  Tests hold them against numpy and batch twins."""

from __future__ import annotations

import dataclasses
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.functions import registry
from sigspark.operators import aggregates, decompose, learning, signal, windows
from sigspark.operators.tables import kept, shared_folder
from sigspark.params import General, Params
from sigspark.plans import details  # noqa: F401  registers its queries
from sigspark.plans.catalog import BAND, KINDS, ORACLE_SQL, QUERIES, QUIET, SLACK, THRESHOLDS, query
from sigspark.sources import recordings
from sigspark.sources.recordings import CHANNELS, events_trace, events_trains, lineitem_channels, vectors
from sigspark.streaming import twins


@query()
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, _ = learning.components(vectors(spark, sf_dir), 64, 90.0)
    return spark.createDataFrame([(i, float(round(v, 4))) for i, v in enumerate(value)], "rank int, value double")


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    _, columns = learning.components(v, 64, 50.0)
    return learning.project(v, columns).select("snip_id", F.transform("scores", lambda x: F.round(x, 5)).alias("scores"))


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Params().clustering
    v = vectors(spark, sf_dir).withColumnRenamed("label", "known")
    return learning.cluster(v, c.num_waveforms, features="features", restarts=c.restarts, max_iter=c.max_iter).groupBy("label").agg(F.count("*").alias("n"))


_WHITENING = (4.5, 5, 4)  # level of a zone, its least length, lags


def _lineitem_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels of ``lineitem`` in the order of their keys, standardised."""
    wide = lineitem_channels(spark, sf_dir).withColumn("rec_id", F.concat(F.lit("part"), F.col("l_orderkey") % 4))
    flat = aggregates.rescaled(aggregates.centered(wide, CHANNELS), CHANNELS)  # before rows are shuffled to number them
    scaled = signal.numbered(flat, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], keys=("rec_id",)).withColumns({c: F.col(c) * k for c, k in zip(CHANNELS, (2000.0, 1.0, 10_000_000.0, 10_000_000.0), strict=True)})
    return scaled.select("rec_id", "t", F.posexplode(F.array(*CHANNELS)).alias("channel", "v"))


@query()
def whiten_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of ``lineitem`` whitened by its quiet zones."""
    white = signal.whiten(_lineitem_trace(spark, sf_dir), *_WHITENING, reg=1e-3)
    return white.select("rec_id", "channel", "t", F.round("v", 4).alias("v"))


@query()
def whiten_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelations and covariances of the noise before and after whitening."""
    return signal.whitening_report(_lineitem_trace(spark, sf_dir), *_WHITENING).withColumn("value", F.round("value", 6))


_FIR = signal.fir_taps((400.0, 5000.0), 1 / 25_000, 50).tolist()


@query(f"""WITH w AS (SELECT unnest(range(51)) AS k, unnest({_FIR}) AS w), x AS (SELECT event_id AS t, value AS v, min(event_id) OVER () AS a, max(event_id) OVER () AS z FROM events),
    p AS (SELECT t, w, greatest(least(t + 25 - k, z), a) AS at FROM x, w), y AS (SELECT p.t, sum(p.w * x.v) AS v FROM p JOIN x ON x.t = p.at GROUP BY p.t), m AS (SELECT avg(v) AS m FROM y)
    SELECT t, round((v - m) / (SELECT max(abs(v - m)) FROM y, m), 6) + 0.0 AS v FROM y, m""")
def filter_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole filter step: band-pass, means off, scaled."""
    out = signal.filter_recording(events_trace(spark, sf_dir), (400.0, 5000.0), 1 / 25_000, 50)
    return out.select("t", (F.round("v", 6) + 0.0).alias("v"))


@query()
def filter_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    taps = signal.fir_taps((100.0, 5000.0), 1 / 25_000, 50)
    out = signal.filter_trace(signal.standardise(events_trace(spark, sf_dir)), taps)
    return out.select("t", F.round("v", 6).alias("v"))


def _register(sf_dir: str) -> None:
    """The events as a recording of one channel at 25 kHz, whose events of known kind are its truth."""
    path = f"{sf_dir}/events.parquet"
    recordings.register("events", recordings.Dataset(path, 1 / 25_000, t="event_id", channels=("value",), truth=path, truth_t="event_id", truth_cell="event_type", polarity="max"))


@query("SELECT 'events' AS rec_id, 0 AS channel, event_id // 100 AS block, count(*) AS n, round(avg(value), 4) + 0.0 AS mean, max(value) AS most FROM events GROUP BY 3")
def recording_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording loaded by its id through the data source, in blocks of a hundred samples."""
    _register(sf_dir)
    trace, _, _ = recordings.load_recording(spark, "events", Params())
    blocks = trace.where("t >= 0 and channel = 0").groupBy("rec_id", "channel", F.floor(F.col("t") / 100).alias("block"))
    return blocks.agg(F.count("*").alias("n"), (F.round(F.avg("v"), 4) + 0.0).alias("mean"), F.max("v").alias("most"))


@query("SELECT event_type AS cell_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def recording_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known events of a recording, by cell."""
    _register(sf_dir)
    _, truth, _ = recordings.load_recording(spark, "events", Params())
    return truth.groupBy("cell_id").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def _waveforms() -> list[np.ndarray]:
    t = np.arange(-4, 5)
    return [np.exp(-((t / 2.0) ** 2))[:, None], (np.exp(-(((t - 1.5) / 1.5) ** 2)) - np.exp(-(((t + 1.5) / 1.5) ** 2)))[:, None]]


@query()
def pursuit_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two templates pursued through the whole trace of events, less its mean, in three rounds."""
    flat = aggregates.centered(events_trace(spark, sf_dir), ["v"], 2)
    found = decompose.pursue(flat, _waveforms(), 60.0, 3, [0], lambda df: kept(df, "pursuit"))
    return found.select("cell_id", "t", F.round("amp", 4).alias("amp"), "round")


_LOUD_CELLS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items())


@query(f"""WITH s AS (SELECT event_id AS t, event_type AS cell_id FROM events WHERE value > CASE event_type {_LOUD_CELLS} ELSE -1 END), n AS (SELECT cell_id, count(*) AS n FROM s GROUP BY cell_id)
    SELECT s.cell_id, CAST(l.lag AS BIGINT) AS lag, round(sum(e.value) / any_value(n.n), 5) + 0.0 AS w FROM s JOIN n ON n.cell_id = s.cell_id, (SELECT unnest(range(-6, 7)) AS lag) l, events e WHERE e.event_id = s.t + l.lag GROUP BY s.cell_id, l.lag""")
def refit_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms of the event types from their events above a threshold each."""
    trace = events_trace(spark, sf_dir)
    spikes = events_trains(spark, sf_dir).select(F.lit("events").alias("rec_id"), "cell_id", F.col("event_id").alias("t"), "amp")
    found = decompose.refit_waveforms(trace, spikes, spark.createDataFrame(list(THRESHOLDS.items()), "cell_id string, threshold double"), 6)
    return found.select("cell_id", F.col("lag").cast("long").alias("lag"), (F.round("w", 5) + 0.0).alias("w"))


@query()
def initial_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first guess of waveforms: peaks of the trace less its mean, aligned, reduced and clustered; strongest first."""
    flat = aggregates.centered(events_trace(spark, sf_dir), ["v"], 2)
    params = dataclasses.replace(Params(), general=General(21), clustering=dataclasses.replace(Params().clustering, spike_threshold=60.0))
    labelled, found = learning.first_waveforms(flat, params, [0])
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = [(k, counts[k], lag - 10, round(float(w[lag, 0]), 4)) for k, w in enumerate(found) for lag in range(21)]
    return spark.createDataFrame(rows, "cell_id int, n long, lag int, w double")


@query()
def session_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered scalar and aggregate functions, from SQL."""
    registry.register(spark)
    events_trains(spark, sf_dir).createOrReplaceTempView("trains")
    return spark.sql("SELECT cell_id, round(chi2_cdf(avg(amp), 40D), 4) AS p, round(erfc(min(amp)), 4) AS e FROM trains GROUP BY cell_id")


@query(ORACLE_SQL["quiet_zones"])
def sql_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quiet_zones`` by the registered table function, in blocks of time."""
    registry.register(spark)
    block = 1 << 16
    events_trace(spark, sf_dir).where(F.col("v") < QUIET).select(F.col("rec_id").alias("key"), F.floor(F.col("t") / block).alias("block"), "t").createOrReplaceTempView("quiet_samples")
    parts = spark.sql("SELECT key, start, `end` FROM islands(TABLE(quiet_samples) PARTITION BY (key, block) ORDER BY t)")
    return windows.chained_runs(parts, keys=("key",), block=block).where("len > 8").select("start", "end", "len")


@query(ORACLE_SQL["greedy_match"])
def sql_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``greedy_match`` by the registered table function."""
    registry.register(spark)
    e = events_trains(spark, sf_dir)
    sides = F.array_compact(F.array(F.when(F.col("amp") > 40, 0), F.when(F.col("user_id") % 2 == 0, 1)))
    e.select(F.col("cell_id").alias("key"), F.explode(sides).alias("side"), F.col("event_id").alias("id"), "t").createOrReplaceTempView("both_trains")
    return spark.sql(f"SELECT key AS cell_id, est_id, true_id FROM greedy_match(TABLE(both_trains) PARTITION BY key ORDER BY (t, side, id), {-SLACK}L, {SLACK}L)")


@query(ORACLE_SQL["cross_correlogram"])
def sql_correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cross_correlogram`` by the registered table function, in blocks of time: an event is in one, a trigger in all that it reaches."""
    registry.register(spark)
    side = F.when(F.col("cell_id") == KINDS[0], 0).when(F.col("cell_id") == KINDS[1], 1)
    block = lambda gap: F.floor((F.col("t") + gap) / (1024 * BAND))
    blocks = F.explode(F.when(side == 0, F.array(block(0))).otherwise(F.sequence(block(-BAND), block(BAND))))
    events_trains(spark, sf_dir).where(side.isNotNull()).select(F.lit("all").alias("key"), blocks.alias("block"), side.alias("side"), "t").createOrReplaceTempView("two_trains")
    return spark.sql(f"SELECT bin, sum(n) AS n FROM correlogram(TABLE(two_trains) PARTITION BY (key, block) ORDER BY (t), {-BAND}L, {BAND}L, 50) GROUP BY bin")


@query("""WITH z AS (SELECT event_id // 100 AS zone, event_id, value - avg(value) OVER (PARTITION BY event_id // 100) AS x FROM events),
    p AS (SELECT a.zone, l.lag, sum(a.x * b.x) AS s FROM z a, (SELECT CAST(unnest(range(11)) AS INTEGER) AS lag) l, z b WHERE b.zone = a.zone AND b.event_id = a.event_id + l.lag GROUP BY a.zone, l.lag)
    SELECT zone, lag, round(s / max(s) FILTER (WHERE lag = 0) OVER (PARTITION BY zone), 6) + 0.0 AS acf FROM p""")
def sql_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelations of runs of a hundred samples by the registered aggregate."""
    registry.register(spark)
    events_trace(spark, sf_dir).createOrReplaceTempView("trace_samples")
    return spark.sql("SELECT zone, lag, round(x, 6) + 0D AS acf FROM (SELECT floor(t / 100) AS zone, acf(t, v) AS a FROM trace_samples GROUP BY 1) LATERAL VIEW posexplode(a) p AS lag, x")


@query()
def sql_kde_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by day from the registered aggregate, of amplitudes brought to [0.3, 1]."""
    registry.register(spark)
    e = events_trains(spark, sf_dir)
    day = F.floor(F.col("t") / 86_400_000_000)
    e.select(day.alias("day"), (0.3 + 0.7 * F.col("amp") / F.max("amp").over(Window.partitionBy(day))).alias("amp")).createOrReplaceTempView("scaled_days")
    return spark.sql("SELECT day, round(kde_threshold(amp), 5) AS threshold FROM scaled_days GROUP BY day")


def _whole_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events as a stream that ends two days behind the last one, and its folder."""
    folder, path = shared_folder(spark, "stream"), f"{sf_dir}/events.parquet"
    return twins.ended(twins.event_stream(spark, path), spark.read.parquet(path), folder, timedelta(days=2)), folder


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, count(*) AS n, round(sqrt(sum(value * value)), 3) + 0.0 AS norm FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _whole_stream(spark, sf_dir)
    out = twins.drain(twins.window_counts(stream, "6 hours"), folder, "counts", output="append")
    return out.withColumn("norm", F.round("norm", 3) + 0.0)


@query(ORACLE_SQL["session_activity"])
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _whole_stream(spark, sf_dir)
    return twins.drain(twins.sessions(stream, "6 hours", late="1 hour"), folder, "sessions")


@query(ORACLE_SQL["greedy_match"])
def stream_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of ``greedy_match``, as the watermark settles them."""
    path, folder = f"{sf_dir}/events.parquet", shared_folder(spark, "stream")
    e = twins.event_stream(spark, path)
    sides = F.array_compact(F.array(F.when(F.col("value") > 40, 0), F.when(F.col("user_id") % 2 == 0, 1)))
    both = e.select(F.col("event_type").alias("cell_id"), F.explode(sides).alias("side"), F.col("event_id").alias("id"), "ts")
    both = twins.ended(both, spark.read.parquet(path), folder, timedelta(days=2), cell_id="", side=0, id=-1)
    with twins.rocksdb_state(spark):
        return twins.drain(twins.greedy_match_stream(both, -SLACK, SLACK), folder, "matches")


@query(ORACLE_SQL["cross_correlogram"])
def stream_correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of ``cross_correlogram`` as a join of two streams with watermarks, and their bins."""
    path, folder = f"{sf_dir}/events.parquet", shared_folder(spark, "stream")
    events, triggers = (twins.event_stream(spark, path).where(F.col("event_type") == kind) for kind in KINDS)
    pairs = twins.correlogram_pairs(events.select("ts"), triggers.select(F.col("ts").alias("trigger_ts")), -BAND, BAND).select("dt")
    return aggregates.pair_correlogram(twins.drain(pairs, folder, "pairs"), -BAND, BAND).select("bin", F.col("n").cast("long").alias("n"))


__all__ = ["QUERIES"]
