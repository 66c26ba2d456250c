"""Streams over several triggers in time order, the bound of their state, and late rows."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sigspark.operators import aggregates
from sigspark.plans import catalog, numeric
from sigspark.streaming import twins


def run(stream, folder, name):
    """All rows of a stream that is drained trigger by trigger, and its progress reports."""
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    reports = query.recentProgress
    return stream.sparkSession.table(name), reports


def written(frames, folder):
    """Each frame as one file; the files are as old as their order."""
    for k, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/rows.parquet")
        fresh = [f for f in os.listdir(f"{folder}/rows.parquet") if f.endswith(".parquet") and not f.startswith("done-")]
        os.rename(f"{folder}/rows.parquet/{fresh[0]}", f"{folder}/rows.parquet/done-{k:03}.parquet")
        os.utime(f"{folder}/rows.parquet/done-{k:03}.parquet", (1_600_000_000 + k, 1_600_000_000 + k))
    return f"{folder}/rows.parquet"


def in_time_order(spark, sf_dir, parts):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    share = (F.unix_micros("ts") - F.unix_micros(F.lit(first))) / ((last - first).total_seconds() * 1e6)
    return [events.where(F.least(F.floor(share * parts), F.lit(parts - 1)) == k) for k in range(parts)], last


def test_matches_come_trigger_by_trigger_with_bounded_state(spark, sf_dir, tmp_path):
    frames, last = in_time_order(spark, sf_dir, 12)
    end = frames[0].limit(1).withColumn("ts", F.lit(last) + F.expr("interval 2 days")).withColumn("event_type", F.lit("")).withColumn("value", F.lit(50.0))
    path = written([*frames, end], tmp_path)
    sides = F.array_compact(F.array(F.when(F.col("value") > 40, 0), F.when(F.col("user_id") % 2 == 0, 1)))
    both = twins.event_stream(spark, path, files_per_trigger=1).select(F.col("event_type").alias("cell_id"), F.explode(sides).alias("side"), F.col("event_id").alias("id"), "ts")
    with twins.rocksdb_state(spark):
        found, reports = run(twins.greedy_match_stream(both, -catalog.SLACK, catalog.SLACK), tmp_path, "stream_matches")
    expected = {tuple(r) for r in numeric.QUERIES["greedy_match"](spark, sf_dir).collect()}
    assert {tuple(r) for r in found.collect()} == expected
    assert sum(r["numInputRows"] > 0 for r in reports) == 13
    assert sum(r["sink"]["numOutputRows"] > 0 for r in reports) > 6  # matches come as the watermark passes, not all at the end
    events = sum(r["numInputRows"] for r in reports)
    state = [r["stateOperators"][0]["numRowsTotal"] for r in reports]
    assert max(state) < events / 4 and state[-1] <= 8


def test_correlogram_pairs_come_from_two_streams(spark, sf_dir, tmp_path):
    frames, _ = in_time_order(spark, sf_dir, 6)
    path = written(frames, tmp_path)
    one, two = (twins.event_stream(spark, path, files_per_trigger=1).where(F.col("event_type") == kind) for kind in catalog.KINDS)
    band = 20 * catalog.BAND
    pairs = twins.correlogram_pairs(one.select("event_id", "ts"), two.select(F.col("event_id").alias("trigger_id"), F.col("ts").alias("trigger_ts")), -band, band)
    found, reports = run(pairs.select("event_id", "trigger_id", "dt"), tmp_path, "stream_pairs")
    trains = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type").collect()
    expected = {(a["event_id"], b["event_id"], a["t"] - b["t"]) for a in trains for b in trains if (a["event_type"], b["event_type"]) == catalog.KINDS and abs(a["t"] - b["t"]) <= band}
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    state = [r["stateOperators"][0]["numRowsTotal"] for r in reports]
    assert max(state) < sum(r["numInputRows"] for r in reports) / 2
    counts = aggregates.pair_correlogram(found, -band, band, 10).agg(F.sum("n")).first()[0]
    assert counts >= len(expected)


def test_a_late_row_counts_within_lateness_and_not_beyond(spark, tmp_path):
    def rows(*times):
        return spark.createDataFrame([("click", f"2024-01-01 {t}", 3.0) for t in times], "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))

    path = written([rows("10:00:00", "10:10:00", "12:10:00"), rows("12:20:00"), rows("11:20:00", "09:30:00"), rows("18:00:00")], tmp_path)
    stream = twins.event_stream(spark, path, files_per_trigger=1)
    found, reports = run(twins.window_counts(stream, "1 hour", late="1 hour"), tmp_path, "late_counts")
    got = {r["start"] // 3_600_000_000 % 24: r["n"] for r in found.collect()}
    # A trigger drops what the watermark of the one before it rules out: 11:10 when 11:20 and 09:30 came.
    assert got == {10: 2, 11: 1, 12: 2}
    assert sum(r["stateOperators"][0]["numRowsDroppedByWatermark"] for r in reports) == 1
