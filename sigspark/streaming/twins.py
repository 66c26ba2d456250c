"""Structured Streaming forms of counts, norms, sessions, greedy matching and correlograms.

Each takes a streaming (or batch) DataFrame with an event time and gives the rows of its batch twin, once the watermark
has passed them.  Late rows beyond the watermark are dropped by it.  A stream that is drained takes all files in one
trigger, so no order of files makes a row late, and ``ended`` lets the watermark pass all rows at the end.
"""

from __future__ import annotations

import bisect
import contextlib
from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sigspark.operators.matching import run_block, windows_of


def event_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """``events`` files as a stream, with ts as a timestamp; without ``files_per_trigger`` all files are one trigger's."""
    there = spark.read.parquet(path)
    stream = spark.readStream.schema(there.schema)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if all(f.endswith(f"/{name}") for f in there.inputFiles()):  # a single file: streams read folders
        raw = stream.option("pathGlobFilter", name).parquet(folder)
    else:
        raw = stream.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str, *, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and norms of tumbling windows: keys, start (microseconds), n, norm."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return rows.select(*keys, F.unix_micros("w.start").alias("start"), "n", "norm")


def sessions(events: DataFrame, gap: str, *, late: str = "1 hour", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Activity between silences of at least ``gap``: keys, start, end (of the last event, microseconds), n."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return rows.select(*keys, F.unix_micros("w.start").alias("start"), F.unix_micros("last").alias("end"), "n")


def correlogram_pairs(events: DataFrame, triggers: DataFrame, low_us: int, high_us: int, *, late: str = "1 hour") -> DataFrame:
    """Pairs of two streams with low <= event - trigger <= high: all columns of both, and dt.

    A stream join needs an equality, so a trigger goes to the two or three buckets of time, as wide as the band, that its
    partners can lie in.  The band on the event times lets each side's state go once the other's watermark is past it.
    """
    width = max(1, high_us - low_us)
    bucket = lambda c, by: F.floor((F.unix_micros(c) + by) / width)
    e = events.withWatermark("ts", late).withColumn("_bucket", bucket("ts", 0))
    t = triggers.withWatermark("trigger_ts", late).withColumn("_bucket", F.explode(F.sequence(bucket("trigger_ts", low_us), bucket("trigger_ts", high_us))))
    low, high = F.expr(f"trigger_ts + interval {low_us} microseconds"), F.expr(f"trigger_ts + interval {high_us} microseconds")
    pairs = e.alias("e").join(t.alias("t"), (F.col("e._bucket") == F.col("t._bucket")) & (F.col("ts") >= low) & (F.col("ts") <= high))
    return pairs.drop("_bucket").withColumn("dt", F.unix_micros("ts") - F.unix_micros("trigger_ts"))


class GreedyMatcher(StatefulProcessor):
    """Greedy one-to-one matching of a key's two sides, in event time.

    Events wait in a map from buckets of time, at least as wide as the reach, to the events in them.  A timer for each bucket goes
    off when the watermark has passed all that its estimates could take; they are settled with the true events of their
    own and the two neighbouring buckets, and what the next bucket can't need is dropped.  As matches never cross, a
    bucket hands on to the next no more than the last true event that is used up.  State holds the events of the lateness
    and of three buckets, whatever the length of the stream.
    """

    def __init__(self, low_us: int, high_us: int, bucket_us: int = 1):
        self.low, self.high = low_us, high_us
        self.width = max(abs(low_us), abs(high_us), bucket_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "side array<int>, id array<long>, t array<long>")
        self.used = handle.getValueState("used", "t long, id long")

    def _due_ms(self, bucket: int) -> int:
        return ((bucket + 1) * self.width + max(self.high, 0)) // 1000 + 1

    def _events(self, bucket: int) -> list[tuple[int, int, int]]:
        """(t, id, side) of a bucket in order."""
        held = self.waiting.getValue((bucket,)) if self.waiting.containsKey((bucket,)) else None
        return sorted(zip(held[2], held[1], held[0], strict=True)) if held else []

    def _put(self, bucket: int, events: list[tuple[int, int, int]]) -> None:
        self.waiting.updateValue((bucket,), ([x[2] for x in events], [x[1] for x in events], [x[0] for x in events]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[tuple[int, int, int]]] = {}
        for batch in rows:
            for side, i, t in zip(batch["side"].tolist(), batch["id"].tolist(), batch["t"].tolist(), strict=True):
                fresh.setdefault(t // self.width, []).append((t, i, side))
        for bucket, events in fresh.items():
            self._put(bucket, self._events(bucket) + events)
            self.handle.registerTimer(self._due_ms(bucket))
            self.handle.registerTimer(self._due_ms(bucket + 1))  # then its true events may go
        yield from ()

    def _settle(self, bucket: int) -> list[tuple[int, int]]:
        own = self._events(bucket)
        est = [x for x in own if x[2] == 0]
        if not est:
            return []
        used = self.used.get() if self.used.exists() else None
        near = [x for b in (bucket - 1, bucket, bucket + 1) for x in (own if b == bucket else self._events(b)) if x[2] == 1]
        gone = bisect.bisect_right(near, (used[0], used[1], 1)) if used else 0
        windows = windows_of(np.array([x[0] for x in est]), np.array([x[0] for x in near]), self.low, self.high, True)
        matches, after = run_block(*windows, gone)
        if after:
            self.used.update((near[after - 1][0], near[after - 1][1]))
        self._put(bucket, [x for x in own if x[2] == 1])
        return [(e[1], near[k][1]) for e, k in zip(est, matches.tolist(), strict=True) if k >= 0]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        found = []
        buckets = sorted(k[0] for k in self.waiting.keys())
        for bucket in buckets:
            if self._due_ms(bucket) <= now:
                found += self._settle(bucket)
        for bucket in buckets:
            if self._due_ms(bucket + 1) <= now:  # its neighbour is settled too
                self.waiting.removeKey((bucket,))
        if found:
            yield pd.DataFrame({"cell_id": [key[0]] * len(found), "est_id": [i for i, _ in found], "true_id": [j for _, j in found]})

    def close(self) -> None:
        pass


def greedy_match_stream(both: DataFrame, low_us: int, high_us: int, *, late: str = "1 hour", bucket_us: int = 3_600_000_000) -> DataFrame:
    """Matches of a stream of (cell_id, side 0 estimate or 1 true, id, ts): cell_id, est_id, true_id.

    The session's state store must be RocksDB's; see ``rocksdb_state``.
    """
    rows = both.withColumn("t", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("cell_id").transformWithStateInPandas(
        statefulProcessor=GreedyMatcher(low_us, high_us, bucket_us),
        outputStructType="cell_id string, est_id long, true_id long",
        outputMode="Append",
        timeMode="EventTime",
    )


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def ended(stream: DataFrame, events: DataFrame, folder: str, after: timedelta, **values: Any) -> DataFrame:
    """``stream`` with a last row of ``values``, ``after`` behind the greatest ts of ``events`` (the same rows as a batch).

    ``after`` is more than the lateness and the reach of the operator that follows, so the watermark settles every other
    row; what the last row opens stays in state and gives no row.
    """
    end = events.agg((F.max(F.col("ts").cast("timestamp")) + F.lit(after)).alias("ts")).where("ts is not null")
    last = end.select(*(F.col("ts") if f.name == "ts" else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema))
    last.write.parquet(f"{folder}/end")
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(f"{folder}/end"))


def drain(stream: DataFrame, folder: str, name: str, *, output: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet under a shared folder, and read the result."""
    path = f"{folder}/{name}"
    query = stream.writeStream.outputMode(output).format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
