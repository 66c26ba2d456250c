"""Recordings by dataset id, column-pruned reads, ground truth, and adapters from star-schema tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.params import Params
from sigspark.sources.datasource import register_source

MAX_DT = 1 / 5000


@dataclass(frozen=True)
class Dataset:
    """A registered recording: where it lies, its columns, its sampling step, and what its kind changes in the parameters.

    Columns ``t`` (sample index) and ``channels`` make the trace; ``truth`` is the path of its known events, if there are
    any, with columns ``truth_t`` and ``truth_cell``.
    """

    path: str
    dt: float
    t: str = "t"
    channels: tuple[str, ...] = ("v",)
    truth: str | None = None
    truth_t: str = "t"
    truth_cell: str = "cell_id"
    polarity: str = "maxrms"
    adjust: Callable[[Params], Params] = field(default=lambda p: p)


_REGISTRY: dict[str, Dataset] = {}


def register(dataset_id: str, dataset: Dataset) -> None:
    _REGISTRY[dataset_id] = dataset


def load_recording(spark: SparkSession, dataset_id: str, params: Params, schema: str | None = None) -> tuple[DataFrame, DataFrame | None, Params]:
    """The trace of a registered recording (rec_id, channel, t, v, or the columns of ``schema``), its known events
    (cell_id, t) or None, and the parameters that it is read with."""
    if dataset_id not in _REGISTRY:
        raise KeyError(f"no recording {dataset_id!r}; known: {sorted(_REGISTRY)}")
    found = _REGISTRY[dataset_id]
    if found.dt > MAX_DT:
        warnings.warn(f"{dataset_id}: sampled at under 5 kHz (dt = {found.dt:g} s)", stacklevel=2)
    register_source(spark)
    reader = spark.read.format("recording").options(path=found.path, rec_id=dataset_id, t=found.t, channels=",".join(found.channels))
    trace = (reader.schema(schema) if schema else reader).load()
    truth = spark.read.format("recording").options(path=found.truth, truth=True, t=found.truth_t, cell=found.truth_cell).load() if found.truth else None
    return trace, truth, found.adjust(params)


def events_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a recording of one channel: t is event_id (contiguous), v is value."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(F.lit("events").alias("rec_id"), F.lit(0).alias("channel"), F.col("event_id").cast("long").alias("t"), F.col("value").alias("v"))


def events_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trains: cell_id (event_type), t (microseconds), amp, event_id, user_id."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return raw.select(F.col("event_type").alias("cell_id"), micros.alias("t"), F.col("value").alias("amp"), "event_id", "user_id")


CHANNELS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lineitem_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as four channels, wide: the order key columns and one column for each channel."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *CHANNELS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as feature vectors: snip_id, features (array of doubles), label."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return raw.select(F.col("vec_id").alias("snip_id"), F.col("embedding").cast("array<double>").alias("features"), "label")
