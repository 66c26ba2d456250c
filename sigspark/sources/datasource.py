"""Recordings as a Spark data source: ``spark.read.format("recording")``.

A recording is Parquet with a column of sample indexes and one column for each channel; the source gives it in long form
(rec_id, channel, t, v), or its known events (cell_id, t).  Each run of row groups is a partition.  Only the columns of
the schema that is asked for are read, and filters on t and channel are applied by the source: row groups whose range of t
is ruled out are never opened.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

TRACE = "rec_id string, channel int, t long, v double"
TRUTH = "cell_id string, t long"
PART_ROWS = 1 << 22


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class RowGroups(InputPartition):
    """Some row groups of one file."""

    def __init__(self, path: str, groups: list[int]):
        super().__init__((path, groups))


class RecordingReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str], truth: bool):
        self.names, self.truth = schema.names, truth
        self.path, self.rec_id = options["path"], options.get("rec_id", "")
        self.t = options.get("t", "t")
        self.cell = options.get("cell", "cell_id")
        self.channels = [c.strip() for c in options.get("channels", "v").split(",")]
        self.low, self.high = -math.inf, math.inf
        self.wanted = set(range(len(self.channels)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of t and choices of channels are kept here; all other filters stay with Spark."""
        for f in filters:
            column, value = f.attribute, getattr(f, "value", None)
            if isinstance(f, IsNotNull) and column in (("t",), ("channel",), ("rec_id",)):
                continue
            if column == ("t",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            elif column == ("channel",) and isinstance(f, (EqualTo, In)) and not self.truth:
                self.wanted &= {value} if isinstance(f, EqualTo) else set(value)
            else:
                yield f

    def _files(self) -> Iterator[tuple[pafs.FileSystem, str]]:
        files, path = _open(self.path)
        if files.get_file_info(path).type == pafs.FileType.File:
            yield files, path
            return
        for info in sorted(files.get_file_info(pafs.FileSelector(path, recursive=True)), key=lambda x: x.path):
            if info.type == pafs.FileType.File and not os.path.basename(info.path).startswith(("_", ".")):
                yield files, info.path

    def partitions(self) -> Sequence[InputPartition]:
        """Row groups that may hold a wanted t, by the footers; about ``PART_ROWS`` rows a partition."""
        out: list[InputPartition] = []
        for files, path in self._files() if self.wanted else ():
            with files.open_input_file(path) as file:
                footer = pq.ParquetFile(file).metadata
            at = footer.schema.names.index(self.t)
            groups, rows = [], 0
            for g in range(footer.num_row_groups):
                held = footer.row_group(g).column(at).statistics
                if held is not None and held.has_min_max and (held.max < self.low or held.min > self.high):
                    continue
                groups.append(g)
                rows += footer.row_group(g).num_rows
                if rows >= PART_ROWS:
                    out.append(RowGroups(path, groups))
                    groups, rows = [], 0
            if groups:
                out.append(RowGroups(path, groups))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, groups = partition.value
        files, _ = _open(self.path)
        wanted = sorted(self.wanted) if not self.truth else [0]
        columns = {self.t} | ({self.cell} if self.truth and "cell_id" in self.names else set()) | ({self.channels[k] for k in wanted} if "v" in self.names else set())
        with files.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(row_groups=groups, columns=sorted(columns)):
                t = batch.column(self.t).cast(pa.int64())
                if self.low > -math.inf or self.high < math.inf:
                    keep = pc.and_(pc.greater_equal(t, self.low) if self.low > -math.inf else pc.is_valid(t), pc.less_equal(t, self.high) if self.high < math.inf else pc.is_valid(t))
                    batch, t = batch.filter(keep), t.filter(keep)
                for k in wanted:
                    made: dict[str, Any] = {"t": t}
                    if self.truth:
                        made["cell_id"] = batch.column(self.cell).cast(pa.string()) if "cell_id" in self.names else None
                    else:
                        made |= {"rec_id": pa.array([self.rec_id] * len(t), pa.string()), "channel": pa.array([k] * len(t), pa.int32()), "v": batch.column(self.channels[k]).cast(pa.float64()) if "v" in self.names else None}
                    yield pa.RecordBatch.from_arrays([made[n] for n in self.names], names=self.names)


class RecordingSource(DataSource):
    """Options: path, rec_id, t (column of sample indexes), channels (columns, by commas); with ``truth`` true: cell (column)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def _truth(self) -> bool:
        return str(self.options.get("truth", "false")).lower() == "true"

    def schema(self) -> str:
        return TRUTH if self._truth() else TRACE

    def reader(self, schema: StructType) -> DataSourceReader:
        unknown = set(schema.names) - {x.split()[0] for x in self.schema().split(", ")}
        if unknown or "path" not in self.options:
            raise ValueError(f"a recording has no columns {sorted(unknown)}" if unknown else "a recording needs a path")
        return RecordingReader(schema, dict(self.options), self._truth())


def register_source(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
