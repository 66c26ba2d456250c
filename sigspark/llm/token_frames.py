"""Token shards: independent zstandard frames, a trailing seek table and a checksum of each frame.

A shard file holds the ids of a range of documents in ascending order:

    frame 0 | frame 1 | ... | seek table | footer

Each frame is an independent zstandard frame of whole documents (a very long document fills one frame of
its own).  The seek table is a zstandard frame too; its content is one row for each document (doc_id, frame,
first id in the frame, ids) and one row for each frame (offset, stored bytes, plain bytes, crc32 of the plain
bytes).  The footer has a magic word, the id width, the counts and the table's place, so a reader fetches the
footer, the table, and then only those frames that hold the documents it wants.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm import storage
from sigspark.llm.tokens import END_ID, VOCABULARY, encoder

FRAME_BYTES = 256 * 1024
SHARD_TEXT_BYTES = 24 << 20
RUN_SHARDS = 4096
LEVEL = 3
MAGIC = b"SGTOKFR1"
_FOOTER = struct.Struct("<8sIIQQQ")  # magic, id width, frames, documents, table offset, table bytes
_DOC = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")])
_FRAME = np.dtype([("offset", "<u8"), ("stored", "<u4"), ("plain", "<u4"), ("crc32", "<u4")])


NO_ID = -(1 << 63)  # stands for a null document id in a shard


class CorruptFrame(ValueError):
    """A frame's bytes don't have the checksum that the seek table gives."""


def write_shard(out, docs: Iterable[tuple[int, bytes]], itemsize: int = 2) -> tuple[int, int]:
    """Write (doc_id, ids) in the order given; returns the documents and ids written."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    doc_rows: list[tuple[int, int, int, int]] = []
    frames: list[tuple[int, int, int, int]] = []
    held: list[bytes] = []
    size = at = total = 0

    def flush() -> None:
        nonlocal size, at
        plain = b"".join(held)
        stored = pack(plain)
        out.write(stored)
        frames.append((at, len(stored), len(plain), zlib.crc32(plain)))
        at += len(stored)
        held.clear()
        size = 0

    for doc_id, ids in docs:
        if held and size + len(ids) > FRAME_BYTES:
            flush()
        doc_rows.append((doc_id, len(frames), size // itemsize, len(ids) // itemsize))
        held.append(ids)
        size += len(ids)
        total += len(ids) // itemsize
    if held:
        flush()
    plain = np.array(doc_rows, _DOC).tobytes() + np.array(frames, _FRAME).tobytes()
    seek = pack(struct.pack("<I", zlib.crc32(plain)) + plain)
    out.write(seek)
    out.write(_FOOTER.pack(MAGIC, itemsize, len(frames), len(doc_rows), at, len(seek)))
    return len(doc_rows), total


class ShardReader:
    """Random access to a shard's documents; only the frames asked for are read and decompressed."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        self.frames_read = 0
        end = file.size()
        magic, self.itemsize, n_frames, n_docs, at, size = _FOOTER.unpack(file.read_at(_FOOTER.size, end - _FOOTER.size))
        if magic != MAGIC:
            raise CorruptFrame("not a token shard")
        table = zstandard.ZstdDecompressor().decompress(file.read_at(size, at))
        if zlib.crc32(table[4:]) != struct.unpack_from("<I", table)[0]:
            raise CorruptFrame("seek table")
        self.docs = np.frombuffer(table, _DOC, n_docs, 4)
        self.frames = np.frombuffer(table, _FRAME, n_frames, 4 + n_docs * _DOC.itemsize)
        self._held: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self._held[0] != i:
            row = self.frames[i]
            plain = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(row["stored"]), int(row["offset"])), max_output_size=int(row["plain"]))
            if len(plain) != row["plain"] or zlib.crc32(plain) != row["crc32"]:
                raise CorruptFrame(f"frame {i}")
            self.frames_read += 1
            self._held = (i, plain)
        return self._held[1]

    def rows(self, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in stored order, of all documents or of those wanted."""
        for doc_id, frame, first, n in self.docs.tolist():
            if wanted is None or doc_id in wanted:
                yield doc_id, np.frombuffer(self.frame(frame), f"<u{self.itemsize}", n, first * self.itemsize)


def write_token_frames(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encode ``docs`` into shards under ``folder`` in ascending id order; returns the manifest.

    Manifest: shard int (in id order), path, n_docs, n_tokens, start (ids in the shards before).  A null or empty
    text gives its end id alone; repeated rows are all written; equal ids are neighbours, ordered by text; a null id
    comes first; an empty table gives no shard; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(storage.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(storage.col(text_col), F.lit("")).alias("text"))
    n = storage.parts_for(spark, storage.input_bytes(rows, "text"), SHARD_TEXT_BYTES)
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        end = end_id.to_bytes(codec.itemsize, "little")
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = first.column("shard")[0].as_py()

        def encoded() -> Iterator[tuple[int, bytes]]:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), codec.encode_all(batch.column("text")), strict=True):
                    yield doc_id, ids + end
                batch = next(batches, None)

        path = f"{folder}/shard-{shard:06d}.tokens"
        with storage.committed(path) as out:
            n_docs, n_tokens = write_shard(out, encoded(), codec.itemsize)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    manifest = storage.materialize(storage.map_batches(ordered, write, "shard int, path string, n_docs long, n_tokens long"), "token-manifest")
    # Starts by runs of RUN_SHARDS shards: only one row for each run is ordered in one task.
    runs = manifest.withColumn("run", F.floor(F.col("shard") / RUN_SHARDS))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.groupBy("run").agg(F.sum("n_tokens").alias("ids")).withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).drop("ids")
    inside = Window.partitionBy("run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return runs.join(base, "run").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("run", "base")


def read_token_frames(manifest: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """Read shards back, one row for each document: doc_id, start, n_tokens, ids_crc32, shard.

    Checksums of the seek table and of each frame read are verified; ``wanted`` limits the documents, and then
    only their frames are decompressed.  ids_crc32 is of the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = storage.open_fs(row["path"])
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "shard")}
                with files.open_input_file(path) as file:
                    shard = ShardReader(file)
                    starts = row["start"] + np.cumsum(shard.docs["n"], dtype=np.int64) - shard.docs["n"]
                    kept = range(len(starts)) if wanted is None else [i for i, d in enumerate(shard.docs["doc_id"].tolist()) if d in wanted]
                    for i, (doc_id, ids) in zip(kept, shard.rows(wanted), strict=True):
                        for k, v in zip(out, (None if doc_id == NO_ID else doc_id, int(starts[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"]), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "shard" else pa.int64()) for k, v in out.items()], names=list(out))

    spread = manifest.select("shard", "path", "start").repartition(max(1, manifest.count()), "shard")
    return storage.map_batches(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
