"""Hierarchical residual packing of token pieces into sequences of a fixed length.

1. Each task encodes its documents, cuts those longer than a sequence, and packs the rest best-fit in
   decreasing order.  Sequences with at most ``slack`` free places are done.
2. The underfull ones travel as items: a round deals them to tasks of at most ``ROUND_BINS`` bins, and each task
   repeats best-fit, once over the bins as they are and once over their pieces, and keeps the better result.
3. Rounds merge as a tree until one task holds what is left, or a round brings under 1 % fewer bins.

Nothing but the (few) underfull bins is ever shuffled, and a task's memory is bounded by its batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import storage
from sigspark.llm.tokens import END_ID, VOCABULARY, encoder

CAPACITY = 1024
LEAF_PIECES = 1 << 16
ROUND_BINS = 1 << 14
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"
_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item, taking items by decreasing length into the fullest bin that holds them, and the number of bins.

    Bins are kept by their free places; a bit set of the free counts in use finds the best one.
    """
    where = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = used >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                used &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        room -= n
        if room:
            free[room].append(b)
            used |= 1 << room
        where[i] = b
    return where, bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole capacities, but for the first, which takes the remainder."""
    head = n % capacity if n > capacity else n
    pieces = [(0, head)] if head else []
    return pieces + [(s, capacity) for s in range(head, n, capacity)]


def _placed(columns: list[np.ndarray], where: np.ndarray, capacity: int, slack: int, first_id: int) -> pa.RecordBatch:
    """Rows in bin order with their sequence, offset, and whether the sequence stays open."""
    order = np.argsort(where, kind="stable")
    bins, length = where[order], columns[3][order]
    ends = np.cumsum(length)
    new = np.r_[True, bins[1:] != bins[:-1]]
    base = np.maximum.accumulate(np.where(new, ends - length, 0))
    filled = np.bincount(bins, weights=length).astype(np.int64)
    columns = [c[order] for c in columns] + [first_id + bins, ends - length - base, filled[bins] < capacity - slack]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _types(), strict=True)], names=_names())


def _names() -> list[str]:
    return [*_COLUMNS, "sequence_id", "offset", "open"]


def _types() -> list[pa.DataType]:
    return [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]


def _leaf(capacity: int, slack: int, end_id: int, vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        end = end_id.to_bytes(codec.itemsize, "little")
        next_id = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, int, int, int, int]] = []

        def pack() -> pa.RecordBatch:
            nonlocal next_id
            ids = [x[0] for x in held]
            columns = [np.array([x[k] or 0 for x in held], np.int64) for k in range(5)]
            where, bins = best_fit(columns[3], capacity)
            batch = _placed([np.arange(len(held)), *columns[1:]], where, capacity, slack, next_id)
            batch = batch.set_column(0, "doc_id", pa.array([ids[i] for i in batch.column(0).to_pylist()], pa.int64()))
            next_id += bins
            held.clear()
            return batch

        for batch in batches:
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), codec.encode_all(batch.column("text")), strict=True):
                ids = np.frombuffer(encoded + end, codec.dtype).astype("<u4")
                for piece, (start, n) in enumerate(cut(len(ids), capacity)):
                    held.append((doc_id, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                if len(held) >= LEAF_PIECES:
                    yield pack()
        if held:
            yield pack()

    return run


def _merge(round_no: int, capacity: int, slack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        ids = rows.column("doc_id").combine_chunks()
        columns = [np.arange(rows.num_rows), *(rows.column(c).to_numpy() for c in _COLUMNS[1:])]
        _, bin_of = np.unique(rows.column("sequence_id").to_numpy(), return_inverse=True)
        filled = np.bincount(bin_of, weights=columns[3]).astype(np.int64)
        whole, n_whole = best_fit(filled, capacity)
        apart, n_apart = best_fit(columns[3], capacity)
        where = apart if n_apart < n_whole else whole[bin_of]
        first = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        batch = _placed(columns, where, capacity, slack, first)
        yield batch.set_column(0, "doc_id", ids.take(batch.column(0)))

    return run


def pack_sequences(docs: DataFrame, *, capacity: int = CAPACITY, slack: int | None = None, end_id: int = END_ID, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all ``docs`` into sequences of at most ``capacity`` ids; one row for each piece.

    Returns doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit), sequence_id and
    offset.  A null or empty text is its end id alone; repeated rows and null ids are packed like any other; an
    empty table gives no row; other columns are not read.  ``slack`` (default capacity / 128) is how many free places
    a sequence may have that no later round tries to fill.
    """
    slack = capacity // 128 if slack is None else slack
    rows = docs.select(storage.col(id_col).cast("long").alias("doc_id"), storage.col(text_col).alias("text"))
    packed = storage.materialize(storage.map_batches(rows, _leaf(capacity, slack, end_id, vocabulary), SCHEMA), "packed-0")
    done = [packed.where("not open")]
    left = packed.where("open")
    bins = left.where("offset = 0").count()
    for round_no in range(1, 128):
        if bins == 0:
            break
        tasks = -(-bins // ROUND_BINS)
        merged = storage.materialize(storage.map_batches(left.repartition(tasks, "sequence_id"), _merge(round_no, capacity, slack), SCHEMA), f"packed-{round_no}")
        done.append(merged.where("not open"))
        left = merged.where("open")
        before, bins = bins, left.where("offset = 0").count()
        if tasks == 1 or bins > 0.99 * before:
            break
    out = left
    for x in done:
        out = out.unionByName(x)
    return out.drop("open")
