"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are normalised (lower case, no accents; every run of ASCII white space and punctuation is one space) and compared
as UTF-8 bytes.  An item of m bytes that stands in a text with at most e edits shares m - q + 1 - q e q-grams with it,
all within e diagonals (place in the text less place in the item).  Diagonals are counted in bands of twice the
largest e, each overlapping half of the next, so some band holds them all; bands that reach the bound are aligned
within their region, and those of at most e edits are leaks.

The benchmark is the stated query set: it comes in blocks of at most ``BLOCK_BYTES`` of text.  A pass over all documents
takes ``PASS_BLOCKS`` blocks: it ships their texts to the tasks, and a task builds their indexes once (about 20 MB a
block) and hashes each document once for all of them.  No document is shuffled.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import rolling, storage

Q = 12
BUDGET = 0.06
BLOCK_BYTES = 1 << 20
PASS_BLOCKS = 12
FILTER_BITS = 22
POSTINGS = 1 << 21  # q-gram hits that are counted at once
FOUND = "doc_id long, item_id long, edits int, start long, end long"

_MARKS = re.compile("[\u0300-\u036f]+")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def normalise(text: str | None) -> np.ndarray:
    """The bytes that are compared."""
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    data = _FOLD[np.frombuffer(text.encode("utf-8"), np.uint8)]
    blank = data == 0x20
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    data = data[keep]
    return data[int(len(data) > 0 and data[0] == 0x20) : len(data) - int(len(data) > 1 and data[-1] == 0x20)]


def budget(m: int, q: int = Q, rate: float = BUDGET) -> int:
    """Edits allowed in an item of m bytes: a share of m, but few enough for the lemma to ask for one q-gram."""
    return max(0, min(int(rate * m), (m - q) // q))


def align_banded(item: np.ndarray, data: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """The least edits that turn ``item`` into a part of ``data``, and that part's start and end, within a band of diagonals.

    Cells of the alignment are (row, diagonal) with diagonal, the place in ``data`` less the row, from ``low`` to ``high``; a
    cell's start comes along with its cost.  None: no part of ``data`` lies in the band.
    """
    m, n, width = len(item), len(data), high - low + 1
    far = m + n + 1
    column = np.arange(width)
    padded = np.full(m + width, 256, np.int64)  # data[low + k] at k; 256 outside of it
    a, b = max(0, low), min(n, low + m + width)
    if b > a:
        padded[a - low : b - low] = data[a:b]
    place = low + column
    cost = np.where((place >= 0) & (place <= n), 0, far)
    begin = place.copy()
    for i, c in enumerate(item.tolist(), 1):
        # Matched or changed (same diagonal), or left out (from the next diagonal); then bytes of data put in, from the left.
        step = cost + (padded[i - 1 : i - 1 + width] != c)
        skip = np.append(cost[1:] + 1, far)
        take = skip < step
        best = np.where(take, skip, step)
        begin = np.where(take, np.append(begin[1:], 0), begin)
        place = low + column + i
        best[(place < 0) | (place > n)] = far
        run = best - column
        least = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == least, column, 0))
        cost, begin = least + column, begin[source]
        cost[(place < 0) | (place > n)] = far
    at = int(cost.argmin())
    return (int(cost[at]), int(begin[at]), low + at + m) if cost[at] < far else None


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], q: int = Q, rate: float = BUDGET):
        self.q = q
        texts = [(i, normalise(t)) for i, t in items]
        self.items = [(i, t, budget(len(t), q, rate)) for i, t in texts if len(t) >= q]
        self.short = [(i, b" " + t.tobytes() + b" ") for i, t in texts if 0 < len(t) < q]
        self.need = np.array([len(t) - q + 1 - q * e for _, t, e in self.items], np.int64)
        self.stride = 1 + max((e for _, _, e in self.items), default=0)
        grams = [rolling.mix(rolling.windows(rolling.sums(t), q)) for _, t, _ in self.items]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, at = np.unique(flat[order], return_index=True)
        self.bounds = np.r_[at, len(flat)]
        self.of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order].astype(np.int32) if grams else np.empty(0, np.int32)
        self.place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])[order] if grams else np.empty(0, np.int32)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of each item found in a text, at its best place (in normalised bytes)."""
        data = normalise(text)
        return self.leaks_in(data, hashed(data, self.q))

    def leaks_in(self, data: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``leaks`` of a normalised text with its q-grams' hashes."""
        found = []
        if self.short and len(data):
            raw = b" " + data.tobytes() + b" "
            found += [(i, 0, at, at + len(t) - 2) for i, t in self.short if (at := raw.find(t)) >= 0]
        if not len(h) or not len(self.grams):
            return found
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        gram = np.searchsorted(self.grams, h[at])
        gram[gram == len(self.grams)] = 0
        same = self.grams[gram] == h[at]
        at, gram = at[same], gram[same]
        n = self.bounds[gram + 1] - self.bounds[gram]
        if int(n.sum()) < self.need.min():
            return found
        best: dict[int, tuple[int, int, int]] = {}
        for item, band in self._bands(at, gram, n, len(data)):
            here = self._place(item, band, data)
            if here and (item not in best or here < best[item]):
                best[item] = here
        return found + [(self.items[k][0], *best[k]) for k in sorted(best)]

    def _bands(self, at: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(item, band) of the bands that reach the bound, from counts of the shared q-grams in each.

        Hits are counted in parts of about ``POSTINGS``, so a common q-gram in a long text doesn't need memory for all at once.
        """
        ends = np.cumsum(n)
        cuts = np.searchsorted(ends, np.arange(POSTINGS, int(ends[-1]) + POSTINGS, POSTINGS), side="left") + 1
        bands = size // self.stride + 2 + max((len(t) for _, t, _ in self.items)) // self.stride + 2
        shift = max((len(t) for _, t, _ in self.items)) // self.stride + 2
        seen, count = np.empty(0, np.int64), np.empty(0, np.int64)
        a = 0
        for b in np.unique(np.minimum(cuts, len(n))).tolist():
            part = n[a:b]
            posting = np.arange(part.sum()) + np.repeat(self.bounds[gram[a:b]] - (np.cumsum(part) - part), part)
            item = self.of[posting].astype(np.int64)
            band = (np.repeat(at[a:b], part) - self.place[posting]) // self.stride + shift
            key, number = np.unique(np.concatenate([item * bands + band, item * bands + band - 1]), return_counts=True)
            both = np.concatenate([seen, key])
            seen, where = np.unique(both, return_inverse=True)
            count = np.bincount(where, weights=np.concatenate([count, number]), minlength=len(seen)).astype(np.int64)
            a = b
        enough = seen[count >= self.need[seen // bands]]
        return [(k // bands, k % bands - shift) for k in enough.tolist()]

    def _place(self, k: int, band: int, data: np.ndarray) -> tuple[int, int, int] | None:
        """Edits, start and end of an item in the diagonals of a band, and as far beside it as its edits reach."""
        _, item, most = self.items[k]
        low, high = band * self.stride - most, (band + 2) * self.stride - 1 + most
        begin = max(0, low)
        exact = data[begin : max(0, high + len(item))].tobytes().find(item.tobytes())
        if exact >= 0:
            return 0, begin + exact, begin + exact + len(item)
        found = align_banded(item, data, low, high)
        return found if found and found[0] <= most else None


def hashed(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The hashes of a normalised text's q-grams."""
    return rolling.mix(rolling.windows(rolling.sums(data), q)) if len(data) >= q else np.empty(0, np.uint64)


def item_blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct items in blocks, by a hash, of about ``block_bytes``; nulls are no items."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total * 5 // (4 * block_bytes))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows]


def _passes(benchmark: DataFrame) -> Iterator[list[list[tuple[int, str]]]]:
    """The benchmark's blocks, ``PASS_BLOCKS`` at a time."""
    held: list[list[tuple[int, str]]] = []
    for block in item_blocks(benchmark):
        held.append(block)
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


def _searcher(blocks: list[list[tuple[int, str]]]) -> Callable[[str | None], list[tuple[int, int, int, int]]]:
    """All leaks of a text in the items of ``blocks``; built where it is called, which is in a task."""
    indexes = [Index(b) for b in blocks]

    def leaks(text: str | None) -> list[tuple[int, int, int, int]]:
        data = normalise(text)
        h = hashed(data)
        return [x for index in indexes for x in index.leaks_in(data, h)]

    return leaks


def _scan(blocks: list[list[tuple[int, str]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaks = _searcher(blocks)
        for batch in batches:
            rows = [(doc, *leak) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for leak in leaks(text.as_py())]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each benchmark item in each document: doc_id, item_id, edits, start, end (in normalised bytes).

    An item's best place counts: of least edits, then the first.  Items of under ``Q`` bytes must stand as whole words and
    exactly; empty and null items and texts leak nothing; repeated rows are searched each, and a repeated item once; an
    empty table on either side gives no row; other columns are not read.
    """
    named = docs.select(storage.col(id_col).cast("long").alias("doc_id"), storage.col(text_col).alias("text"))
    parts = [storage.map_batches(named, _scan(blocks), FOUND) for blocks in _passes(benchmark)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns, of any names.

    A row of a null or empty text stays, and repeated rows each; an empty benchmark takes nothing away.
    """

    def keep(blocks: list[list[tuple[int, str]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaks = _searcher(blocks)
            for batch in batches:
                yield batch.filter(pa.array([not leaks(text.as_py()) for text in batch.column(text_col)], pa.bool_()))

        return run

    for blocks in _passes(benchmark):
        docs = storage.map_batches(docs, keep(blocks), docs.schema)
    return docs
