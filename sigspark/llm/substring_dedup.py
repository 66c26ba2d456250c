"""Exact substring deduplication over a corpus by prefix-free parsing.

Every run of ``length`` bytes has a trigger: the window of ``TRIGGER`` bytes in it with the least rolling hash.  A
phrase is a maximal run of starts with one trigger, so the parse of a text is the sequence of its phrases, and each
``length``-byte string of the corpus starts in exactly one phrase and is found again under the same trigger.

The corpus order of suffixes, up to ``length`` bytes, comes from two sorts, both spread by trigger (the order is that
inside each trigger's bucket, since equal strings never lie in two buckets):

* The parse: the phrases of the corpus, sorted by trigger and content.  A phrase that a smaller document has too is
  repeated as a whole.  This settles all but the ends of repeated passages, in one row for each phrase, and a task
  keeps the repeats that it sees itself, so a passage in a third of all documents sends one row from each task.
* The dictionary: where a trigger has different phrases, each distinct phrase is fetched once, from its smallest
  document, and the suffix array of these phrases is built from their bytes, up to ``length`` of them.  Suffixes of equal
  rank follow one another by their phrases' documents, which gives the corpus order; what is found in a phrase holds at
  every place where its smallest document has it.

Bytes are compared in the dictionary, and for repeats that one task sees.  Of a whole phrase in two tasks' documents, 48
bits of its trigger's hash and 48 of its own are compared instead.

Removed bytes go back to their documents in blocks, and each text is cut once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from sigspark.llm import rolling, storage

LENGTH = 50
TRIGGER = 24
CHUNK = 1 << 18
FLUSH = 8 << 20
PART_BYTES = 16 << 20
NO_ID = (1 << 63) - 1  # a null id counts as the greatest
PHRASES, COVERS, WANTED, PLACES, DOCUMENT = 0, 1, 2, 3, 9
_MESSAGE = "dest int, kind int, payload binary"
_LOW48 = np.uint64((1 << 48) - 1)
_SPREAD = np.uint64(0x9FB21C651E98DF25)
_COLUMNS = (("trigger", np.uint64), ("phrase", np.uint64), ("doc", np.int64), ("tag", np.int64), ("at", np.int64), ("span", np.uint8))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as one compressed message; those of 64-bit signed numbers are stored as differences."""
    parts = []
    for c in columns:
        if c.dtype == np.int64:
            c = np.diff(c, prepend=np.int64(0))
            c = c.astype(np.int32) if len(c) and abs(c).max() < 1 << 31 else c
        head = c.dtype.str.encode().ljust(8) + len(c).to_bytes(8, "little")
        parts.append(head + c.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(message: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(message), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 8].decode().strip()), int.from_bytes(raw[at + 8 : at + 16], "little")
        c = np.frombuffer(raw, kind, n, at + 16)
        at += 16 + n * kind.itemsize
        out.append(np.cumsum(c, dtype=np.int64) if kind in (np.int32, np.int64) else c)
    return out


def _short(hashes: np.ndarray, size: int) -> np.ndarray:
    """The low ``size`` bytes of 64-bit values."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :size]).ravel()


def _long(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = raw.reshape(-1, size)
    return out.view(np.uint64).ravel()


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        values = np.minimum(values[:-w], values[w:])
        w *= 2
    rest = width - w
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def phrases(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """Parse joined texts (``ends`` of each): trigger hash, phrase hash, first and last start of each phrase."""
    width = length - trigger + 1
    if len(data) < length:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    prefix = rolling.sums(data)
    h = rolling.windows(prefix, trigger)
    h = (h ^ (h >> np.uint64(32))) * _SPREAD
    h ^= h >> np.uint64(29)
    least = _sliding_min(h, width)
    n = len(least)
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False
    opens = np.empty(n, bool)
    opens[0] = True
    # The trigger changes when a lesser one comes in, or when it stood at the start just left.
    opens[1:] = (least[1:] != least[:-1]) | (h[: n - 1] == least[:-1]) | ~inside[:-1]
    opens &= inside
    first = np.flatnonzero(opens)
    last = np.flatnonzero(inside & np.r_[opens[1:] | ~inside[1:], True])
    content = rolling.mix(rolling.hashes(prefix, first, last + length) + (last - first).astype(np.uint64))
    return least[first], content, first, last


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys change: bounds of the runs, and the keys."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return np.r_[at, len(keys)], keys[at] if len(keys) else keys


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    dest, kind, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["dest", "kind", "payload"])


def _by_dest(dest: np.ndarray, kind: int, columns: list[np.ndarray], pack: Callable[..., bytes] = _pack) -> list[tuple[int, int, bytes]]:
    order = np.argsort(dest, kind="stable")
    columns = [c[order] for c in columns]
    bounds, keys = _runs(dest[order])
    return [(int(k), kind, pack(*(c[a:b] for c in columns))) for k, a, b in zip(keys, bounds[:-1], bounds[1:], strict=True)]


def suffix_ranks(data: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The rank of each start in the suffix array of ``data``, by its first ``length`` bytes: equal strings, equal ranks.

    Starts are sorted by eight bytes at a time, and only those that are still equal to others go on.
    """
    rank = np.zeros(len(start), np.int64)
    active = np.arange(len(start))
    for at in [*range(0, length - 8, 8), length - 8]:
        place = start[active] + at
        key = np.zeros(len(active), np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | data[place + k]
        order = np.lexsort((key, rank[active]))
        active, key = active[order], key[order]
        now = rank[active]
        group = np.r_[True, now[1:] != now[:-1]]
        run = group | np.r_[True, key[1:] != key[:-1]]
        index = np.arange(len(active))
        rank[active] = now + np.maximum.accumulate(np.where(run, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        active = active[~(run & np.r_[run[1:], True])]
        if not len(active):
            break
    return rank


def _pack_phrases(trigger: np.ndarray, phrase: np.ndarray, *rest: np.ndarray) -> bytes:
    return _pack(_short(trigger, 6), _short(phrase, 6), *rest)


def _block(doc: np.ndarray, tag: np.ndarray, blocks: int) -> np.ndarray:
    return ((doc ^ tag) % blocks).astype(np.int32)


def _bucket(trigger: np.ndarray, buckets: int) -> np.ndarray:
    """A trigger's bucket.  Of the least of several hashes only the low bits are even, and all of them are mixed."""
    return (rolling.mix(trigger & _LOW48) % np.uint64(buckets)).astype(np.int64)


def _same_bytes(texts: list[bytes], of: np.ndarray, at: np.ndarray, span: np.ndarray, one: np.ndarray, two: np.ndarray, length: int) -> np.ndarray:
    """Whether phrases ``one`` and ``two`` (numbers of phrases) have equal bytes; neighbours are compared in one go."""
    if not len(one):
        return np.zeros(0, bool)
    size = span[one].astype(np.int64) + 1
    follows = (of[one][1:] == of[one][:-1]) & (of[two][1:] == of[two][:-1]) & (at[one][1:] == (at[one] + size)[:-1]) & (at[two][1:] == (at[two] + size)[:-1])
    first = np.flatnonzero(np.r_[True, ~follows])
    last = np.r_[first[1:], len(one)] - 1
    n = (at[one[last]] + size[last] - at[one[first]] + length - 1).tolist()
    columns = (x.tolist() for x in (of[one[first]], at[one[first]], of[two[first]], at[two[first]]))
    same = [texts[a][i : i + k] == texts[b][j : j + k] for a, i, b, j, k in zip(*columns, n, strict=True)]
    return np.repeat(np.array(same), last - first + 1)


def _parse(length: int, buckets: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to messages: first phrases to their bucket; repeats seen here, as covers, to their block."""

    def flush(held: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
        held.sort(key=lambda x: x[:2])
        ids, tags = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        i = 0
        while i < len(held):
            j, size = i, 0
            while j < len(held) and (j == i or size + len(held[j][2]) <= CHUNK):
                size += len(held[j][2])
                j += 1
            ends = np.cumsum([len(x[2]) for x in held[i:j]])
            trigger, phrase, first, last = phrases(np.frombuffer(b"".join(x[2] for x in held[i:j]), np.uint8), ends, length)
            doc = np.searchsorted(ends, first, side="right")
            found.append((trigger, phrase, i + doc, first - np.r_[0, ends][doc], (last - first).astype(np.uint8)))
            i = j
        trigger, phrase, of, at, span = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(phrase, kind="stable")
        bounds, _ = _runs(phrase[order])
        lead = np.empty(len(order), np.int64)
        lead[order] = np.repeat(order[bounds[:-1]], np.diff(bounds))
        repeat = ids[of] > ids[of[lead]]
        repeat[repeat] = _same_bytes([x[2] for x in held], of, at, span, np.flatnonzero(repeat), lead[repeat], length)
        doc, tag = ids[of], tags[of]
        keep = ~repeat
        out = _by_dest(_bucket(trigger[keep], buckets), PHRASES, [trigger[keep], phrase[keep], doc[keep], tag[keep], at[keep], span[keep]], _pack_phrases)
        covers = _by_dest(_block(doc[repeat], tag[repeat], blocks), COVERS, [doc[repeat], tag[repeat], at[repeat], span[repeat].astype(np.int64)])
        # Covers ride along to a bucket, which sends them on; the block is the first byte group of the message.
        return out + [(dest % buckets, COVERS, dest.to_bytes(4, "little") + payload) for dest, _, payload in covers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, tag, text in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) >= length:
                    held.append((doc, tag, raw))
                    size += len(raw)
                if size >= FLUSH:
                    if rows := flush(held):
                        yield _messages(rows)
                    held, size = [], 0
        if held and (rows := flush(held)):
            yield _messages(rows)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The messages of each destination, which follow one another."""
    now, held = None, []
    for batch in batches:
        for dest, kind, payload in zip(batch.column("dest").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if dest != now:
                if held:
                    yield now, held
                now, held = dest, []
            held.append((kind, payload))
    if held:
        yield now, held


def _sort_parse(buckets: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A bucket's phrases to covers, to requests for the distinct phrases of triggers that have several, and to the other
    places of a requested phrase in its smallest document."""

    def settle(messages: list[bytes]) -> list[tuple[int, int, bytes]]:
        columns = [np.concatenate(c) for c in zip(*(_unpack(m) for m in messages), strict=True)]
        trigger, rest = _long(columns[0], 6), columns[1:]
        order = np.argsort(trigger)
        bounds, _ = _runs(trigger[order])
        order = order[np.repeat(np.diff(bounds) > 1, np.diff(bounds))]
        if not len(order):
            return []
        phrase = _long(rest[0], 6)[order]
        trigger, doc, tag, at, span = trigger[order], rest[1][order], rest[2][order], rest[3][order], rest[4][order]
        order = np.lexsort((at, tag, doc, phrase, trigger))
        trigger, phrase, doc, tag, at, span = (c[order] for c in (trigger, phrase, doc, tag, at, span))
        new_trigger = np.r_[True, trigger[1:] != trigger[:-1]]
        new_phrase = new_trigger | np.r_[True, phrase[1:] != phrase[:-1]]
        which = np.cumsum(new_phrase) - 1
        rep = doc[new_phrase][which]
        covered = doc > rep
        out = _by_dest(_block(doc[covered], tag[covered], blocks), COVERS, [doc[covered], tag[covered], at[covered], span[covered].astype(np.int64)])
        # Requests: one for each distinct phrase of a trigger whose phrases have different smallest documents.
        lead = np.flatnonzero(new_phrase)
        group = (np.cumsum(new_trigger) - 1)[lead]
        low, high = np.full(group[-1] + 1, NO_ID), np.full(group[-1] + 1, -NO_ID)
        np.minimum.at(low, group, doc[lead])
        np.maximum.at(high, group, doc[lead])
        asked = (low < high)[group]
        other = np.flatnonzero(asked[which] & ~covered & ~new_phrase)
        first = lead[which[other]]
        out += _by_dest(_bucket(trigger[other], buckets), PLACES, [doc[other], tag[first], at[first], tag[other], at[other]])
        lead = lead[asked]
        return out + _by_dest(_block(doc[lead], tag[lead], blocks), WANTED, [doc[lead], tag[lead], at[lead], span[lead].astype(np.int64), trigger[lead]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, messages in _gathered(batches):
            rows = [(int.from_bytes(m[:4], "little"), COVERS, m[4:]) for kind, m in messages if kind == COVERS]
            if own := [m for kind, m in messages if kind == PHRASES]:
                rows += settle(own)
            if rows:
                yield _messages(rows)

    return run


class _Rows:
    """Messages of a block as columns, looked up by document."""

    def __init__(self, messages: list[bytes]):
        columns = [np.concatenate(c) for c in zip(*(_unpack(m) for m in messages), strict=True)] if messages else [np.empty(0, np.int64)] * 5
        order = np.lexsort((columns[1], columns[0]))
        self.columns = [c[order] for c in columns]
        doc, tag = self.columns[:2]
        at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if len(doc) else np.empty(0, np.int64)
        ends = np.r_[at[1:], len(doc)] if len(doc) else at
        self.index = {(int(d), int(t)): (int(a), int(b)) for d, t, a, b in zip(doc[at], tag[at], at, ends, strict=True)}

    def of(self, doc: int, tag: int) -> list[np.ndarray]:
        a, b = self.index.get((doc, tag), (0, 0))
        return [c[a:b] for c in self.columns[2:]]


def _blocks(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[tuple[pa.RecordBatch, _Rows]]:
    """Batches of documents of one block each, with that block's messages (which come before them)."""
    now, held, rows = None, [], None
    for batch in batches:
        dest = np.asarray(batch.column("dest"))
        bounds, _ = _runs(dest)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if dest[a] != now:
                now, held, rows = dest[a], [], None
            part = batch.slice(a, b - a)
            kinds = np.asarray(part.column("kind"))
            n = int(np.searchsorted(kinds, DOCUMENT))
            held += [m for k, m in zip(kinds[:n].tolist(), part.column("payload").slice(0, n).to_pylist(), strict=True) if k == kind]
            if n < len(kinds):
                rows = rows or _Rows(held)
                yield part.slice(n), rows


def _fetch(length: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Requested phrases' bytes, to their trigger's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, wanted in _blocks(batches, WANTED):
            found: list[tuple[np.ndarray, ...]] = []
            for doc, tag, text in zip(docs.column("doc").to_pylist(), docs.column("tag").to_pylist(), docs.column("text"), strict=True):
                at, span, trigger = wanted.of(doc, tag)
                if len(at):
                    raw = text.as_buffer().to_pybytes()
                    parts = [raw[a : a + s + length] for a, s in zip(at.tolist(), span.tolist(), strict=True)]
                    found.append((np.full(len(at), doc), np.full(len(at), tag), at, span, trigger, np.array(parts, object)))
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                bucket = _bucket(columns[4], buckets)

                def pack(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, span: np.ndarray, _: np.ndarray, parts: np.ndarray) -> bytes:
                    return _pack(doc, tag, at, span, np.frombuffer(b"".join(parts.tolist()), np.uint8))

                yield _messages(_by_dest(bucket, WANTED, columns, pack))

    return run


def _matches(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the equi-join of two tables on all of their columns."""
    both = [np.concatenate(c) for c in zip(left, right, strict=True)]
    order = np.lexsort(both)
    new = np.zeros(len(order), bool)
    for c in both:
        new[1:] |= np.diff(c[order]) != 0
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new)
    one, two = code[: len(left[0])], code[len(left[0]) :]
    order = np.argsort(two, kind="stable")
    low, high = (np.searchsorted(two[order], one, side) for side in ("left", "right"))
    n = high - low
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
    return np.repeat(np.arange(len(one)), n), order[at]


def _sort_dictionary(length: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The suffix array of a bucket's phrases, by ``length`` bytes, with equal suffixes in their documents' order; starts that a smaller document has are covers,
    at each place of the phrase."""

    def settle(messages: list[bytes], places: list[bytes]) -> list[tuple[int, int, bytes]]:
        doc, tag, at, span, data = (np.concatenate(c) for c in zip(*(_unpack(m) for m in messages), strict=True))
        size = span + 1
        base = np.cumsum(size + length - 1) - (size + length - 1)
        of = np.repeat(np.arange(len(doc)), size)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        start = base[of] + offset
        suffix = suffix_ranks(data, start, length)
        order = np.lexsort((doc[of], suffix))
        bounds, _ = _runs(suffix[order])
        least = np.repeat(doc[of[order[bounds[:-1]]]], np.diff(bounds))
        covered = np.zeros(len(of), bool)
        covered[order] = doc[of[order]] > least
        where = np.flatnonzero(covered)
        if not len(where):
            return []
        opens = np.r_[True, (np.diff(where) > 1) | (np.diff(of[where]) > 0)]
        closes = np.r_[opens[1:], True]
        first, last = where[opens], where[closes]
        k = of[first]
        found = [doc[k], tag[k], at[k] + offset[first], last - first]
        if places:
            of_doc, lead_tag, lead_at, also_tag, also_at = (np.concatenate(c) for c in zip(*(_unpack(m) for m in places), strict=True))
            hit, place = _matches([doc[k], tag[k], at[k]], [of_doc, lead_tag, lead_at])
            more = [of_doc[place], also_tag[place], also_at[place] + offset[first][hit], (last - first)[hit]]
            found = [np.concatenate(c) for c in zip(found, more, strict=True)]
        return _by_dest(_block(found[0], found[1], blocks), COVERS, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, messages in _gathered(batches):
            texts, places = ([m for kind, m in messages if kind == k] for k in (WANTED, PLACES))
            if texts and (rows := settle(texts, places)):
                yield _messages(rows)

    return run


def cut_text(raw: bytes, at: np.ndarray, span: np.ndarray, length: int = LENGTH) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and the bytes kept, for covered starts [at, at + span]."""
    if not len(at):
        return 0, 0, raw
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + span + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(np.count_nonzero(gone)), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


_ADDED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept "


def _cut(length: int, passed: list[str], names: list[str], as_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, covers in _blocks(batches, COVERS):
            rows = []
            for doc, tag, text in zip(docs.column("doc").to_pylist(), docs.column("tag").to_pylist(), docs.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                at, span = covers.of(doc, tag)[:2]
                removed, spans, kept = cut_text(raw, at, span, length)
                left = kept if not as_text else kept.decode("utf-8", "ignore") if text.is_valid else None
                rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), left))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string() if as_text else pa.binary()]
            added = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in passed), *added], names=names)

    return run


def cut_repeats(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, as_text: bool = False, prefix: str = "") -> DataFrame:
    """Remove from each text every byte covered by a ``length``-byte string that starts in a document of a smaller id too.

    Returns the columns of ``keep`` (default: the id), n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes
    left, which need not be whole characters; with ``as_text`` a string without the rest of characters that a cut has split,
    and null for a null text).  Matches lie inside one text.  A null text is empty; documents of equal
    ids don't cut each other; a null id counts as greater than any other; texts under ``length`` bytes stay; an empty
    table gives no row.  Columns of ``docs`` may have any names; ``prefix`` is put before the names of the added ones, and
    a column of ``keep`` of such a name is an error.
    """
    spark = docs.sparkSession
    keep = [id_col] if keep is None else keep
    passed = [f"kept_{i}" for i in range(len(keep))]
    tag: Column = F.xxhash64(storage.col(text_col)).bitwiseAND(F.lit((1 << 31) - 1))
    base = docs.select(F.coalesce(storage.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), tag.alias("tag"), storage.col(text_col).alias("text"), *(storage.col(c).alias(p) for c, p in zip(keep, passed, strict=True)))
    n = storage.parts_for(spark, storage.input_bytes(base, "text"), PART_BYTES)

    def dealt(messages: DataFrame) -> DataFrame:
        return messages.repartitionById(n, "dest").sortWithinPartitions("dest")

    def with_texts(messages: DataFrame, *columns: str) -> DataFrame:
        block = F.pmod(F.col("doc").bitwiseXOR(F.col("tag")), F.lit(n)).cast("int")
        texts = base.select(block.alias("dest"), F.lit(DOCUMENT).alias("kind"), "doc", "tag", "text", *columns)
        return messages.unionByName(texts, allowMissingColumns=True).repartitionById(n, "dest").sortWithinPartitions("dest", "kind")

    parsed = storage.map_batches(base.select("doc", "tag", "text"), _parse(length, n, n), _MESSAGE)
    settled = storage.materialize(storage.map_batches(dealt(parsed), _sort_parse(n, n), _MESSAGE), "parse")
    wanted = settled.where(F.col("kind") == WANTED)
    fetched = storage.map_batches(with_texts(wanted), _fetch(length, n), _MESSAGE)
    places = settled.where(F.col("kind") == PLACES)
    ends = storage.materialize(storage.map_batches(dealt(fetched.unionByName(places)), _sort_dictionary(length, n), _MESSAGE), "dictionary")
    covers = settled.where(F.col("kind") == COVERS).unionByName(ends)
    added = [StructField(prefix + x.split()[0], LongType() if "long" in x else StringType()) for x in _ADDED.split(", ")[:-1]]
    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in keep), *added, StructField(f"{prefix}kept", StringType() if as_text else BinaryType())])
    if len(set(schema.names)) < len(schema):
        raise ValueError(f"a kept column has the name of an added one: {schema.names}")
    return storage.map_batches(with_texts(covers, *passed), _cut(length, passed, schema.names, as_text), schema)
