"""Scoring texts by an n-gram language model whose counts stand in shards of a memory-mapped Elias-Fano trie.

The model is an interpolation of three levels.  The first is the base distribution of words; the second and third add the
relative frequencies of a word behind the one and the two words before it, each with a weight that depends on how often
that context was seen.  Weights are fitted to all training tokens, each left out of its own counts.

1. Texts are cut into batches of about 8 MB.  A batch's distinct words go to shards of the vocabulary, which
   count them and answer with ids (small for frequent words) and counts.
2. A batch's distinct n-grams go to shards of the trie as messages, one for each pair of batch and shard.  A shard adds
   up the training counts, writes its levels to the shared folder, maps them and answers every message by successor
   search: how often the pair, and how often the triple was seen.  N-grams are dealt by their middle word, and those of a
   very frequent word by the last word too, so no word fills a shard by itself.
3. A context's total is the frequency of the pair before, which the same batch has asked for.  So the weights are fitted
   from histograms that batches count, and documents are scored, without another look-up.

A level stores frequencies as quantised codes; a pair's conditional probability needs the total of a node that may be in
another shard, so the smoothed probability is formed where the answers meet.  Nothing of the model is broadcast or
collected but the totals and the histograms, whose size is fixed.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import rolling, storage
from sigspark.llm.ngram_trie import PAIRS, TRIPLES, NgramTrie

CHUNK = 1 << 20
LONG_WORD = 1 << 16  # bytes; a longer word is hashed by itself
FOLDS, HELD_OUT = 5, 1
BUCKETS, BINS = 41, 256  # of a context's count and of a ratio, in powers of 2 and in quarters of them


@dataclasses.dataclass(frozen=True)
class Sizes:
    """How much one task holds; scores don't depend on it."""

    batch_bytes: int = 8 << 20
    batch_tokens: int = 1_500_000  # a longer text is cut into pieces, each of which knows the two words before it
    shard_bytes: int = 12 << 20  # of text, whose n-grams make a shard of the trie


_END = np.uint64(0xE4D0_0F7E_C57E_11D5)  # stands for the end of a text, and for what is before it
_SHIFT = np.uint64(32)
_MESSAGE = "batch long, shard int, payload binary"


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept out of training; one with a null id isn't."""
    return F.coalesce(F.crc32(storage.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of some UTF-8 bytes, lower-cased in A-Z, and where it starts."""
    data = rolling.LOWER[data]
    start, end = rolling.words(data)
    out = np.empty(len(start), np.uint64)
    bounds = np.searchsorted(start, np.arange(0, len(data) + CHUNK, CHUNK))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a == b:
            continue
        s, e = start[a:b], np.minimum(end[a:b], start[a:b] + LONG_WORD)
        sums = rolling.sums(data[s[0] : e[-1]])
        out[a:b] = rolling.mix(rolling.hashes(sums, s - s[0], e - s[0]) + (e - s).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out, start


# Messages and files


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers in their fewest bytes, byte by byte of all numbers, compressed."""
    parts = []
    for c in columns:
        most = int(c.max()) if len(c) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
        raw = np.ascontiguousarray(c.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
        parts.append(bytes([width]) + len(c).to_bytes(8, "little") + raw.T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(payload: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload), 0, []
    while at < len(raw):
        width, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        planes = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 9 + n * width
    return out


def _save(uri: str, *columns: np.ndarray) -> None:
    with storage.committed(uri) as out:
        out.write(_pack(*columns))


def _load(uri: str) -> list[np.ndarray]:
    files, path = storage.open_fs(uri)
    with files.open_input_file(path) as file:
        return _unpack(file.read())


def _messages(batch: list[int], shard: list[int], payload: list[bytes], **more: list[int]) -> pa.RecordBatch:
    columns = {"batch": pa.array(batch, pa.int64()), "shard": pa.array(shard, pa.int32()), "payload": pa.array(payload, pa.binary())}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(v, pa.int64()) for k, v in more.items()})


def _grouped(batches: Iterator[pa.RecordBatch], key: str, other: str) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Messages of each ``key``, which follow one another."""
    now, others, payloads = None, [], []
    for batch in batches:
        for k, o, p in zip(*(batch.column(c).to_pylist() for c in (key, other, "payload")), strict=True):
            if k != now and others:
                yield now, others, payloads
                others, payloads = [], []
            now = k
            others.append(o)
            payloads.append(p)
    if others:
        yield now, others, payloads


# Batches of texts


class _Batch:
    """Tokens of some pieces of texts, as places in the batch's own dictionary.

    A piece starts with ``lead`` tokens of context, the end mark or the two words before it, that aren't its own.
    """

    def __init__(self, token: np.ndarray, size: np.ndarray, lead: np.ndarray, train: np.ndarray):
        self.token, self.size = token.astype(np.int64), size.astype(np.int64)
        self.piece = np.repeat(np.arange(len(size)), self.size)
        self.off = np.arange(len(token)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.scored = self.off >= lead.astype(np.int64)[self.piece]
        self.train = (train[self.piece] > 0) & self.scored

    def ngrams(self, ids: np.ndarray, counts: np.ndarray, shards: int, hot: int) -> _Ngrams:
        return _Ngrams(self, ids, counts, shards, hot)


class _Ngrams:
    """The distinct n-grams of a batch in the order in which its messages have them."""

    def __init__(self, batch: _Batch, ids: np.ndarray, counts: np.ndarray, shards: int, hot: int):
        token = batch.token
        at = np.flatnonzero(batch.off >= 1)
        at = at[(ids[token[at]] > 0) & (ids[token[at - 1]] > 0)]  # a word that training lacks is in no n-gram
        self.at = at
        v, w = token[at - 1], token[at]
        two = np.maximum(at - 2, 0)
        u = np.where((batch.off[at] >= 2) & (ids[token[two]] > 0), token[two] + 1, 0)
        pairs, self.pair_of = np.unique(v.astype(np.uint64) << _SHIFT | w.astype(np.uint64), return_inverse=True)
        triples, self.triple_of = np.unique(self.pair_of.astype(np.uint64) << _SHIFT | u.astype(np.uint64), return_inverse=True)
        self.n = np.bincount(self.triple_of, batch.train[at], len(triples)).astype(np.int64)
        low = np.uint64(0xFFFFFFFF)
        self.v, self.w = (pairs >> _SHIFT).astype(np.int64), (pairs & low).astype(np.int64)
        self.pair, u = (triples >> _SHIFT).astype(np.int64), (triples & low).astype(np.int64)
        self.u = np.where(u > 0, ids[np.maximum(u - 1, 0)], 0)
        key = rolling.mix(ids[self.v].astype(np.uint64))
        key = np.where(counts[self.v] > hot, rolling.mix(key + ids[self.w].astype(np.uint64)), key)
        dest = ((key >> _SHIFT) * np.uint64(shards) >> _SHIFT).astype(np.int32)
        self.pair_order = np.argsort(dest, kind="stable")
        self.triple_order = np.argsort(dest[self.pair], kind="stable")
        self.dest, self.ids = dest, ids

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """(shard, payload): words v with their pairs, words w with their triples, words u and training counts."""
        place = np.empty(len(self.pair_order), np.int64)
        place[self.pair_order] = np.arange(len(place))
        pair = place[self.pair[self.triple_order]]  # ascending
        n_u = np.bincount(pair, minlength=len(place))
        dest = self.dest[self.pair_order]
        bounds = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1], True]) if len(dest) else np.zeros(1, int)
        first_u = np.r_[0, np.cumsum(n_u)]
        v, w, u, n = self.v[self.pair_order], self.ids[self.w[self.pair_order]], self.u[self.triple_order], self.n[self.triple_order]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            runs = np.flatnonzero(np.r_[True, v[a + 1 : b] != v[a : b - 1], True])
            yield int(dest[a]), _pack(self.ids[v[a:b][runs[:-1]]], np.diff(runs), w[a:b], n_u[a:b], u[first_u[a] : first_u[b]], n[first_u[a] : first_u[b]])

    def at_tokens(self, n_tokens: int, codes2: np.ndarray, codes3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Answers, in the order of the messages, as codes for each token of the batch."""
        out = []
        for codes, order, of in ((codes2, self.pair_order, self.pair_of), (codes3, self.triple_order, self.triple_of)):
            mine = np.empty(len(order), codes.dtype)
            mine[order] = codes
            full = np.zeros(n_tokens, codes.dtype)
            full[self.at] = mine[of]
            out.append(full)
        return out[0], out[1]


def _read_texts(folder: str, shards: int, sizes: Sizes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (doc_id, held_out, text) to files of tokens, and requests for the words of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24  # the same in each attempt of a task, as are its batches
        row = number
        held: list[tuple[np.ndarray, ...]] = []  # hashes; size, lead, train, row, whether it has an id and the id of pieces

        def flush() -> pa.RecordBatch:
            nonlocal number
            hashes, size, lead, train, *texts = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            words, token = np.unique(hashes, return_inverse=True)
            batch = _Batch(token, size, lead, train)
            n = np.bincount(token[batch.train], minlength=len(words))
            _save(f"{folder}/tokens-{number}", token, size, lead, train, *texts)
            shard = ((words >> _SHIFT) * np.uint64(shards) >> _SHIFT).astype(np.int64)  # ascends with the hash
            bounds = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            pieces = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            out = _messages([number] * len(pieces), [int(shard[a]) for a, _ in pieces], [_pack(np.diff(words[a:b], prepend=np.uint64(0)), n[a:b]) for a, b in pieces])
            number += 1
            return out

        def chunk() -> Iterator[pa.RecordBatch]:
            nonlocal row
            ends = np.cumsum([len(t) + 1 for t in texts])
            hashes, start = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
            doc = np.searchsorted(ends, start, "right")
            n = np.bincount(doc, minlength=len(texts)) + 2
            token = np.full(int(n.sum()), _END)  # in front of each text and behind it
            token[np.arange(len(hashes)) + 2 * doc + 1] = hashes
            one = (np.array([not m[1] for m in marks], np.uint8), np.arange(row, row + len(texts)), np.array([m[0] is not None for m in marks], np.uint8), np.array([m[0] or 0 for m in marks], np.int64).view(np.uint64))
            row += len(texts)
            if len(texts) > 1 or len(token) <= sizes.batch_tokens:
                held.append((token, n, np.ones(len(n), np.int64), *one))
            else:
                if held:
                    yield flush()
                for a in range(1, len(token), sizes.batch_tokens):
                    lead = min(a, 2)
                    piece = token[a - lead : a + sizes.batch_tokens]
                    held.append((piece, np.array([len(piece)]), np.array([lead]), *one))
                    yield flush()
            texts.clear()
            marks.clear()

        texts: list[bytes] = []
        marks: list[tuple[int | None, bool]] = []
        size = total = 0
        for batch in batches:
            for text, *mark in zip(batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
                raw = text.as_py() or b""
                full = total > 0 and total + len(raw) > sizes.batch_bytes
                if texts and (full or size + len(raw) > CHUNK):
                    yield from chunk()
                    size = 0
                if full:
                    if held:
                        yield flush()
                    total = 0
                texts.append(raw)
                marks.append(tuple(mark))
                size += len(raw)
                total += len(raw)
        if texts:
            yield from chunk()
        if held:
            yield flush()

    return run


def _count_words(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A vocabulary shard's requests to ids and counts; ``n`` and ``words`` have its totals, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, batch, payloads in _grouped(batches, "shard", "batch"):
            asked = [_unpack(p) for p in payloads]
            asked = [(np.cumsum(h, dtype=np.uint64), n) for h, n in asked]
            words, at = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in asked]), len(words)).astype(np.int64)
            rank = np.empty(len(words), np.int64)
            rank[np.lexsort((words, -counts))] = np.arange(len(words))
            ids = np.where(counts > 0, rank * shards + shard + 1, 0)
            ends = np.cumsum([len(h) for h, _ in asked])[:-1]
            answers = [_pack(ids[a], counts[a]) for a in np.split(at, ends)]
            once = [0] * (len(batch) - 1)
            yield _messages(batch, [shard] * len(batch), answers, n=[int(counts.sum()), *once], words=[int((counts > 0).sum()), *once])

    return run


def _ask_ngrams(folder: str, shards: int, hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch's ids and counts of words, kept beside its tokens, to requests for its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, payloads in _grouped(batches, "batch", "shard"):
            ids, counts = (np.concatenate(c).astype(np.int64) for c in zip(*map(_unpack, payloads), strict=True))
            _save(f"{folder}/words-{number}", ids, counts)
            token, size, lead, train, *_ = _load(f"{folder}/tokens-{number}")
            asked = list(_Batch(token, size, lead, train).ngrams(ids, counts, shards, hot).messages())
            if asked:
                yield _messages([number] * len(asked), [d for d, _ in asked], [p for _, p in asked])

    return run


def _expanded(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v, n_w, w, n_u, u, n = _unpack(payload)
    return np.repeat(v, n_w).astype(np.int64), w.astype(np.int64), np.repeat(np.arange(len(w)), n_u), u.astype(np.int64), n.astype(np.int64)


def _answer_ngrams(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A trie shard's requests to its file and to the codes of every request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, batch, payloads in _grouped(batches, "shard", "batch"):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for payload in payloads:
                v, w, pair, u, n = _expanded(payload)
                seen = n > 0
                for c, x in zip(columns, (v[pair[seen]], w[pair[seen]], u[seen], n[seen]), strict=True):
                    c.append(x)
            trie = NgramTrie.of(*(np.concatenate(c) for c in columns))
            del columns
            path = f"{folder}/trie-{shard}"
            trie.write(path)
            trie = NgramTrie.open(path)
            for number, asked in _together(batch, payloads):
                v, w, pair, u = (np.concatenate(c) for c in zip(*asked, strict=True))
                codes2, codes3 = trie.find(v, w, pair, u)
                at2, at3 = np.cumsum([0] + [len(x[0]) for x in asked]), np.cumsum([0] + [len(x[3]) for x in asked])
                answers = [_pack(codes2[at2[i] : at2[i + 1]], codes3[at3[i] : at3[i + 1]]) for i in range(len(asked))]
                yield _messages(number, [shard] * len(number), answers)

    return run


def _together(batch: list[int], payloads: list[bytes], most: int = 300_000) -> Iterator[tuple[list[int], list[tuple[np.ndarray, ...]]]]:
    """Some requests at a time, with the places of their pairs counted on."""
    numbers, held, pairs, size = [], [], 0, 0
    for number, payload in zip(batch, payloads, strict=True):
        v, w, pair, u, _ = _expanded(payload)
        numbers.append(number)
        held.append((v, w, pair + pairs, u))
        pairs += len(w)
        size += len(u)
        if size > most:
            yield numbers, held
            numbers, held, pairs, size = [], [], 0, 0
    if numbers:
        yield numbers, held


# Smoothing and scores


class _Features:
    """Counts behind each own token of a batch: with ``left_out``, of training tokens only and without themselves."""

    def __init__(self, folder: str, number: int, total: int, words: int, codes: tuple[np.ndarray, np.ndarray] | None = None, *, left_out: bool):
        token, size, lead, self.train, *self.texts = _load(f"{folder}/tokens-{number}")
        _, counts = _load(f"{folder}/words-{number}")
        codes2, codes3 = codes or _load(f"{folder}/codes-{number}")
        batch = _Batch(token, size, lead, self.train)
        at = np.flatnonzero(batch.train if left_out else batch.scored)
        less = 1 if left_out else 0
        pair, known = PAIRS.decode(codes2), counts.astype(np.float64)[batch.token]
        self.piece = batch.piece[at]
        self.word = known[at] - less
        self.base = (self.word + 0.5) / (total - less + 0.5 * (words + 1))
        self.context1 = known[at - 1] - less
        self.context2 = np.where(batch.off[at] >= 2, pair[at - 1], 0) - less
        self.pair, self.triple = pair[at] - less, TRIPLES.decode(codes3)[at] - less

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of the context (-1: never seen) and relative frequency behind it, for one word of context or two."""
        context, count = (self.context1, self.pair) if k == 1 else (self.context2, self.triple)
        seen = context >= 1
        bucket = np.where(seen, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), -1)
        return bucket, np.where(seen, np.clip(count, 0, context) / np.maximum(context, 1), 0.0)

    def smoothed(self, k: int, weights: list[np.ndarray]) -> np.ndarray:
        """Probability by the base and the first ``k`` levels of context."""
        p = self.base
        for i in range(1, k + 1):
            bucket, share = self.level(i)
            weight = np.where(bucket >= 0, weights[i - 1][np.maximum(bucket, 0)], 0.0)
            p = weight * share + (1 - weight) * p
        return p


def _histogram(features: _Features, k: int, weights: list[np.ndarray]) -> np.ndarray:
    """Training tokens by the bucket of their context and by how much likelier level ``k`` makes them than those below; bin 0: it rules them out."""
    bucket, share = features.level(k)
    at = np.flatnonzero(bucket >= 0)
    ratio = share[at] / features.smoothed(k - 1, weights)[at]
    place = np.where(ratio > 0, np.clip(np.rint(4 * np.log2(np.maximum(ratio, 1e-300))) + BINS // 2, 1, BINS - 1), 0).astype(np.int64)
    return np.bincount(bucket[at] * BINS + place, minlength=BUCKETS * BINS)


def fitted_weights(histogram: np.ndarray) -> np.ndarray:
    """The weight of each bucket that makes its tokens likeliest; a bucket without any takes that of the next lower one."""
    ratio = np.exp2((np.arange(BINS) - BINS // 2) / 4)
    ratio[0] = 0
    out, last = np.zeros(BUCKETS), 0.0
    for b, n in enumerate(histogram.reshape(BUCKETS, BINS)):
        if n.any():
            lo, hi = 0.0, 1.0
            for _ in range(40):  # the slope falls as the weight grows
                mid = (lo + hi) / 2
                if (n * (ratio - 1) / (mid * ratio + 1 - mid)).sum() > 0:
                    lo = mid
                else:
                    hi = mid
            last = min(lo, 1 - 1e-6)
        out[b] = last
    return out


_COUNTS = "batch long, cell int, n long"


def _cells(number: int, counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    at = at if len(at) else np.zeros(1, np.int64)  # a batch has a row at least
    return pa.RecordBatch.from_pydict({"batch": pa.array([number] * len(at), pa.int64()), "cell": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})


def _align(folder: str, shards: int, hot: int, total: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch's answers to a file of codes by token and to counts for the first weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, payloads in _grouped(batches, "batch", "shard"):
            token, size, lead, train, *_ = _load(f"{folder}/tokens-{number}")
            ids, counts = (x.astype(np.int64) for x in _load(f"{folder}/words-{number}"))
            got = [_unpack(p) for p in payloads if p]
            codes2, codes3 = (np.concatenate([np.zeros(0, b.dtype), *(x[i].astype(b.dtype) for x in got)]) for i, b in ((0, PAIRS), (1, TRIPLES)))
            ngrams = _Batch(token, size, lead, train).ngrams(ids, counts, shards, hot)
            codes = ngrams.at_tokens(len(token), codes2, codes3)
            del ngrams, token, ids, counts, got
            _save(f"{folder}/codes-{number}", *codes)
            yield _cells(number, _histogram(_Features(folder, number, total, words, codes, left_out=True), 1, []))

    return run


def _each_batch(run: Callable[[int], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("batch").to_pylist():
                yield run(number)

    return task


def _weights(counted: DataFrame) -> np.ndarray:
    """From (cell, n): of fixed size, BUCKETS x BINS cells."""
    histogram = np.zeros(BUCKETS * BINS, np.int64)
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        histogram[r["cell"]] = r["n"]
    return fitted_weights(histogram)


_SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(f: _Features, weights: list[np.ndarray]) -> pa.RecordBatch:
    """Sums of each piece of a batch."""
    row, has_id, ids = f.texts
    add = lambda x: np.bincount(f.piece, x, len(row))
    columns = {
        "row": row.astype(np.int64), "doc_id": pa.array(ids.astype(np.uint64).view(np.int64), mask=has_id == 0), "held_out": f.train == 0, "n_tokens": np.bincount(f.piece, minlength=len(row)), "n_known": add(f.word > 0).astype(np.int64),
        "base_score": add(np.log10(f.base)), "score": add(np.log10(f.smoothed(2, weights))),
    }
    return pa.RecordBatch.from_pydict(columns)


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; scores are log10.

    The model learns from the rows that aren't held out.  A null or empty text, or one of white space, has its end as its
    only token.  A row with a null id is trained on; repeated rows count each and get a row each.  Without any training
    row, both scores are 0.  An empty table gives no row; other columns, whatever their names, aren't read.  Texts are
    taken whole: a long one is scored in pieces, which know the words before them.
    """
    spark = docs.sparkSession
    folder = storage.new_dir(spark, "ngram-lm")
    rows = docs.select(storage.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), storage.col(text_col).cast("binary").alias("text"))
    size = storage.input_bytes(rows, "text")
    shards, parts = storage.parts_for(spark, size, sizes.shard_bytes), storage.parts_for(spark, size, sizes.batch_bytes)

    by_shard = lambda df: df.repartitionById(shards, "shard").sortWithinPartitions("shard", "batch")
    by_batch = lambda df: df.repartition(parts, "batch").sortWithinPartitions("batch", "shard")

    asked = storage.map_batches(rows, _read_texts(folder, shards, sizes), _MESSAGE)
    words = storage.materialize(storage.map_batches(by_shard(asked), _count_words(shards), f"{_MESSAGE}, n long, words long"), "ngram-words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    total, distinct = sums["n"], sums["words"]
    hot = max(1, total // (4 * shards))  # from so many occurrences on, a word's n-grams are dealt by the last word too
    asked = storage.map_batches(by_batch(words.select("batch", "shard", "payload")), _ask_ngrams(folder, shards, hot), _MESSAGE)
    found = storage.map_batches(by_shard(asked), _answer_ngrams(folder), _MESSAGE)
    # A batch whose words are all unknown asks for nothing and is still scored.
    every = words.select("batch").distinct().select("batch", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("payload"))
    counted = storage.materialize(storage.map_batches(by_batch(found.unionByName(every)), _align(folder, shards, hot, total, distinct), _COUNTS), "ngram-counts")
    weights = [_weights(counted)]
    numbers = counted.select("batch").distinct().repartition(parts, "batch")
    second = _each_batch(lambda b: _cells(b, _histogram(_Features(folder, b, total, distinct, left_out=True), 2, weights)))
    weights = [*weights, _weights(storage.map_batches(numbers, second, _COUNTS))]
    pieces = storage.map_batches(numbers, _each_batch(lambda b: _scores(_Features(folder, b, total, distinct, left_out=False), weights)), _SCORES)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = pieces.groupBy("row", "doc_id", "held_out").agg(*sums)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
