"""Language identification: scripts narrow the candidates, and Viterbi labels spans of mixed-language text.

The model holds, for each language, smoothed log shares of hashed letter trigrams (with word borders), and the
scripts that the language is written in.  A word's script (that of its first letter) narrows its candidates to the
languages written in it; in a script that no language is written in, all are.  Only languages that some word of a text has
for a candidate are scored, by the sum of the word's trigrams, and the best path over the words, with a penalty for each
change of language, gives the text's spans.  The text's language is that of most of its letters.

Where no language but the best one ever gains half a penalty on it over any run of words, no change can pay, so the
best path is that one language; this test is a prefix sum, and only other texts need the word-by-word recursion.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sigspark.llm import storage

UNKNOWN = "und"
BUCKETS = 1 << 14
SWITCH = 12.0
SCRIPT_SHARE = 1e-3
OUTSIDE = -1e6  # of a language that is no candidate of a word: less than any path that avoids it
_HASHES = 1 << 63
TRAIN_CHARS = 4_000_000  # characters of text of each language, at most about so many, that a model is fitted on

# First code points of the blocks that tell scripts apart, in order; each reaches to the next.
SCRIPTS = [(0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x323B0, "Other")]
NAMES = sorted({name for _, name in SCRIPTS})


@functools.lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, and its script's number."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    starts = np.array([s for s, _ in SCRIPTS])
    number = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)
    return letter, number[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]


def letters(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's letters: their trigrams' buckets, the first letter of each word, and that letter's script."""
    letter, script = _code_points()
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = np.concatenate([[False], letter[code], [False]])
    c = np.zeros(len(code) + 2, np.uint32)
    c[1:-1] = code
    c *= is_letter
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(is_letter[1:-1])
    opens = ~is_letter[:-2][at]
    first = np.flatnonzero(opens)
    return (h[at] >> np.uint32(32 - 14)).astype(np.int64), first, script[code[at[first]]]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages, log shares less their mean over languages
    written: np.ndarray  # scripts x languages
    switch: float = SWITCH

    def word_scores(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each word for each candidate language of the text, these languages, and the letters of each word."""
        bucket, first, script = letters(text)
        if not len(first) or not self.languages:
            return np.empty((0, 0), np.float32), np.empty(0, np.int64), np.empty(0, np.int64)
        n = np.diff(np.r_[first, len(bucket)])
        open_to = self.written[script]
        among = np.flatnonzero(open_to.any(axis=0))
        score = np.add.reduceat(self.scores[bucket] if len(among) == len(self.languages) else self.scores[bucket][:, among], first, axis=0)
        if not open_to[:, among].all():
            score = np.where(open_to[:, among], score, np.float32(OUTSIDE))
        return score, among, n

    def path(self, score: np.ndarray) -> np.ndarray:
        """The language of each word on the best path."""
        total = score.sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        gain = np.cumsum(score - score[:, best : best + 1], axis=0, dtype=np.float64)
        low = np.minimum.accumulate(np.vstack([np.zeros(score.shape[1]), gain]), axis=0)[:-1]
        if ((gain - low).max(axis=0) <= self.switch / 2).all():
            return np.full(len(score), best)
        return _viterbi(score, self.switch)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most letters and their share; ``und`` and 0 where there is no letter."""
        score, among, n = self.word_scores(text)
        if not len(n):
            return UNKNOWN, 0.0
        share = np.bincount(self.path(score), weights=n, minlength=len(among))
        best = int(share.argmax())
        return self.languages[among[best]], float(share[best] / share.sum())

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Runs of words of one language: language, first word, end word."""
        score, among, n = self.word_scores(text)
        if not len(n):
            return []
        path = among[self.path(score)]
        at = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        return [(self.languages[path[a]], int(a), int(b)) for a, b in zip(at, np.r_[at[1:], len(path)], strict=True)]


def _viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    """The recursion itself; ties keep the language, and then take the first."""
    rows = score.tolist()
    value = rows[0]
    back: list[list[int] | None] = [None]
    k = range(len(value))
    for row in rows[1:]:
        top = max(value)
        lead, bar = value.index(top), top - switch
        if min(value) >= bar:
            back.append(None)
            value = [v + s for v, s in zip(value, row, strict=True)]
        else:
            back.append([i if value[i] >= bar else lead for i in k])
            value = [(v if v >= bar else bar) + s for v, s in zip(value, row, strict=True)]
    now = value.index(max(value))
    out = np.empty(len(rows), np.int64)
    for t in range(len(rows) - 1, -1, -1):
        out[t] = now
        now = now if back[t] is None else back[t][now]
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = TRAIN_CHARS, switch: float = SWITCH) -> Model:
    """Fit a model on labelled rows: all of them, or where a language has over ``chars`` characters, a sample of about that.

    The sample takes whole texts by a hash of their id.  Rows without a label, text or id don't count; no rows at all
    give a model of no language.  What comes to the driver is a count for each language and bucket.
    """
    rows = docs.select(storage.col(id_col).alias("doc_id"), storage.col(text_col).alias("text"), storage.col(lang_col).alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.ones((len(NAMES), 0), bool), switch)
    languages = sorted(sizes)
    # A text is in the sample if its hash, of 63 bits, is below its language's share of them: alike at every size.
    bar = F.lit(0).cast("long")
    for name in languages:
        bar = F.when(F.col("lang") == name, F.lit(min(_HASHES - 1, _HASHES * chars // max(1, sizes[name]))).cast("long")).otherwise(bar)
    sample = rows.where(F.xxhash64("doc_id").bitwiseAND(F.lit(_HASHES - 1)) <= bar)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                bucket, first, script = letters(text.as_py())
                got = seen.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                got[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                got[BUCKETS:] += np.bincount(script, minlength=len(NAMES))
        for lang, got in seen.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "slot": pa.array(at, pa.int32()), "n": pa.array(got[at], pa.int64())})

    counts = np.zeros((len(languages), BUCKETS + len(NAMES)), np.float64)
    index = {name: i for i, name in enumerate(languages)}
    summed = storage.map_batches(sample.select("lang", "text"), count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    for row in summed.toLocalIterator():
        counts[index[row["lang"]], row["slot"]] = row["n"]
    grams, words = counts[:, :BUCKETS], counts[:, BUCKETS:]
    score = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    written = words >= SCRIPT_SHARE * np.maximum(1, words.sum(axis=1, keepdims=True))
    written[:, ~written.any(axis=0)] = True
    return Model(languages, np.ascontiguousarray((score - score.mean(axis=0)).T, np.float32), np.ascontiguousarray(written.T), switch)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language and its share of the letters added, in place of columns of those names.

    A null text, or one without a letter, is ``und`` with score 0; repeated rows stay; an empty table gives no row.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in (pred_col.lower(), score_col.lower())]
    schema = StructType([*kept, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*(f.name for f in kept), pred_col, score_col])

    return storage.map_batches(docs.select(*(storage.col(f.name) for f in kept)), run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
