"""The Elias-Fano sequences, the trie and the language model against plain dictionaries."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import ngram_lm
from sigspark.llm.elias_fano import EliasFano
from sigspark.llm.ngram_trie import PAIRS, TRIPLES, NgramTrie

SCHEMA = "doc_id long, text string"
SMALL = ngram_lm.Sizes(batch_bytes=3000, batch_tokens=400, shard_bytes=6000)


@pytest.mark.parametrize("top", [1, 7, 1000, 1 << 40])
@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n + top)
    values = np.sort(rng.integers(0, top, n).astype(np.uint64))
    held = EliasFano.of(values)
    assert (held.decode() == values).all()
    at = rng.integers(0, n, 300) if n else np.zeros(0, np.int64)
    assert (held.access(at) == values[at]).all()
    asked = np.r_[rng.integers(0, top + 5, 300).astype(np.uint64), values[:50], np.array([0, top * 2], np.uint64)]
    assert (held.locate(asked) == np.searchsorted(values, asked)).all()


def test_elias_fano_of_clustered_values_is_small():
    values = np.cumsum(np.random.default_rng(3).integers(0, 200, 100_000)).astype(np.uint64)
    held = EliasFano.of(values)
    assert (held.decode() == values).all()
    assert (held.low.nbytes + held.high.nbytes) * 8 / len(values) < 9
    with pytest.raises(ValueError, match="ascend"):
        EliasFano.of(values[::-1])


def test_codes():
    counts = np.r_[np.arange(3000), 10**5, 10**9, 2**39]
    for book, error in ((PAIRS, 0.001), (TRIPLES, 0.1)):
        back = book.decode(book.encode(counts))
        assert (back[: book.exact + 1] == np.arange(book.exact + 1)).all()
        assert (np.abs(back - counts) <= error * counts).all()


@pytest.mark.parametrize("n", [0, 1, 400, 3000])
def test_trie_finds_what_a_dictionary_finds(tmp_path, n):
    rng = np.random.default_rng(n)
    v, w, u = (1 + rng.zipf(1.5, n) % 50 for _ in range(3))
    u = np.where(rng.random(n) < 0.1, 0, u)
    counts = rng.integers(1, 5, n)
    pairs, triples = collections.Counter(), collections.Counter()
    for a, b, c, k in zip(v.tolist(), w.tolist(), u.tolist(), counts.tolist(), strict=True):
        pairs[a, b] += k
        triples[a, b, c] += k
    NgramTrie.of(v, w, u, counts).write(f"{tmp_path}/trie")
    for size in (0, 3, 2000):  # few are searched in the sequences as they are
        qv, qw, qu = rng.integers(1, 60, size), rng.integers(1, 60, size), rng.integers(0, 60, size)
        codes2, codes3 = NgramTrie.open(f"{tmp_path}/trie").find(qv, qw, np.arange(size), qu)
        assert PAIRS.decode(codes2).tolist() == [pairs[x] for x in zip(qv.tolist(), qw.tolist(), strict=True)]
        assert TRIPLES.decode(codes3).tolist() == [triples[x] if x[2] else 0 for x in zip(qv.tolist(), qw.tolist(), qu.tolist(), strict=True)]


def test_words_of_any_length_hash_alike():
    one = ("Long" * 40_000 + " a B  b " + "x" * 70_000).encode()
    hashes, start = ngram_lm.word_hashes(np.frombuffer(one, np.uint8))
    again, _ = ngram_lm.word_hashes(np.frombuffer(b"b\tA " + b"x" * 70_000 + b"\n" + b"lONG" * 40_000, np.uint8))
    assert len(set(hashes.tolist())) == 4 and set(hashes.tolist()) == set(again.tolist())
    assert start.tolist()[:2] == [0, 160_001]
    assert len(ngram_lm.word_hashes(np.zeros(0, np.uint8))[0]) == 0


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _brute(rows):
    """The whole model by dictionaries; weights by the operator's fit of histograms that are counted here."""
    one, two, three, total = collections.Counter(), collections.Counter(), collections.Counter(), 0
    texts = [["<e>", *_words(t), "<e>"] for _, t in rows]
    for (i, _), x in zip(rows, texts, strict=True):
        if not _is_held_out(i):
            for k in range(1, len(x)):
                one[x[k]] += 1
                two[x[k - 1], x[k]] += 1
                three[tuple(x[k - 2 : k + 1]) if k > 1 else None] += 1
                total += 1
    distinct = len(one)

    def levels(x, k, less):
        base = (one[x[k]] - less + 0.5) / (total - less + 0.5 * (distinct + 1))
        found = [(one[x[k - 1]] - less, two[x[k - 1], x[k]] - less)]
        if k > 1:
            found.append((two[x[k - 2], x[k - 1]] - less, three[x[k - 2], x[k - 1], x[k]] - less))
        return base, [(int(math.log2(c)), n / c) if c >= 1 else None for c, n in found]

    weights = []
    for level in (0, 1):
        histogram = np.zeros(ngram_lm.BUCKETS * ngram_lm.BINS, np.int64)
        for (i, _), x in zip(rows, texts, strict=True):
            for k in range(1, len(x)) if not _is_held_out(i) else ():
                p, found = levels(x, k, 1)
                if level and found[0]:
                    p = weights[0][found[0][0]] * found[0][1] + (1 - weights[0][found[0][0]]) * p
                if len(found) > level and found[level]:
                    bucket, share = found[level]
                    place = 0 if share <= 0 else max(1, min(ngram_lm.BINS - 1, round(4 * math.log2(share / p)) + ngram_lm.BINS // 2))
                    histogram[bucket * ngram_lm.BINS + place] += 1
        weights.append(ngram_lm.fitted_weights(histogram))
    out = []
    for (i, _), x in zip(rows, texts, strict=True):
        base = score = 0.0
        for k in range(1, len(x)):
            p, found = levels(x, k, 0)
            base += math.log10(p)
            for level, at in enumerate(found):
                if at:
                    p = weights[level][at[0]] * at[1] + (1 - weights[level][at[0]]) * p
            score += math.log10(p)
        out.append((i, _is_held_out(i), len(x) - 1, sum(w in one for w in x[1:]), total, base, score))
    return out


def _texts():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 80), p=np.arange(120, 0, -1) / 7260).tolist()) for _ in range(60)]
    texts += texts[:9] + [None, "", " \n", "Only Held", "ünïcode Ünïcode", "the same " * 700, "x" * 100_000 + " w1 " + "x" * 100_000]
    return [*((i, t) for i, t in enumerate(texts)), (None, "w1 w2 w3"), (None, None), (3, texts[3]), (3, "other")]


@pytest.mark.parametrize("sizes", [SMALL, ngram_lm.Sizes()])
def test_scores_equal_brute_force(spark, sizes):
    rows = _texts()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("batch", F.lit(1)).withColumn("a.b", F.lit(2))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted((tuple(r) for r in ngram_lm.score_texts(docs, sizes=sizes).collect()), key=key)
    for mine, his in zip(got, sorted(_brute(rows), key=key), strict=True):
        assert mine[:5] == his[:5]
        assert mine[5:] == pytest.approx(his[5:], rel=2e-3 if mine[2] > 1000 else 1e-6)  # a count over 100 is stored within 9 %


def test_without_training_rows_or_any(spark):
    held = [i for i in range(40) if _is_held_out(i)]
    rows = ngram_lm.score_texts(spark.createDataFrame([(i, "a b") for i in held], SCHEMA)).collect()
    assert [tuple(r)[1:] for r in rows] == [(True, 3, 0, 0, 0.0, 0.0)] * len(held)
    assert ngram_lm.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_weights_are_where_the_likelihood_peaks():
    histogram = np.zeros((ngram_lm.BUCKETS, ngram_lm.BINS), np.int64)
    histogram[3, 0], histogram[3, ngram_lm.BINS // 2 + 8] = 60, 40  # ruled out by the level, or four times likelier
    weights = ngram_lm.fitted_weights(histogram.ravel())
    grid = np.linspace(0, 0.99, 1000)
    assert weights[3] == pytest.approx(grid[np.argmax(60 * np.log(1 - grid) + 40 * np.log(1 + 3 * grid))], abs=2e-3)
    assert weights[2] == 0 and weights[9] == weights[3]


def test_model_beats_base_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sums = ngram_lm.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > 0.95 * sums[1]
