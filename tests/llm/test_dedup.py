"""Near-duplicates and substring dedup against brute force, and their cases of nulls, ties and clashing names."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from sigspark.llm import near_dup, queries, rolling, substring_dedup
from sigspark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def brute_cut(docs, length=50):
    """(n_bytes, n_removed, n_spans, sha256 of the bytes kept) of each document."""
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_near_dup_query_is_brute_force(spark, sf_dir):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op10_minhash_near_dup(spark, sf_dir).collect()}
    assert got == brute_components(documents(spark, sf_dir))


def made_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))] for _ in range(n // 8)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    return out


def test_near_dup_links_around_the_threshold(spark, monkeypatch):
    docs = made_texts(7, 240)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute_components(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()}
    assert got == expected
    monkeypatch.setattr(near_dup, "SLICE_COST", 3_000)  # many slices and blocks in a group, as for very large ones
    monkeypatch.setattr(near_dup, "BLOCK_COST", 4_000)
    for pivots in (1, 8):
        monkeypatch.setattr(near_dup, "PIVOTS", pivots)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()}
        assert got == expected


def test_copies_that_link_through_one_text_alone(spark, monkeypatch):
    """Copies of one text with edits of their own: each links with it (or with nothing), but not with each other."""
    monkeypatch.setattr(near_dup, "SLICE_COST", 5_000)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    docs = [(50, " ".join(words))]
    for i in range(1, 50):
        copy = words.copy()
        for k in range(3 if i % 5 else 4):
            copy[rng.randrange(40 * k, 40 * k + 36)] = f"own{i}x{k}"
        docs.append((i, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs) and len({c for _, c, _ in got.values()}) < 25


def test_near_dup_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b c", "x"), (4, "A  b\tC", "y"), (5, " \n", "x"), (None, "a b c", "x"), (7, "a b c", "x"), (7, "a b c", "x"), (9, "é " * 5000, "z"), (8, "é " * 5001, "z")]
    df = spark.createDataFrame([(i, t, k, k, k, k) for i, t, k in rows], "doc_id long, text string, n_shingles string, kept string, component_id string, h1 string")
    got = [tuple(r) for r in near_dup.near_duplicates(df).collect()]
    expected = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (7, 1, 3, False), (7, 1, 3, False), (8, 1, 8, True), (9, 1, 8, False)]
    assert sorted(g for g in got if g[0] is not None) == expected
    assert [g for g in got if g[0] is None] == [(None, 1, None, True)]
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def test_repeated_id_ties_its_texts(spark):
    df = spark.createDataFrame([(5, "one two three four five six"), (5, "red green blue pink grey cyan"), (9, "red green blue pink grey cyan")], "doc_id long, text string")
    assert {r["component_id"] for r in near_dup.near_duplicates(df).collect()} == {5}


def test_minhash_shingles_are_counted_exactly():
    text = "The quick\tbrown fox JUMPS over the  lazy dog"
    assert len(rolling.shingles(text, 5)) == len(shingle_set(text)) == 5
    assert (rolling.shingles("A B", 5) == rolling.shingles("a\n b ", 5)).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 300)] + [(7, 7), (9, 8), (None, 3)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, 8: 8, 9: 8}


def test_substring_query_is_brute_force(spark, sf_dir):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op4_suffix_array_dedup(spark, sf_dir).collect()}
    assert got == brute_cut(documents(spark, sf_dir))


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_on_repetitive_text(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab") for _ in range(rng.choice([20, 49, 50, 51, 90]))) for _ in range(8)] + ["a" * 120, "ab" * 70, "é" * 40]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.cut_repeats(df).collect()}
    assert got == brute_cut(docs)


def test_a_passage_repeated_in_its_document_is_cut_everywhere(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = []
    for i in range(0, 60, 3):
        x, foo, bar = word(rng.randrange(50, 140)), word(60), word(60)
        docs += [(i, x), (i + 1, f"{foo} {x} {bar} {foo} {x} {bar}"), (i + 1, f"{word(30)} {foo} {x} {bar}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.cut_repeats(df).collect())
    expected = []
    for i, t in docs:  # rows of an id don't cut each other, so each is held against the rows of other ids
        n, removed, _, sha = brute_cut([d for d in docs if d[0] != i] + [(i, t)])[i]
        expected.append((i, n, removed, sha))
    assert got == sorted(expected)


def test_substring_edge_cases(spark):
    passage = "".join(chr(97 + (i * i) % 26) for i in range(80))
    rows = [(1, None), (2, ""), (3, passage), (3, passage), (4, passage + " end"), (None, passage), (6, "short")]
    df = spark.createDataFrame([(i, t, "k", "s", 1) for i, t in rows], "doc_id long, text string, kept string, dest string, n_bytes int")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substring_dedup.cut_repeats(df).collect()]
    # Rows of one id don't cut each other; a null id is the greatest.
    assert sorted(got, key=str) == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (3, 80, 0, 0), (3, 80, 0, 0), (4, 84, 80, 1), (None, 80, 80, 1), (6, 5, 0, 0)], key=str)
    assert substring_dedup.cut_repeats(df.limit(0)).collect() == []


def test_a_cut_through_a_character_loses_it(spark):
    passage = "".join(chr(97 + (i * i) % 26) for i in range(60)) + "\u00e9"
    df = spark.createDataFrame([(1, passage), (2, passage[:-1] + "\u00e8 end"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.cut_repeats(df, as_text=True).collect()}
    # The two last letters share their first byte, which is part of the repeat.
    assert got == {1: (0, passage), 2: (61, " end"), 3: (0, None), 4: (0, "")}


def test_phrases_follow_content_alone():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 400).astype(np.uint8)
    a, b = np.concatenate([rng.integers(97, 123, 90).astype(np.uint8), passage]), np.concatenate([rng.integers(97, 123, 333).astype(np.uint8), passage])
    first, second = (set(substring_dedup.phrases(x, np.array([len(x)]))[1].tolist()) for x in (a, b))
    assert len(first & second) > 5


def test_suffix_ranks_are_the_order_of_the_bytes():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(97, 99, 600), np.full(200, 97), rng.integers(0, 256, 300), np.full(80, 0), rng.integers(97, 99, 600)]).astype(np.uint8)
    data = np.concatenate([data, data[100:900]])
    start = np.arange(len(data) - 49)
    strings = [data[i : i + 50].tobytes() for i in start]
    places = {s: i for i, s in reversed(list(enumerate(sorted(strings))))}
    assert substring_dedup.suffix_ranks(data, start).tolist() == [places[s] for s in strings]


def test_repeats_of_a_task_are_held_against_bytes(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [rng.integers(97, 123, 300).astype(np.uint8).tobytes() for _ in range(2)]
    texts.append(texts[0])
    of, at, span = np.array([0, 0, 1, 2, 2]), np.array([0, 10, 0, 0, 10]), np.full(5, 9, np.uint8)
    assert substring_dedup._same_bytes(texts, of, at, span, np.array([3, 4, 2]), np.array([0, 1, 0]), 50).tolist() == [True, True, False]
