"""Filter audit and fill-in-middle against brute force, on hard texts."""

from __future__ import annotations

import hashlib
import itertools
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sigspark.llm import fill_middle, filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000 + "ümlaut x\ny " + "Z" * 70_000
TEXTS = [None, "", " ", "\t \n", "one", " one", "one ", "a b  c\n\nd ", "x\x01y \x02 \x020\x021 z\x01", "\x01", "<P>", "a <S b> <M", "é è ​", LONG, "$1 \\1 $ \\", "one"]


def _docs(spark, texts, source="s"):
    rows = [(i, t, "en", source, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def _middle(doc_id, text, percent=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("percent", "spm"), [(50, 80), (100, 100), (100, 0)])
def test_fill_in_middle_equals_brute_force(spark, percent, spm):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS * 8)] + [(None, "null id here", None, None, None), (3, "again", None, None, None), (3, "again", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("output", F.lit("mine")).withColumn("a.b", F.lit(1))
    made = fill_middle.fill_in_middle(docs, fim_percent=percent, spm_percent=spm)
    made = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    got = sorted((tuple(r) for r in made.collect()), key=key)
    assert got == sorted(((i, *_middle(i, t, percent, spm), t or "") for i, t, *_ in rows), key=key)


def test_fill_in_middle_of_an_empty_table(spark):
    assert fill_middle.fill_in_middle(_docs(spark, [])).count() == 0


def _brute_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails, found = [], {}
    for i, t, _, source, _ in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), text in least and (i is None or i > least[text])]
        mine = [x for x in labels if x[0] == i and i is not None]
        fails.append((source or "", f, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    for part in {x[0] for x in fails}:
        mine, removed_by = [x for x in fails if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order):
                k = "ABCDE".index(name)
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                removed_by[name] += len(gone)
                found[part, "".join(order), step + 1] = [len(left), len(gone), sum(x[1][k] for x in mine) - len(gone), sum(x[1] == [j == k for j in range(5)] for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def test_filter_audit_equals_brute_force(spark):
    good = " ".join(f"word{i}" for i in range(250))
    texts = [None, "", "", good, good, good + " $", good + " X" * 300, "SHOUT" * 3, "a " * 300, "a " * 300 + "#", good, LONG, LONG, good + " |"]
    rows = [(i, t, "en", ("src0", "src1", None, "")[i % 4], 0) for i, t in enumerate(texts)] + [(None, good, None, "src0", None), (None, "lonely", None, "src1", None), (None, "lonely", None, "src1", None), (3, good, None, "src1", None)]
    labels = [(0, 1, 0), (3, 1, 1), (4, 0, 1), (4, 1, 0), (6, None, 1), (9, 1, None), (99, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("mask", F.lit(1)).withColumn("part", F.lit("x"))
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 3 * 600
    assert got == _brute_audit(rows, labels)


def test_filter_audit_of_an_empty_table(spark):
    assert filter_audit.audit_filters(_docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_removal_polynomial_between_corners():
    counts = [3, 1, 4, 1, 5, 9, 2, 6]  # three filters
    a = filter_audit.polynomial(counts)
    for x in itertools.product((Fraction(0), Fraction(1, 3), Fraction(1)), repeat=3):
        value = sum(c * _product(x, t) for t, c in enumerate(a))
        direct = sum(n * (1 - _product([1 - y for y in x], m)) for m, n in enumerate(counts))
        assert value == direct
    assert sum(filter_audit.shapley(a, i) for i in range(3)) == filter_audit.corners(a)[-1] == sum(counts[1:])


def _product(x, bits):
    out = Fraction(1)
    for i, y in enumerate(x):
        if bits >> i & 1:
            out *= y
    return out
