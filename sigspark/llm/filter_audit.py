"""How filters of documents interact, from one count of failure masks by the multilinear extension.

Each document fails a set of filters, its mask.  For one part of the corpus, the number of documents that a set S of
filters removes is v(S); its multilinear extension, the removal polynomial, has one variable for each filter and the
monomials' coefficients are sums of mask counts with alternating signs.  At a corner of the cube the polynomial gives
v(S), so every prefix of every order of the filters has its survivors.  A filter's Shapley value is the integral of its
partial derivative along the diagonal, a rational; times the number of orders it is a whole number.

Documents are counted by mask before anything gathers, so a part of any size is one row of 32 counts.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm import storage

FILTERS = "ABCDE"
MIN_WORDS = 200
WORD = r"[^\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
KINDS = ("docs", "good", "toxic")  # what is counted by mask


def conditions(text: Column) -> list[Column]:
    """Filters A to D of a text that isn't null: whether it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    few_distinct = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    return [F.size(words) < MIN_WORDS, few_distinct, 100 * capitals > 2 * F.char_length(text), text.rlike(MARKS)]


def failure_masks(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) of each row; bit k of the mask is filter k of ``FILTERS``.

    E, a text that some smaller id has too, comes from the least id of each repeated text.  The join on digests is one
    that Spark splits where a text has very many copies.
    """
    rows = docs.select(storage.col(id_col).alias("doc_id"), F.coalesce(storage.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(storage.col(text_col), F.lit("")).alias("text"))
    mask = sum(F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions(F.col("text"))))
    flagged = rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    known = storage.materialize(flagged, "filter-masks")  # texts are read once
    # A null id is smaller than none and greater than all.  Written, so that the join shuffles both sides and can split.
    least = known.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1 and least is not null").drop("copies")
    seen = known.join(storage.materialize(least, "filter-copies").hint("merge"), "digest", "left")
    later = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return seen.select("doc_id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, docs, good, toxic): for each part three arrays of counts by mask."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    seen = masks.join(known.hint("merge"), "doc_id", "left")
    one = lambda c, m: F.sum(F.when(F.col("mask") == m, c).otherwise(0)).cast("long")
    counts = seen.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return counts.groupBy("part").agg(*(F.array(*(one(F.col(c), m) for m in range(1 << len(FILTERS)))).alias(c) for c in KINDS))


def polynomial(counts: Sequence[int]) -> list[int]:
    """Coefficients by monomial (a set of variables as bits) of the removal polynomial of counts by mask.

    A document of mask m is removed with 1 - prod(1 - x_i, i in m); multiplied out, each monomial inside m has a sign.
    """
    out = [0] * len(counts)
    for t in range(1, len(counts)):
        out[t] = (-1) ** (t.bit_count() + 1) * sum(n for m, n in enumerate(counts) if m & t == t)
    return out


def derivative(coefficients: Sequence[int], i: int) -> list[int]:
    """The partial derivative in variable i, by its power on the diagonal where all variables are equal."""
    out = [0] * len(coefficients).bit_length()
    for t, a in enumerate(coefficients):
        if t >> i & 1:
            out[t.bit_count() - 1] += a
    return out


def shapley(coefficients: Sequence[int], i: int) -> Fraction:
    """Variable i's Shapley value: the integral of its derivative along the diagonal from 0 to 1."""
    return sum((Fraction(a, power + 1) for power, a in enumerate(derivative(coefficients, i))), Fraction())


def corners(coefficients: Sequence[int]) -> list[int]:
    """The polynomial at each corner of the cube: what that set of filters removes."""
    return [sum(a for t, a in enumerate(coefficients) if t & s == t) for s in range(len(coefficients))]


@functools.cache
def _steps() -> tuple[list[str], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of each order's steps in turn: the order, the step, its filter's index, and the sets before and after it."""
    names, steps, which, before, after = [], [], [], [], []
    for order in itertools.permutations(range(len(FILTERS))):
        name, seen = "".join(FILTERS[i] for i in order), 0
        for k, i in enumerate(order):
            names.append(name)
            steps.append(k + 1)
            which.append(i)
            before.append(seen)
            seen |= 1 << i
            after.append(seen)
    return names, steps, np.array(which), np.array(before), np.array(after)


def _part_rows(part: str, counts: dict[str, list[int]]) -> pa.RecordBatch:
    names, steps, which, before, after = _steps()
    n, orders = len(FILTERS), math.factorial(len(FILTERS))
    removal = polynomial(counts["docs"])
    at = {c: np.array(corners(polynomial(counts[c])), np.int64) for c in KINDS}
    whole = (1 << n) - 1
    docs = at["docs"]
    fails = docs[1 << np.arange(n)]
    only = docs[whole] - docs[whole ^ (1 << np.arange(n))]
    values = [shapley(removal, i) * orders for i in range(n)]
    if any(v.denominator != 1 for v in values):
        raise ArithmeticError("a scaled Shapley value must be whole")
    removed = docs[after] - docs[before]
    columns = {
        "part": [part] * len(names), "filter_order": names, "step": pa.array(steps, pa.int32()), "kept": sum(counts["docs"]) - docs[after], "removed": removed, "redundant": fails[which] - removed, "unique_fails": only[which],
        "good_lost": at["good"][after] - at["good"][before], "toxic_lost": at["toxic"][after] - at["toxic"][before], "shapley": np.array([v.numerator for v in values], np.int64)[which],
    }
    return pa.RecordBatch.from_pydict(columns)


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_filters(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """One row for each part, each order of the five filters and each step of it; see ``SCHEMA``.

    A null text counts as empty, a null part as ``''``; null ids fail E if any id has their text, and don't make others
    fail it.  Rows that repeat an id and its text count each, and neither is the smaller.  A document with several label
    rows is good, or toxic, if one of them says so.  An empty table has no part and gives no row; other columns aren't
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _part_rows(row["part"], row)

    return storage.map_batches(mask_counts(failure_masks(docs, text_col=text_col, id_col=id_col, part_col=part_col), labels), run, SCHEMA)
