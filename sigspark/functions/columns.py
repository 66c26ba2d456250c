"""Array and scalar expressions on columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift(a: Column, k: int) -> Column:
    """An array moved right by k places (left for a negative k), zeros coming in."""
    n = F.size(a)
    zeros = F.array_repeat(F.lit(0.0), F.least(F.lit(abs(k)), n))
    if k >= 0:
        return F.concat(zeros, F.slice(a, 1, F.greatest(n - k, F.lit(0))))
    return F.concat(F.slice(a, F.least(F.lit(-k), n) + 1, n), zeros)


def shift_triple(a: Column, k: int) -> tuple[Column, Column, Column]:
    """The array moved left, as it is, and moved right by k."""
    return shift(a, -k), a, shift(a, k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def norm_inf(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))


def axpy(k: float | Column, a: Column, b: Column) -> Column:
    """k a + b."""
    return F.zip_with(a, b, lambda x, y: F.lit(k) * x + y)


def residual(a: Column, b: Column) -> Column:
    return axpy(-1.0, b, a)


def centroid(a: Column) -> Column:
    """The mean 1-based place weighted by value."""
    weighted = F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return weighted / F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def argmax(a: Column) -> Column:
    """The 0-based place of the greatest value; the first of equals."""
    return F.array_position(a, F.array_max(a)) - 1


def argmin(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


PEAK_MODES = ("peak", "max", "min", "centroid", "biphasic")


def peak_place(w: Column, mode: str = "peak") -> Column:
    """The 1-based place of a waveform's peak; the first of equals, and halves go up.

    Modes: peak (greatest magnitude), max (greatest), min (least), centroid (of magnitudes), biphasic (midway between least
    and greatest).  A waveform of several channels comes as its sums over channels (peak, max, min) or its extremes (the
    modes max1 and min1 of such sums are max and min here).
    """
    magnitude = F.transform(w, F.abs)
    if mode == "centroid":
        return F.round(centroid(magnitude)).cast("int")
    if mode == "biphasic":
        return F.floor((argmax(w) + argmin(w)) / 2 + 1.5).cast("int")
    return ({"peak": argmax(magnitude), "max": argmax(w), "min": argmin(w)}[mode] + 1).cast("int")


def align_peak(w: Column, length: int, mode: str = "peak") -> Column:
    """A waveform cut or filled to an odd length with its peak (``peak_place``) in the middle; a waveform of zeros stays one."""
    if length % 2 == 0:
        raise ValueError("length must be odd")
    half = length // 2
    padded = F.concat(F.array_repeat(F.lit(0.0), half), w, F.array_repeat(F.lit(0.0), half))
    return F.slice(padded, F.coalesce(peak_place(w, mode), F.lit(1)), length)


def snip_ends(w: Column, share: float) -> Column:
    """How many samples fall off both ends alike while none of them is over ``share`` of the greatest magnitude."""
    magnitude = F.transform(w, F.abs)
    big = F.filter(F.transform(magnitude, lambda x, i: F.when(x > share * F.array_max(magnitude), i)), lambda i: i.isNotNull())
    return F.least(F.array_min(big), F.size(w) - 1 - F.array_max(big))


def resized(w: Column, cut: Column, buffer: int) -> Column:
    """``w`` without ``cut`` samples at both ends, with ``buffer`` zeros there, and one more behind if its length is even."""
    zeros = F.array_repeat(F.lit(0.0), buffer)
    middle = F.concat(zeros, F.slice(w, cut + 1, F.size(w) - 2 * cut), zeros)
    return F.when(F.size(middle) % 2 == 0, F.concat(middle, F.array(F.lit(0.0)))).otherwise(middle)


def uniform_grid(lengths: Sequence[Column], spacings: Sequence[Column]) -> Column:
    """Points from -floor(length / 2) to floor(length / 2) in steps of a spacing, as arrays of one number or two each.

    One length and one spacing give a line of points; two of each a plane, whose first coordinate goes slowest.
    """
    if len(lengths) != len(spacings) or len(lengths) not in (1, 2):
        raise ValueError("a grid has one dimension or two")
    lines = []
    for length, spacing in zip(lengths, spacings, strict=True):
        half = F.floor(length / 2).cast("long")
        lines.append(F.sequence(-half, half, spacing.cast("long")))
    if len(lines) == 1:
        return F.transform(lines[0], lambda x: F.array(x))
    return F.flatten(F.transform(lines[0], lambda x: F.transform(lines[1], lambda y: F.array(x, y))))


def ragged_lengths(cells: Column) -> Column:
    return F.transform(cells, F.size)


def flat(cells: Column) -> Column:
    """A ragged array of arrays as one array."""
    return F.flatten(cells)


def ragged(values: Column, lengths: Column) -> Column:
    """One array cut into runs of the given lengths; the inverse of ``flat``."""
    starts = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda s, x: s + x))
    return F.transform(F.arrays_zip(starts.alias("a"), lengths.alias("n")), lambda x: F.slice(values, x["a"] + 1, x["n"]))


def matrix_rows(values: Column, rows: int, cols: int) -> Column:
    """A column-major vector as rows of a matrix."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.element_at(values, c * rows + r + 1)))


def has_nan(a: Column) -> Column:
    return F.exists(a, F.isnan)


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """The 0-based bin of evenly spaced centres from low to high; the outer bins are open."""
    width = (high - low) / (bins - 1)
    return F.least(F.greatest(F.floor((x - low) / width + 0.5), F.lit(0)), F.lit(bins - 1)).cast("int")


def rice_bins(n: Column) -> Column:
    """Bins for n values: 2 n^(1/3), at most 100."""
    return F.least(F.lit(100), F.ceil(F.round(2 * F.pow(n, F.lit(1 / 3)), 6))).cast("int")


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(2 * F.pi())


def lattice_index(t: Column, low: float, step: float) -> Column:
    """The index of the nearest point of a grid; halves go away from zero."""
    return F.round((t - low) / step).cast("int")


def rate_penalty(p: Column | float) -> Column:
    """The penalty that fits a firing rate best, 1/p, at most 1e6."""
    return F.least(F.lit(1e6), 1 / F.lit(p))
