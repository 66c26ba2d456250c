"""Ordered work on a long series without ordering it in one task.

A frame that reaches ``left`` rows back and ``right`` rows on needs only those neighbours, so a series is cut into
blocks by its sample index and each block gets copies of the samples at its borders.  The index is contiguous, so
rows and index steps are the same thing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sigspark.operators.tables import kept

BLOCK = 1 << 18


def with_halo(df: DataFrame, left: int, right: int, *, t: str = "t", block: int = BLOCK) -> DataFrame:
    """``df`` with _block and _core; samples within reach of another block's border are repeated there with _core false."""
    block = max(block, left, right, 1)
    own = F.floor(F.col(t) / block)
    at = F.pmod(F.col(t), F.lit(block))
    near = F.array(
        F.when(at < right, own - 1),  # it comes after the block before
        own,
        F.when(at >= block - left, own + 1),
    )
    return df.withColumn("_block", F.explode(F.array_compact(near))).withColumn("_core", F.col("_block") == own)


def framed(keys: Sequence[str], left: int, right: int, *, t: str = "t") -> WindowSpec:
    """A frame of ``left`` rows back to ``right`` rows on, inside a block."""
    return Window.partitionBy(*keys, "_block").orderBy(t).rowsBetween(-left, right)


def in_blocks(df: DataFrame, columns: dict[str, Column], left: int, right: int, *, keys: Sequence[str] = ("rec_id", "channel"), t: str = "t", block: int = BLOCK) -> DataFrame:
    """Add window columns over rows [-left, right] (given as functions of a frame by ``framed``) in blocks with halo."""
    wide = with_halo(df, left, right, t=t, block=block)
    frame = framed(keys, left, right, t=t)
    ordered = Window.partitionBy(*keys, "_block").orderBy(t)
    added = {name: column(frame) if callable(column) else column.over(ordered) for name, column in columns.items()}
    return wide.withColumns(added).where("_core").drop("_block", "_core")


def following(df: DataFrame, value: str, order: Sequence[str], *, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``df`` with _next, the ``value`` of the row that follows in ``order`` by keys; the first of ``order`` is a whole number.

    Rows are put in order in blocks of that number; of each block only its first row is ordered with the other blocks'.
    """
    cut = df.withColumn("_block", F.floor(F.col(order[0]) / block))
    firsts = cut.groupBy(*keys, "_block").agg(F.min(F.struct(*order, F.col(value).alias("_v"))).alias("_first"))
    after = firsts.select(*keys, "_block", F.lead("_first._v").over(Window.partitionBy(*keys).orderBy("_block")).alias("_after"))
    inside = cut.withColumn("_in", F.lead(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    seen = inside.join(after, [*keys, "_block"])
    return seen.withColumn("_next", F.when(F.col("_in").isNotNull(), F.col("_in.v")).otherwise(F.col("_after"))).drop("_block", "_in", "_after")


def running_sums(df: DataFrame, columns: Sequence[str], order: str, *, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Running totals of ``columns`` up to each row, in ``order`` by keys, as columns of the same names behind ``sum_``.

    ``order`` has no equal values within a key.  Rows are dealt by ranges of keys and order; each range is summed by
    itself, on top of the totals of the ranges before it, which are one row each, so a key of any size spreads.
    """
    ranges = kept(df.repartitionByRange(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")), *keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    base = totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranges.withColumns({f"sum_{c}": F.sum(c).over(inside) for c in columns}).join(base, [*keys, "_range"])
    return summed.withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.col(f"_{c}") for c in columns}).drop("_range", *(f"_{c}" for c in columns))
