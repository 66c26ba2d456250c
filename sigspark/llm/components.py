"""Connected components by alternating stars, in aggregates and joins that Spark can spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm import storage

MAX_ROUNDS = 64


def _stars(edges: DataFrame, *, large: bool) -> DataFrame:
    """Hang nodes onto the least neighbour: from each node its greater neighbours (large), or itself and its lesser ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # Written first, so that the join shuffles both sides, and Spark can split a node with very many neighbours.
        least = storage.materialize(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least")), "least")
        hung = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        least = edges.groupBy("src").agg(F.min("dst").alias("least"))
        hung = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        hung = hung.unionByName(least.select("src", F.col("least").alias("dst")))
    turned = hung.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    return turned.where("src <> dst").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of each node of ``edges`` (src, dst longs): the least id that is reachable.

    Self-loops and repeated edges add nothing; nulls are no nodes; an empty table gives no row.  Rounds grow with the
    logarithm of the longest path; each is written to the shared folder, so a lost executor costs one round.
    """
    turned = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now = storage.materialize(turned.where("src <> dst").distinct(), name)
    mark = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("h")).first()
        if tuple(state) == mark or not state["n"]:
            break
        mark = tuple(state)
        now = storage.materialize(_stars(_stars(now, large=True), large=False), name)
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return members.unionByName(now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
