"""The corpus pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import decontaminate, language_id, near_dup, packing, storage, substring_dedup, token_frames

NEAR_PERCENT = 80
NEAR_TABLES = 10  # at a similarity of 0.8 these miss about as few links as op10's 8 do at its 0.85

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _like(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order."""
    return found.select(*(storage.col(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language (operator 5): those without any letter go, null and empty texts too.

    The model is fitted on the labelled documents; a missing label is filled in by the prediction.  Repeated rows and null
    ids stay; without any labelled document no language is known, and all rows go; an empty table gives an empty one.
    Columns beside those of documents stay, whatever their names.
    """
    found, share = storage.unused("found_lang", docs), storage.unused("found_share", docs)
    named = language_id.predict(docs, language_id.fit(docs), pred_col=found, score_col=share)
    known = named.where(F.col(found) != language_id.UNKNOWN)
    return _like(known.withColumn("lang", F.coalesce("lang", found)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each group of near-duplicates (operator 10, at a similarity of 0.8 or more).

    Null and empty texts and null ids are in no group and stay; so do all rows of the smallest id of a group; an empty
    table gives an empty one; other columns stay, whatever their names.
    """
    gone = near_dup.near_duplicates(docs, percent=NEAR_PERCENT, tables=NEAR_TABLES).where("not kept").select("doc_id").distinct()
    return _like(docs.join(gone, "doc_id", "left_anti"), docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes and more that a smaller document has (operator 4); a text that is cut away whole goes.

    Null and short texts stay as they are; rows of one id don't cut each other, and a null id is the greatest; n_chars
    follows a text that is cut; an empty table gives an empty one; other columns stay, whatever their names.
    """
    new = storage.unused("cut_", docs)
    cut = substring_dedup.cut_repeats(docs, keep=[c for c in docs.columns if c != "text"], as_text=True, prefix=new)
    removed = F.col(f"{new}n_removed")
    left = cut.where((removed == 0) | (removed < F.col(f"{new}n_bytes"))).withColumn("text", F.col(f"{new}kept"))
    return _like(left.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item (operator 2).

    Null and empty texts stay, and so does everything if the benchmark is empty; repeated rows are judged each; other
    columns stay, whatever their names.
    """
    return decontaminate.without_leaks(docs, storage.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences (operator 6).

    The ids themselves go to token shards (operator 1) under ``corpus-tokens-*`` in the shared folder, beside their
    manifest; column ``tokens`` has that folder.  A piece's ids are those of its document, from ``start`` on, so a trainer
    reads sequences by (doc_id, start, length).  Null and empty texts are their end id alone; repeated rows and null ids are
    packed like any other; an empty table gives no row.
    """
    folder = storage.new_dir(spark, "corpus-tokens")
    token_frames.write_token_frames(docs, folder).write.parquet(f"{folder}/manifest")
    return packing.pack_sequences(docs).withColumn("tokens", F.lit(folder))


STAGES: list[tuple[str, Stage]] = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("cut_repeated_passages", cut_repeated_passages),
    ("drop_benchmark_leaks", drop_benchmark_leaks),
    ("best_fit_packing", best_fit_packing),
]

#: Learned languages, minhash groups and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written as Parquet and read again by the next."""
    docs = storage.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = storage.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
