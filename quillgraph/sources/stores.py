"""Keyed stores as DataFrames: upsert, lookup, deletion, change detection.

A store is a parquet folder; a change is a new DataFrame that the caller writes
to another folder, so readers never see half a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return new.unionByName(old.join(new.select(keys).distinct(), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last in ``order`` (nulls first), ties broken by all columns."""
    best = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*[c for c in rows.columns]).asc())
    return rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def point_lookup(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``ids`` (pos, key) with the row of each, null where there is none."""
    return ids.join(rows, key, "left")


def document_index(chunks: DataFrame) -> DataFrame:
    """Per document the number of different chunks and their sorted ids' hash."""
    return chunks.select("doc_name", "chunk_id").distinct().groupBy("doc_name").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


def delete_documents(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks of the documents that stay."""
    return chunks.join(names, "doc_name", "left_anti")


def deleted_ids(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``(doc_name, chunk_id)`` of what :func:`delete_documents` takes away; an unknown name has none."""
    return chunks.join(names, "doc_name", "left_semi").select("doc_name", "chunk_id").distinct()


def file_states(states: DataFrame, put: DataFrame | None = None, delete: DataFrame | None = None) -> DataFrame:
    """The table of known files (doc_name, mtime_secs, file_size) after some were put and
    others deleted (doc_name); a file in both is put."""
    if delete is not None:
        states = states.join(delete.select("doc_name").distinct(), "doc_name", "left_anti")
    return states if put is None else upsert(states, put.select(states.columns), ["doc_name"])


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (doc_name, mtime_secs, file_size) that are new or differ from ``known``."""
    k = known.select("doc_name", F.col("mtime_secs").alias("old_mtime"), F.col("file_size").alias("old_size"))
    rows = files.join(k, "doc_name", "left")
    differs = F.col("old_mtime").isNull() | (F.col("old_mtime") != F.col("mtime_secs")) | (F.col("old_size") != F.col("file_size"))
    return rows.where(differs).select("doc_name", F.when(F.col("old_mtime").isNull(), "new").otherwise("changed").alias("reason"))


def checked_vectors(rows: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """``rows``; a vector of another length fails the job with its length."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(column).cast("string")))
    return rows.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == dim), F.col(column)).otherwise(wrong))


def grounding_export(cases: DataFrame) -> DataFrame:
    """question, answer, contexts, and ground_truth only if any case has one."""
    if "ground_truth" not in cases.columns or cases.where("ground_truth IS NOT NULL").isEmpty():
        return cases.select("question", "answer", "contexts")
    return cases.select("question", "answer", "contexts", F.coalesce("ground_truth", F.lit("")).alias("ground_truth"))
