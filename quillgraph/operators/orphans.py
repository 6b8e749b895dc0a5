"""References to records that do not exist (problem 2)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.common import cut


@dataclass(frozen=True)
class Source:
    """A table of records: its key, the time a record is judged at or valid from."""

    df: DataFrame
    key: str
    at: str | None


@dataclass(frozen=True)
class Reference:
    """A column of ``table`` whose value, or each element of it, is a key of ``target``."""

    table: str
    column: str
    target: str


def _entries(ref: Reference, ids: Column) -> Column:
    """The targets of one reference as an array, empty for a null list."""
    made = F.transform(ids, lambda i: F.struct(F.lit(ref.column).alias("column_name"), F.lit(ref.target).alias("target_kind"), i.cast("long").alias("target_id")))
    return F.coalesce(made, F.array().cast("array<struct<column_name:string,target_kind:string,target_id:bigint>>"))


def references(sources: dict[str, Source], refs: list[Reference]) -> DataFrame:
    """``(table_name, column_name, record_id, at, target_kind, target_id)``.

    Each table is read once, whatever the number of its references; a target
    that one record names twice counts once; null ids, null lists and their
    null elements are no references.
    """
    parts = []
    for name in dict.fromkeys(r.table for r in refs):
        source = sources[name]
        entries = []
        for ref in (r for r in refs if r.table == name):
            value = F.col(ref.column)
            ids = value if source.df.schema[ref.column].dataType.typeName() == "array" else F.array(value)
            entries.append(_entries(ref, F.array_distinct(ids)))
        at = F.col(source.at) if source.at else F.lit(None).cast("timestamp")
        rows = source.df.select(F.lit(name).alias("table_name"), F.col(source.key).cast("long").alias("record_id"), at.alias("at"), F.explode(F.concat(*entries)).alias("e"))
        parts.append(rows.select("table_name", "e.column_name", "record_id", "at", "e.target_kind", "e.target_id"))
    return reduce(DataFrame.unionByName, parts).where(F.col("target_id").isNotNull())


def targets(sources: dict[str, Source], kinds: dict[str, str], deletions: DataFrame | None = None) -> DataFrame:
    """``(target_kind, target_id, present, since, deleted_at)``: one row per known target.

    ``kinds`` maps each target table to its name in ``deletions.target_kind``. A
    record delivered repeatedly exists from its earliest time on.
    """
    parts = []
    for name, kind in kinds.items():
        source = sources[name]
        since = F.col(source.at) if source.at else F.lit(None).cast("timestamp")
        parts.append(source.df.select(F.lit(name).alias("target_kind"), F.col(source.key).cast("long").alias("target_id"), F.lit(True).alias("present"), since.alias("since"), F.lit(None).cast("timestamp").alias("deleted_at")))
        if deletions is not None:
            gone = deletions.where(F.col("target_kind") == kind)
            parts.append(gone.select(F.lit(name).alias("target_kind"), F.col("target_id").cast("long").alias("target_id"), F.lit(False).alias("present"), F.lit(None).cast("timestamp").alias("since"), "deleted_at"))
    rows = reduce(DataFrame.unionByName, parts).where(F.col("target_id").isNotNull())
    return rows.groupBy("target_kind", "target_id").agg(F.max("present").alias("present"), F.min("since").alias("since"), F.min("deleted_at").alias("deleted_at"))


def direct_orphans(refs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose target is broken at the record's time, with ``reason``.

    ``deleted``: deleted at or before that time; else ``missing``: no row; else
    ``late``: the target's earliest time is after it. Without a time only
    ``missing`` can hold. ``known`` has one row per target, so the join never
    multiplies, and a target that a third of all records name is only one
    skewed key of a sort-merge join, which adaptive execution splits.
    """
    joined = refs.join(known, ["target_kind", "target_id"], "left")
    reason = (
        F.when(F.col("deleted_at") <= F.col("at"), "deleted")
        .when(~F.coalesce(F.col("present"), F.lit(False)), "missing")
        .when(F.col("since") > F.col("at"), "late")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*refs.columns, "reason")


def orphan_cascade(sources: dict[str, Source], refs: list[Reference], kinds: dict[str, str], deletions: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """``(table_name, column_name, record_id, target_id, reason, period, inherited, level)``.

    Level 0 are the direct orphans. A reference to a record that is itself an
    orphan makes its record an inherited one (reason ``inherited``) on the next
    level; semi-joins go down the foreign keys until no record is added, which
    also ends on keys that form a cycle. One row per record, column and target.
    ``period`` is the month of the record's time, or ``unknown``. Empty tables,
    null keys and extra columns are harmless; a repeated record counts once.
    """
    every = references(sources, refs)
    parents = {r.target for r in refs} & {r.table for r in refs}
    direct = cut(direct_orphans(every, targets(sources, kinds, deletions)).withColumn("level", F.lit(0)))
    levels, frontier = [direct], direct
    done = direct.where(F.col("table_name").isin(*parents)).select("table_name", "record_id").distinct()
    while parents and (max_rounds is None or len(levels) <= max_rounds):
        origin = frontier.where(F.col("table_name").isin(*parents)).select(F.col("table_name").alias("target_kind"), F.col("record_id").alias("target_id")).distinct()
        reached = every.join(origin, ["target_kind", "target_id"], "left_semi")
        known = reduce(DataFrame.unionByName, levels).select("table_name", "column_name", "record_id", "target_id").distinct()
        reached = reached.join(known, ["table_name", "column_name", "record_id", "target_id"], "left_anti")
        fresh = cut(reached.withColumn("reason", F.lit("inherited")).withColumn("level", F.lit(len(levels))))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        frontier = fresh.join(done, ["table_name", "record_id"], "left_anti")
        done = cut(done.unionByName(frontier.where(F.col("table_name").isin(*parents)).select("table_name", "record_id")).distinct())
    rows = reduce(DataFrame.unionByName, levels)
    period = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return rows.select("table_name", "column_name", "record_id", "target_id", "reason", period.alias("period"), (F.col("level") > 0).alias("inherited"), "level").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table, column, period and reason."""
    return found.groupBy("table_name", "column_name", "period", "reason").agg(F.count("*").alias("n_references"), F.countDistinct("record_id").alias("n_records"))
