"""Memory strength: consolidation of nodes, edges and chunks, forgetting, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.common import cut
from quillgraph.functions.scalar import elapsed_days, memory_state, strength
from quillgraph.operators.graph import merge_entities
from quillgraph.operators.resolution import greedy_names


def _scored(rows: DataFrame, now: Column) -> DataFrame:
    value = strength(F.col("reinforcement"), elapsed_days(F.col("last_seen"), now))
    return rows.withColumn("strength", F.round(value, 6)).withColumn("state", memory_state(value))


def memory_nodes(entities: DataFrame, mentions: DataFrame, chunk_times: DataFrame, now: Column) -> DataFrame:
    """Per entity: reinforcement (mentions), last seen (latest chunk), strength, state."""
    seen = mentions.join(chunk_times, "chunk_id").groupBy("entity_id").agg(F.max("ingested_at").alias("last_seen"))
    rows = entities.select("entity_id", F.col("mention_count").alias("reinforcement")).join(seen, "entity_id", "left")
    return _scored(rows, now)


def memory_edges(relations: DataFrame, chunk_times: DataFrame, now: Column) -> DataFrame:
    """Per relation: reinforcement (at least 1, the evidence), last seen, strength, state."""
    seen = relations.select("src_id", "dst_id", "relation_type", F.explode("evidence").alias("chunk_id")).join(chunk_times, "chunk_id")
    seen = seen.groupBy("src_id", "dst_id", "relation_type").agg(F.max("ingested_at").alias("last_seen"))
    rows = relations.select("src_id", "dst_id", "relation_type", F.greatest(F.lit(1), F.size("evidence")).cast("bigint").alias("reinforcement"))
    return _scored(rows.join(seen, ["src_id", "dst_id", "relation_type"], "left"), now)


def memory_chunks(chunk_times: DataFrame, mentions: DataFrame, now: Column) -> DataFrame:
    """Per chunk: reinforcement (at least 1, its entities), strength, state."""
    counts = mentions.groupBy("chunk_id").agg(F.count("*").alias("n"))
    rows = chunk_times.join(counts, "chunk_id", "left").select("chunk_id", F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).cast("bigint").alias("reinforcement"), F.col("ingested_at").alias("last_seen"))
    return _scored(rows, now)


def forgetting_series(entities: DataFrame, days: list[int]) -> DataFrame:
    """Average strength and share of each state after each number of days, over
    the histogram of mention counts (bounded by the number of different counts)."""
    histogram = entities.select(F.greatest(F.lit(1), F.col("mention_count")).alias("r")).groupBy("r").agg(F.count("*").alias("n"))
    rows = histogram.withColumn("day", F.explode(F.array(*(F.lit(x) for x in days))))
    value = strength(F.col("r"), F.col("day").cast("double"))
    rows = rows.withColumn("s", value).withColumn("state", memory_state(value))
    total = F.sum("n")
    share = lambda state: F.round(100.0 * F.sum(F.when(F.col("state") == state, F.col("n")).otherwise(0)) / total, 2)
    return rows.groupBy("day").agg(F.round(F.sum(F.col("s") * F.col("n")) / total, 4).alias("avg_strength"), share("long_term").alias("long_term_pct"), share("short_term").alias("short_term_pct"), share("dormant").alias("dormant_pct"))


def prune_dormant(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without dormant entities (a missing state is dormant) and their relations."""
    kept = nodes.where(F.coalesce("state", F.lit("dormant")) != "dormant")
    ids = kept.select("entity_id")
    rest = relations.join(nodes.join(ids, "entity_id", "left_anti").select(F.col("entity_id").alias("src_id")), "src_id", "left_anti")
    return kept, rest.join(nodes.join(ids, "entity_id", "left_anti").select(F.col("entity_id").alias("dst_id")), "dst_id", "left_anti")


def convergence(cycles: DataFrame, least: float = 0.05) -> DataFrame:
    """``cycles`` (cycle, compression) with the mean of the three cycles before
    and whether it is below ``least`` (never before the fourth)."""
    before = Window.orderBy("cycle").rowsBetween(-3, -1)
    mean, n = F.avg("compression").over(before), F.count("compression").over(before)
    return cycles.withColumn("mean_before", F.round(mean, 6)).withColumn("converged", (n == 3) & (mean < least))


def consolidation_cycle(entities: DataFrame, relations: DataFrame, mentions: DataFrame, chunk_times: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """One cycle: strength, state, pruning of what is dormant, merging of duplicates."""
    n_before, r_before = entities.count(), relations.count()
    nodes = memory_nodes(entities, mentions, chunk_times, now)
    kept, rest = prune_dormant(nodes, relations)
    kept = cut(entities.join(kept.select("entity_id"), "entity_id", "left_semi"))
    pairs = cut(greedy_names(kept))
    linked = mentions.join(kept.select("entity_id"), "entity_id", "left_semi")
    merged = kept
    if not pairs.isEmpty():
        merged, rest, linked = merge_entities(kept, rest, linked, pairs)
        merged = cut(merged)
    rest, linked = cut(rest), cut(linked)
    n_after = merged.count()
    return merged, rest, linked, {"entities_before": n_before, "entities_after": n_after, "relations_before": r_before, "relations_after": rest.count(), "merged": pairs.count(), "compression": (n_before - n_after) / n_before if n_before else 0.0}


def run_cycles(entities: DataFrame, relations: DataFrame, mentions: DataFrame, chunk_times: DataFrame, now: Column, most: int = 20, least: float = 0.05) -> list[dict]:
    """Cycles until the mean compression of the three before falls below ``least``."""
    history: list[dict] = []
    while len(history) < most:
        before = [h["compression"] for h in history[-3:]]
        entities, relations, mentions, counted = consolidation_cycle(entities, relations, mentions, chunk_times, now)
        history.append(counted | {"cycle": len(history) + 1, "converged": len(before) == 3 and sum(before) / 3 < least})
        if history[-1]["converged"]:
            break
    return history


def core_fact_inputs(nodes: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 20, most: int = 8) -> DataFrame:
    """The k strongest entities with at most ``most`` of their outgoing relations
    as text; entities without one are left out."""
    order = Window.orderBy(F.desc("strength"), "entity_id")
    top = nodes.orderBy(F.desc("strength"), "entity_id").limit(k).withColumn("rank", F.row_number().over(order)).select("entity_id", "rank", "strength")
    names = entities.select("entity_id", "name")
    out = relations.select(F.col("src_id").alias("entity_id"), "relation_type", F.col("dst_id").alias("other")).join(top.select("entity_id"), "entity_id", "left_semi")
    out = out.join(names.toDF("other", "other_name"), "other").withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("relation_type", "other"))).where(F.col("r") <= most)
    facts = out.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "relation_type", "other_name").alias("t")))), lambda x: x["t"]), "; ").alias("facts"))
    return top.join(names, "entity_id").join(facts, "entity_id")


def forgetting_curves(days: list[int], counts: tuple[int, ...] = (1, 3, 10, 50)) -> list[tuple[int, int]]:
    """(reinforcement, day) pairs of the classic curves."""
    return [(r, d) for r in counts for d in days]


def curve_table(spark, days: list[int], counts: tuple[int, ...] = (1, 3, 10, 50)) -> DataFrame:
    """``(reinforcement, day, strength)`` of the classic curves."""
    rows = spark.createDataFrame(forgetting_curves(days, counts), "reinforcement int, day int")
    return rows.select("reinforcement", "day", F.round(strength(F.col("reinforcement"), F.col("day").cast("double")), 4).alias("strength"))


def mention_histogram(entities: DataFrame) -> DataFrame:
    """``(reinforcement, n)``: how many entities are mentioned how often, at least once."""
    return entities.select(F.greatest(F.lit(1).cast("bigint"), F.coalesce("mention_count", F.lit(1))).alias("reinforcement")).groupBy("reinforcement").agg(F.count("*").alias("n"))


def forgetting_examples(entities: DataFrame, counts: tuple[int, ...] = (1, 2, 3, 5, 10, 12), top: int = 8, longest: int = 365) -> DataFrame:
    """``(kind, place, name, reinforcement, day30, day90, day365, state_day90, state_day365)``:
    the first entity (smallest id) of each of ``counts``, and the ``top`` most reinforced, by name."""
    rows = entities.select("entity_id", "name", F.greatest(F.lit(1).cast("bigint"), F.coalesce("mention_count", F.lit(1))).alias("reinforcement"))
    first = rows.where(F.col("reinforcement").isin(*counts)).groupBy("reinforcement").agg(F.min_by("name", "entity_id").alias("name"), F.min("entity_id").alias("entity_id"))
    first = first.select(F.lit("example").alias("kind"), "reinforcement", "name", "entity_id")
    most = rows.orderBy(F.desc("reinforcement"), F.coalesce("name", F.lit("")), "entity_id").limit(top).select(F.lit("most").alias("kind"), "reinforcement", "name", "entity_id")
    at = lambda d: strength(F.col("reinforcement"), F.lit(float(d)))
    return first.unionByName(most).select(
        "kind", "entity_id", "name", "reinforcement", F.round(at(30), 3).alias("day30"), F.round(at(90), 3).alias("day90"), F.round(at(longest), 3).alias("day365"),
        memory_state(at(90)).alias("state_day90"), memory_state(at(longest)).alias("state_day365"),
    )
