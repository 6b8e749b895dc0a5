"""The property graph: keyed upserts, adjacency, traversal, deletion and merging.

Entities: entity_id, name, entity_type, ...; relations: src_id, dst_id,
relation_type, evidence (sorted, different chunk ids), strength; mentions:
chunk_id, entity_id. Everything is a DataFrame; no step gathers a graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.common import cut
from quillgraph.functions.scalar import normalize_name, tokens
from quillgraph.operators.components import connected_components

# Familial relations, their inverses, and the symmetric ones.
INVERSE = {
    "parent_of": "child_of", "child_of": "parent_of", "grandparent_of": "grandchild_of", "grandchild_of": "grandparent_of",
    "uncle_of": "nephew_of", "aunt_of": "niece_of", "nephew_of": "uncle_of", "niece_of": "aunt_of",
    "foster_parent_of": "foster_child_of", "foster_child_of": "foster_parent_of",
}
SYMMETRIC = ["spouse_of", "sibling_of", "half_sibling_of", "cousin_of"]
FAMILIAL = [*INVERSE, *SYMMETRIC]

# Weights of relations in a traversal; others weigh 0.5.
RELATION_WEIGHTS = {
    "spouse_of": 1.0, "parent_of": 1.0, "child_of": 1.0, "sibling_of": 0.9, "founded": 1.0, "led": 0.9, "worked_at": 0.8, "studied_under": 0.9,
    "collaborated_with": 0.7, "discovered": 1.0, "invented": 1.0, "capital_of": 0.9, "located_in": 0.8, "part_of": 0.8, "co_occurs": 0.3,
}


def case_of(column: Column, table: dict, otherwise) -> Column:
    """A lookup in a small fixed table, as a CASE expression."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def relation_strength(evidence: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(1), F.size(evidence)) / 10)


def upsert_relations(observed: DataFrame) -> DataFrame:
    """One row per (src_id, dst_id, relation_type) of observed rows with an
    ``evidence`` array: the union of the evidence and its strength. Rows with a
    null end or type are dropped."""
    rows = observed.where("src_id IS NOT NULL AND dst_id IS NOT NULL AND relation_type IS NOT NULL")
    single = rows.select("src_id", "dst_id", "relation_type", F.explode_outer("evidence").alias("chunk_id")).distinct()
    merged = single.groupBy("src_id", "dst_id", "relation_type").agg(F.array_sort(F.collect_list("chunk_id")).alias("evidence"))
    return merged.withColumn("strength", relation_strength(F.col("evidence")))


def with_inverses(observed: DataFrame) -> DataFrame:
    """Each familial row also in its other direction; other rows once."""
    inverse = case_of(F.col("relation_type"), INVERSE | {s: s for s in SYMMETRIC}, F.lit(None).cast("string"))
    forward = F.struct("src_id", "dst_id", "relation_type")
    back = F.struct(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), inverse.alias("relation_type"))
    both = F.explode(F.when(inverse.isNotNull(), F.array(forward, back)).otherwise(F.array(forward))).alias("r")
    return observed.select(both, "evidence").select("r.src_id", "r.dst_id", "r.relation_type", "evidence")


def allowed_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Without places and employers that are works, and without familial
    relations to a known end that is no person (an unknown end is fine)."""
    kinds = entities.select("entity_id", "entity_type")
    src, dst = kinds.toDF("src_id", "src_type"), kinds.toDF("dst_id", "dst_type")
    rows = relations.join(src, "src_id", "left").join(dst, "dst_id", "left")
    work = F.col("relation_type").isin("located_in", "works_at") & F.coalesce(F.col("dst_type") == "CreativeWork", F.lit(False))
    other = F.col("relation_type").isin(FAMILIAL) & (F.coalesce(F.col("src_type") != "Person", F.lit(False)) | F.coalesce(F.col("dst_type") != "Person", F.lit(False)))
    return rows.where(~work & ~other).select(relations.columns)


def upsert_entities(observed: DataFrame) -> DataFrame:
    """One row per normalised name and type: of the first row its name, chunk and, where
    there are such columns, gender and schema type; mentions summed, aliases and
    evidence united, the longest description."""
    key = observed.withColumn("norm", normalize_name(F.col("name"))).withColumn("ord", F.struct("created_at", "entity_id"))
    aliases = key.select("norm", "entity_type", F.explode_outer("aliases").alias("alias")).groupBy("norm", "entity_type").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    longest = F.struct(F.length(F.coalesce("description", F.lit(""))), F.coalesce("description", F.lit("")))
    others = [F.min_by(c, "ord").alias(c) for c in ("gender", "schema_type") if c in observed.columns]
    rows = key.groupBy("norm", "entity_type").agg(
        *others, F.min_by("entity_id", "ord").alias("entity_id"), F.min_by("name", "ord").alias("name"), F.sum("mention_count").alias("mention_count"),
        F.min_by("first_chunk_id", "ord").alias("first_chunk_id"), F.max_by(F.coalesce("description", F.lit("")), longest).alias("description"),
    )
    if "evidence" in observed.columns:
        chunks = key.select("norm", "entity_type", F.explode_outer("evidence").alias("chunk")).groupBy("norm", "entity_type").agg(F.array_sort(F.collect_set("chunk")).alias("evidence"))
        rows = rows.join(chunks, ["norm", "entity_type"])
    return rows.join(aliases, ["norm", "entity_type"])


def mentions(entities: DataFrame) -> DataFrame:
    """``(chunk_id, entity_id)``: evidence and first chunk of every entity, once."""
    listed = F.concat(F.coalesce("evidence", F.array().cast("array<bigint>")), F.array("first_chunk_id"))
    return entities.select("entity_id", F.explode(listed).alias("chunk_id")).where("chunk_id IS NOT NULL").select("chunk_id", "entity_id").distinct()


def adjacency(relations: DataFrame) -> DataFrame:
    """``(node_id, neighbour_id, relation_type, strength)``: each relation under both ends."""
    forward = relations.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("neighbour_id"), "relation_type", "strength")
    back = relations.select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("neighbour_id"), "relation_type", "strength")
    return forward.unionByName(back)


def neighbours(relations: DataFrame) -> DataFrame:
    """Different pairs of neighbours, in both directions, without loops."""
    return adjacency(relations).where("node_id <> neighbour_id").select("node_id", "neighbour_id").distinct()


def bfs(seeds: DataFrame, relations: DataFrame, hops: int) -> DataFrame:
    """``(entity_id, depth)`` of the nodes within ``hops`` of ``seeds`` (entity_id).

    Each round expands only the new frontier and is stored before the next, so
    the plan does not grow; it ends early when nothing new is reached.
    """
    edges = neighbours(relations)
    reached = frontier = cut(seeds.select("entity_id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        found = frontier.select(F.col("entity_id").alias("node_id")).join(edges, "node_id").select(F.col("neighbour_id").alias("entity_id")).distinct()
        frontier = cut(found.join(reached, "entity_id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def cooccurrence(mentioned: DataFrame) -> DataFrame:
    """``(a, b, n_chunks)``: entities a < b of the same chunk."""
    one, two = mentioned.toDF("chunk_id", "a"), mentioned.toDF("chunk_id", "b")
    return one.join(two, "chunk_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_chunks"))


def prune_dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both ends of which exist."""
    ids = entities.select("entity_id")
    return relations.join(ids, F.col("src_id") == F.col("entity_id"), "left_semi").join(ids, F.col("dst_id") == F.col("entity_id"), "left_semi")


def delete_relations(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the relations of ``keys`` (src_id, dst_id, relation_type) and their inverse twins."""
    twins = with_inverses(keys.select("src_id", "dst_id", "relation_type", F.array().cast("array<bigint>").alias("evidence"))).drop("evidence").distinct()
    return relations.join(twins, ["src_id", "dst_id", "relation_type"], "left_anti")


def merge_entities(entities: DataFrame, relations: DataFrame, mentioned: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges all ``pairs`` (keep_id, drop_id) at once.

    Chains of merges are resolved first: every component keeps the entity with
    most mentions (then the smallest id). Relations are rewritten and regrouped,
    loops dropped; the dropped names become aliases.
    """
    component = connected_components(pairs, "keep_id", "drop_id")
    ranked = component.join(entities.select(F.col("entity_id").alias("node"), "mention_count"), "node")
    keep = ranked.groupBy("component").agg(F.max_by("node", F.struct("mention_count", -F.col("node"))).alias("keep"))
    mapping = cut(component.join(keep, "component").where("node <> keep").select(F.col("node").alias("old"), "keep"))
    new = lambda df, c: df.join(mapping.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("keep", c)).drop("keep")
    moved = new(new(relations, "src_id"), "dst_id").where("src_id <> dst_id")
    mapped = entities.join(mapping, F.col("entity_id") == F.col("old"), "left").withColumn("target", F.coalesce("keep", "entity_id"))
    alias = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("keep").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")))
    names = mapped.select("target", F.explode_outer(alias).alias("alias")).groupBy("target").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    longest = F.struct(F.length(F.coalesce("description", F.lit(""))), F.coalesce("description", F.lit("")))
    merged = mapped.groupBy("target").agg(F.sum("mention_count").alias("mention_count"), F.max_by(F.coalesce("description", F.lit("")), longest).alias("description"))
    changed = merged.join(names, "target")
    if "evidence" in entities.columns:
        evidence = mapped.select("target", F.explode_outer("evidence").alias("chunk")).groupBy("target").agg(F.array_sort(F.collect_set("chunk")).alias("evidence"))
        changed = changed.join(evidence, "target")
    # everything else, the embedding, times, gender and schema, is what the kept one has
    rest = entities.drop(*(c for c in changed.columns if c != "target"))
    out = rest.join(changed.withColumnRenamed("target", "entity_id"), "entity_id").select(entities.columns)
    return out, upsert_relations(moved), new(mentioned, "entity_id").distinct()


def is_seeded(evidence: Column) -> Column:
    """Whether a relation was seeded: its evidence holds chunk 0."""
    return F.coalesce(F.array_contains(evidence, F.lit(0).cast("bigint")), F.lit(False))


def delete_entities(entities: DataFrame, relations: DataFrame, mentioned: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the entities of ``gone`` (entity_id), their relations and mentions."""
    gone = gone.select("entity_id").distinct()
    kept = relations.join(gone.withColumnRenamed("entity_id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("entity_id", "dst_id"), "dst_id", "left_anti")
    return entities.join(gone, "entity_id", "left_anti"), kept.select(relations.columns), mentioned.join(gone, "entity_id", "left_anti").select(mentioned.columns)


def set_attributes(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """``entities`` with the values of ``changes`` (entity_id and any of their columns)
    that are not null in place of their own; one change an entity."""
    names = [c for c in changes.columns if c != "entity_id"]
    joined = entities.join(changes.select("entity_id", *(F.col(c).alias(f"__{c}") for c in names)), "entity_id", "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in entities.columns))


def count_mentions(entities: DataFrame, accesses: DataFrame) -> DataFrame:
    """``entities`` with the mention count raised by one for each access (entity_id)."""
    more = accesses.groupBy("entity_id").agg(F.count("*").alias("__more"))
    rows = entities.join(more, "entity_id", "left").withColumn("mention_count", F.col("mention_count") + F.coalesce("__more", F.lit(0)))
    return rows.select(entities.columns)


def sync_evidence(entities: DataFrame, mentioned: DataFrame) -> DataFrame:
    """``entities`` with the evidence of the mentions index, sorted; none is the empty list."""
    listed = mentioned.groupBy("entity_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("__evidence"))
    rows = entities.drop("evidence").join(listed, "entity_id", "left")
    return rows.withColumn("evidence", F.coalesce("__evidence", F.array().cast("array<bigint>"))).drop("__evidence")


def graph_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(n_entities, n_relations)``: stored rows."""
    return entities.agg(F.count("*").alias("n_entities")).crossJoin(relations.agg(F.count("*").alias("n_relations")))


def query_entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``(query_id, entity_id)``: the entities of ``names`` (key, entity_id) whose
    normalised name is a token, or two neighbouring ones, of a query's text."""
    words = queries.select("query_id", tokens(F.col("text")).alias("t"))
    pairs = F.zip_with("t", F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    keys = words.select("query_id", F.explode(F.concat("t", pairs)).alias("phrase")).select("query_id", normalize_name(F.col("phrase")).alias("key"))
    return keys.where("key <> ''").join(names, "key").select("query_id", "entity_id").distinct()


def graph_search(queries: DataFrame, mentioned: DataFrame, relations: DataFrame, entities: DataFrame, chunk_docs: DataFrame, hops: int = 2, entity_weight: float = 0.5, near_weight: float = 0.5) -> DataFrame:
    """``(query_id, doc_id, score)``: documents of the queries' entities (query_id,
    entity_id), directly or over at most ``hops`` neighbours, the nearest counting."""
    edges = neighbours(relations).join(entities.select(F.col("entity_id").alias("neighbour_id")), "neighbour_id", "left_semi")
    reached = frontier = cut(queries.select("query_id", "entity_id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        found = frontier.select("query_id", F.col("entity_id").alias("node_id")).join(edges, "node_id").select("query_id", F.col("neighbour_id").alias("entity_id")).distinct()
        frontier = cut(found.join(reached, ["query_id", "entity_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    scored = reached.join(entities.select("entity_id", "confidence"), "entity_id").join(mentioned, "entity_id").join(chunk_docs, "chunk_id")
    best = scored.groupBy("query_id", "doc_id").agg(F.min("depth").alias("depth"), F.max(F.when(F.col("depth") == 0, F.col("confidence"))).alias("direct"))
    direct = entity_weight * F.col("direct") + near_weight
    return best.select("query_id", "doc_id", F.when(F.col("depth") == 0, direct).otherwise(entity_weight * 0.5 + near_weight / (F.col("depth") + 1)).alias("score"))


def weighted_graph_search(queries: DataFrame, mentioned: DataFrame, relations: DataFrame, entities: DataFrame, chunk_docs: DataFrame, hops: int = 2, least_confidence: float = 0.5, least_score: float = 0.05) -> DataFrame:
    """``(query_id, doc_id, score)``: path scores (confidence x confidence x
    strength x weight of the relation, halved and thirded by depth), the best
    per entity and document, divided by 1 + 0.3 depth."""
    weight = case_of(F.col("relation_type"), RELATION_WEIGHTS, 0.5)
    edges = adjacency(relations).where("node_id <> neighbour_id").withColumn("w", weight * F.col("strength")).groupBy("node_id", "neighbour_id").agg(F.max("w").alias("w"))
    sure = entities.where(F.col("confidence") >= least_confidence).select(F.col("entity_id").alias("neighbour_id"), F.col("confidence").alias("c"))
    edges = edges.join(sure, "neighbour_id")
    start = queries.select("query_id", "entity_id").distinct().join(entities.select("entity_id", "confidence"), "entity_id")
    reached = frontier = cut(start.select("query_id", "entity_id", F.col("confidence").alias("path"), (F.col("confidence") * F.col("confidence")).alias("score"), F.lit(0).alias("depth")))
    for depth in range(1, hops + 1):
        step = frontier.select("query_id", "path", F.col("entity_id").alias("node_id")).join(edges, "node_id")
        step = step.select("query_id", F.col("neighbour_id").alias("entity_id"), (F.col("path") * F.col("c") * F.col("w") / (depth + 1)).alias("path"))
        step = step.groupBy("query_id", "entity_id").agg(F.max("path").alias("path")).where(F.round("path", 9) >= least_score)
        frontier = cut(step.join(reached, ["query_id", "entity_id"], "left_anti").select("query_id", "entity_id", "path", F.col("path").alias("score"), F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    docs = reached.join(mentioned, "entity_id").join(chunk_docs, "chunk_id")
    return docs.groupBy("query_id", "doc_id").agg(F.max(F.col("score") / (1 + 0.3 * F.col("depth"))).alias("score"))
