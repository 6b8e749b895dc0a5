"""Queries of the property graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.common import table
from quillgraph.functions import scalar as S
from quillgraph.operators import graph as G
from quillgraph.operators.retrieval import bm25_scores, reciprocal_rank_fusion, top_k
from quillgraph.plans.base import MEN, REL, chunk_docs, entities, mentions, norm, relations


def _observed(s, d):
    return table(s, d, "relations").select("src_id", "dst_id", "relation_type", F.col("evidence_chunk_ids").alias("evidence"))


def entity_upsert(s, d):
    return G.upsert_entities(entities(s, d)).select("norm", "entity_type", "entity_id", "name", "mention_count", "description", F.array_join("aliases", "|").alias("aliases"), "gender", "schema_type", F.array_join("evidence", ",").alias("evidence"))


def relation_upsert(s, d):
    return relations(s, d).select("src_id", "dst_id", "relation_type", F.size("evidence").alias("n_evidence"), F.round("strength", 6).alias("strength"))


def familial_inverse(s, d):
    full = G.upsert_relations(G.with_inverses(_observed(s, d)))
    return full.where(F.col("relation_type").isin(G.FAMILIAL)).select("src_id", "dst_id", "relation_type", F.size("evidence").alias("n_evidence"))


def relation_constraints(s, d):
    return G.allowed_relations(relations(s, d), entities(s, d)).groupBy("relation_type").agg(F.count("*").alias("n"))


def mentions_index(s, d):
    return mentions(s, d).groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("entity_ids"))


def entity_chunks(s, d):
    return mentions(s, d).groupBy("entity_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))


def cooccurrence(s, d):
    return G.cooccurrence(mentions(s, d))


def adjacency(s, d):
    return G.adjacency(relations(s, d)).groupBy("node_id").agg(F.count("*").alias("n_edges"), F.countDistinct("neighbour_id").alias("n_neighbours"), F.round(F.sum("strength"), 6).alias("total_strength"))


def outgoing_relations(s, d):
    return relations(s, d).groupBy("src_id", "relation_type").agg(F.count("*").alias("n"), F.sum(F.size("evidence")).alias("n_evidence"))


def relation_breakdown(s, d):
    rows = relations(s, d).groupBy("relation_type").agg(F.count("*").alias("n"))
    return rows.withColumn("share_pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def bfs_neighbors(s, d):
    seeds = entities(s, d).where("entity_type = 'Event'").select("entity_id")
    return G.bfs(seeds, relations(s, d), 2).select("entity_id", "depth")


def find_by_name(s, d):
    e = entities(s, d)
    keys = e.select("entity_id", "mention_count", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).withColumn("key", S.normalize_name(F.col("n")))
    best = keys.groupBy("key").agg(F.max_by("entity_id", F.struct("mention_count", -F.col("entity_id"))).alias("entity_id"), F.countDistinct("entity_id").alias("n_entities"))
    return best.where("key <> ''")


def alias_token_lookup(s, d):
    e = entities(s, d).select("entity_id", F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("alias"))
    words = e.select("entity_id", F.explode(F.split(F.lower("alias"), r"\s+")).alias("raw"))
    both = words.select("entity_id", F.explode(F.array("raw", S.token_core(F.col("raw")))).alias("token")).where("token <> ''").distinct()
    return both.groupBy("token").agg(F.count("*").alias("n_entities"), F.min("entity_id").alias("first_id"))


def dangling_prune(s, d):
    return G.prune_dangling(relations(s, d), entities(s, d)).select("src_id", "dst_id", "relation_type")


def delete_relation(s, d):
    rel = relations(s, d)
    return G.delete_relations(rel, rel.where("relation_type = 'parent_of' OR relation_type = 'spouse_of' AND src_id < dst_id")).select("src_id", "dst_id", "relation_type")


def _merge(s, d):
    e = entities(s, d)
    alias = e.select(F.col("entity_id").alias("keep_id"), F.explode("aliases").alias("name"))
    pairs = alias.join(e.select("name", F.col("entity_id").alias("drop_id")), "name").where("keep_id <> drop_id").select("keep_id", "drop_id")
    return G.merge_entities(e, relations(s, d), mentions(s, d), pairs)


def merge_entities(s, d):
    merged = _merge(s, d)[0]
    listed = F.array_join(F.array_sort(F.array_distinct(F.coalesce("evidence", F.array().cast("array<bigint>")))), ",")
    return merged.select("entity_id", "name", "mention_count", F.length("description").alias("description_length"), "gender", "schema_type", F.round("confidence", 6).alias("confidence"), F.size("embedding").alias("dim"), "first_chunk_id", F.array_join("aliases", "|").alias("aliases"), listed.alias("evidence"))


def unmerge_alias(s, d):
    e = entities(s, d).where(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0)
    first = e.withColumn("alias", F.array_min("aliases"))
    stub = first.select(S.entity_id(F.col("alias"), F.col("entity_type")).alias("entity_id"), F.col("alias").alias("name"), F.lit(1).cast("bigint").alias("mention_count"), F.lit(0).alias("n_aliases"))
    kept = first.select("entity_id", "name", F.greatest(F.lit(0), F.col("mention_count") - 1).alias("mention_count"), (F.size(F.array_distinct("aliases")) - 1).alias("n_aliases"))
    return kept.unionByName(stub)


def chunk_tag_prefix(s, d):
    rows = mentions(s, d).join(entities(s, d).select("entity_id", "name", "mention_count"), "entity_id")
    best = Window.partitionBy("chunk_id").orderBy(F.desc("mention_count"), "entity_id")
    top = rows.withColumn("r", F.row_number().over(best)).where("r <= 3")
    tags = top.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("t"))
    return tags.select("chunk_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("["), x["name"], F.lit("]"))), " ").alias("tags"))


def crosslink_entities(s, d):
    rows = mentions(s, d).join(chunk_docs(s, d), "chunk_id").groupBy("entity_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("chunk_id").alias("n_chunks"))
    return rows.where("n_docs > 1")


def _by_place(s, d):
    """The observed relations with, for each chunk of evidence, its place in its document."""
    place = table(s, d, "chunks").groupBy("chunk_id").agg(F.min("chunk_index").alias("place"))
    rows = _observed(s, d).where("src_id IS NOT NULL AND dst_id IS NOT NULL AND relation_type IS NOT NULL").select("src_id", "dst_id", "relation_type", F.explode_outer("evidence").alias("chunk_id"))
    return rows.join(place, "chunk_id", "left").groupBy("src_id", "dst_id", "relation_type").agg(F.collect_set("place").alias("evidence"))


def relation_seeded(s, d):
    """Relations with evidence in chunk 0, the first of a document: chunks are numbered by their place."""
    rows = _by_place(s, d).withColumn("seeded", G.is_seeded(F.col("evidence")))
    return rows.groupBy("relation_type").agg(F.count_if("seeded").alias("n_seeded"), F.count("*").alias("n"))


def _query_entities(s, d):
    """The entities that a question or its passage names, by single words and pairs of words."""
    cases = table(s, d, "eval_cases").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "question", "passage").alias("text"))
    return G.query_entities(cases, find_by_name(s, d).select("key", "entity_id"))


def query_entities(s, d):
    return _query_entities(s, d)


def delete_entity(s, d):
    gone = table(s, d, "deletions").where("target_kind = 'entity'").select(F.col("target_id").alias("entity_id"))
    e, r, m = G.delete_entities(entities(s, d), relations(s, d), mentions(s, d), gone)
    return e.agg(F.count("*").alias("n_entities")).crossJoin(r.agg(F.count("*").alias("n_relations"))).crossJoin(m.agg(F.count("*").alias("n_mentions")))


def set_attributes(s, d):
    changes = entities(s, d).where("entity_id % 4 = 0").select("entity_id", F.when(F.col("entity_id") % 8 == 0, "Thing").alias("schema_type"), F.concat(F.lit("About "), "name").alias("description"))
    return G.set_attributes(entities(s, d), changes).select("entity_id", "schema_type", "description", "mention_count")


def increment_mention(s, d):
    accesses = table(s, d, "relations").select(F.col("dst_id").alias("entity_id")).where("entity_id IS NOT NULL")
    return G.count_mentions(entities(s, d), accesses).select("entity_id", "mention_count")


def sync_evidence(s, d):
    return G.sync_evidence(entities(s, d), mentions(s, d)).select("entity_id", F.array_join("evidence", ",").alias("evidence"))


def graph_counts(s, d):
    return G.graph_counts(entities(s, d), relations(s, d))


def graph_search(s, d):
    scored = G.graph_search(_query_entities(s, d), mentions(s, d), relations(s, d), entities(s, d), chunk_docs(s, d))
    return top_k(scored, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def improved_graph_search(s, d):
    scored = G.weighted_graph_search(_query_entities(s, d), mentions(s, d), relations(s, d), entities(s, d), chunk_docs(s, d))
    return top_k(scored, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def hybrid_search(s, d):
    """The evaluation questions by their words and by the entities that they name,
    fused over the documents' names."""
    cases = table(s, d, "eval_cases").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    docs = table(s, d, "documents").where("doc_name IS NOT NULL").select("doc_id", "doc_name", "text")
    words = bm25_scores(docs, cases).join(docs.select("doc_id", "doc_name"), "doc_id").groupBy("query_id", F.col("doc_name").alias("doc_id")).agg(F.max("score").alias("score"))
    named = G.query_entities(cases, find_by_name(s, d).select("key", "entity_id"))
    near = G.graph_search(named, mentions(s, d), relations(s, d), entities(s, d), chunk_docs(s, d), entity_weight=0.6, near_weight=0.4)
    fused = reciprocal_rank_fusion([top_k(words, 10), top_k(near, 10)], 10)
    return fused.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def confidence_score(s, d):
    f = table(s, d, "field_values").where(F.coalesce(F.trim("value"), F.lit("")) != "").where(~F.lower(F.trim("value")).isin(S.PLACEHOLDERS))
    kinds = [(k, v) for k, fields in S.EXPECTED_FIELDS.items() for v in fields]
    expected = G.case_of(F.col("entity_type"), {k: len(v) for k, v in S.EXPECTED_FIELDS.items()}, F.lit(None).cast("int"))
    known = F.lit(False)
    for kind, field in kinds:
        known = known | ((F.col("entity_type") == kind) & (F.col("field_key") == field))
    filled = f.join(entities(s, d).select("entity_id", "entity_type"), "entity_id").where(known).groupBy("entity_id").agg(F.countDistinct("field_key").alias("filled"))
    rows = entities(s, d).join(filled, "entity_id", "left")
    score = F.when(expected.isNotNull(), F.coalesce("filled", F.lit(0)) / expected).otherwise(F.least(F.lit(1.0), F.col("mention_count") / 3.0))
    return rows.select("entity_id", F.round(score, 6).alias("confidence"))


def field_merge(s, d):
    rows = table(s, d, "field_values").where("entity_id IS NOT NULL")
    order = F.struct("extracted_at", "field_value_id")
    value = rows.where(F.coalesce("value", F.lit("")) != "").groupBy("entity_id", "field_key").agg(F.min_by("value", order).alias("value"))
    evidence = rows.select("entity_id", "field_key", F.explode_outer("evidence_chunk_ids").alias("c")).groupBy("entity_id", "field_key").agg(F.countDistinct("c").alias("n_evidence"))
    return evidence.join(value, ["entity_id", "field_key"], "left").select("entity_id", "field_key", "value", "n_evidence", F.round(F.least(F.lit(1.0), F.col("n_evidence") / 3), 6).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        entity_upsert, relation_upsert, familial_inverse, relation_constraints, mentions_index, entity_chunks, cooccurrence, adjacency, outgoing_relations, relation_breakdown,
        bfs_neighbors, find_by_name, alias_token_lookup, dangling_prune, delete_relation, merge_entities, unmerge_alias, chunk_tag_prefix, crosslink_entities, relation_seeded,
        query_entities, delete_entity, set_attributes, increment_mention, sync_evidence, graph_counts, graph_search, improved_graph_search, hybrid_search, confidence_score, field_merge,
    )
}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_INV = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (G.INVERSE | {x: x for x in G.SYMMETRIC}).items()) + " END"
_WEIGHT = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.RELATION_WEIGHTS.items()) + " ELSE 0.5 END"
_FOUND = f"""
fk AS (SELECT entity_id, mention_count, {norm('n')} AS key FROM (SELECT entity_id, mention_count, unnest(list_concat([name], coalesce(aliases, []))) AS n FROM entities)),
fn AS (SELECT key, max_by(entity_id, (mention_count, -entity_id)) AS entity_id FROM fk WHERE key <> '' GROUP BY 1),
ft AS (SELECT item_id AS query_id, [x FOR x IN regexp_split_to_array(lower(?), '\\s+') IF x <> ''] AS t FROM eval_cases),
fp AS (SELECT query_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) AS phrase FROM ft),
qe AS (SELECT DISTINCT query_id, entity_id FROM (SELECT query_id, {norm('phrase')} AS key FROM fp) JOIN fn USING (key)),"""
_SEARCH = f"""{_FOUND}
e1 AS (SELECT n.* FROM nb n SEMI JOIN entities e ON e.entity_id = n.neighbour_id),
d0 AS (SELECT DISTINCT query_id, entity_id FROM qe),
d1 AS (SELECT DISTINCT query_id, neighbour_id AS entity_id FROM d0 JOIN e1 ON node_id = d0.entity_id EXCEPT SELECT * FROM d0),
d2 AS (SELECT DISTINCT query_id, neighbour_id AS entity_id FROM d1 JOIN e1 ON node_id = d1.entity_id EXCEPT (SELECT * FROM d0 UNION SELECT * FROM d1)),
reach AS (SELECT *, 0 AS depth FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2),
gs AS (
  SELECT query_id, doc_id, min(depth) AS depth, max(CASE WHEN depth = 0 THEN confidence END) AS direct
  FROM reach JOIN entities USING (entity_id) JOIN men USING (entity_id) JOIN cd USING (chunk_id) GROUP BY 1, 2
),
g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, CASE WHEN depth = 0 THEN 0.5 * direct + 0.5 ELSE 0.25 + 0.5 / (depth + 1) END AS score FROM gs)),
ew AS (SELECT node_id, neighbour_id, max({_WEIGHT} * strength) AS w, any_value(confidence) AS c FROM adj JOIN entities ON entity_id = neighbour_id WHERE node_id <> neighbour_id AND confidence >= 0.5 GROUP BY 1, 2),
w0 AS (SELECT query_id, entity_id, confidence AS path FROM d0 JOIN entities USING (entity_id)),
w1 AS (SELECT query_id, neighbour_id AS entity_id, max(path * c * w / 2) AS path FROM w0 JOIN ew ON node_id = w0.entity_id ANTI JOIN w0 x ON x.query_id = w0.query_id AND x.entity_id = neighbour_id GROUP BY 1, 2 HAVING round(max(path * c * w / 2), 9) >= 0.05),
w2 AS (SELECT w1.query_id, neighbour_id AS entity_id, max(path * c * w / 3) AS path FROM w1 JOIN ew ON node_id = w1.entity_id
  ANTI JOIN w0 x ON x.query_id = w1.query_id AND x.entity_id = neighbour_id ANTI JOIN w1 y ON y.query_id = w1.query_id AND y.entity_id = neighbour_id GROUP BY 1, 2 HAVING round(max(path * c * w / 3), 9) >= 0.05),
wr AS (SELECT query_id, entity_id, path * path AS score, 0 AS depth FROM w0 UNION ALL SELECT *, 1 FROM w1 UNION ALL SELECT *, 2 FROM w2),
g2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, max(score / (1 + 0.3 * depth)) AS score FROM wr JOIN men USING (entity_id) JOIN cd USING (chunk_id) GROUP BY 1, 2))"""
_BOTH = "concat_ws(' ', question, passage)"
_TOP = "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM {} WHERE rank <= 10"
_SIDE = "CASE WHEN k.kind IS NULL THEN least(1.0, e.mention_count / 3.0) ELSE coalesce(f.filled, 0) / k.n END"
_EXPECTED = ", ".join(f"('{k}', '{v}')" for k, fields in S.EXPECTED_FIELDS.items() for v in fields)

ORACLE = {
    "entity_upsert": f"""WITH k AS (SELECT *, {norm('name')} AS norm, row_number() OVER (PARTITION BY {norm('name')}, entity_type ORDER BY created_at NULLS FIRST, entity_id) AS rn FROM entities),
al AS (SELECT norm, entity_type, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM (SELECT norm, entity_type, unnest(aliases) AS a FROM k) GROUP BY 1, 2)
, ek AS (SELECT norm, entity_type, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS evidence FROM (SELECT DISTINCT norm, entity_type, unnest(evidence) AS c FROM k) GROUP BY 1, 2)
SELECT k.norm, k.entity_type, max(CASE WHEN rn = 1 THEN gender END) AS gender, max(CASE WHEN rn = 1 THEN schema_type END) AS schema_type, coalesce(any_value(ek.evidence), '') AS evidence, max(CASE WHEN rn = 1 THEN entity_id END) AS entity_id, max(CASE WHEN rn = 1 THEN name END) AS name, CAST(sum(mention_count) AS BIGINT) AS mention_count,
  max_by(coalesce(description, ''), (length(coalesce(description, '')), coalesce(description, ''))) AS description, coalesce(any_value(al.aliases), '') AS aliases
FROM k LEFT JOIN al USING (norm, entity_type) LEFT JOIN ek USING (norm, entity_type) GROUP BY 1, 2""",
    "relation_upsert": f"WITH {REL} SELECT src_id, dst_id, relation_type, CAST(n_evidence AS INTEGER) AS n_evidence, round(strength, 6) AS strength FROM rel",
    "familial_inverse": f"""WITH o AS (SELECT src_id, dst_id, relation_type, evidence_chunk_ids AS ev FROM relations WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND relation_type IN {_in(G.FAMILIAL)}),
b AS (SELECT * FROM o UNION ALL SELECT dst_id, src_id, {_INV}, ev FROM o),
u AS (SELECT DISTINCT src_id, dst_id, relation_type, unnest(ev) AS c FROM b)
SELECT b.src_id, b.dst_id, b.relation_type, CAST(count(u.c) AS INTEGER) AS n_evidence FROM (SELECT DISTINCT src_id, dst_id, relation_type FROM b) b LEFT JOIN u USING (src_id, dst_id, relation_type) GROUP BY 1, 2, 3""",
    "relation_constraints": f"""WITH {REL} SELECT relation_type, count(*) AS n FROM rel LEFT JOIN entities s ON s.entity_id = src_id LEFT JOIN entities t ON t.entity_id = dst_id
WHERE NOT (relation_type IN ('located_in', 'works_at') AND coalesce(t.entity_type = 'CreativeWork', false))
  AND NOT (relation_type IN {_in(G.FAMILIAL)} AND (coalesce(s.entity_type <> 'Person', false) OR coalesce(t.entity_type <> 'Person', false))) GROUP BY 1""",
    "mentions_index": f"WITH {MEN} SELECT chunk_id, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY entity_id) AS entity_ids FROM men GROUP BY 1",
    "entity_chunks": f"WITH {MEN} SELECT entity_id, count(*) AS n_chunks, min(chunk_id) AS first, max(chunk_id) AS last FROM men GROUP BY 1",
    "cooccurrence": f"WITH {MEN} SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS n_chunks FROM men x JOIN men y ON x.chunk_id = y.chunk_id AND x.entity_id < y.entity_id GROUP BY 1, 2",
    "adjacency": f"WITH {REL} SELECT node_id, count(*) AS n_edges, count(DISTINCT neighbour_id) AS n_neighbours, round(sum(strength), 6) AS total_strength FROM adj GROUP BY 1",
    "outgoing_relations": f"WITH {REL} SELECT src_id, relation_type, count(*) AS n, CAST(sum(n_evidence) AS BIGINT) AS n_evidence FROM rel GROUP BY 1, 2",
    "relation_breakdown": f"WITH {REL} SELECT relation_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share_pct FROM rel GROUP BY 1",
    "bfs_neighbors": f"""WITH {REL}, s AS (SELECT entity_id FROM entities WHERE entity_type = 'Event'),
h1 AS (SELECT DISTINCT neighbour_id AS entity_id FROM s JOIN nb ON node_id = s.entity_id EXCEPT SELECT entity_id FROM s),
h2 AS (SELECT DISTINCT neighbour_id AS entity_id FROM h1 JOIN nb ON node_id = h1.entity_id EXCEPT (SELECT entity_id FROM s UNION SELECT entity_id FROM h1))
SELECT entity_id, 0 AS depth FROM s UNION ALL SELECT entity_id, 1 FROM h1 UNION ALL SELECT entity_id, 2 FROM h2""",
    "find_by_name": f"""WITH k AS (SELECT entity_id, mention_count, {norm('n')} AS key FROM (SELECT entity_id, mention_count, unnest(list_concat([name], coalesce(aliases, []))) AS n FROM entities))
SELECT key, max_by(entity_id, (mention_count, -entity_id)) AS entity_id, count(DISTINCT entity_id) AS n_entities FROM k WHERE key <> '' GROUP BY 1""",
    "alias_token_lookup": r"""WITH w AS (SELECT entity_id, unnest(regexp_split_to_array(lower(a), '\s+')) AS raw FROM (SELECT entity_id, unnest(aliases) AS a FROM entities)),
b AS (SELECT entity_id, raw AS token FROM w UNION SELECT entity_id, regexp_replace(raw, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') FROM w)
SELECT token, count(*) AS n_entities, min(entity_id) AS first_id FROM b WHERE token <> '' GROUP BY 1""",
    "dangling_prune": f"WITH {REL} SELECT src_id, dst_id, relation_type FROM rel SEMI JOIN entities a ON a.entity_id = src_id SEMI JOIN entities b ON b.entity_id = dst_id",
    "delete_relation": f"""WITH {REL}, k AS (SELECT src_id, dst_id, relation_type FROM rel WHERE relation_type = 'parent_of' OR relation_type = 'spouse_of' AND src_id < dst_id),
b AS (SELECT * FROM k UNION SELECT dst_id, src_id, {_INV} FROM k)
SELECT src_id, dst_id, relation_type FROM rel ANTI JOIN b USING (src_id, dst_id, relation_type)""",
    "chunk_tag_prefix": f"""WITH {MEN}, r AS (SELECT chunk_id, name, row_number() OVER (PARTITION BY chunk_id ORDER BY mention_count DESC, entity_id) AS rn FROM men JOIN entities USING (entity_id))
SELECT chunk_id, string_agg('[' || name || ']', ' ' ORDER BY rn) AS tags FROM r WHERE rn <= 3 GROUP BY 1""",
    "crosslink_entities": f"WITH {MEN} SELECT entity_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT chunk_id) AS n_chunks FROM men JOIN cd USING (chunk_id) GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    "relation_seeded": f"""WITH {REL}, pl AS (SELECT chunk_id, min(chunk_index) AS place FROM chunks GROUP BY 1),
z AS (SELECT DISTINCT src_id, dst_id, relation_type FROM ev JOIN pl ON pl.chunk_id = ev.c WHERE place = 0)
SELECT relation_type, count(*) FILTER (WHERE z.src_id IS NOT NULL) AS n_seeded, count(*) AS n FROM rel LEFT JOIN z USING (src_id, dst_id, relation_type) GROUP BY 1""",
    "merge_entities": """WITH RECURSIVE a AS (SELECT entity_id AS k, unnest(aliases) AS name FROM entities),
p AS (SELECT k, e.entity_id AS x FROM a JOIN entities e USING (name) WHERE k <> e.entity_id),
b AS (SELECT k, x FROM p UNION SELECT x, k FROM p),
reach(u, v) AS (SELECT entity_id, entity_id FROM entities UNION SELECT r.u, b.x FROM reach r JOIN b ON b.k = r.v),
comp AS (SELECT u, min(v) AS c FROM reach GROUP BY 1),
keep AS (SELECT c, max_by(entity_id, (mention_count, -entity_id)) AS keep FROM comp JOIN entities ON entity_id = u GROUP BY 1),
m AS (SELECT keep, entity_id, name, mention_count, description, coalesce(aliases, []) AS aliases, coalesce(evidence, []) AS evidence FROM entities JOIN comp ON u = entity_id JOIN keep USING (c)),
al AS (SELECT keep, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM (SELECT keep, unnest(CASE WHEN keep = entity_id THEN aliases ELSE list_append(aliases, name) END) AS a FROM m) GROUP BY 1),
vi AS (SELECT keep, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS evidence FROM (SELECT DISTINCT keep, unnest(evidence) AS x FROM m) GROUP BY 1),
t AS (SELECT keep, CAST(sum(mention_count) AS BIGINT) AS mention_count, CAST(max(length(coalesce(description, ''))) AS INTEGER) AS description_length FROM m GROUP BY 1)
SELECT e.entity_id, e.name, t.mention_count, t.description_length, e.gender, e.schema_type, round(e.confidence, 6) AS confidence, CAST(len(e.embedding) AS INTEGER) AS dim, e.first_chunk_id, coalesce(al.aliases, '') AS aliases, coalesce(vi.evidence, '') AS evidence
FROM t JOIN entities e ON e.entity_id = t.keep LEFT JOIN al ON al.keep = t.keep LEFT JOIN vi ON vi.keep = t.keep""",
    "unmerge_alias": """WITH f AS (SELECT *, list_sort(list_distinct(aliases))[1] AS alias, len(list_distinct(aliases)) AS n FROM entities WHERE len(aliases) > 0),
h AS (SELECT *, sha256(lower(alias) || '::' || entity_type) AS x FROM f),
i AS (SELECT *, CAST(CAST('0x' || x[15:16] || x[13:14] || x[11:12] || x[9:10] || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS UBIGINT) AS HUGEINT) AS big FROM h)
SELECT entity_id, name, greatest(0, mention_count - 1) AS mention_count, CAST(n - 1 AS INTEGER) AS n_aliases FROM f
UNION ALL SELECT CAST(CASE WHEN big >= 9223372036854775808 THEN big - 18446744073709551616 ELSE big END AS BIGINT), alias, 1, 0 FROM i""",
    "graph_search": f"WITH {REL}, {MEN}, {_SEARCH.replace('?', _BOTH)} " + _TOP.format("g1"),
    "improved_graph_search": f"WITH {REL}, {MEN}, {_SEARCH.replace('?', _BOTH)} " + _TOP.format("g2"),
    "query_entities": f"WITH {_FOUND.replace('?', _BOTH).rstrip(',')} SELECT query_id, entity_id FROM qe",
    "hybrid_search": f"""WITH {REL}, {MEN}, {_SEARCH.replace('?', "coalesce(question, '')").replace('0.5 * direct + 0.5', '0.6 * direct + 0.4').replace('0.25 + 0.5 /', '0.3 + 0.4 /')},
nd AS (SELECT doc_id, doc_name, text FROM documents WHERE doc_name IS NOT NULL),
tok AS (SELECT doc_id, unnest([x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '\\s+') IF x <> '']) AS term FROM nd),
size AS (SELECT d.doc_id, count(t.term) AS len FROM nd d LEFT JOIN tok t USING (doc_id) GROUP BY 1), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest([x FOR x IN regexp_split_to_array(lower(question), '\\s+') IF x <> '']) AS term FROM eval_cases) GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, sum(qtf * ln(1 + ((SELECT count(*) FROM nd) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM size)))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id) GROUP BY 1, 2),
bn AS (SELECT query_id, doc_name AS doc_id, max(score) AS score FROM bm JOIN nd USING (doc_id) GROUP BY 1, 2),
b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bn),
fu AS (SELECT query_id, doc_id, sum(1 / (60.0 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM b1 WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, rank FROM g1 WHERE rank <= 10) GROUP BY 1, 2),
g3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM fu) """ + _TOP.format("g3"),
    "delete_entity": f"""WITH {REL}, {MEN}, g AS (SELECT target_id FROM deletions WHERE target_kind = 'entity') SELECT (SELECT count(*) FROM entities WHERE entity_id NOT IN (SELECT * FROM g)) AS n_entities,
(SELECT count(*) FROM rel WHERE src_id NOT IN (SELECT * FROM g) AND dst_id NOT IN (SELECT * FROM g)) AS n_relations, (SELECT count(*) FROM men WHERE entity_id NOT IN (SELECT * FROM g)) AS n_mentions""",
    "set_attributes": "SELECT entity_id, CASE WHEN entity_id % 8 = 0 THEN 'Thing' ELSE schema_type END AS schema_type, CASE WHEN entity_id % 4 = 0 AND name IS NOT NULL THEN 'About ' || name ELSE description END AS description, mention_count FROM entities",
    "increment_mention": "SELECT e.entity_id, e.mention_count + coalesce(n, 0) AS mention_count FROM entities e LEFT JOIN (SELECT dst_id, count(*) AS n FROM relations GROUP BY 1) ON dst_id = e.entity_id",
    "sync_evidence": f"WITH {MEN} SELECT e.entity_id, coalesce(string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id), '') AS evidence FROM entities e LEFT JOIN men USING (entity_id) GROUP BY 1",
    "graph_counts": f"WITH {REL} SELECT (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM rel) AS n_relations",
    "confidence_score": f"""WITH x(kind, field) AS (VALUES {_EXPECTED}), k AS (SELECT kind, count(*) AS n FROM x GROUP BY 1),
f AS (SELECT v.entity_id, count(DISTINCT field_key) AS filled FROM field_values v JOIN entities e USING (entity_id) JOIN x ON x.kind = e.entity_type AND x.field = field_key
  WHERE coalesce(trim(value), '') <> '' AND lower(trim(value)) NOT IN {_in(S.PLACEHOLDERS)} GROUP BY 1)
SELECT e.entity_id, round({_SIDE}, 6) AS confidence FROM entities e LEFT JOIN k ON k.kind = e.entity_type LEFT JOIN f USING (entity_id)""",
    "field_merge": """WITH v AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field_key ORDER BY extracted_at NULLS FIRST, field_value_id) AS rn FROM field_values WHERE entity_id IS NOT NULL AND coalesce(value, '') <> ''),
e AS (SELECT entity_id, field_key, count(DISTINCT c) AS n FROM (SELECT entity_id, field_key, unnest(evidence_chunk_ids) AS c FROM field_values) GROUP BY 1, 2)
SELECT k.entity_id, k.field_key, v.value, coalesce(e.n, 0) AS n_evidence, round(least(1.0, coalesce(e.n, 0) / 3), 6) AS confidence
FROM (SELECT DISTINCT entity_id, field_key FROM field_values WHERE entity_id IS NOT NULL) k LEFT JOIN v ON v.entity_id = k.entity_id AND v.field_key IS NOT DISTINCT FROM k.field_key AND rn = 1
LEFT JOIN e ON e.entity_id = k.entity_id AND e.field_key IS NOT DISTINCT FROM k.field_key""",
}
