"""Queries of memory strength and of the consistency rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.common import table
from quillgraph.functions import scalar as S
from quillgraph.operators import graph as G
from quillgraph.operators import memory as M
from quillgraph.operators import sanitize as Z
from quillgraph.plans.base import CHUNK, MEN, REL, chunks, entities, mentions, relations

DAYS = [0, 7, 14, 30, 60, 90, 180, 365]
NOW = "2025-07-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _times(s, d):
    return table(s, d, "chunks").groupBy("chunk_id").agg(F.min("ingested_at").alias("ingested_at"))


def _nodes(s, d):
    return M.memory_nodes(entities(s, d), mentions(s, d), _times(s, d), _now())


def memory_nodes(s, d):
    return _nodes(s, d).select("entity_id", "reinforcement", "strength", "state")


def memory_edges(s, d):
    return M.memory_edges(relations(s, d), _times(s, d), _now()).select("src_id", "dst_id", "relation_type", "reinforcement", "strength", "state")


def memory_chunks(s, d):
    return M.memory_chunks(_times(s, d), mentions(s, d), _now()).select("chunk_id", "reinforcement", "strength", "state")


def state_histogram(s, d):
    nodes = _nodes(s, d).select(F.lit("node").alias("kind"), "state", "strength")
    edges = M.memory_edges(relations(s, d), _times(s, d), _now()).select(F.lit("edge").alias("kind"), "state", "strength")
    return nodes.unionByName(edges).groupBy("kind", "state").agg(F.count("*").alias("n"), F.round(F.avg("strength"), 5).alias("avg_strength"))


def forgetting_simulation(s, d):
    return M.forgetting_series(entities(s, d), DAYS)


def dormant_prune(s, d):
    kept, rest = M.prune_dormant(_nodes(s, d), relations(s, d))
    return kept.agg(F.count("*").alias("n_entities")).crossJoin(rest.agg(F.count("*").alias("n_relations")))


def consolidation_cycles(s, d):
    history = M.run_cycles(entities(s, d), relations(s, d), mentions(s, d), _times(s, d), _now())
    return s.createDataFrame([(h["cycle"], h["entities_before"], h["entities_after"], h["relations_after"], h["merged"], h["converged"]) for h in history], "cycle int, entities_before long, entities_after long, relations_after long, merged long, converged boolean")


def cycle_convergence(s, d):
    rows = entities(s, d).groupBy(F.date_format("created_at", "yyyy-MM").alias("cycle")).agg((F.count_if(F.col("mention_count") > 3) / F.count("*")).alias("compression"))
    return M.convergence(rows.where("cycle IS NOT NULL"), 0.15).select("cycle", "mean_before", "converged")


def core_fact_inputs(s, d):
    return M.core_fact_inputs(_nodes(s, d), entities(s, d), relations(s, d)).select("rank", "entity_id", "name", "strength", "facts")


def top_strength(s, d):
    return _nodes(s, d).orderBy(F.desc("strength"), "entity_id").limit(25).select("entity_id", "strength", "state")


def compression_delta(s, d):
    e = entities(s, d)
    rows = e.agg(F.count("*").alias("before"), F.countDistinct(S.normalize_name(F.col("name"))).alias("after"))
    return rows.select("before", "after", F.round(S.relative_reduction(F.col("before"), F.col("after")), 6).alias("compression"))


def dedup_delta(s, d):
    rows = table(s, d, "relations").where("src_id IS NOT NULL AND dst_id IS NOT NULL").agg(F.count("*").alias("before"), F.countDistinct("src_id", "dst_id", "relation_type").alias("after"))
    return rows.select("before", "after", F.round(S.relative_reduction(F.col("before"), F.col("after")), 6).alias("reduction"))


def coverage_completeness(s, d):
    e = entities(s, d).select("entity_id")
    r = relations(s, d)
    valid = G.prune_dangling(r, e).agg(F.count("*").alias("valid"))
    covered = mentions(s, d).select("entity_id").distinct().join(e, "entity_id", "left_semi").agg(F.count("*").alias("covered"))
    rows = covered.crossJoin(e.agg(F.count("*").alias("expected"))).crossJoin(valid).crossJoin(r.agg(F.count("*").alias("relations")))
    return rows.select(F.round(F.col("covered") / F.col("expected"), 6).alias("entity_coverage"), F.round(F.col("valid") / F.col("relations"), 6).alias("relation_completeness"))


def sanitize_familial(s, d):
    return Z.drop_impersonal_familial(relations(s, d), entities(s, d)).select("src_id", "dst_id", "relation_type")


def sanitize_inverse(s, d):
    return Z.missing_inverses(relations(s, d)).select("src_id", "dst_id", "relation_type", F.size("evidence").alias("n_evidence"))


def sanitize_strength(s, d):
    return Z.shared_chunk_strength(relations(s, d), mentions(s, d)).select("src_id", "dst_id", "relation_type", F.round("strength", 6).alias("strength"))


def sanitize_gender(s, d):
    return Z.inferred_genders(entities(s, d).withColumn("description", F.concat_ws(" ", "description", F.when(F.pmod("entity_id", F.lit(2)) == 0, F.lit("He wrote.")))))


def sanitize_spouse(s, d):
    return Z.drop_same_gender_spouses(relations(s, d), entities(s, d)).where("relation_type = 'spouse_of'").select("src_id", "dst_id")


def sanitize_half_sibling(s, d):
    """Over all relations."""
    return Z.drop_superseded_half_siblings(relations(s, d)).select("src_id", "dst_id", "relation_type")


def sanitize_parent_paradox(s, d):
    """Over all relations, children turned to parents."""
    return Z.drop_parent_paradoxes(Z.children_turned(relations(s, d))).select("src_id", "dst_id", "relation_type")


def sanitize_type_mismatch(s, d):
    return Z.drop_type_mismatches(relations(s, d), entities(s, d)).groupBy("relation_type").agg(F.count("*").alias("n"))


def sanitize_stub(s, d):
    return Z.honorific_stubs(entities(s, d).withColumn("name", F.when(F.pmod("entity_id", F.lit(50)) == 0, "Mr. Dr").otherwise(F.col("name"))))


def purge_unseeded(s, d):
    first = entities(s, d).select(F.col("entity_id").alias("src_id"), "first_chunk_id")
    r = relations(s, d).join(first, "src_id", "left").withColumn("seeded", F.size("evidence") > 1)
    return Z.purge_unseeded_parents(r).where("relation_type IN ('parent_of', 'child_of')").select("src_id", "dst_id", "relation_type")


def maiden_name(s, d):
    return Z.maiden_name_candidates(relations(s, d), entities(s, d))


def running_mentions(s, d):
    day = F.to_date("ingested_at")
    rows = chunks(s, d).where("ingested_at IS NOT NULL").groupBy("doc_name", day.alias("day")).agg(F.count("*").alias("n"))
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy("doc_name").orderBy("day"))).select("doc_name", F.col("day").cast("string").alias("day"), "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        memory_nodes, memory_edges, memory_chunks, state_histogram, forgetting_simulation, dormant_prune, consolidation_cycles, cycle_convergence, core_fact_inputs, top_strength,
        compression_delta, dedup_delta, coverage_completeness, sanitize_familial, sanitize_inverse, sanitize_strength, sanitize_gender, sanitize_spouse, sanitize_half_sibling,
        sanitize_parent_paradox, sanitize_type_mismatch, sanitize_stub, purge_unseeded, maiden_name, running_mentions,
    )
}

_S = lambda r, days: f"exp(-({days}) / (30.0 * (1 + 1.5 * ln(1 + greatest(0, {r})))))"
_DAYS = lambda t: f"coalesce(greatest(0, date_diff('microsecond', {t}, TIMESTAMP '{NOW}') / 86400e6), 0)"
_STATE = lambda s: f"CASE WHEN {s} >= 0.66 THEN 'long_term' WHEN {s} >= 0.33 THEN 'short_term' ELSE 'dormant' END"
_MEM = f"""
ct AS (SELECT chunk_id, min(ingested_at) AS t FROM chunks GROUP BY 1),
ns AS (SELECT entity_id, max(t) AS t FROM men JOIN ct USING (chunk_id) GROUP BY 1),
nd AS (SELECT entity_id, mention_count AS reinforcement, {_S('mention_count', _DAYS('t'))} AS s FROM entities LEFT JOIN ns USING (entity_id)),
node AS (SELECT entity_id, reinforcement, round(s, 6) AS strength, {_STATE('s')} AS state FROM nd),
es AS (SELECT src_id, dst_id, relation_type, max(t) AS t FROM ev JOIN ct ON ct.chunk_id = ev.c GROUP BY 1, 2, 3),
ed AS (SELECT src_id, dst_id, relation_type, greatest(1, n_evidence) AS reinforcement, {_S('greatest(1, n_evidence)', _DAYS('t'))} AS s FROM rel LEFT JOIN es USING (src_id, dst_id, relation_type)),
edge AS (SELECT src_id, dst_id, relation_type, reinforcement, round(s, 6) AS strength, {_STATE('s')} AS state FROM ed)"""
_W = f"WITH {REL}, {MEN}, {_MEM} "
_IN = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
_INV = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (G.INVERSE | {x: x for x in G.SYMMETRIC}).items()) + " END"
_EDGE = r"[^\p{L}\p{M}\p{N}_]"
_HAS = lambda t, words: " + ".join(f"CAST(regexp_matches(lower({t}), '(^|{_EDGE}){w}($|{_EDGE})') AS INTEGER)" for w in words)

ORACLE = {
    "memory_nodes": _W + "SELECT entity_id, reinforcement, strength, state FROM node",
    "memory_edges": _W + "SELECT src_id, dst_id, relation_type, reinforcement, strength, state FROM edge",
    "memory_chunks": f"WITH {MEN}, ct AS (SELECT chunk_id, min(ingested_at) AS t FROM chunks GROUP BY 1), n AS (SELECT chunk_id, count(*) AS n FROM men GROUP BY 1), x AS (SELECT chunk_id, greatest(1, coalesce(n, 0)) AS reinforcement, {_S('greatest(1, coalesce(n, 0))', _DAYS('t'))} AS s FROM ct LEFT JOIN n USING (chunk_id)) SELECT chunk_id, reinforcement, round(s, 6) AS strength, {_STATE('s')} AS state FROM x",
    "state_histogram": _W + "SELECT kind, state, count(*) AS n, round(avg(strength), 5) AS avg_strength FROM (SELECT 'node' AS kind, state, strength FROM node UNION ALL SELECT 'edge', state, strength FROM edge) GROUP BY 1, 2",
    "forgetting_simulation": f"""WITH x AS (SELECT day, {_S('greatest(1, mention_count)', 'day')} AS s FROM entities CROSS JOIN (SELECT unnest({DAYS}) AS day)), y AS (SELECT *, {_STATE('s')} AS state FROM x)
SELECT day, round(avg(s), 4) AS avg_strength, round(100.0 * count(*) FILTER (WHERE state = 'long_term') / count(*), 2) AS long_term_pct, round(100.0 * count(*) FILTER (WHERE state = 'short_term') / count(*), 2) AS short_term_pct, round(100.0 * count(*) FILTER (WHERE state = 'dormant') / count(*), 2) AS dormant_pct FROM y GROUP BY 1""",
    "dormant_prune": _W + """, dead AS (SELECT entity_id FROM node WHERE state = 'dormant')
SELECT (SELECT count(*) FROM node WHERE state <> 'dormant') AS n_entities, (SELECT count(*) FROM rel WHERE src_id NOT IN (SELECT entity_id FROM dead) AND dst_id NOT IN (SELECT entity_id FROM dead)) AS n_relations""",
    "cycle_convergence": """WITH c AS (SELECT strftime(created_at, '%Y-%m') AS cycle, count(*) FILTER (WHERE mention_count > 3) / count(*) AS compression FROM entities WHERE created_at IS NOT NULL GROUP BY 1),
w AS (SELECT cycle, avg(compression) OVER b AS m, count(compression) OVER b AS n FROM c WINDOW b AS (ORDER BY cycle ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT cycle, round(m, 6) AS mean_before, coalesce(n = 3 AND m < 0.15, false) AS converged FROM w""",
    "core_fact_inputs": _W + """, top AS (SELECT *, row_number() OVER (ORDER BY strength DESC, entity_id) AS rank FROM node QUALIFY rank <= 20),
o AS (SELECT src_id, relation_type || ' ' || name AS f, row_number() OVER (PARTITION BY src_id ORDER BY relation_type, dst_id) AS r FROM rel JOIN entities ON entity_id = dst_id WHERE src_id IN (SELECT entity_id FROM top))
SELECT CAST(rank AS INTEGER) AS rank, entity_id, name, strength, string_agg(f, '; ' ORDER BY r) AS facts FROM top JOIN entities USING (entity_id) JOIN o ON src_id = entity_id WHERE r <= 8 GROUP BY ALL""",
    "top_strength": _W + "SELECT entity_id, strength, state FROM node ORDER BY strength DESC, entity_id LIMIT 25",
    "compression_delta": rf"SELECT count(*) AS before, count(DISTINCT lower(trim(regexp_replace(name, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))) AS after, round((count(*) - count(DISTINCT lower(trim(regexp_replace(name, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))))) / count(*), 6) AS compression FROM entities",
    "dedup_delta": "WITH x AS (SELECT count(*) AS b, count(DISTINCT (src_id, dst_id, relation_type)) AS a FROM relations WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND relation_type IS NOT NULL), y AS (SELECT count(*) AS b FROM relations WHERE src_id IS NOT NULL AND dst_id IS NOT NULL) SELECT y.b AS before, a AS after, round((y.b - a) / y.b, 6) AS reduction FROM x, y",
    "coverage_completeness": f"""WITH {REL}, {MEN} SELECT round((SELECT count(DISTINCT entity_id) FROM men) / (SELECT count(*) FROM entities), 6) AS entity_coverage,
round((SELECT count(*) FROM rel SEMI JOIN entities a ON a.entity_id = src_id SEMI JOIN entities b ON b.entity_id = dst_id) / (SELECT count(*) FROM rel), 6) AS relation_completeness""",
    "sanitize_familial": f"WITH {REL}, o AS (SELECT entity_id FROM entities WHERE entity_type <> 'Person') SELECT src_id, dst_id, relation_type FROM rel WHERE NOT (relation_type IN {_IN(G.FAMILIAL)} AND (src_id IN (SELECT * FROM o) OR dst_id IN (SELECT * FROM o)))",
    "sanitize_inverse": f"""WITH {REL}, i AS (SELECT dst_id AS src_id, src_id AS dst_id, {_INV} AS relation_type, n_evidence, src_id AS os, dst_id AS od, relation_type AS ot FROM rel WHERE relation_type IN {_IN(G.FAMILIAL)}),
m AS (SELECT i.* FROM i ANTI JOIN rel USING (src_id, dst_id, relation_type))
SELECT m.src_id, m.dst_id, m.relation_type, CAST(count(DISTINCT e.c) AS INTEGER) AS n_evidence FROM m LEFT JOIN ev e ON e.src_id = os AND e.dst_id = od AND e.relation_type = ot GROUP BY 1, 2, 3""",
    "sanitize_strength": f"""WITH {REL}, {MEN}, p AS (SELECT DISTINCT src_id, dst_id FROM rel), n AS (SELECT src_id, dst_id, count(*) AS n FROM p JOIN men a ON a.entity_id = src_id JOIN men b ON b.entity_id = dst_id AND b.chunk_id = a.chunk_id GROUP BY 1, 2)
SELECT src_id, dst_id, relation_type, round(CASE WHEN n > 0 THEN least(1.0, n / 10) ELSE least(1.0, greatest(0.1, n_evidence / 10)) END, 6) AS strength FROM rel LEFT JOIN n USING (src_id, dst_id)""",
    "sanitize_gender": f"""WITH e AS (SELECT entity_id, concat_ws(' ', description, CASE WHEN entity_id % 2 = 0 THEN 'He wrote.' END) AS t FROM entities WHERE entity_type = 'Person' AND coalesce(gender, 'unknown') IN ('unknown', '')),
c AS (SELECT entity_id, {_HAS('t', ['he', 'him', 'his', 'himself'])} AS m, {_HAS('t', ['she', 'her', 'hers', 'herself'])} AS f FROM e)
SELECT entity_id, CASE WHEN m > f THEN 'Male' ELSE 'Female' END AS gender FROM c WHERE m <> f""",
    "sanitize_spouse": f"WITH {REL} SELECT src_id, dst_id FROM rel LEFT JOIN entities a ON a.entity_id = src_id LEFT JOIN entities b ON b.entity_id = dst_id WHERE relation_type = 'spouse_of' AND NOT coalesce(lower(a.gender) IN ('male', 'female') AND lower(a.gender) = lower(b.gender), false)",
    "sanitize_half_sibling": f"""WITH {REL}, f AS (SELECT src_id, dst_id FROM rel WHERE relation_type = 'sibling_of' UNION SELECT dst_id, src_id FROM rel WHERE relation_type = 'sibling_of')
SELECT src_id, dst_id, relation_type FROM rel WHERE relation_type <> 'half_sibling_of' UNION ALL SELECT src_id, dst_id, relation_type FROM rel ANTI JOIN f USING (src_id, dst_id) WHERE relation_type = 'half_sibling_of'""",
    "sanitize_parent_paradox": f"""WITH {REL}, p AS (SELECT src_id, dst_id FROM rel WHERE relation_type = 'parent_of' UNION SELECT dst_id, src_id FROM rel WHERE relation_type = 'child_of'),
e AS (SELECT src_id, dst_id, c FROM ev WHERE relation_type = 'parent_of' UNION SELECT dst_id, src_id, c FROM ev WHERE relation_type = 'child_of'),
w AS (SELECT p.src_id, p.dst_id, count(e.c) AS n FROM p LEFT JOIN e USING (src_id, dst_id) GROUP BY 1, 2), g AS (SELECT *, least(1.0, greatest(1, n) / 10) AS strength FROM w),
bad AS (SELECT a.src_id, a.dst_id FROM g a JOIN g b ON b.src_id = a.dst_id AND b.dst_id = a.src_id WHERE a.strength <= b.strength)
SELECT src_id, dst_id, 'parent_of' AS relation_type FROM g ANTI JOIN bad USING (src_id, dst_id) UNION ALL SELECT src_id, dst_id, relation_type FROM rel WHERE relation_type NOT IN ('parent_of', 'child_of')""",
    "sanitize_type_mismatch": f"WITH {REL} SELECT relation_type, count(*) AS n FROM rel LEFT JOIN entities ON entity_id = dst_id WHERE NOT (relation_type IN ('located_in', 'works_at', 'lived_in') AND coalesce(entity_type IN ('Person', 'CreativeWork', 'Work'), false)) GROUP BY 1",
    "sanitize_stub": "SELECT entity_id, 'Mr. Dr' AS name FROM entities WHERE entity_id % 50 = 0",
    "purge_unseeded": f"""WITH {REL}, l AS (SELECT *, n_evidence > 1 AS seeded FROM rel WHERE relation_type IN ('parent_of', 'child_of')), x AS (SELECT src_id, dst_id, relation_type FROM l WHERE NOT seeded AND src_id IN (SELECT src_id FROM l WHERE seeded)),
k AS (SELECT * FROM x UNION SELECT dst_id, src_id, CASE relation_type WHEN 'parent_of' THEN 'child_of' ELSE 'parent_of' END FROM x) SELECT src_id, dst_id, relation_type FROM l ANTI JOIN k USING (src_id, dst_id, relation_type)""",
    "maiden_name": rf"""WITH {REL}, p AS (SELECT entity_id, lower(gender) AS g, regexp_split_to_array(lower(trim(name)), '\s+') AS w FROM entities WHERE entity_type = 'Person' AND name IS NOT NULL),
x AS (SELECT a.entity_id AS ai, b.entity_id AS bi, coalesce(a.g = 'female', false) AS af, coalesce(b.g = 'female', false) AS bf, a.w AS aw, b.w AS bw FROM rel JOIN p a ON a.entity_id = src_id JOIN p b ON b.entity_id = dst_id WHERE relation_type = 'spouse_of'),
y AS (SELECT CASE WHEN af THEN ai ELSE bi END AS wife_id, CASE WHEN af THEN aw[1] ELSE bw[1] END AS f, CASE WHEN af THEN bw[-1] ELSE aw[-1] END AS s FROM x WHERE af <> bf)
SELECT DISTINCT wife_id, p.entity_id AS candidate_id FROM y JOIN p ON p.w[1] = f WHERE p.entity_id <> wife_id AND p.w[-1] <> s""",
    "running_mentions": f"WITH {CHUNK}, r AS (SELECT doc_name, CAST(ingested_at AS DATE) AS day, count(*) AS n FROM one WHERE ingested_at IS NOT NULL GROUP BY 1, 2) SELECT doc_name, CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER (PARTITION BY doc_name ORDER BY day) AS BIGINT) AS total FROM r",
}
