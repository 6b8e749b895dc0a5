"""The graph's tables out of the delivered ones, in Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.common import table
from quillgraph.operators import graph as G


def entities(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "entities")


def relations(s: SparkSession, d: str) -> DataFrame:
    return G.upsert_relations(table(s, d, "relations").select("src_id", "dst_id", "relation_type", F.col("evidence_chunk_ids").alias("evidence")))


def mentions(s: SparkSession, d: str) -> DataFrame:
    return G.mentions(entities(s, d))


def chunks(s: SparkSession, d: str) -> DataFrame:
    """One row per chunk_id, the earliest delivery."""
    return table(s, d, "chunks").groupBy("chunk_id").agg(*(F.min_by(c, "ingested_at").alias(c) for c in ("doc_name", "chunk_index", "text", "page_num", "section_name", "skip_extraction", "section_type")), F.min("ingested_at").alias("ingested_at"))


def chunk_docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", F.col("doc_name").alias("doc_id")).distinct()


REL = """
ev AS (SELECT DISTINCT src_id, dst_id, relation_type, unnest(evidence_chunk_ids) AS c FROM relations WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND relation_type IS NOT NULL),
rel AS (
  SELECT r.src_id, r.dst_id, r.relation_type, count(e.c) AS n_evidence, least(1.0, greatest(1, count(e.c)) / 10) AS strength
  FROM (SELECT DISTINCT src_id, dst_id, relation_type FROM relations WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND relation_type IS NOT NULL) r
  LEFT JOIN ev e USING (src_id, dst_id, relation_type) GROUP BY 1, 2, 3
),
adj AS (SELECT src_id AS node_id, dst_id AS neighbour_id, relation_type, strength FROM rel UNION ALL SELECT dst_id, src_id, relation_type, strength FROM rel),
nb AS (SELECT DISTINCT node_id, neighbour_id FROM adj WHERE node_id <> neighbour_id)"""
MEN = """
men AS (SELECT DISTINCT c AS chunk_id, entity_id FROM (SELECT entity_id, unnest(evidence) AS c FROM entities UNION ALL SELECT entity_id, first_chunk_id FROM entities) WHERE c IS NOT NULL),
cd AS (SELECT DISTINCT chunk_id, doc_name AS doc_id FROM chunks)"""
CHUNK = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) AS rn FROM chunks) WHERE rn = 1)"


def norm(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
