"""Queries p2 and p3: orphan references and full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.common import table
from quillgraph.operators.hierarchy import full_hierarchies
from quillgraph.operators.orphans import Reference, Source, orphan_cascade, orphan_report

REFERENCES = [
    Reference("relations", "src_id", "entities"),
    Reference("relations", "dst_id", "entities"),
    Reference("relations", "evidence_chunk_ids", "chunks"),
    Reference("field_values", "evidence_chunk_ids", "chunks"),
]
#: Further foreign keys down which orphans are inherited.
INHERITED = [Reference("field_values", "entity_id", "entities"), Reference("entities", "first_chunk_id", "chunks")]
KINDS = {"entities": "entity", "chunks": "chunk"}

# Hierarchy, relation type, and whether the source is below the target.
HIERARCHICAL = [
    ("part_of", "part_of", True),
    ("part_of", "contains", False),
    ("child_of", "child_of", True),
    ("child_of", "parent_of", False),
    ("subtype_of", "subtype_of", True),
]


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {
        "relations": Source(table(spark, sf_dir, "relations"), "relation_id", "extracted_at"),
        "field_values": Source(table(spark, sf_dir, "field_values"), "field_value_id", "extracted_at"),
        "entities": Source(table(spark, sf_dir, "entities"), "entity_id", "created_at"),
        "chunks": Source(table(spark, sf_dir, "chunks"), "chunk_id", "ingested_at"),
    }
    return orphan_cascade(sources, REFERENCES + INHERITED, KINDS, table(spark, sf_dir, "deletions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct orphan references of the four columns of problem 2."""
    found = _cascade(spark, sf_dir).where(~F.col("inherited"))
    asked = [(F.col("table_name") == r.table) & (F.col("column_name") == r.column) for r in REFERENCES]
    return found.where(asked[0] | asked[1] | asked[2] | asked[3]).select("table_name", "column_name", "record_id", "target_id", "reason", "period")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans of all foreign keys per table, column, period and reason."""
    return orphan_report(_cascade(spark, sf_dir))


def hierarchical_links(relations: DataFrame) -> DataFrame:
    """``(hierarchy, child, parent)`` of the relations of the hierarchical types."""
    hierarchy, below = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, kind, source_below in HIERARCHICAL:
        hierarchy = F.when(F.col("relation_type") == kind, name).otherwise(hierarchy)
        below = F.when(F.col("relation_type") == kind, source_below).otherwise(below)
    rows = relations.where(F.col("relation_type").isin(*(kind for _, kind, _ in HIERARCHICAL)))
    return rows.select(
        hierarchy.alias("hierarchy"),
        F.when(below, F.col("src_id")).otherwise(F.col("dst_id")).alias("child"),
        F.when(below, F.col("dst_id")).otherwise(F.col("src_id")).alias("parent"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth, path, state and descendants of every node of the three hierarchies."""
    return full_hierarchies(hierarchical_links(table(spark, sf_dir, "relations")))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found}

_REFS = """
refs AS (
  SELECT DISTINCT 'relations' AS table_name, 'src_id' AS column_name, relation_id AS record_id, extracted_at AS at, 'entity' AS kind, src_id AS target_id FROM relations
  UNION SELECT DISTINCT 'relations', 'dst_id', relation_id, extracted_at, 'entity', dst_id FROM relations
  UNION SELECT DISTINCT 'relations', 'evidence_chunk_ids', relation_id, extracted_at, 'chunk', unnest(evidence_chunk_ids) FROM relations
  UNION SELECT DISTINCT 'field_values', 'evidence_chunk_ids', field_value_id, extracted_at, 'chunk', unnest(evidence_chunk_ids) FROM field_values
  {more}
),
known AS (
  SELECT 'entity' AS kind, entity_id AS id, min(created_at) AS since FROM entities GROUP BY 2
  UNION ALL SELECT 'chunk', chunk_id, min(ingested_at) FROM chunks GROUP BY 2
),
gone AS (SELECT target_kind AS kind, target_id AS id, min(deleted_at) AS deleted_at FROM deletions GROUP BY 1, 2),
judged AS (
  SELECT r.*, k.id IS NOT NULL AS present,
    CASE WHEN g.deleted_at <= r.at THEN 'deleted' WHEN k.id IS NULL THEN 'missing' WHEN k.since > r.at THEN 'late' END AS reason,
    coalesce(strftime(r.at, '%Y-%m'), 'unknown') AS period
  FROM refs r LEFT JOIN known k ON k.kind = r.kind AND k.id = r.target_id LEFT JOIN gone g ON g.kind = r.kind AND g.id = r.target_id
  WHERE r.target_id IS NOT NULL
)"""

ORACLE = {
    "p2_found": f"WITH {_REFS.format(more='')} SELECT table_name, column_name, record_id, target_id, reason, period FROM judged WHERE reason IS NOT NULL",
    "p2_report": f"""WITH {_REFS.format(more='''
  UNION SELECT DISTINCT 'field_values', 'entity_id', field_value_id, extracted_at, 'entity', entity_id FROM field_values
  UNION SELECT DISTINCT 'entities', 'first_chunk_id', entity_id, created_at, 'chunk', first_chunk_id FROM entities''')},
orphan_entities AS (SELECT DISTINCT record_id FROM judged WHERE table_name = 'entities' AND reason IS NOT NULL),
found AS (
  SELECT table_name, column_name, record_id, target_id, reason, period FROM judged WHERE reason IS NOT NULL
  UNION ALL
  SELECT table_name, column_name, record_id, target_id, 'inherited', period FROM judged
  WHERE reason IS NULL AND kind = 'entity' AND target_id IN (SELECT record_id FROM orphan_entities)
)
SELECT table_name, column_name, period, reason, count(*) AS n_references, count(DISTINCT record_id) AS n_records
FROM found GROUP BY 1, 2, 3, 4""",
    "p3_found": """WITH RECURSIVE links AS (
  SELECT DISTINCT CASE WHEN relation_type IN ('part_of', 'contains') THEN 'part_of' WHEN relation_type IN ('child_of', 'parent_of') THEN 'child_of' ELSE 'subtype_of' END AS hierarchy,
    CASE WHEN relation_type IN ('contains', 'parent_of') THEN dst_id ELSE src_id END AS child,
    CASE WHEN relation_type IN ('contains', 'parent_of') THEN src_id ELSE dst_id END AS parent
  FROM relations WHERE relation_type IN ('part_of', 'contains', 'child_of', 'parent_of', 'subtype_of') AND src_id IS NOT NULL AND dst_id IS NOT NULL
),
nodes AS (SELECT hierarchy, child AS node FROM links UNION SELECT hierarchy, parent FROM links),
reach(hierarchy, node, above) AS (
  SELECT hierarchy, child, parent FROM links
  UNION
  SELECT r.hierarchy, r.node, l.parent FROM reach r JOIN links l ON l.hierarchy = r.hierarchy AND l.child = r.above
),
trees(hierarchy, node, root, depth, path) AS (
  SELECT n.hierarchy, n.node, n.node, 0, CAST(n.node AS VARCHAR) FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.hierarchy = n.hierarchy AND l.child = n.node)
  UNION ALL
  SELECT t.hierarchy, l.child, t.root, t.depth + 1, t.path || '/' || CAST(l.child AS VARCHAR)
  FROM trees t JOIN links l ON l.hierarchy = t.hierarchy AND l.parent = t.node
),
below AS (SELECT hierarchy, above AS node, count(*) FILTER (WHERE node <> above) AS n, bool_or(node = above) AS ring FROM reach GROUP BY 1, 2)
SELECT n.hierarchy, n.node AS node_id, coalesce(t.root, -1) AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, coalesce(t.path, '') AS path,
  CASE WHEN t.node IS NOT NULL THEN 'tree' WHEN b.ring THEN 'cycle' ELSE 'below_cycle' END AS state, CAST(coalesce(b.n, 0) AS BIGINT) AS n_descendants
FROM nodes n LEFT JOIN trees t ON t.hierarchy = n.hierarchy AND t.node = n.node LEFT JOIN below b ON b.hierarchy = n.hierarchy AND b.node = n.node""",
}
