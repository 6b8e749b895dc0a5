"""Titles, roles and organisations, on invented strings and on the tables."""

from quillgraph.operators.extraction import pattern_entities
from quillgraph.plans.text import pattern_ner

TEXT = "Dr. Una Galpa met Professor Ada Byron. Climate Research Institute and John Smith is a chemist."


def test_pattern_families(spark):
    rows = pattern_entities(spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.name, r.entity_type, r.confidence) for r in rows} == {
        (1, "Una Galpa", "Person", 0.85), (1, "Ada Byron", "Person", 0.85), (1, "John Smith", "Person", 0.75), (1, "Climate Research Institute", "Organization", 0.8),
    }


def test_pattern_ner_reads_documents_and_chunks(spark, tmp_path):
    spark.createDataFrame([(1, "They met at Tidal Records Academy."), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = (7, "n", 0, "Mr. Noor Silke wrote.", None, None, None, None, 1)
    chunk = "chunk_id long, doc_name string, chunk_index long, text string, page_num int, section_name string, skip_extraction boolean, section_type string, ingested_at long"
    spark.createDataFrame([row, (*row[:-1], 2)], chunk).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(5, "Ann Lee", "climate")], "item_id long, answer string, topic string").write.parquet(f"{tmp_path}/eval_cases.parquet")
    got = sorted(tuple(r) for r in pattern_ner(spark, str(tmp_path)).collect())
    assert got == [("chunks", 7, "Noor Silke", "Person", 0.85), ("documents", 1, "Tidal Records Academy", "Organization", 0.8)]
