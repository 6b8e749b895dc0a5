"""Descriptions of all three kinds, resolved among the entities of the text."""

from quillgraph.plans.text import definite_descriptions


def test_entities_of_the_text_are_the_candidates(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    text = "My father crossed the street to the committee."
    write("documents", [(1, "d1", text), (2, "d2", text), (3, None, None)], "doc_id long, doc_name string, text string")
    chunk = "chunk_id long, doc_name string, chunk_index long, text string, page_num int, section_name string, skip_extraction boolean, section_type string, ingested_at long"
    write("chunks", [(11, "d1", 0, text, None, None, None, None, 1), (12, "g", 0, text, None, None, None, None, 1), (13, "g", 1, "Nothing.", None, None, None, None, 1)], chunk)
    write("entities", [(1, "Noor Silke", ["Father"], 11, [], "Person"), (2, "Galpa Street", [], 12, [], "Location"), (3, "Tidal Council", ["the Committee"], 11, [12], "Organization"), (4, "A Committee", [], 13, [], "Organization"), (5, "Street", [], 12, [], "Person")],
          "entity_id long, name string, aliases array<string>, first_chunk_id long, evidence array<long>, entity_type string")
    got = {tuple(r) for r in definite_descriptions(spark, str(tmp_path)).collect()}
    father, street, group = ("Person", "my father", 0, "Noor Silke"), ("Location", "the street", 18, "Galpa Street"), ("Organization", "the committee", 32, "Tidal Council")
    assert got == {("documents", 1, *father), ("documents", 1, *group), ("chunks", 11, *father), ("chunks", 11, *group), ("chunks", 12, *street), ("chunks", 12, *group)}
