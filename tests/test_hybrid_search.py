"""The hybrid ranking finds by words and by entities, under one key."""

from quillgraph.plans.graph import hybrid_search


def test_words_and_graph_are_fused(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("documents", [(1, "d1", "where glaciers melt"), (2, "d2", "harbour records"), (3, "d3", "glaciers of a very cold and distant coast"), (4, "d4", None)], "doc_id long, doc_name string, text string")
    write("eval_cases", [(1, "where did Noor Solbury study glaciers"), (2, "harbour"), (3, "Galpa, again"), (4, "nothing here"), (5, None)], "item_id long, question string")
    write("chunks", [(11, "g1"), (12, "d3"), (13, "g2")], "chunk_id long, doc_name string")
    write("entities", [(1, "Noor Solbury", [], 2, 11, [11], 1.0, "Person"), (2, "Institute", [], 1, 12, [12], 0.5, "Organization"), (3, "Una Gimenko", ["Galpa"], 1, 13, [], 0.5, "Person")],
          "entity_id long, name string, aliases array<string>, mention_count long, first_chunk_id long, evidence array<long>, confidence double, entity_type string")
    write("relations", [(1, 2, "works_at", [11])], "src_id long, dst_id long, relation_type string, evidence_chunk_ids array<long>")
    got = sorted(tuple(r) for r in hybrid_search(spark, str(tmp_path)).collect())
    one, both = round(1 / 61, 6), round(2 / 62, 6)
    assert got == [(1, 1, "d3", both), (1, 2, "d1", one), (1, 3, "g1", one), (2, 1, "d2", one), (3, 1, "g2", one)]
