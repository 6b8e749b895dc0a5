"""Coreference, extraction pipelines, graph upkeep and sinks on small tables."""

import json
import random

import pytest

from quillgraph.functions import scalar as S
from quillgraph.operators import build as B
from quillgraph.operators import coref as C
from quillgraph.operators import graph as G
from quillgraph.operators import resolution as R
from quillgraph.operators import retrieval, text
from quillgraph.sources import readers, sinks

ENTITY = "entity_id long, name string, entity_type string, aliases array<string>, gender string, description string, mention_count long, confidence double"


def people(spark):
    rows = [
        (1, "Noor Silke", "Person", ["the author"], "Female", "", 3, 0.2), (2, "Una Galpa", "Person", None, "Female", "x", 1, 0.9),
        (3, "Ben Solbury", "person", [], "Male", None, 2, 0.1), (4, "Cape Tormund", "Location", ["the Point"], None, None, 1, 0.3),
    ]
    return spark.createDataFrame(rows, ENTITY)


def chunk_table(spark):
    rows = [(10, "d", 0, "Noor came. She left."), (11, "d", 1, "He and they met at Tormund and stayed there. Where?"), (12, "d", 2, None), (13, "e", 0, "Where was she?"), (14, None, 0, "She.")]
    return spark.createDataFrame([(*r, 1) for r in rows], "chunk_id long, doc_name string, chunk_index long, text string, name int")


def test_candidates_and_words_that_point(spark):
    mentioned = spark.createDataFrame([(10, 1), (11, 3), (11, 4), (12, 2), (13, 2), (99, 1)], "chunk_id long, entity_id long")
    found = C.candidates(chunk_table(spark), mentioned, people(spark))
    assert sorted((r.chunk_id, r.entity_id, r.pos) for r in found.collect()) == [(10, 1, 0), (10, 3, 1), (11, 1, 1), (11, 2, 1), (11, 3, 0), (12, 2, 0), (12, 3, 1), (13, 2, 0)]
    told = C.candidates(chunk_table(spark), mentioned, people(spark), narrators=("the author",), narrator_gender="Male")
    assert {(r.chunk_id, r.gender) for r in told.where("entity_id = 1").collect()} == {(c, "Male") for c in (10, 11, 12, 13)}
    got = sorted(tuple(r) for r in C.resolve(chunk_table(spark), found).collect())
    assert got == [(10, "She", "Noor Silke", 11, 0.9), (11, "He", "Ben Solbury", 0, 0.9), (11, "they", "Una Galpa", 7, 0.9), (13, "she?", "Una Galpa", 10, 0.9)]
    places = C.candidates(chunk_table(spark), mentioned, people(spark), "location", 0)
    assert [tuple(r) for r in C.resolve(chunk_table(spark), places, False).collect()] == [(11, "there.", "Cape Tormund", 38, 0.85), (11, "Where?", "Cape Tormund", 45, 0.85)]
    assert C.resolve(chunk_table(spark).limit(0), found).count() == 0


def test_duplicates_within_a_document(spark):
    assert B.merge_extracted([("Ruth Rasul", "Person", 0.9), ("Professor Ruth Rasul", "Person", 0.85), ("Rasul Foundation", "Organization", 0.8)]) == [("Professor Ruth Rasul", "Person", 0.85), ("Rasul Foundation", "Organization", 0.8)]
    assert B.merge_extracted([("Ann Lee", "Person", 0.9), ("Bob Lee", "Person", 0.5)]) == [("Ann Lee", "Person", 0.9)]
    rows = spark.createDataFrame([(1, "Ann Lee", "Person", 0.9), (1, '"Ann  Lee"', "Person", 0.7), (2, "Ann Lee", "Person", 0.8), (2, "house", "Person", 0.9)], "doc_id long, name string, entity_type string, confidence double")
    assert sorted(tuple(r) for r in B.merge_within(rows).collect()) == [(1, "Ann Lee", "Person", 0.9), (2, "Ann Lee", "Person", 0.8)]
    spans = spark.createDataFrame([(1, "Ann Lee", "Person", 0.9), (1, "Bo Ray", "Person", 0.9), (2, "Cy Fox", "Person", 0.3)], rows.schema)
    patterns = spark.createDataFrame([(1, "Dee Dow", "Person", 0.9), (2, "Cy Fox", "Person", 0.8), (3, "Eve Orr", "Person", 0.8)], rows.schema)
    got = sorted(tuple(r) for r in B.ensemble(spans, None, patterns, patterns).collect())
    assert got == [(1, "Ann Lee", "Person", 0.9), (1, "Bo Ray", "Person", 0.9), (2, "Cy Fox", "Person", 0.8), (3, "Eve Orr", "Person", 0.8)]


def test_contexts_refinement_and_embeddings(spark):
    chunks = spark.createDataFrame([(i, "d", i, f"t{i}") for i in range(9)] + [(50, None, 1, "x")], "chunk_id long, doc_name string, chunk_index long, text string")
    spans = spark.createDataFrame([("Ann", "d", i) for i in (8, 0, 1, 4, 4)], "name string, doc_name string, chunk_index long")
    (row,) = B.entity_contexts(spans, chunks, joint="|").collect()
    assert tuple(row) == ("Ann", "d", 6, "t0|t1|t2|t3|t4|t5")

    def provider(names, contexts):
        if "Ben Solbury" in names:
            raise RuntimeError("down")
        return [[{"name": f"{n}'s", "type": "Person", "fields": {"spouse": "B", "child": "unknown", "parent": "C", "birthDate": "1900"}}, {"name": None}] for n in names]

    asked = spark.createDataFrame([("Noor Silke", "x"), ("Ben Solbury", "y")], "name string, context string")
    got = {(r.asked, r.name, r.error is None) for r in B.extract_in_context(asked, provider, 1).collect()}
    assert got == {("Noor Silke", "Noor Silke", True), ("Ben Solbury", None, False)}
    mentioned = spark.createDataFrame([(0, 1), (1, 3), (2, 2)], "chunk_id long, entity_id long")
    refined = {r.entity_id: (round(r.new, 2), r.improved) for r in B.refine(people(spark).where("entity_id <> 3"), chunks, mentioned, provider, 0.5, 2, ["PERSON"]).collect()}
    assert refined == {1: (0.3, True)}
    fields = spark.createDataFrame([(1, {"spouse": "B", "child": "unknown"})], "entity_id long, values map<string,string>")
    vectors = {r.entity_id: (r.description, r.embedding) for r in B.reembed(people(spark), fields, lambda ts: [[float(len(t))] for t in ts], mentioned).collect()}
    told = "Noor Silke — spouse: B"
    assert vectors[1] == (told, [float(len(f"Noor Silke (the author): {told}"))]) and vectors[2][0] == "x" and 4 not in vectors


def test_graph_of_texts(spark):
    docs = spark.createDataFrame([(1, "Marie Curie led Paris Institute. Marie Curie met Pierre. Pierre studied under Becquerel. Becquerel and Pierre, the theory of light."), (2, None), (3, "")], "doc_id long, text string")
    e, m, r = B.corpus_graph(docs)
    assert {(x.name, x.entity_type) for x in e.collect()} == {("Marie Curie", "Person"), ("Pierre", "Person"), ("Becquerel", "Person"), ("Paris Institute", "Organization"), ("Paris", "Location"), ("theory of light", "Concept")}
    assert m.count() == 6 and r.count() == 15
    extract = lambda d: spark.createDataFrame([(1, "Pierre", "Person", 0.9), (1, "Becquerel", "Person", 0.9)], "doc_id long, name string, entity_type string, confidence double")
    kinds = sorted((x.relation_type, x.evidence) for x in B.improved_graph(docs, extract)[2].collect())
    assert kinds == [("co_occurs", [1]), ("studied_under", [1])]


def test_upkeep(spark):
    e = people(spark)
    r = spark.createDataFrame([(1, 2, "knows", [0, 5], 0.2), (2, 3, "knows", [5], 0.1), (4, 1, "near", None, 0.1)], "src_id long, dst_id long, relation_type string, evidence array<long>, strength double")
    m = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "chunk_id long, entity_id long")
    assert [x.s for x in r.select(G.is_seeded(r.evidence).alias("s")).collect()] == [True, False, False]
    left = G.delete_entities(e, r, m, e.where("entity_id = 2").select("entity_id"))
    assert [x.count() for x in left] == [3, 1, 2]
    changed = G.set_attributes(e, spark.createDataFrame([(1, "Old", None), (9, "x", "y")], "entity_id long, description string, gender string"))
    assert {x.entity_id: (x.description, x.gender) for x in changed.collect()} == {1: ("Old", "Female"), 2: ("x", "Female"), 3: (None, "Male"), 4: (None, None)}
    assert {x.entity_id: x.mention_count for x in G.count_mentions(e, m).collect()} == {1: 5, 2: 2, 3: 2, 4: 1}
    assert {x.entity_id: x.evidence for x in G.sync_evidence(e, m).collect()} == {1: [10, 11], 2: [11], 3: [], 4: []}
    merged = G.merge_entities(e.withColumn("evidence", G.F.array("entity_id")), r, m, spark.createDataFrame([(1, 2)], "keep_id long, drop_id long"))
    (kept,) = merged[0].where("entity_id = 1").collect()
    assert (kept.name, kept.gender, kept.mention_count, kept.description, sorted(kept.aliases), kept.evidence) == ("Noor Silke", "Female", 4, "x", ["Una Galpa", "the author"], [1, 2])
    family = spark.createDataFrame([(1, 9, "child_of", 0.1), (2, 9, "child_of", 0.3), (1, 8, "child_of", 0.1), (2, 7, "child_of", 0.2), (3, 9, "child_of", 0.05)], "src_id long, dst_id long, relation_type string, strength double")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "keep_id long, drop_id long")
    assert [tuple(x) for x in R.different_parents(pairs, family).collect()] == [(1, 2)]


def test_greedy_names_against_the_plain_loop(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5]))).title()) for i in range(60)]
    got = sorted(tuple(r) for r in R.greedy_names(spark.createDataFrame(rows + [(99, None)], "entity_id long, name string")).collect())

    def alike(a, b):
        x, y = a.split(), b.split()
        if a == b or len(x) == 1 and len(y) > 1 and x[0] == y[-1] or len(y) == 1 and len(x) > 1 and y[0] == x[-1]:
            return True
        return len(a) > 10 and len(b) > 10 and len({*x} & {*y}) / max(len({*x}), len({*y})) >= 0.8

    gone, want = set(), []
    low = [(i, n.lower()) for i, n in rows]
    for i, a in low:
        if i not in gone:
            for j, b in low:
                if j > i and j not in gone and alike(a, b):
                    gone.add(j)
                    want.append((i, j))
    assert {d for _, d in got} == gone and len(got) == len(want)


def test_texts_and_ranking(spark):
    chunks = spark.createDataFrame([(1, "A|Old.txt", "x"), (2, "B|new.txt", None), (3, None, "y")], "chunk_id long, doc_name string, text string")
    prefixes = spark.createDataFrame([(1, "TXT", "second"), (0, "old", "first")], "ord int, key string, prefix string")
    assert {r.chunk_id: r.text for r in text.document_prefix(chunks, prefixes).collect()} == {1: "first\n\nx", 2: "second\n\n", 3: "y"}
    with pytest.raises(ValueError):
        text.document_prefix(chunks, prefixes, most=1)
    with pytest.raises(ValueError):
        text.match_sections(spark.createDataFrame([(1, "Intro")], "id int, heading string"), spark.createDataFrame([(0, "a", "main", False), (1, "b", "main", False)], "ord int, pattern string, section_type string, skip boolean"), most=1)
    assert text.pack_units(["aaa", "bbb", "ccc"], 7, 2) == ["aaa\nbbb", "bb\nccc"] and text.pack_units([], 5, 1) == []
    assert text.extraction_pieces("a" * 10 + "\n\n" + "b" * 5 + "\n\n" + "c" * 25, 20) == ["a" * 10 + "\n\n" + "b" * 5, "c" * 20, "c" * 5]
    docs = spark.createDataFrame([(i, "cats and dogs" if i % 2 else "dream") for i in range(6)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "dream"), (2, "nothing")], "query_id long, text string")
    run = retrieval.top_k(retrieval.bm25_scores(docs, queries), 4)
    full = retrieval.with_zero_scores(run, docs, queries, 4)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in full.collect()) == [(1, 1, 0), (1, 2, 2), (1, 3, 4), (1, 4, 1), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3)]
    words = spark.createDataFrame([("They would know the well known Harbour over there",)], "t string").select(S.significant_words(G.F.col("t")).alias("w")).first().w
    assert words == ["know", "harbour", "there"]


def test_spans_of_a_model(spark):
    from quillgraph.operators.extraction import parse_spans

    answers = [(1, '[{"text": "Ann", "label": "person", "score": 0.9}, {"text": " "}]'), (2, '{"entities": [{"text": "Bo", "label": "org", "score": 1}]}'), (3, "down"), (4, None)]
    got = sorted(tuple(r) for r in parse_spans(spark.createDataFrame(answers, "doc_id long, answer string")).collect())
    assert got == [(1, "Ann", "person", 0.9), (2, "Bo", "org", 1.0)]


def test_sinks_and_readers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 3)], "id int, name string, n int")
    sinks.write_memory_state(rows, rows, rows.limit(1), str(tmp_path / "m"))
    sinks.write_memory_state(rows.limit(1), rows, rows.limit(1), str(tmp_path / "m"))
    assert [x.count() for x in sinks.read_memory_state(spark, str(tmp_path / "m"))] == [1, 2, 1]
    assert {r.id: r.json for r in sinks.json_rows(rows, "id").collect()} == {1: '{"id":1,"name":"a"}', 2: '{"id":2,"n":3}'}
    sinks.export_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    schema = {"name": "c", "entity_types": []}
    sinks.save_corpus_schema(schema, str(tmp_path / "s" / "schema.json"))
    assert readers.load_corpus_schema(str(tmp_path / "s" / "schema.json"), {"entity_types": ["X"]}) == {"entity_types": ["X"], "name": "c"}
    (tmp_path / "d.json").write_text(json.dumps({"document_title": "T", "sections": [{"pattern": "index", "index_seeds": True}, {"pattern": "notes", "skip": True, "section_type": "end_notes"}]}))
    head, sections = sinks.load_section_schema(spark, str(tmp_path / "d.json"))
    assert head["document_title"] == "T" and [(r.ord, r.pattern, r.skip, r.index_seeds, r.section_type) for r in sections.collect()] == [(0, "index", False, True, "main"), (1, "notes", True, False, "end_notes")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.doc").write_bytes(b"x")
    (tmp_path / "f" / "b.docx").write_bytes(b"no zip")
    (tmp_path / "f" / "c.txt").write_text("fine")
    read = {r.doc_name: (r.text, r.error) for r in readers.read_with_errors(readers.list_files(spark, str(tmp_path / "f"))).collect()}
    assert read["c.txt"] == ("fine", None) and read["a.doc"][1].startswith("UnreadableFormat") and read["b.docx"][0] is None and "BadZipFile" in read["b.docx"][1]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "Some_law.csv").write_text('question,answer\n"What,\nis it?",That\n,x\nWho?,\n')
    assert sorted(tuple(r) for r in readers.load_questions(spark, str(tmp_path / "q")).collect()) == [("Some law|q2", "Some law", "What,\nis it?", "That"), ("Some law|q4", "Some law", "Who?", None)]
