"""Goldens of the reference operators, invariants, and small mini-oracles."""

import hashlib
import math
import random
import struct
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import scalar as S
from quillgraph.operators import extraction as X
from quillgraph.operators import graph as G
from quillgraph.operators import memory as M
from quillgraph.operators import resolution as R
from quillgraph.operators import retrieval as Q
from quillgraph.operators import text as T
from quillgraph.operators.components import connected_components
from quillgraph.sources import readers, stores


def test_ids_match_hashlib(spark):
    names = [("Élan Vital", "Concept"), ("A", "Person"), ("日本", "Location")]
    df = spark.createDataFrame(names, "n string, t string").select("n", "t", S.entity_id(F.col("n"), F.col("t")).alias("i"))
    for r in df.collect():
        assert r.i == struct.unpack("<q", hashlib.sha256(f"{r.n.lower()}::{r.t}".encode()).digest()[:8])[0]
    for i, r in ((i, spark.sql("select 1").select(S.chunk_id(F.lit("doc é"), F.lit(i)).alias("i")).first()) for i in (0, 300, 70000)):
        assert r.i == struct.unpack("<q", hashlib.sha256("doc é::".encode() + struct.pack("<I", i)).digest()[:8])[0]


def test_strength_goldens(spark):
    row = spark.range(1).select(S.strength(F.lit(1), F.lit(90.0)).alias("s"), S.memory_state(F.lit(0.66)).alias("a"), S.memory_state(F.lit(0.3299)).alias("b")).first()
    assert abs(row.s - 0.22974) < 1e-5 and row.a == "long_term" and row.b == "dormant"
    histogram = {1: 2281, 2: 139, 3: 28, 4: 16, 5: 9, 6: 3, 7: 1, 8: 4, 9: 1, 10: 4, 12: 3}
    df = spark.createDataFrame([(r,) for r, n in histogram.items() for _ in range(n)], "mention_count long")
    got = {r.day: r.avg_strength for r in M.forgetting_series(df, [0, 7, 30, 60, 90]).collect()}
    assert got == {0: 1.0, 7: 0.8944, 30: 0.6204, 60: 0.3856, 90: 0.2403}


def test_convergence(spark):
    df = spark.createDataFrame([(1, 0.4465), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.0)], "cycle int, compression double")
    assert [r.converged for r in M.convergence(df).orderBy("cycle").collect()] == [False, False, False, False, True]


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "text graph retrieval evaluation"), (2, "cats and dogs"), (3, None), (4, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "text retrieval retrieval")], "query_id long, text string")
    scored = Q.bm25_scores(docs, queries).collect()
    assert [r.doc_id for r in scored] == [1]
    idf, norm = math.log(1 + 3.5 / 1.5), 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / 1.75))
    assert abs(scored[0].score - 3 * idf * norm) < 1e-9
    run = lambda ids: spark.createDataFrame([(1, d, i) for i, d in enumerate(ids, 1)], "query_id long, doc_id string, rank int")
    fused = Q.reciprocal_rank_fusion([run("abc"), run("acd")], 3).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == ["a", "c", "b"]


def test_vector_top_k_against_brute_force(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(900, [0.0] * 6), (901, None), (902, [1.0])]
    df = spark.createDataFrame(vectors, "doc_id long, embedding array<float>")
    queries = df.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    got = {(r.query_id, r.rank): r.doc_id for r in Q.vector_top_k(df, queries, 4).collect()}
    for q, v in vectors[:5]:
        best = sorted(vectors[:200], key=lambda x: (-round(cos(v, x[1]), 6), x[0]))[:4]
        assert [got[q, r] for r in range(1, 5)] == [b[0] for b in best]


def test_jaro_winkler_and_names(spark):
    assert abs(R.jaro_winkler("martha", "marhta") - 0.9611) < 1e-4 and abs(R.jaro_winkler("dixon", "dicksonx") - 0.8133) < 1e-4 and R.jaro_winkler("ab", "xy") == 0
    row = spark.range(1).select(*(F.levenshtein(F.lit(a), F.lit(b)) for a, b in (("helen", "hassen"), ("hassen", "hassan"), ("", "abc")))).first()
    assert tuple(row) == (3, 1, 3)
    row = spark.range(1).select(S.stripped_key(F.lit("Prof. Dr. A. B-C")), S.strip_qualifications(F.lit("Ann Lee Ph.D. BA")), S.strip_qualifications(F.lit("Ann Lee"))).first()
    assert tuple(row) == ("a b c", "ann lee", None)


def test_underscores_and_ooxml():
    for raw, want in (("Dr_ Smith", "Dr. Smith"), ("Wooding_s house", "Wooding's house"), ("E_S_ Reddy", "E.S. Reddy")):
        assert readers.repair_underscores(raw) == want
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>Hello world.</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t><w:tab/><w:t>paragraph.</w:t></w:r></w:p></w:body></w:document>")
    assert readers.ooxml_text(out.getvalue()) == "Hello world.\nSecond\tparagraph."


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Ünï text")
    (tmp_path / "b.html").write_text("<p>bold <b>x</b></p>")
    (tmp_path / "c.vtt").write_text("WEBVTT\n\n1\n00:01 --> 00:02\nspoken")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "README.md").write_text("no")
    got = {r.doc_name: r.text for r in readers.read_documents(readers.list_files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": "Ünï text", "b.html": "bold x", "c.vtt": "spoken", "d.docx": None}


def test_proper_nouns_and_pronouns():
    assert X.proper_nouns("We visited Cape Town. London is far away.")[:2] == ["Cape Town", "London"]
    assert X.proper_nouns("The doctor said He was fine. She visited The Hospital.") == ["Hospital"]
    assert X.proper_nouns("Ann Lee, Bob Ray, Cy Day, Di Fox") == ["Ann Lee", "Bob Ray", "Cy Day", "Di Fox"]
    assert all(len(n.split()) <= 5 for n in X.proper_nouns("Aa Bb Cc Dd Ee Ff Gg"))
    assert ("she", "Zainab") in X.resolve_pronouns("Zainab left. She took the train.", [("Zainab", "Female")], [])
    assert ("he", "Nelson Mandela") in X.resolve_pronouns("He was a great leader. Nelson Mandela inspired millions.", [], [])
    assert X.resolve_pronouns("They left.", [("A", None), ("B", None)], []) == []


def test_paragraphs():
    packer = T.Paragraphs(200, 30)
    short = "\n\n".join(f"This is paragraph number {i}, long enough." for i in range(3))
    assert len(packer.chunks(short)) == 1
    long = "\n\n".join(" ".join(f"Sentence {i} of part {p} goes on." for i in range(12)) for p in range(3))
    chunks = packer.chunks(long)
    assert len(chunks) > 3 and all(len(c[0]) <= 240 for c in chunks)
    marked = packer.chunks("Appendix A\n\nSome words that are long enough to stay here.\n\nChapter 1\n\nOther words that are long enough to stay here.", [("appendix", "appendix", True)])
    assert [(c[1], c[2], c[3]) for c in marked] == [("Appendix A", "appendix", True), ("Chapter 1", "main", False)]


def test_components_against_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_upserts_are_idempotent_and_symmetric(spark):
    rows = [(1, 2, "parent_of", [5, 6]), (1, 2, "parent_of", [6, 7]), (3, 4, "spouse_of", None), (1, None, "led", [1]), (8, 9, "led", [])]
    df = spark.createDataFrame(rows, "src_id long, dst_id long, relation_type string, evidence array<long>")
    once = G.upsert_relations(G.with_inverses(df))
    again = G.upsert_relations(G.with_inverses(once))
    key = lambda d: sorted((r.src_id, r.dst_id, r.relation_type, tuple(r.evidence), r.strength) for r in d.collect())
    assert key(once) == key(again)
    assert (2, 1, "child_of", (5, 6, 7), 0.3) in key(once) and (4, 3, "spouse_of", (), 0.1) in key(once) and len(key(once)) == 5


def test_greedy_names_within_components(spark):
    names = [(1, "Leslie Groves"), (2, "Groves"), (3, "groves"), (4, "Institute of Advanced Long Study"), (5, "Institute of Advanced Long Study West"), (6, None), (7, "")]
    got = {tuple(r) for r in R.greedy_names(spark.createDataFrame(names, "entity_id long, name string")).collect()}
    assert got == {(1, 2), (1, 3), (4, 5)}


def test_merge_resolves_chains(spark):
    e = spark.createDataFrame([(1, "A", "Person", "d", 1, ["x"]), (2, "B", "Person", "longer", 5, None), (3, "C", "Person", None, 2, [])], "entity_id long, name string, entity_type string, description string, mention_count long, aliases array<string>")
    rel = spark.createDataFrame([(1, 3, "led", [1]), (1, 9, "led", [2]), (3, 9, "led", [3])], "src_id long, dst_id long, relation_type string, evidence array<long>")
    men = spark.createDataFrame([(7, 1), (7, 3)], "chunk_id long, entity_id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "keep_id long, drop_id long")
    merged, relations, mentions = G.merge_entities(e, rel, men, pairs)
    (row,) = merged.collect()
    assert (row.entity_id, row.name, row.mention_count, row.description, row.aliases) == (2, "B", 8, "longer", ["A", "C", "x"])
    assert [tuple(r[:3]) + (r.evidence,) for r in relations.select("src_id", "dst_id", "relation_type", "evidence").collect()] == [(2, 9, "led", [2, 3])]
    assert [tuple(r) for r in mentions.select("chunk_id", "entity_id").collect()] == [(7, 2)]


def test_store_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(tuple(r) for r in stores.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        stores.checked_vectors(spark.createDataFrame([([1.0],)], "embedding array<float>"), 3).collect()


def test_provider_failures_give_no_rows(spark):
    def provider(texts):
        if "bad" in texts[0]:
            raise RuntimeError("down")
        return [[("X", "Person", 0.9)] for _ in texts]

    df = spark.createDataFrame([(1, "bad"), (2, "fine")], "doc_id long, text string").repartition(2, "doc_id")
    assert {r.name for r in X.with_provider(df, provider, 1).collect()} == {"X"}
