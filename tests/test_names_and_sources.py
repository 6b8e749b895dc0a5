from pyspark.sql import functions as F

from quillgraph.functions import names as N
from quillgraph.operators import extraction as X
from quillgraph.sources import readers


def test_clean_names(spark):
    wanted = {
        "M_K_ Gandhi": "M.K. Gandhi", "J_ M_ H_ Gool": "J. M. H. Gool", "Mrs_ Wo": "Mrs. Wo", "Joe Rassool_s": "Joe Rassool's",
        "Yousuf _Joe_ Rassool": "Yousuf (Joe) Rassool", "Y’Allah": "Y'Allah", "": "", "a  b": "a b",
    }
    df = spark.createDataFrame([(k,) for k in wanted] + [(None,)], "n string")
    got = {r.n: r.c for r in df.select("n", N.clean_entity_name(F.col("n")).alias("c")).collect()}
    assert got == wanted | {None: None}
    cases = {"Paris's": "Paris", "James": "James", "the doctor": None, "When Ann": None, "Ann Lee there again": "Ann Lee", "a b c d e f g h": None, "crowd": None, " ": None}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    clean = N.clean_extracted_name(F.col("n"), ["crowd"], ["the "], ["when"], ["there", "again"])
    assert {r.n: r.c for r in df.select("n", clean.alias("c")).collect()} == cases


def test_registered_functions(spark):
    N.register(spark)
    assert abs(spark.sql("SELECT jaro_winkler('martha', 'marhta') AS s").first().s - 0.9611) < 1e-4
    text = "First paragraph with enough words.\n\nSecond paragraph with enough words."
    rows = spark.sql(f"SELECT * FROM paragraph_chunks('{text}', 40, 0)").collect()
    assert [r.text for r in rows] == text.split("\n\n")


def test_corpus_and_questions(spark, tmp_path):
    folder = tmp_path / "corpus" / "law" / "documents"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("some text")
    got = readers.load_corpus(spark, str(tmp_path / "corpus"), 4).collect()
    assert [tuple(r) for r in got] == [("law|a.txt", "law", "some")]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "Some_law.csv").write_text("question,answer\nWhat is it?,That\n")
    (row,) = readers.load_questions(spark, str(tmp_path / "q")).collect()
    assert (row.topic, row.question, row.answer) == ("Some law", "What is it?", "That")


def test_payload(spark):
    answers = [(1, '```json\n{"entities": [{"name": " A ", "type": "Person", "fields": {"k": "v"}}, {"name": ""}], "relations": [{"from": "A", "to": "B", "relation": "led"}]}\n```'), (2, "no json"), (3, None)]
    entities, relations = X.parse_payload(spark.createDataFrame(answers, "chunk_id long, answer string"))
    assert [(r.chunk_id, r.name, r.entity_type, r.fields) for r in entities.collect()] == [(1, "A", "Person", {"k": "v"})]
    assert [tuple(r) for r in relations.collect()] == [(1, "A", "B", "led")]
