"""Long texts keep all their names."""

from quillgraph.plans.text import pronoun_resolution, proper_nouns


def test_names_after_the_fortieth(spark, tmp_path):
    names = [f"N{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    text = ". ".join(names) + ". There we saw that she left."
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.name for r in proper_nouns(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [*names, "There"]
    assert [tuple(r) for r in pronoun_resolution(spark, str(tmp_path)).collect()] == [(1, "she", "There")]
