"""Rare cases of the consistency rules, over relations of all types."""

from quillgraph.plans.memory import sanitize_half_sibling, sanitize_parent_paradox


def _relations(spark, path, rows):
    spark.createDataFrame(rows, "src_id long, dst_id long, relation_type string, evidence_chunk_ids array<long>").write.parquet(f"{path}/relations.parquet")


def test_the_stronger_parent_stays(spark, tmp_path):
    _relations(spark, tmp_path, [
        (1, 2, "parent_of", [1, 2]), (2, 1, "parent_of", [3]),  # the stronger stays
        (3, 4, "parent_of", [1]), (3, 4, "child_of", [2, 3]),  # the same pair, told the other way
        (5, 6, "parent_of", [1]), (6, 5, "child_of", [2]), (6, 5, "parent_of", [3, 4]),  # equal once joined: neither
        (7, 8, "parent_of", [1]), (8, 7, "child_of", [1]),  # the two agree
        (9, 10, "cites", [1]), (10, 9, "cites", [1]),
    ])
    got = {tuple(r) for r in sanitize_parent_paradox(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, "parent_of"), (4, 3, "parent_of"), (7, 8, "parent_of"), (9, 10, "cites"), (10, 9, "cites")}


def test_half_siblings_go_and_cousins_stay(spark, tmp_path):
    _relations(spark, tmp_path, [
        (1, 2, "sibling_of", [1]), (2, 1, "half_sibling_of", [1]), (1, 2, "cousin_of", [1]),
        (3, 4, "half_sibling_of", [1]), (3, 4, "cites", [1]),
    ])
    got = {tuple(r) for r in sanitize_half_sibling(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, "sibling_of"), (1, 2, "cousin_of"), (3, 4, "half_sibling_of"), (3, 4, "cites")}
