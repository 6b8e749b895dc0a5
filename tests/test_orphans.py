import datetime as dt

from quillgraph.operators.orphans import Reference, Source, orphan_cascade, orphan_report

D = lambda d: dt.datetime(2024, 1, d)


def tables(spark, rows, links):
    parents = spark.createDataFrame(rows, "id long, up long, created timestamp, level string")
    records = spark.createDataFrame(links, "rid long, one long, many array<long>, at timestamp, reason string")
    return {"parents": Source(parents, "id", "created"), "records": Source(records, "rid", "at")}


REFS = [Reference("records", "one", "parents"), Reference("records", "many", "parents"), Reference("parents", "up", "parents")]


def test_reasons_and_levels(spark):
    rows = [(1, None, D(1), ""), (1, None, D(9), ""), (2, 99, D(2), ""), (3, 2, D(3), ""), (4, 3, D(4), ""), (5, None, D(1), "")]
    links = [
        (10, 1, [1, 1, None], D(5), ""),
        (11, 7, [4, 5], D(5), ""),
        (12, 5, None, D(3), ""),
        (13, 4, [], D(1), ""),
        (14, 8, [4], None, ""),
        (14, 8, [4], None, ""),
        (15, 5, [7], D(2), ""),
    ]
    deletions = spark.createDataFrame([("parent", 5, D(3)), ("other", 1, D(1)), ("parent", 7, D(4))], "target_kind string, target_id long, deleted_at timestamp")
    found = orphan_cascade(tables(spark, rows, links), REFS, {"parents": "parent"}, deletions)
    got = {(r.table_name, r.column_name, r.record_id, r.target_id, r.reason, r.period, r.level) for r in found.collect()}
    assert got == {
        ("records", "one", 11, 7, "deleted", "2024-01", 0),
        ("records", "many", 11, 5, "deleted", "2024-01", 0),
        ("records", "one", 12, 5, "deleted", "2024-01", 0),
        ("records", "one", 13, 4, "late", "2024-01", 0),
        ("records", "one", 14, 8, "missing", "unknown", 0),
        ("records", "many", 15, 7, "missing", "2024-01", 0),
        ("parents", "up", 2, 99, "missing", "2024-01", 0),
        ("parents", "up", 3, 2, "inherited", "2024-01", 1),
        ("parents", "up", 4, 3, "inherited", "2024-01", 2),
        ("records", "many", 11, 4, "inherited", "2024-01", 3),
        ("records", "many", 14, 4, "inherited", "unknown", 3),
    }
    assert orphan_report(found).count() > 0


def test_cyclic_keys_end_and_empty_tables(spark):
    rows = [(1, 2, D(2), ""), (2, 1, D(2), ""), (3, 3, D(1), ""), (1, 77, D(2), "")]
    found = orphan_cascade(tables(spark, rows, []), REFS, {"parents": "parent"})
    assert {(r.record_id, r.target_id, r.level) for r in found.collect()} == {(1, 77, 0), (2, 1, 1), (1, 2, 2)}
    assert orphan_cascade(tables(spark, [], []), REFS, {"parents": "parent"}).count() == 0


def test_three_inherited_levels(spark):
    """d names a missing record, c names d, b names c and a names b."""
    from quillgraph.operators.orphans import Reference, Source, orphan_cascade

    tables = {n: spark.createDataFrame([(1, 1), (2, 2)], f"{n}_id long, up long") for n in "abcd"}
    tables["d"] = spark.createDataFrame([(1, 77), (2, 1)], "d_id long, up long")
    tables["e"] = spark.createDataFrame([(1, None)], "e_id long, up long")
    sources = {n: Source(df, f"{n}_id", None) for n, df in tables.items()}
    refs = [Reference(x, "up", y) for x, y in zip("abcd", "bcde")]
    got = {(r.table_name, r.record_id, r.level, r.reason) for r in orphan_cascade(sources, refs, {n: n for n in "bcde"}).collect()}
    assert got == {("d", 1, 0, "missing"), ("c", 1, 1, "inherited"), ("b", 1, 2, "inherited"), ("a", 1, 3, "inherited")}
