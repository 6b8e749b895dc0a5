"""Names a few edits apart against a comparison of all pairs."""

import random

from quillgraph.operators import resolution as R

SCHEMA = "entity_id bigint, entity_type string, mention_count bigint, name string"


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _all_pairs(rows):
    found = set()
    for x in rows:
        for y in rows:
            a, b = x[3].lower(), y[3].lower()
            if x[0] < y[0] and x[1] is not None and x[1] == y[1] and a != b and a[0] == b[0] and abs(len(a) - len(b)) <= 2:
                if any(len(w) >= 4 for w in set(a.split()) & set(b.split())) and _edits(a, b) <= 2:
                    found.add((x[0], y[0]) if x[2] >= y[2] else (y[0], x[0]))
    return found


def test_blanks_taken_out_change_two_tokens_each(spark):
    rows = [(1, "Person", 1, "anna berg cara dorn emil"), (2, "Person", 3, "annaberg caradorn emil"), (3, "Person", 1, "annaxberg cara dorn emil")]
    # the one token that both have is the most frequent
    rows += [(10 + i, "Person", 1, f"{w} emil") for i, w in enumerate(("quentin", "roswitha", "siegfried", "theodora"))]
    want = _all_pairs(rows)
    assert want == {(2, 1), (1, 3), (2, 3)}
    assert {tuple(r) for r in R.fuzzy(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_names_of_all_lengths_with_frequent_words(spark):
    pick = random.Random(3)
    kept = ["noor", "theory", "institute of records", "aaaa", "åbøå"]
    rows = []
    for i in range(160):
        word = "".join(pick.choice("abå" if i % 2 else "abcdefgh") for _ in range(pick.randint(1, 12)))
        name = pick.choice([f"{word} {{}}", f"{{}} {word}", f"a {word} {{}}"]).format(pick.choice(kept))
        for _ in range(3):
            rows.append((len(rows), pick.choice(["Person", "Person", "Work", None]), pick.randint(1, 3), name))
            at = pick.randrange(1, len(name))
            name = " ".join((name[:at] + pick.choice(["", "b", " ", "å"]) + name[at + pick.randint(0, 1) :]).split())
    want = _all_pairs([(i, kind, -i, name) for i, kind, _, name in rows])
    mentions = {r[0]: r[2] for r in rows}
    want = {(a, b) if mentions[a] >= mentions[b] else (b, a) for a, b in want}
    assert len(want) > 100
    got = [tuple(r) for r in R.fuzzy(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_frequent_words_compare_few_names(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))
    names = [("Concept", f"s{word()} theory") for _ in range(2000)]
    keys = R.name_keys(spark.createDataFrame(names, "entity_type string, norm string"), 2)
    compared = keys.groupBy("key").count().selectExpr("sum(count * (count - 1) / 2) AS n").first().n
    # by shared tokens it would be each with each, 1,999,000
    assert compared < 100_000
