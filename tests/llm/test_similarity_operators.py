"""Tests of problems 1, 4 and 6 against brute force and small cases."""

import random

import numpy as np

from quillgraph.llm import names, near_duplicates, neighbours


def test_neighbours_recall_ties_and_unusable_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 16)) * 3
    rows = [(i, (centres[i % 8] + rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(8)]  # equal vectors under other keys
    usable = dict(rows)
    rows += rows[:5] + [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 8), (2003, [float("nan")] * 16), (None, rows[1][1]), (2004, [None] * 16), (2005, [])]
    df = spark.createDataFrame([(*r, b"x", True) for r in rows], "key long, embedding array<float>, vec binary, asks boolean")
    ids = np.array(sorted(usable))
    unit = np.array([usable[i] for i in ids], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -9)
    want = {int(i): ids[np.lexsort((ids, -np.round(score[k], 9)))[:5]].tolist() for k, i in enumerate(ids)}
    for cell, alone in ((65_536, 4096), (16, 4096), (65_536, 3)):  # many cells and split ones; coarser buckets for the lonely
        monkeypatch.setattr(neighbours, "CELL_VECTORS", cell)
        monkeypatch.setattr(neighbours, "LONELY", alone)
        monkeypatch.setattr(neighbours, "SHALLOW", 0.8 if alone > 3 else -8)
        found: dict = {}
        for r in neighbours.most_similar(df, "key").collect():
            found.setdefault(r.item_id, []).append(r.neighbour_id)
        assert {*found} == {*usable} and {len(v) for v in found.values()} == {5}
        hits = sum(len({*found[i]} & {*want[i]}) for i in want)
        assert hits / (5 * len(want)) >= 0.93
        assert sorted(found[1003]) == [0, 1000, 1001, 1002, 1004]
    # a vector that most keys have is compared once
    same = spark.createDataFrame([(i, [1.0, 2.0, 0.5]) for i in range(3000)] + [(5000 + i, [1.0, 2.0, 0.5 + i]) for i in range(1, 20)], "key long, embedding array<float>")
    visits = spark.sparkContext.accumulator(0)
    got = neighbours.most_similar(same, "key", visits=visits).collect()
    assert len(got) == 5 * 3019 and visits.value <= 8 * 20 * 20 and {r.neighbour_id for r in got if r.item_id < 3000} == {*range(6)}
    few = neighbours.most_similar(df.where("key < 3"), "key")
    assert few.count() == 6
    assert neighbours.most_similar(df.limit(0), "key").count() == 0


def test_perturbation_sets():
    sets = neighbours.perturbation_sets(6, 60)
    assert sets[0] == () and sets[1] == (0,) and len({*sets}) == len(sets) == 60
    assert not any(11 - p in s for s in sets for p in s)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(900)]
    rows = []
    for i in range(0, 300, 3):
        words = rng.sample(vocabulary, 60)
        rows.append((i, " ".join(words)))
        changed = rng.sample(vocabulary, 9)
        rows.append((i + 1, ", ".join([w.upper() for w in words[: 60 - i % 14]] + changed[: i % 14])))
        rows.append((i + 2, " ".join(reversed(words)) + " 12 34"))
    rows += rows[:10] + [(900, None), (901, ""), (902, "12 !"), (None, rows[0][1]), (903, "x " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "chunk_id long, text string, set_id int, band string")
    sets = {i: near_duplicates.words_of(t) for i, t in rows if i is not None and near_duplicates.words_of(t)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9}
    got = [(r.chunk_id_a, r.chunk_id_b) for r in near_duplicates.near_duplicate_pairs(df, threshold=0.7).collect()]
    assert len(got) == len({*got}) and {*got} <= want and len(got) >= 0.98 * len(want) and len(want) > 150
    assert near_duplicates.near_duplicate_pairs(df.limit(0)).count() == 0
    classes = {r.chunk_id: r.class_id for r in near_duplicates.near_duplicate_classes(df, threshold=0.7).collect()}
    assert {*classes} == {*sets} and all(classes[i] == classes[i + 2] == i for i in range(0, 300, 3) if sets[i] == sets[i + 2])


def test_chance_candidates_are_judged_before_they_are_stored(spark):
    """Sets a third alike by chance share bands in numbers that grow with the square of the
    table; nothing is shuffled for a pair that the sketches do not let through."""
    rng = random.Random(12)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(77)]
    rows = [(i, " ".join(rng.sample(vocabulary, 40))) for i in range(3000)]
    rows += [(5000 + i, text + " ownword" + chr(97 + i)) for i, (_, text) in enumerate(rows[:20])] + [(6000 + i, text) for i, (_, text) in enumerate(rows[20:30])]
    df = spark.createDataFrame(rows, "chunk_id long, text string").repartition(4, "chunk_id")
    context, name = spark.sparkContext, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    stages = lambda: context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    written = lambda: {stages().apply(i).stageId(): stages().apply(i).shuffleWriteRecords() for i in range(stages().size())}
    before, kept = written(), spark.conf.get(name)
    links, _ = near_duplicates.near_duplicate_sets(df, "chunk_id", "text", 0.7)
    moved = sum(n for i, n in written().items() if i not in before)
    assert moved < 1.5 * near_duplicates.BANDS * len(rows), moved  # the rows of the bands alone are once that
    assert spark.conf.get(name) == kept
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(t.split()), i)
    each = [*sets]
    bits = np.array([[w in s for w in [*vocabulary, *(f"ownword{chr(97 + i)}" for i in range(20))]] for s in each], dtype=np.int32)
    common, size = bits @ bits.T, bits.sum(axis=1)
    want = int((np.triu(common, 1) >= 0.7 * (size[:, None] + size - common) - 1e-9).sum())
    assert want >= 20 and 0.9 * want <= links.count() <= want


def test_name_forms():
    assert names.person_form("Capt. Richard U_ Frurk") == ("frurk", "richard", "u")
    assert names.person_form("Frurkig, Dick") == ("frurkig", "dick")
    assert names.person_form("Hitusim ML") == ("hitusim", "m", "l")
    assert names.person_form("...") is None and names.person_form("") is None
    assert names.within_one("abcd", "abdc") and names.within_one("abc", "abcd") and not names.within_one("abcd", "badc")
    same = lambda a, b: names.same_person(names.person_form(a), names.person_form(b))
    assert same("Penny Bolnugur", "Penelope Bolnugur") and same("W. K. Chovel", "William Kerensa Chhovel") and same("Una Galpa gimenko", "Una Galpagimenko")
    assert not same("William K. Chovel", "William D. Chovel") and not same("Ann Chovel", "Bert Chovel") and not same("Chovel", "Ann Chovel")
    org = lambda a, b: names.same_organisation(names.organisation_form(a), names.organisation_form(b))
    assert org("Drun Department of Sleep Affairs", "Drun DSA") and org("Inst. for Civic Stud. (Berk)", "Berk Institute for Civic Studies") and org("Klel & Sons Ltd", "Klel and Sons Limited")
    assert not org("Chal Department of Memory Affairs", "Chal Museum of Civic History") and not org("Chal Department", "Chal Department of Sleep")


def test_same_entities(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (1, "Anthony F. Drinbazar", "Person", [], near), (2, "A. Drinbazar", "Person", None, near), (3, "Drinbazar, Tony", "Person", ["The Pilot of Bifum"], near),
        (4, "The Pilot of Bifum", "Person", [], far), (5, "Anthony Drinbasar", "Person", [], near), (6, "Anthony Drinpazar", "Person", [], far),
        (7, "Anthony F. Drinbazar", "Organization", [], near), (8, None, "Person", ["Tony"], near), (9, "", "Person", [], near), (10, "Anthony F. Drinbazar", "Location", [], near),
    ]
    df = spark.createDataFrame([(*r, "f") for r in rows + rows[:3]], "entity_id long, name string, entity_type string, aliases array<string>, embedding array<float>, form string")
    got = {(r.entity_id_a, r.entity_id_b) for r in names.same_entity_pairs(df).collect()}
    assert got == {(a, b) for a in range(1, 6) for b in range(1, 6) if a < b}
    assert names.same_entity_pairs(df.limit(0)).count() == 0


def test_reordered_names_acronyms_and_numbers(spark):
    assert names.person_form("John Smith III") == ("smith", "john") and names.person_form("John Smith, IV") == ("smith", "john")
    assert names.same_person(names.person_form("Ludo Garciaz"), names.person_form("Ludovic Garciaz")) and not names.same_person(names.person_form("Al Garciaz"), names.person_form("Alma Garciaz"))
    rows = [(1, "Pablo Garcia", "Person"), (2, "Garcia Pablo", "Person"), (3, "Maria del Carmen Lopez", "Person"), (4, "Lopez Maria del Carmen", "Person"), (5, "Paula Garcia", "Person")]
    rows += [(6, "IBM", "Organization"), (7, "International Business Machines", "Organization"), (8, "World Health Organisation", "Organization"), (9, "WHO", "Organization"), (10, "The WHO Foundation", "Organization")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "entity_id long, name string, entity_type string, aliases array<string>, embedding array<float>")
    assert {(r.entity_id_a, r.entity_id_b) for r in names.same_entity_pairs(df).collect()} == {(1, 2), (3, 4), (6, 7), (8, 9)}


def test_one_family_name_with_very_many_forms(spark):
    rng = random.Random(2)
    syllables = ["ka", "lo", "mi", "ne", "ru", "sa", "to", "vu", "ze", "pi", "da", "ho"]
    givens = sorted({"".join(rng.choices(syllables, k=5)).capitalize() for _ in range(60_000)})[:50_000]
    rows = [(i, f"{g} Smithson", "Person", None) for i, g in enumerate(givens)] + [(100_000, f"{givens[7]} Smithsom", "Person", None), (100_001, f"Smithson, {givens[9]}", "Person", None)]
    df = spark.createDataFrame(rows, "entity_id long, name string, entity_type string, aliases array<string>")
    classes = {r.entity_id: r.class_id for r in names.same_entities(df, embedding=None).collect()}
    assert len(classes) == 50_002 and classes[100_000] == classes[7] and classes[100_001] == classes[9]


def test_limits_come_from_known_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        v = rng.standard_normal(16)
        name = "".join(chr(97 + x) for x in rng.integers(0, 26, 9)).capitalize()
        rows += [(3 * i, f"Anna {name}", "Person", [], v.tolist()), (3 * i + 1, f"Anna {name}", "Person", [], (v + 0.3 * rng.standard_normal(16)).tolist())]
        w = v if i % 2 else -v
        rows.append((3 * i + 2, f"Anna {name[:-1]}{'q' if name[-1] != 'q' else 'z'}", "Person", [], (w + 0.3 * rng.standard_normal(16)).tolist()))
    df = spark.createDataFrame(rows, "entity_id long, name string, entity_type string, aliases array<string>, embedding array<double>")
    classes = {r.entity_id: r.class_id for r in names.same_entities(df).collect()}
    assert all(classes[3 * i + 1] == classes[3 * i] for i in range(40)) and not any(classes[3 * i + 2] == classes[3 * i] for i in range(0, 40, 2))
    assert sum(classes[3 * i + 2] == classes[3 * i] for i in range(1, 40, 2)) >= 18  # two standard deviations keep most


def test_limits_come_from_every_known_pair(spark):
    """12,000 rows bear the name of row 0; the 2,000 pairs with the largest hashes are unlike."""
    from pyspark.sql import functions as F

    hashes = {r.id: r.h for r in spark.range(1, 12_001).select("id", F.xxhash64(F.lit(0).cast("long"), "id").alias("h")).collect()}
    rows = [(0, "Anna Smithson", [1.0, 0.0])] + [(k, "Anna Smithson", [1.0, 0.0] if i < 10_000 else [0.0, 1.0]) for i, k in enumerate(sorted(hashes, key=hashes.get))]
    rows += [(20_000, "Bert Kowalczyk", [1.0, 0.0]), (20_001, "Bert Kowalczuk", [0.6, 0.8]), (20_002, "Clara Drinbazar", [1.0, 0.0]), (20_003, "Clara Drinbasar", [0.05, 1.0])]
    df = spark.createDataFrame([(k, n, "Person", None, v) for k, n, v in rows], "entity_id long, name string, entity_type string, aliases array<string>, embedding array<double>")
    classes = {r.entity_id: r.class_id for r in names.same_entities(df).collect()}
    # of all pairs the mean is 0.833 and the deviation 0.373, so the limit is 0.088
    assert classes[20_001] == classes[20_000] == 20_000
    assert classes[20_003] != classes[20_002]
    assert {classes[k] for k in range(12_001)} == {0}
