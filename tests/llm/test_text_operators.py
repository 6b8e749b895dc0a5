"""Tests of problems 7 to 10 against brute force and exact round trips."""

import random
import re

import pytest

from quillgraph.llm import boilerplate, leakage, lookalike, tokens


def test_ids_round_trip_and_edges(spark):
    import tiktoken

    ranks = {t: i for i, t in enumerate(tokens.read_ranks(tokens.VOCABULARY))}
    known = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "  \n\t ", "Hello, world's  naïve\r\n text", "a" * 50_000, "漢字🙂‍<|endoftext|><unk>\x00▁Ġ", "ß " * 2000, "same", "same"]
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, key string, ids array<int>")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert got == {i: known.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = tokens.decode_corpus(tokens.encode_corpus(df))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_same_looking(spark):
    base = "A naïve co-op office, 12 flats"
    texts = {
        1: base, 2: base, 3: base.replace("ï", "ï"), 4: base.replace("o", "о"), 5: base.replace("ffi", "ﬃ").replace("fl", "ﬂ"),
        6: base.replace(" ", " "), 7: base.replace("-", "‐").replace("of", "o­f"), 8: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base),
        9: base.replace("ï", "i"), 10: base.upper(), 11: base.replace(" ", "\n"), 12: base.replace("12", "13"), 13: None, 14: "", 15: " ​\n", 16: " ",
    }
    df = spark.createDataFrame([(i, t, 0, "f") for i, t in texts.items()] + [(2, base, 0, "f")], "doc_id long, text string, key int, form string")
    got = {(r.doc_id_a, r.doc_id_b) for r in lookalike.same_looking_pairs(df).collect()}
    alike = range(1, 9)
    assert got == {(a, b) for a in alike for b in alike if a < b and texts[a] != texts[b]}
    assert lookalike.same_looking_pairs(df.limit(0)).count() == 0
    forms = {r.doc_id: r.canonical_text for r in lookalike.same_looking(df).collect()}
    assert len({forms[i] for i in alike}) == 1 and 13 not in forms and 16 not in forms


def test_confusable_letters(spark):
    letters = lookalike.confusable_letters(spark)
    assert len(letters) > 150 and all(letters[c] == x for c, x in lookalike.LOOK_ALIKE.items())
    assert letters["Ꭺ"] == "A" and letters["ꓳ"] == "O" and letters["Ӏ"] == "I" and "б" not in letters and "ж" not in letters
    texts = {1: "SPAM offer", 2: "ЅРАМ offer", 3: "SPᎪM offer", 4: "𝐒𝐏𝐀𝐌 𝑜𝑓𝑓𝑒𝑟", 5: "SPAM off3r", 6: "spam offer", 7: "ﺳﻼم", 8: "سلام"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {(r.doc_id_a, r.doc_id_b) for r in lookalike.same_looking_pairs(df).collect()}
    assert {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)} <= got and not any({5, 6} & {*p} for p in got)


def test_invisible_and_blank_tables_are_what_they_say():
    import unicodedata

    assert all(unicodedata.category(c) == "Zs" for c in lookalike.BLANKS)
    assert all(unicodedata.category(c) in ("Cf", "Mn", "Lo") for c in lookalike.INVISIBLE)


def test_repeated_lines(spark):
    rng = random.Random(1)
    rows = []
    for n in range(60):
        site, doc = f"s{n % 3}", f"s{n % 3}|d{n // 2}"
        lines = ["Share this page %d times  NOW" % n if n % 2 else "share\tthis page 7 times now ", "tiny 1", "unique words %s" % "".join(rng.choices("abcdef", k=12)), ""]
        rows.append((n, doc, "\n".join(lines), None, "x", 1))
    rows += rows[:5] + [(900, None, "Share this page 1 times now", None, "x", 1), (901, "s0|z", None, None, "x", 1), (902, "s0|e", "", None, "x", 1)]
    df = spark.createDataFrame(rows, "chunk_id long, doc_name string, text string, ingested_at timestamp, line string, cluster int")
    seen = {}
    norm = lambda s: re.sub("[0-9]+", "0", re.sub(r"\s+", " ", s).strip().lower())
    for c, d, t, *_ in rows:
        for i, line in enumerate((t or "").split("\n"), 1):
            if d and len(re.findall(r"[^\W\d_]", line)) >= 10:
                seen.setdefault((d.split("|")[0], norm(line)), []).append((c, i, d))
    want = {(c, i) for v in seen.values() if len({d for *_, d in v}) >= 8 for c, i, _ in v}
    got = [(r.chunk_id, r.line_no) for r in boilerplate.repeated_line_places(df).collect()]
    assert want and len(got) == len({*got}) and {*got} == want
    clean = {r.chunk_id: r.text for r in boilerplate.without_repeated_lines(df).collect()}
    assert "hare" not in clean[3] and clean[901] is None and clean[902] == "" and clean[3].startswith("tiny 1\nunique")
    assert boilerplate.repeated_line_places(df, min_clusters=9999).count() == 0
    assert boilerplate.repeated_line_places(df.limit(0)).count() == 0


def test_republished_articles_are_no_boilerplate(spark):
    from datetime import datetime

    rows = [(n, f"s|r{n}", "a republished article about rivers\nand its second line", datetime(2024, 1, 1 + n)) for n in range(12)]  # one cluster
    rows += [(100 + n, f"s|d{n}", f"share this page with friends\nown words {'abcdefghijkl'[n]}", datetime(2024, 1, 1 + n)) for n in range(12)]
    rows += [(200 + n, f"s|o{n}", f"only on one single day\nother words {'abcdefghijkl'[n]}", datetime(2024, 2, 1)) for n in range(12)]
    df = spark.createDataFrame(rows, "chunk_id long, doc_name string, text string, ingested_at timestamp")
    lines = lambda **least: {tuple(r) for r in boilerplate.repeated_line_places(df, **least).collect()}
    assert {c // 100 for c, _ in lines()} == {0, 1, 2}
    assert lines(min_clusters=4) == {(c, 1) for c in (*range(100, 112), *range(200, 212))}
    assert lines(min_clusters=4, min_dates=3) == {(c, 1) for c in range(100, 112)}
    counts = {r.n_docs: (r.n_clusters, r.n_dates) for r in boilerplate.repeated_lines(df, min_clusters=4, min_dates=3).collect()}
    assert counts == {12: (12, 12)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["naïve", "café"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 13, 30, 90]))), rng.choice([None, "", " ".join(rng.choices(vocabulary, k=40))])) for i in range(120)]
    documents = [(0, None), (1, ""), (2, "w1 w2")]
    for d in range(3, 160):
        words = rng.choices(vocabulary, k=rng.choice([20, 150, 400]))
        field = (items[rng.randrange(120)][rng.choice([1, 2])] or "").split()
        k, at = rng.choice([11, 12, 13, 14, 40]), rng.randrange(len(words))
        start = rng.randrange(max(1, len(field) - k + 1))
        words[at:at] = field[start : start + k]
        text = ", ".join(words)
        documents.append((d, text.upper().replace("W", "Ｗ") if d % 3 else text.replace("é", "é")))
    run = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    want = {(d, i) for d, t in documents for i, *fields in items if any(run(leakage.words_of(t)) & run(leakage.words_of(f)) for f in fields)}
    docs = spark.createDataFrame([(*r, 1) for r in documents + documents[:9]], "doc_id long, text string, item int")
    tests = spark.createDataFrame([(*r, "k") for r in items], "item_id int, question string, passage string, key string")
    got = leakage.leaked_items(docs, tests)
    assert len(want) > 30 and sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted(want)
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, tests, max_words=1500).collect()} == want
    assert leakage.leaked_items(docs, tests.limit(0)).count() == 0 and leakage.leaked_items(docs.limit(0), tests).count() == 0


def test_many_items_need_one_pass_and_answers_are_checked(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20)), None, f"answer {i}") for i in range(5000)]
    docs = [(d, " ".join([*rng.choices(vocabulary, k=30), items[7 * d][1], "the ANSWER", str(7 * d + d % 2), "x"])) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = leakage.leaks(df, spark.createDataFrame(items, "item_id long, question string, passage string, answer string"))
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(d, 7 * d, "question", d % 2 == 0) for d in range(60)]
    report = {r.item_id: tuple(r)[1:] for r in leakage.leak_report(df, spark.createDataFrame(items, "item_id long, question string, passage string, answer string")).collect()}
    assert report[14] == (1, 1, 0, 1) and report[7] == (1, 1, 0, 0) and len(report) == 60


@pytest.mark.parametrize("text", ["", "ﬁle", "е́"])
def test_canonical_form_is_stable(text):
    assert lookalike.canonical(lookalike.canonical(text)) == lookalike.canonical(text)
