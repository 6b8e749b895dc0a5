"""Tests of problem 5 on a small fixture."""

from quillgraph.llm import scans

BODY = "the modern committee recorded the careful survey and the stations within 45 days of the annual meeting near the cross-section"


def fixture():
    rows = [(100 + i, f"news|d{i}", 0, "\n".join([BODY, BODY, BODY])) for i in range(5)]
    pages = [
        "The modern com-\nmittee recorded the ca-\n- 1 -",
        "PAPERS OF QUENDAL\nreful 5urvey and the statioris\nwithin 4S days near the cross-\nsection of the rneeting\n\n- 2 -",
        "STUDY OF QUENDAL    3\n\nThe careful survey. (see Quendal, f. 1l)\nthe annua1 meeting near the (ommittee 8\n- 3 -",
        "PAPERS OF QUENDAL\n\nthe harbour-\n- l -",
    ]
    rows += [(i, "x-papers2|p.pdf", i, t) for i, t in enumerate(pages, 1)]
    return rows + rows[-4:-2] + [(50, "x-papers2|n.pdf", 0, None), (51, "x-papers2|e.pdf", 0, ""), (52, None, 0, "5urvey"), (53, "x-papers2|b.pdf", 0, "\n \n")]


def test_faults(spark):
    df = spark.createDataFrame([(*r, "w", 1) for r in fixture()], "chunk_id long, doc_name string, chunk_index long, text string, word string, page int")
    got = {tuple(r) for r in scans.scan_faults(df).collect()}
    assert got == {
        (1, 1, "hyphen", "committee"), (1, 2, "hyphen", "careful"), (1, 3, "page_number", ""),
        (2, 1, "header", ""), (2, 2, "misread", "survey"), (2, 2, "misread", "stations"), (2, 3, "misread", "45"),
        (2, 3, "hyphen", "cross-section"), (2, 4, "misread", "meeting"), (2, 6, "page_number", ""),
        (3, 1, "header", ""), (3, 3, "misread", "11"), (3, 4, "misread", "annual"), (3, 4, "misread", "committee"), (3, 5, "page_number", ""),
        (4, 1, "header", ""), (4, 4, "page_number", ""),
    }
    assert scans.scan_faults(df.limit(0)).count() == 0


def test_confusions():
    assert scans.one_confusion("rnodern", "modern") and scans.one_confusion("c1ear", "clear") and scans.one_confusion("iiiner", "iuner")
    assert not scans.one_confusion("rnodcrn", "modern") and not scans.one_confusion("modern", "modern")
    for right, wrong in scans.CONFUSIONS:
        if (right, wrong) not in (("n", "u"), ("u", "n"), ("tt", "u"), ("fi", "h"), ("e", "3")):
            assert len(scans.skeleton("x" + right)) > 0
    assert scans.as_number("l9S5") == "1955" and scans.as_number("so1") is None and scans.as_number("12") is None


def test_neighbours_decide_between_forms(spark):
    rows = [(i, f"news|d{i}", 0, "a standard form letter and an old farm house near the fields") for i in range(40)]
    rows += [(100 + i, f"news|e{i}", 0, "an old farm house\na small hat box and one hot day") for i in range(10)]
    rows += [(100 + i, f"news|f{i}", 0, "one standard form letter\na small hat box") for i in range(50, 120)]
    rows += [(900, "x-papers1|a", 0, "we saw a standard farm letter and an old farm house today"), (901, "x-papers1|b", 0, "a small h4t box and one h4t day")]
    df = spark.createDataFrame(rows, "chunk_id long, doc_name string, chunk_index long, text string")
    got = {tuple(r) for r in scans.scan_faults(df).collect()}
    assert got == {(900, 1, "misread", "form"), (901, 1, "misread", "hat")} | ({(901, 1, "misread", "hot")} if scans.one_confusion("h4t", "hot") else set())


def test_headers_on_one_page_each_share_a_name(spark):
    rows = [(1, "x-papers1|a", 1, "Quendal Inquiry on the Annual Report\nthe survey was long and"), (2, "x-papers1|a", 2, "Minor appendix of Quendal Inquiry\nthe survey was short."), (3, "x-papers1|a", 3, "Quendal was seen there\nthe survey was short.")]
    df = spark.createDataFrame(rows, "chunk_id long, doc_name string, chunk_index long, text string")
    assert {tuple(r) for r in scans.scan_faults(df).collect()} == {(1, 1, "header", ""), (2, 1, "header", "")}


def test_paragraphs_over_pages(spark):
    pages = [
        "The first text is here. And the com-", "PAPERS OF QUENDAL\nmittee, which goes on", "PAPERS OF QUENDAL\nand on to the",
        "PAPERS OF QUENDAL\n\nend of it.\n\nA rneeting was held.\n3", "Another page.\n- 5 -", "",
    ]
    rows = [(100 + i, f"news|d{i}", 0, BODY) for i in range(5)] + [(i, "x-papers2|p", i, t) for i, t in enumerate(pages)] + [(77, "x-papers2|q", 0, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[-4:-3]], "chunk_id long, doc_name string, chunk_index long, text string, no int")
    got = {tuple(r) for r in scans.repaired_text(df).collect()}
    assert got == {
        (0, 1, "x-papers2|p", "The first text is here. And the committee, which goes on and on to the end of it."),
        (3, 2, "x-papers2|p", "A meeting was held."), (4, 1, "x-papers2|p", "Another page."),
    }
    assert scans.repaired_text(df.limit(0)).count() == 0
