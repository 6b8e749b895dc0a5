"""The queries of the operators of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.common import table
from quillgraph.llm.boilerplate import repeated_line_places
from quillgraph.llm.leakage import leak_report, leaked_items
from quillgraph.llm.lookalike import same_looking_pairs
from quillgraph.llm.names import same_entity_pairs
from quillgraph.llm.near_duplicates import near_duplicate_pairs
from quillgraph.llm.neighbours import most_similar
from quillgraph.llm.scans import repaired_text, scan_faults
from quillgraph.llm.tokens import encode_corpus


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of every usable vector of both collections."""
    parts = [most_similar(table(spark, sf_dir, name), key).select(F.lit(name).alias("collection"), "item_id", "neighbour_id") for name, key in (("vectors", "chunk_id"), ("entities", "entity_id"))]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks that share at least 0.7 of their words."""
    return near_duplicate_pairs(table(spark, sf_dir, "chunks"), threshold=0.7)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, page numbers, cut and misread words of the scanned papers."""
    return scan_faults(table(spark, sf_dir, "chunks"))


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned papers as continuous paragraphs."""
    return repaired_text(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of persons or of organisations that mean the same one."""
    return same_entity_pairs(table(spark, sf_dir, "entities"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line that stands in at least 8 documents of its site."""
    return repeated_line_places(table(spark, sf_dir, "chunks"))


def p7_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The occurrences of lines of at least 8 documents that are not one republished
    article: of at least 4 clusters of equal documents and 3 days."""
    return repeated_line_places(table(spark, sf_dir, "chunks"), min_clusters=4, min_dates=3)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 13 consecutive words of an item's question or passage."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item that leaked the documents with its question, its passage, and its answer as well."""
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with different text that reads the same."""
    return same_looking_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p5_text": p5_text, "p6_found": p6_found, "p7_found": p7_found, "p7_boilerplate": p7_boilerplate, "p8_ids": p8_ids, "p9_found": p9_found, "p9_report": p9_report, "p10_found": p10_found}



# Fixed values, written out for the SQL on purpose: what problem 10 takes for equal.
_SQL_LETTERS = ("асеорхуіјѕһԁԛԝАВЕКМНОРСТХУІЈЅαινορΑΒΕΖΗΙΚΜΝΟΡΤΥΧёїЁЇ", "aceopxyijshdqwABEKMHOPCTXYIJSaivopABEZHIKMNOPTYXëïËÏ")
_SQL_LIGATURES = [("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬆ", "st")]
_SQL_BLANKS = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_SQL_HYPHENS = [0x2010, 0x2011, 0x2012, 0x2212]
_SQL_INVISIBLE = [0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF]


def _consistent(column: str) -> str:
    """The consistent form of a text, as SQL."""
    for ligature, plain in _SQL_LIGATURES:
        column = f"replace({column}, '{ligature}', '{plain}')"
    listed = lambda codes: "".join(map(chr, codes)).replace("'", "''")
    wide = range(0xFF01, 0xFF5F)
    old = listed(wide) + _SQL_LETTERS[0] + listed(_SQL_BLANKS + _SQL_HYPHENS + _SQL_INVISIBLE)
    new = listed(c - 0xFEE0 for c in wide) + _SQL_LETTERS[1] + " " * len(_SQL_BLANKS) + "-" * len(_SQL_HYPHENS)
    return f"nfc_normalize(translate({column}, '{old}', '{new}'))"


def _runs(key: str, source: str) -> str:
    """Every run of 13 words of a text, as SQL."""
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 12], ' ') AS run
  FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {key}, regexp_extract_all(lower({_consistent('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source}))"""


_LINES = r"""WITH lines AS (
  SELECT chunk_id, doc_name, split_part(doc_name, '|', 1) AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM (SELECT DISTINCT chunk_id, doc_name, text FROM chunks WHERE doc_name IS NOT NULL AND text IS NOT NULL)
),
keyed AS (
  SELECT *, regexp_replace(lower(trim(regexp_replace(line, '[\s\p{Z}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS k
  FROM lines WHERE length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 10
),
"""

ORACLE = {
    "p9_found": f"""WITH item AS (SELECT item_id, question AS text FROM eval_cases UNION ALL SELECT item_id, passage FROM eval_cases),
a AS ({_runs('item_id', 'item')}), b AS ({_runs('doc_id', 'documents')})
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (run)""",
    "p10_found": f"""WITH f AS (SELECT doc_id, text, {_consistent('text')} AS form FROM documents WHERE text IS NOT NULL),
g AS (SELECT * FROM f WHERE regexp_matches(form, '[^\\s]'))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_report": f"""WITH item AS (SELECT item_id, 'q' AS field, question AS text FROM eval_cases UNION ALL SELECT item_id, 'p', passage FROM eval_cases),
a AS ({_runs('item_id, field', 'item')}), b AS ({_runs('doc_id', 'documents')}),
hit AS (SELECT DISTINCT doc_id, item_id, field FROM a JOIN b USING (run)),
said AS (SELECT item_id, array_to_string(regexp_extract_all(lower({_consistent('answer')}), '[\\p{{L}}\\p{{N}}]+'), ' ') AS s FROM eval_cases),
doc AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower({_consistent('text')}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS t FROM documents SEMI JOIN hit USING (doc_id)),
per AS (SELECT item_id, doc_id, bool_or(field = 'q') AS q, bool_or(field = 'p') AS p, bool_or(s <> '' AND contains(t, ' ' || s || ' ')) AS a FROM hit JOIN said USING (item_id) JOIN doc USING (doc_id) GROUP BY 1, 2)
SELECT item_id, count(*) AS n_docs, count(*) FILTER (WHERE q) AS n_question, count(*) FILTER (WHERE p) AS n_passage, count(*) FILTER (WHERE a) AS n_answered FROM per GROUP BY 1""",
    "p7_found": _LINES + """often AS (SELECT site, k FROM keyed GROUP BY site, k HAVING count(DISTINCT doc_name) >= 8)
SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM keyed SEMI JOIN often USING (site, k)""",
    "p7_boilerplate": _LINES + """parts AS (SELECT doc_name, md5(text) AS h, min(CAST(ingested_at AS DATE)) AS day FROM chunks WHERE doc_name IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
docs AS (SELECT doc_name, string_agg(h, ' ' ORDER BY h) AS cluster, min(day) AS day FROM parts GROUP BY 1),
per_cluster AS (SELECT site, k, cluster, count(DISTINCT doc_name) AS n, min(day) AS day FROM (SELECT DISTINCT site, k, doc_name FROM keyed) JOIN docs USING (doc_name) GROUP BY 1, 2, 3),
often AS (SELECT site, k FROM per_cluster GROUP BY site, k HAVING sum(n) >= 8 AND count(*) >= 4 AND count(DISTINCT coalesce(day, DATE '0001-01-01')) >= 3)
SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM keyed SEMI JOIN often USING (site, k)""",
}
