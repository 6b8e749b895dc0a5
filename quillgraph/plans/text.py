"""Queries of chunking, extraction, stores and streaming, with their SQL."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.common import table
from quillgraph.functions import scalar as S
from quillgraph.operators import extraction as X
from quillgraph.operators import text as T
from quillgraph.plans.base import CHUNK, MEN, chunk_docs, chunks, entities, mentions
from quillgraph.sources import stores
from quillgraph.streaming.ingest import replay


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def chunk_character(s, d):
    return T.character_chunks(_docs(s, d)).select("doc_id", "chunk_index", "start", F.md5("text").alias("h"))


def chunk_surrounding(s, d):
    return T.character_chunks(_docs(s, d)).select("doc_id", "chunk_index", F.length("surrounding").alias("n"), F.md5("surrounding").alias("h"))


def chunk_paragraph(s, d):
    return T.paragraph_chunks(_docs(s, d), 400, 50)


def chunk_ids(s, d):
    return T.with_chunk_ids(table(s, d, "chunks").select("doc_name", "chunk_index").distinct()).select("doc_name", "chunk_index", "chunk_id")


def context_window(s, d):
    return T.context_windows(chunks(s, d)).select("chunk_id", F.length("window_text").alias("n"), F.md5("window_text").alias("h"))


def _sections(s):
    return s.createDataFrame([(0, "appendix", "appendix", True), (1, "pre", "preface", False), (2, "chapter", "chapter", False), (3, "note", "end_notes", True)], "ord int, pattern string, section_type string, skip boolean")


def section_match(s, d):
    heads = table(s, d, "chunks").where("section_name IS NOT NULL").select("chunk_id", "section_name").distinct().groupBy("chunk_id").agg(F.min("section_name").alias("heading"))
    return T.match_sections(heads.withColumnRenamed("chunk_id", "id"), _sections(s))


_HEADED = "concat(text, chr(10), 'By Jane Q. Doe', chr(10), '© Town Press, ', cast(1900 + doc_id % 150 as string), ' Copyright', chr(10), 'Published by House ', cast(doc_id % 7 as string), ', Town', chr(10), 'ISBN 97-', cast(10000000000 + doc_id as string))"


def schema_autodetect(s, d):
    rows = _docs(s, d).where("text IS NOT NULL").select("doc_id", F.expr(_HEADED).alias("text"))
    return T.detect_schema(rows)


def index_seeds(s, d):
    pages = F.concat(F.lit(", "), F.pmod("entity_id", F.lit(300)).cast("string"), F.lit("-"), F.pmod("entity_id", F.lit(7)).cast("string"))
    return T.index_seeds(entities(s, d).select(F.col("entity_id").alias("id"), F.concat("name", pages).alias("line")))


def html_strip(s, d):
    rows = _docs(s, d).where("text IS NOT NULL").select("doc_id", F.concat(F.lit("<html><p class='x'>"), F.regexp_replace("text", " the ", " <b>the</b> "), F.lit("</p></html>")).alias("t"))
    return rows.select("doc_id", F.md5(T.strip_html(F.col("t"))).alias("h"))


def vtt_strip(s, d):
    rows = table(s, d, "chunks").where("doc_name LIKE '%.vtt'").groupBy("chunk_id").agg(F.min("text").alias("text"))
    rows = rows.select("chunk_id", F.concat(F.lit("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n"), "text").alias("t"))
    return rows.select("chunk_id", F.md5(T.strip_vtt(F.col("t"))).alias("h"))


def doc_prefix(s, d):
    rows = table(s, d, "chunks").select("chunk_id", "doc_name", "section_name", "text").dropDuplicates(["chunk_id"])
    tagged = F.when(F.coalesce("section_name", F.lit("")) != "", F.concat(F.lit("["), "section_name", F.lit("] "), "text")).otherwise(F.col("text"))
    return rows.select("chunk_id", F.md5(tagged).alias("h"))


def pattern_ner(s, d):
    """The names in whole documents and in chunks, whose ids are their own."""
    sources = {"documents": _docs(s, d), "chunks": chunks(s, d).select(F.col("chunk_id").alias("doc_id"), "text")}
    found = [X.pattern_entities(rows).select(F.lit(name).alias("source"), "doc_id", "name", "entity_type", "confidence") for name, rows in sources.items()]
    return found[0].unionByName(found[1])


def capitalised_ner(s, d):
    found = X.capitalised_entities(_docs(s, d))
    return found.select("doc_id", "name", "n", F.round("confidence", 6).alias("confidence"))


def relation_regex(s, d):
    docs = _docs(s, d).where("text IS NOT NULL")
    names = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9_]+"))).alias("name"))
    return X.phrase_relations(docs, names).select("doc_id", "src", "dst", "relation_type", F.round("confidence", 2).alias("confidence"))


def definite_descriptions(s, d):
    """Of persons, places and groups, among the entities that a chunk, or any chunk
    of a document's name, mentions."""
    seen = mentions(s, d).join(entities(s, d).where("name IS NOT NULL").select("entity_id", "name", "aliases", "entity_type"), "entity_id")
    docs = chunk_docs(s, d).select("chunk_id", F.col("doc_id").alias("doc_name")).join(table(s, d, "documents").select("doc_name", "doc_id"), "doc_name")
    sources = {
        "documents": (_docs(s, d), seen.join(docs, "chunk_id").select("doc_id", "name", "aliases", "entity_type")),
        "chunks": (chunks(s, d).select(F.col("chunk_id").alias("doc_id"), "text"), seen.select(F.col("chunk_id").alias("doc_id"), "name", "aliases", "entity_type")),
    }
    found = [
        X.describe(rows, candidates.where(F.col("entity_type") == kind), kind).select(F.lit(name).alias("source"), "doc_id", F.lit(kind).alias("entity_type"), "surface", "offset", "entity_name")
        for name, (rows, candidates) in sources.items()
        for kind in ("Person", "Location", "Organization")
    ]
    return reduce(DataFrame.unionByName, found)


def described_entities(s, d):
    """Descriptions of all three kinds in documents with a sentence at their end, resolved
    to one name a document with one alias; the last letter of the name tells the kind."""
    text = F.concat("text", F.lit(" My father met the author in the district of the committee."))
    docs = table(s, d, "documents").where("text IS NOT NULL AND doc_name IS NOT NULL").select("doc_id", "doc_name", text.alias("text"))
    kinds = {"Person": [w for _, w in X.KINSHIP], "Location": X.PLACES, "Organization": X.GROUPS}
    found = []
    for i, (kind, words) in enumerate(kinds.items()):
        word = F.element_at(F.array(*(F.lit(w) for w in words)), (F.pmod("doc_id", F.lit(len(words))) + 1).cast("int"))
        candidates = docs.select("doc_id", F.concat("doc_name", F.lit(f" {i}")).alias("name"), F.array(word).alias("aliases"))
        found.append(X.describe(docs, candidates, kind).select("doc_id", "surface", "offset", "entity_name"))
    return reduce(DataFrame.unionByName, found)


def proper_nouns(s, d):
    return X.proper_noun_rows(_docs(s, d))


def pronoun_resolution(s, d):
    return X.pronoun_rows(_docs(s, d))


def span_clean(s, d):
    rows = X.capitalised_entities(_docs(s, d), 1).select("doc_id", F.col("name").alias("text"), F.lit("person").alias("label"), F.col("confidence").alias("score"))
    return X.clean_spans(rows)


def refine_budget(s, d):
    return X.inside_order(entities(s, d).where("confidence < 0.5").select("entity_id", "confidence"), 50)


def token_statistics(s, d):
    rows = _docs(s, d).select("doc_id", S.tokens(F.col("text")).alias("t")).where("t IS NOT NULL")
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


def vector_upsert(s, d):
    v = table(s, d, "vectors").where("size(embedding) = 48").select("chunk_id", "embedding", "embedded_at")
    new = stores.latest(v, ["chunk_id"], "embedded_at").where("chunk_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    old = stores.latest(v, ["chunk_id"], "embedded_at")
    rows = stores.upsert(old, stores.checked_vectors(new, 48), ["chunk_id"])
    return rows.select("chunk_id", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"))


def doc_index(s, d):
    return stores.document_index(table(s, d, "chunks"))


def doc_delete(s, d):
    gone = s.createDataFrame([("listserv|tidal_discussion_full.txt",)], "doc_name string")
    return stores.delete_documents(chunks(s, d), gone).select("chunk_id", "doc_name")


def chunk_point_lookup(s, d):
    ids = table(s, d, "deletions").where("target_kind = 'chunk'").select(F.col("target_id").alias("chunk_id"))
    return stores.point_lookup(ids, chunks(s, d).select("chunk_id", "doc_name", "chunk_index"), "chunk_id")


def reingest_detection(s, d):
    docs = table(s, d, "documents").where("doc_name IS NOT NULL").select("doc_name", F.unix_seconds(F.col("ingested_at").cast("timestamp")).alias("mtime_secs"), F.coalesce("n_chars", F.lit(0)).alias("file_size"))
    known = docs.where("file_size % 5 <> 0").withColumn("file_size", F.when(F.col("file_size") % 7 == 0, 1).otherwise(F.col("file_size")))
    return stores.changed_files(docs, known)


def ragas_export(s, d):
    cases = table(s, d, "eval_cases").select("question", "answer", F.array("passage").alias("contexts"), F.when(F.col("item_id") % 2 == 0, F.col("answer")).alias("ground_truth"))
    return stores.grounding_export(cases).select("question", "answer", F.element_at("contexts", 1).alias("context"), "ground_truth")


def streaming_ingest(s, d):
    """A replay of the chunks as a stream of files gives the latest row of each chunk."""
    source = f"{d}/chunks.parquet"
    return replay(s, source if os.path.isdir(source) else f"{d}/chunks*.parquet", ["chunk_id"], "ingested_at").select("chunk_id", "doc_name", F.md5("text").alias("h"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_character, chunk_surrounding, chunk_paragraph, chunk_ids, context_window, section_match, schema_autodetect, index_seeds, html_strip, vtt_strip, doc_prefix, pattern_ner, capitalised_ner,
        relation_regex, definite_descriptions, described_entities, proper_nouns, pronoun_resolution, span_clean, refine_budget, token_statistics, vector_upsert, doc_index, doc_delete, chunk_point_lookup,
        reingest_detection, ragas_export, streaming_ingest,
    )
}

_WIN = """w AS (SELECT doc_id, text, unnest(range(0, length(text), 600)) AS start FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, start, substring(text, start + 1, 800) AS part, substring(text, greatest(0, start - 200) + 1, least(length(text), least(length(text), start + 800) + 200) - greatest(0, start - 200)) AS around FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i FROM c WHERE length(part) >= 20)"""
_LE = "'0x' || x[15:16] || x[13:14] || x[11:12] || x[9:10] || x[7:8] || x[5:6] || x[3:4] || x[1:2]"
_NARR = "('main', 'chapter', 'introduction', 'preface')"
_ORGW = " OR ".join(f"contains(lower(part), '{w}')" for w in T.ORGANISATION_WORDS)
_PLCW = ", ".join(f"'{w}'" for w in T.PLACE_WORDS)
_NAMEP = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
_RELS = "\nUNION\n".join(
    f"SELECT doc_id, lower(s) AS src, lower(t) AS dst, '{k}' AS relation_type, {c} AS confidence FROM (SELECT doc_id, unnest(regexp_extract_all(text, p, 1)) AS s, unnest(regexp_extract_all(text, p, 2)) AS t FROM (SELECT doc_id, text, '(?i)([a-z0-9_]+)\\s+{ph}{chr(92)}s{'*' if ph.endswith('?') else '+'}([a-z0-9_]+)' AS p FROM documents WHERE text IS NOT NULL))"
    for ph, k, c in X.RELATION_PHRASES
)

ORACLE = {
    "chunk_character": f"WITH {_WIN} SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, md5(part) AS h FROM k",
    "chunk_surrounding": f"WITH {_WIN} SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(length(around) AS INTEGER) AS n, md5(around) AS h FROM k",
    "chunk_ids": f"""WITH u AS (SELECT DISTINCT doc_name, chunk_index, printf('%08x', chunk_index) AS hx FROM chunks),
h AS (SELECT *, sha256(encode(doc_name) || encode('::') || unhex(hx[7:8] || hx[5:6] || hx[3:4] || hx[1:2])) AS x FROM u),
b AS (SELECT *, CAST(CAST({_LE} AS UBIGINT) AS HUGEINT) AS big FROM h)
SELECT doc_name, chunk_index, CAST(CASE WHEN big >= 9223372036854775808 THEN big - 18446744073709551616 ELSE big END AS BIGINT) AS chunk_id FROM b""",
    "context_window": f"""WITH {CHUNK}, l AS (SELECT *, lag((section_type, text)) OVER o AS p, lead((section_type, text)) OVER o AS q FROM (SELECT chunk_id, doc_name, chunk_index, section_type, coalesce(text, '') AS text FROM one) WINDOW o AS (PARTITION BY doc_name ORDER BY chunk_index, chunk_id)),
t AS (SELECT chunk_id, CASE WHEN section_type IN {_NARR} AND p[1] IN {_NARR} THEN p[2] || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) ELSE '' END || text || CASE WHEN section_type IN {_NARR} AND q[1] IN {_NARR} THEN chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || q[2] ELSE '' END AS w FROM l)
SELECT chunk_id, CAST(length(w) AS INTEGER) AS n, md5(w) AS h FROM t""",
    "section_match": """WITH d(ord, pattern, section_type, skip) AS (VALUES (0, 'appendix', 'appendix', true), (1, 'pre', 'preface', false), (2, 'chapter', 'chapter', false), (3, 'note', 'end_notes', true)),
h AS (SELECT chunk_id AS id, min(section_name) AS heading FROM chunks WHERE section_name IS NOT NULL GROUP BY 1),
m AS (SELECT id, min(ord) AS ord FROM h JOIN d ON contains(lower(heading), pattern) GROUP BY 1)
SELECT id, heading, pattern, coalesce(section_type, 'main') AS section_type, coalesce(skip, false) AS skip FROM h LEFT JOIN m USING (id) LEFT JOIN d USING (ord)""",
    "html_strip": "SELECT doc_id, md5(regexp_replace('<html><p class=''x''>' || replace(text, ' the ', ' <b>the</b> ') || '</p></html>', '<[^>]+>', '', 'g')) AS h FROM documents WHERE text IS NOT NULL",
    "vtt_strip": r"""WITH t AS (SELECT chunk_id, 'WEBVTT' || chr(10) || chr(10) || '1' || chr(10) || '00:00:01.000 --> 00:00:02.000' || chr(10) || min(text) AS t FROM chunks WHERE doc_name LIKE '%.vtt' GROUP BY 1)
SELECT chunk_id, md5(array_to_string([x FOR x IN string_split(t, chr(10)) IF trim(x) <> '' AND NOT starts_with(x, 'WEBVTT') AND NOT contains(x, '-->') AND NOT regexp_matches(x, '^\s*[0-9]+\s*$')], chr(10))) AS h FROM t""",
    "doc_prefix": "WITH o AS (SELECT DISTINCT chunk_id, section_name, text FROM chunks) SELECT chunk_id, md5(CASE WHEN coalesce(section_name, '') <> '' THEN '[' || section_name || '] ' || text ELSE text END) AS h FROM o",
    "capitalised_ner": rf"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\x{{2000}}-\x{{206F}}\x{{a0}}]', '_', 'g'), '\b({_NAMEP})\b', 1)) AS name FROM documents WHERE text IS NOT NULL)
SELECT doc_id, name, count(*) AS n, round(CAST(least(0.6, 0.3 + 0.1 * count(*)) AS DOUBLE), 6) AS confidence FROM r WHERE length(name) > 2 AND lower(name) NOT IN ({', '.join(f"'{w}'" for w in X.COMMON)}) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "index_seeds": rf"""WITH l AS (SELECT entity_id AS id, trim(name || ', ' || CAST(((entity_id % 300) + 300) % 300 AS VARCHAR) || '-' || CAST(((entity_id % 7) + 7) % 7 AS VARCHAR)) AS line FROM entities),
p AS (SELECT id, trim(regexp_replace(line, ',\s*[0-9ivxlcIVXLC, \-–]+$', '')) AS part FROM l WHERE length(line) >= 3 AND NOT regexp_matches(line, '^[0-9]')),
s AS (SELECT *, regexp_extract(part, '^(\p{{Lu}}\S*),\s*(\p{{Lu}}.*)$', 1) AS last, regexp_extract(part, '^(\p{{Lu}}\S*),\s*(\p{{Lu}}.*)$', 2) AS rest, regexp_split_to_array(part, '\s+') AS w FROM p WHERE length(part) >= 2)
SELECT id, trim(CASE WHEN last <> '' THEN rest || ' ' || last ELSE part END) AS name, CASE WHEN last <> '' THEN 'Person' WHEN {_ORGW} OR (contains(part, '(') AND contains(part, ')')) THEN 'Organization'
  WHEN len(w) BETWEEN 2 AND 4 AND len([x FOR x IN w IF NOT regexp_matches(x, '^\p{{Lu}}')]) = 0 AND len([x FOR x IN regexp_split_to_array(lower(part), '\s+') IF x IN ({_PLCW})]) = 0 THEN 'Person' END AS type_hint FROM s""",
    "schema_autodetect": r"""WITH t AS (SELECT doc_id, substring(text || chr(10) || 'By Jane Q. Doe' || chr(10) || '© Town Press, ' || CAST(1900 + doc_id % 150 AS VARCHAR) || ' Copyright' || chr(10) || 'Published by House ' || CAST(doc_id % 7 AS VARCHAR) || ', Town' || chr(10) || 'ISBN 97-' || CAST(10000000000 + doc_id AS VARCHAR), 1, 3000) AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM t),
x AS (SELECT doc_id,
  [d FOR d IN [regexp_replace(y, '[^0-9X]', '', 'g') FOR y IN ls IF contains(y, 'ISBN')] IF length(d) IN (10, 13)][1] AS isbn,
  [d FOR d IN [trim(regexp_extract(y, '(?i)published by\s*([^,.]*)', 1)) FOR y IN ls IF contains(lower(y), 'published by')] IF length(d) > 0 AND length(d) < 80][1] AS publisher,
  [d FOR d IN [regexp_extract(y, '(1[89][0-9]{2}|20[0-9]{2}|2100)', 1) FOR y IN ls IF contains(lower(y), 'copyright') OR contains(y, '©')] IF d <> ''][1] AS year,
  [d FOR d IN [trim(regexp_replace(trim(regexp_extract(y, '©\s*(?:opyright)?\s*([^0-9]*)', 1)), ',+$', '')) FOR y IN ls IF contains(y, '©')] IF length(d) > 2][1] AS copyright_holder,
  [d FOR d IN [trim(substring(trim(y), 4, 200)) FOR y IN ls IF starts_with(trim(y), 'By ')] IF regexp_matches(d, '^\p{Lu}') AND len(regexp_split_to_array(d, '\s+')) BETWEEN 2 AND 5][1] AS author FROM l)
SELECT doc_id, CASE WHEN isbn IS NOT NULL THEN 'Book' END AS schema_type, isbn, publisher, year, year AS copyright_year, year AS date_published, copyright_holder, author FROM x""",
    "relation_regex": f"""WITH r AS ({_RELS}),
n AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS name FROM documents WHERE text IS NOT NULL)
SELECT doc_id, src, dst, relation_type, round(CAST(confidence AS DOUBLE), 2) AS confidence FROM r SEMI JOIN n a ON a.doc_id = r.doc_id AND a.name = r.src SEMI JOIN n b ON b.doc_id = r.doc_id AND b.name = r.dst WHERE src <> dst""",
    "described_entities": "WITH t AS (SELECT doc_id, doc_name, lower(text || ' My father met the author in the district of the committee.') AS low FROM documents WHERE text IS NOT NULL AND doc_name IS NOT NULL), "
    + f"k AS (SELECT 0 AS kind, surface, word FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in X.KINSHIP)}) v(surface, word) UNION ALL SELECT 1, 'the ' || w, w FROM (SELECT unnest({X.PLACES}) AS w) UNION ALL SELECT 2, 'the ' || w, w FROM (SELECT unnest({X.GROUPS}) AS w)), "
    + f"c AS (SELECT doc_id, 0 AS kind, doc_name || ' 0' AS name, {[w for _, w in X.KINSHIP]}[doc_id % {len(X.KINSHIP)} + 1] AS alias FROM t UNION ALL SELECT doc_id, 1, doc_name || ' 1', {X.PLACES}[doc_id % {len(X.PLACES)} + 1] FROM t UNION ALL SELECT doc_id, 2, doc_name || ' 2', {X.GROUPS}[doc_id % {len(X.GROUPS)} + 1] FROM t), "
    + r"w AS (SELECT doc_id, kind, name, alias AS word FROM c WHERE kind = 0 UNION SELECT doc_id, kind, name, unnest(regexp_split_to_array(lower(name || ' ' || alias), '[^\p{L}]+')) FROM c WHERE kind > 0) "
    + "SELECT doc_id, surface, CAST(instr(low, surface) - 1 AS INTEGER) AS offset, min(name) AS entity_name FROM t JOIN k ON contains(low, surface) JOIN w USING (doc_id, kind, word) GROUP BY 1, 2, 3",
    "pattern_ner": rf"""WITH {CHUNK}, src AS (SELECT 'documents' AS source, doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'chunks', chunk_id, text FROM one WHERE text IS NOT NULL),
t AS (SELECT source, doc_id, regexp_replace(text, '[^\x00-\x7F\x{{2000}}-\x{{206F}}\x{{a0}}]', '_', 'g') AS x FROM src),
r AS (SELECT source, doc_id, unnest(regexp_extract_all(x, '\b(?i:{'|'.join(X.TITLES)})\.?\s+({_NAMEP})\b', 1)) AS name, 'Person' AS entity_type, 0.85 AS confidence FROM t
  UNION ALL SELECT source, doc_id, unnest(regexp_extract_all(x, '({_NAMEP})\s+(?i:(?:is\s+)?(?:an?\s+)?(?:{'|'.join(X.ROLES)}))\b', 1)), 'Person', 0.75 FROM t
  UNION ALL SELECT source, doc_id, unnest(regexp_extract_all(x, '\b({_NAMEP}\s+(?i:{'|'.join(X.ORGANISATIONS)}))\b', 1)), 'Organization', 0.8 FROM t)
SELECT source, doc_id, min(regexp_replace(name, '\s+', ' ', 'g')) AS name, entity_type, CAST(max(confidence) AS DOUBLE) AS confidence FROM r GROUP BY source, doc_id, lower(regexp_replace(name, '\s+', ' ', 'g')), entity_type""",
    "span_clean": rf"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\x{{2000}}-\x{{206F}}\x{{a0}}]', '_', 'g'), '\b({_NAMEP})\b', 1)) AS name FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, name, CAST(least(0.6, 0.3 + 0.1 * count(*)) AS DOUBLE) AS score FROM r WHERE length(name) > 2 AND lower(name) NOT IN ({', '.join(f"'{w}'" for w in X.COMMON)}) GROUP BY 1, 2),
b AS (SELECT doc_id, lower(name) AS key, max(score) AS score, min(name) AS text FROM n GROUP BY 1, 2)
SELECT doc_id, text, 'person' AS label, score FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND contains(o.key, b.key) AND length(o.key) > length(b.key) AND length(o.key) - length(b.key) <= 20 AND b.score <= o.score + 0.05)""",
    "definite_descriptions": f"""WITH {MEN}, {CHUNK}, seen AS (SELECT chunk_id, name, coalesce(aliases, []) AS aliases, entity_type FROM men JOIN entities USING (entity_id) WHERE name IS NOT NULL),
texts AS (SELECT 'documents' AS source, doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'chunks', chunk_id, lower(text) FROM one WHERE text IS NOT NULL),
cand AS (SELECT 'documents' AS source, d.doc_id, seen.* EXCLUDE (chunk_id) FROM seen JOIN cd ON cd.chunk_id = seen.chunk_id JOIN documents d ON d.doc_name = cd.doc_id UNION ALL SELECT 'chunks', chunk_id, name, aliases, entity_type FROM seen),
kin(surface, word) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in X.KINSHIP)}),
surf AS (SELECT 'Person' AS entity_type, surface, word FROM kin UNION ALL SELECT 'Location', 'the ' || w, w FROM (VALUES {', '.join(f"('{w}')" for w in X.PLACES)}) t(w) UNION ALL SELECT 'Organization', 'the ' || w, w FROM (VALUES {', '.join(f"('{w}')" for w in X.GROUPS)}) t(w)),
words AS (SELECT DISTINCT source, doc_id, entity_type, name, lower(unnest(aliases)) AS word FROM cand WHERE entity_type = 'Person'
  UNION SELECT DISTINCT source, doc_id, entity_type, name, unnest(regexp_split_to_array(lower(array_to_string(list_concat([name], aliases), ' ')), '[^\\p{{L}}]+')) FROM cand WHERE entity_type IN ('Location', 'Organization'))
SELECT t.source, t.doc_id, s.entity_type, s.surface, CAST(instr(low, s.surface) - 1 AS INTEGER) AS offset, min(w.name) AS entity_name
FROM texts t JOIN surf s ON contains(low, s.surface) JOIN words w ON w.source = t.source AND w.doc_id = t.doc_id AND w.entity_type = s.entity_type AND w.word = s.word GROUP BY 1, 2, 3, 4, 5""",
    "refine_budget": "SELECT entity_id, confidence FROM entities WHERE confidence < 0.5 ORDER BY confidence, entity_id LIMIT 50",
    "token_statistics": r"WITH t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> ''] AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_terms FROM t",
    "vector_upsert": """WITH v AS (SELECT chunk_id, embedding, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC) AS r FROM vectors WHERE len(embedding) = 48)
SELECT chunk_id, round(CAST(embedding[1] AS DOUBLE) * CASE WHEN chunk_id % 3 = 0 THEN 2 ELSE 1 END, 4) AS first FROM v WHERE r = 1""",
    "doc_index": "SELECT doc_name, count(DISTINCT chunk_id) AS n_chunks, min(chunk_id) AS first_id, max(chunk_id) AS last_id FROM chunks GROUP BY 1",
    "doc_delete": f"WITH {CHUNK} SELECT chunk_id, doc_name FROM one WHERE doc_name <> 'listserv|tidal_discussion_full.txt'",
    "chunk_point_lookup": f"WITH {CHUNK} SELECT d.target_id AS chunk_id, doc_name, chunk_index FROM deletions d LEFT JOIN one ON chunk_id = target_id WHERE target_kind = 'chunk'",
    "reingest_detection": "SELECT doc_name, CASE WHEN coalesce(n_chars, 0) % 5 = 0 THEN 'new' ELSE 'changed' END AS reason FROM documents WHERE doc_name IS NOT NULL AND (coalesce(n_chars, 0) % 5 = 0 OR (coalesce(n_chars, 0) % 7 = 0 AND n_chars <> 1))",
    "ragas_export": "SELECT question, answer, passage AS context, CASE WHEN item_id % 2 = 0 THEN answer ELSE '' END AS ground_truth FROM eval_cases",
    "streaming_ingest": "SELECT chunk_id, min(doc_name) AS doc_name, md5(min(text)) AS h FROM chunks GROUP BY 1",
}
