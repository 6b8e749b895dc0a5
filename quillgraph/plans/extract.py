"""Queries of extraction, coreference, graph building and the smaller functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.common import table
from quillgraph.functions import names as N
from quillgraph.functions import scalar as S
from quillgraph.operators import build as B
from quillgraph.operators import coref as C
from quillgraph.operators import extraction as X
from quillgraph.operators import memory as M
from quillgraph.operators import text as T
from quillgraph.plans.base import CHUNK, MEN, REL, chunks, entities, mentions, norm, relations
from quillgraph.plans.graph import find_by_name
from quillgraph.plans.memory import DAYS
from quillgraph.sources import sinks, stores

PREFIXES = [(0, "-RECORDS", "Records of an archive."), (1, "records1", "never the first"), (2, "climate_", "About the climate."), (3, ".vtt", "A talk.")]
BLOCKED, ROLES, STARTERS, JUNK = ["bapimgård"], ["the "], ["una"], ["limited", "conference"]


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def doc_meta_prefix(s, d):
    rows = T.document_prefix(chunks(s, d), s.createDataFrame(PREFIXES, "ord int, key string, prefix string"))
    return rows.select("chunk_id", F.md5("text").alias("h"))


def extraction_scope(s, d):
    return T.for_extraction(chunks(s, d)).select("chunk_id")


def entity_type_filter(s, d):
    return T.of_types(entities(s, d), ["PERSON", "location"]).select("entity_id", "entity_type")


def extracted_name_clean(s, d):
    name = F.when(F.pmod("entity_id", F.lit(3)) == 0, F.concat("name", F.lit("'s"))).when(F.pmod("entity_id", F.lit(7)) == 0, F.concat(F.lit("the "), "name")).otherwise(F.col("name"))
    rows = entities(s, d).where("name IS NOT NULL").select("entity_id", name.alias("name"))
    return rows.select("entity_id", N.clean_extracted_name(F.regexp_replace("name", "[_’‘“”]", ""), BLOCKED, ROLES, STARTERS, JUNK).alias("clean"))


def context_line(s, d):
    docs = table(s, d, "documents")
    year = F.date_format("published_at", "yyyy")
    line = S.context_line(F.when(F.pmod("doc_id", F.lit(5)) > 0, F.col("doc_name")), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("source")), year, F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("doc_id").cast("string")), F.lit(None).cast("string"), F.col("topic"))
    return docs.select("doc_id", line.alias("line"))


def entity_name_normalize(s, d):
    messy = F.concat(F.lit(" [ "), F.regexp_replace("name", " ", " \n "), F.lit('" ;,'))
    return entities(s, d).select("entity_id", S.normalize_entity_name(messy).alias("name"))


def label_map(s, d):
    kinds = entities(s, d).select("entity_type").distinct()
    labels = kinds.select(F.upper("entity_type").alias("label")).unionByName(s.createDataFrame([(x,) for x in ("ORG", " gpe ", "work of art", "FAC", "WORK_OF_ART", "DATE", "river delta")], "label string")).distinct()
    return labels.select("label", S.map_label(F.col("label")).alias("span_type"), S.map_tag(F.col("label")).alias("tag_type"))


def _values(s, d):
    rows = table(s, d, "field_values").where("entity_id IS NOT NULL AND field_key IS NOT NULL").groupBy("entity_id", "field_key").agg(F.min_by("value", F.struct("extracted_at", "field_value_id")).alias("value"))
    return rows.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", "value"))).alias("values"))


def field_description(s, d):
    rows = entities(s, d).join(_values(s, d), "entity_id")
    return rows.select("entity_id", S.description_from_fields(F.col("name"), F.col("entity_type"), F.col("values")).alias("description"))


def timestamp_parse(s, d):
    text = F.when(F.pmod("doc_id", F.lit(4)) == 0, F.lit("not a time")).when(F.pmod("doc_id", F.lit(4)) == 1, F.date_format("published_at", "yyyy-MM-dd")).otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(s, d, "documents").select("doc_id", F.date_format(S.parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


def embedding_prefix(s, d):
    return table(s, d, "eval_cases").select("item_id", F.md5(S.query_text(F.col("question"))).alias("q"), F.md5(S.document_text(F.col("passage"))).alias("p"))


def simple_ner(s, d):
    return B.simple_entities(_docs(s, d))


def _patterns(s, d):
    return X.pattern_entities(_docs(s, d))


def ner_ensemble(s, d):
    """Capitalised runs that stand three times take the place of a model's spans."""
    docs = _docs(s, d)
    spans = X.capitalised_entities(docs, 3).select("doc_id", "name", "entity_type", F.lit(0.7).alias("confidence"))
    return B.ensemble(spans, None, _patterns(s, d), X.capitalised_entities(docs, 2).select("doc_id", "name", "entity_type", F.lit(0.6).alias("confidence")))


def ner_dedupe(s, d):
    return B.merge_within(ner_ensemble(s, d))


def ner_chunks(s, d):
    return T.extraction_chunks(_docs(s, d), 600)


def coref_candidates(s, d):
    return C.candidates(chunks(s, d), mentions(s, d), entities(s, d)).select("chunk_id", "entity_id", "name", "gender", "pos")


def coref_places(s, d):
    return C.candidates(chunks(s, d), mentions(s, d), entities(s, d), "location").select("chunk_id", "entity_id", "name", "pos")


def _told(s, d, words):
    """The chunks' texts with a sentence at their end that points back."""
    return chunks(s, d).where("text IS NOT NULL").select("chunk_id", F.concat("text", F.lit(words)).alias("text"))


def graph_pronouns(s, d):
    return C.resolve(_told(s, d, "\nShe wrote that he knew them."), C.candidates(chunks(s, d), mentions(s, d), entities(s, d)))


def place_pronouns(s, d):
    places = C.candidates(chunks(s, d), mentions(s, d), entities(s, d), "location", 0)
    named = places.groupBy("chunk_id").agg(F.min("name").alias("n"))
    text = _told(s, d, "").join(named, "chunk_id").select("chunk_id", F.concat("text", F.lit(" In "), "n", F.lit(" they were, and there they stayed.")).alias("text"))
    return C.resolve(text, places, False)


def entity_contexts(s, d):
    spans = mentions(s, d).join(entities(s, d).where("entity_type = 'Person'").select("entity_id", "name"), "entity_id").join(chunks(s, d).select("chunk_id", "doc_name", "chunk_index"), "chunk_id")
    found = B.entity_contexts(spans.where("doc_name IS NOT NULL AND name IS NOT NULL"), chunks(s, d))
    return found.select("name", "doc_name", "n_chunks", F.md5("context").alias("h"))


def refine_targets(s, d):
    return B.refinement_targets(entities(s, d), 0.6, 40, ["PERSON", "organization"]).select("entity_id", "confidence")


def relation_endpoints(s, d):
    """Relations by the names of their ends, every third of which the graph does not know."""
    e = entities(s, d).where("name IS NOT NULL").select("entity_id", "name")
    r = relations(s, d).join(e.toDF("src_id", "src"), "src_id").join(e.toDF("dst_id", "dst"), "dst_id")
    src = F.when(F.pmod("src_id", F.lit(3)) == 0, F.concat(F.lit("Old "), "src")).otherwise(F.upper("src"))
    pairs = r.where("size(evidence) > 0").select(F.element_at("evidence", 1).alias("chunk_id"), src.alias("src"), "dst").distinct()
    found = mentions(s, d).join(entities(s, d).where("name IS NOT NULL").select("entity_id", "name", "entity_type"), "entity_id").select("chunk_id", "name", "entity_type").distinct()
    return B.resolve_endpoints(pairs, found, find_by_name(s, d).select("key", "entity_id")).select("chunk_id", "src", "dst", "src_id", "dst_id")


def corpus_graph_build(s, d):
    e, _, r = B.corpus_graph(_docs(s, d))
    ends = r.select(F.col("src_id").alias("entity_id")).unionByName(r.select(F.col("dst_id").alias("entity_id"))).groupBy("entity_id").agg(F.count("*").alias("n_neighbours"))
    return e.join(ends, "entity_id", "left").select("name", "entity_type", "mention_count", F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


def improved_graph_build(s, d):
    r = B.improved_graph(_docs(s, d), lambda docs: B.ensemble(X.capitalised_entities(docs, 2).select("doc_id", "name", "entity_type", F.lit(0.7).alias("confidence")), None, X.pattern_entities(docs)))[2]
    return r.groupBy("relation_type").agg(F.count("*").alias("n"))


def forgetting_curves(s, d):
    return M.curve_table(s, DAYS)


def mention_histogram(s, d):
    return M.mention_histogram(entities(s, d))


def forgetting_examples(s, d):
    return M.forgetting_examples(entities(s, d))


def memory_json(s, d):
    rows = M.mention_histogram(entities(s, d))
    return sinks.json_rows(rows, "reinforcement")


def store_stats(s, d):
    """Documents, chunks, mentioned chunks, and documents that the graph reaches."""
    c, m = chunks(s, d), mentions(s, d)
    reached = c.join(m.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = c.agg(F.countDistinct("doc_name").alias("n_docs"), F.count("*").alias("n_chunks"))
    return rows.crossJoin(m.agg(F.countDistinct("chunk_id").alias("n_mentioned"))).crossJoin(reached.agg(F.countDistinct("doc_name").alias("n_mapped")))


def doc_delete_ids(s, d):
    gone = s.createDataFrame([("listserv|tidal_discussion_full.txt",), ("no|such",)], "doc_name string")
    named = table(s, d, "chunks").select("doc_name").distinct().where("doc_name LIKE '%climate%'")
    return stores.deleted_ids(chunks(s, d), gone.unionByName(named).distinct())


def file_states(s, d):
    docs = table(s, d, "documents").where("doc_name IS NOT NULL").groupBy("doc_name").agg(F.min("doc_id").alias("mtime_secs"), F.min(F.coalesce("n_chars", F.lit(0))).alias("file_size"))
    put = docs.where("mtime_secs % 3 = 0").withColumn("file_size", F.col("file_size") + 1)
    return stores.file_states(docs.where("mtime_secs % 2 = 0"), put, docs.where("mtime_secs % 5 = 0"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_meta_prefix, extraction_scope, entity_type_filter, extracted_name_clean, context_line, entity_name_normalize, label_map, field_description, timestamp_parse, embedding_prefix, simple_ner,
        ner_ensemble, ner_dedupe, ner_chunks, coref_candidates, coref_places, graph_pronouns, place_pronouns, entity_contexts, refine_targets, relation_endpoints, corpus_graph_build,
        improved_graph_build, forgetting_curves, mention_histogram, forgetting_examples, memory_json, store_stats, doc_delete_ids, file_states,
    )
}

_PRE = "CASE " + " ".join(f"WHEN contains(lower(doc_name), '{k.lower()}') THEN '{p}'" for _, k, p in PREFIXES) + " END"
_PLAIN = r"regexp_replace(text, '[^\x00-\x7F\x{2000}-\x{206F}\x{a0}]', '_', 'g')"
_RUN = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
_CLEAN = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_SIMPLE = rf"""t AS (SELECT doc_id, text, {_PLAIN} AS plain FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(plain, '\b({_RUN})\b', 1)) AS name FROM t) WHERE length(name) > 2 AND name NOT IN ('The', 'And', 'For', 'With') GROUP BY 1, 2),
o AS (SELECT doc_id, unnest(regexp_extract_all(plain, '\b([A-Z][a-z]+(?:\s+(?:{'|'.join(B.SIMPLE_ENDINGS)})\.?))\b', 1)) AS name FROM t),
c AS (SELECT doc_id, unnest(regexp_extract_all(plain, '(?i)\b((?:{'|'.join(B.SIMPLE_CONCEPTS)})\s+of\s+[a-z]+)\b', 1)) AS name FROM t),
l AS (SELECT doc_id, place FROM t CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in B.SIMPLE_PLACES)}) v(place) WHERE contains(text, place)),
ner AS (SELECT doc_id, {_CLEAN('name')} AS name, 'Person' AS entity_type FROM p WHERE n >= 2 UNION SELECT doc_id, {_CLEAN('name')}, 'Organization' FROM o WHERE length(name) > 3
  UNION SELECT doc_id, place, 'Location' FROM l UNION SELECT doc_id, {_CLEAN('name')}, 'Concept' FROM c WHERE length(name) > 3)"""
_ID = """CAST(CASE WHEN big >= 9223372036854775808 THEN big - 18446744073709551616 ELSE big END AS BIGINT)"""
_HASH = lambda name, kind: f"CAST(CAST('0x' || list_reduce([sha256(lower({name}) || '::' || {kind})[15 - 2 * i:16 - 2 * i] FOR i IN range(0, 8)], lambda a, b: a || b) AS UBIGINT) AS HUGEINT)"
_CAND = lambda kind, reach: f"""WITH {MEN}, {CHUNK}, near AS (SELECT a.chunk_id, b.chunk_id AS near_id, abs(a.chunk_index - b.chunk_index) AS pos FROM one a JOIN one b ON a.doc_name = b.doc_name AND abs(a.chunk_index - b.chunk_index) <= {reach} AND (a.chunk_index <> b.chunk_index OR a.chunk_id = b.chunk_id)),
f AS (SELECT near.chunk_id, entity_id, min(pos) AS pos FROM near JOIN men ON men.chunk_id = near_id GROUP BY 1, 2) SELECT chunk_id, entity_id, name, gender, CAST(pos AS BIGINT) AS pos FROM f JOIN entities USING (entity_id) WHERE lower(entity_type) = '{kind}'"""  # noqa: E731
_S = lambda r, days: f"exp(-({days}) / (30.0 * (1 + 1.5 * ln(1 + {r}))))"
_STATE = lambda v: f"CASE WHEN {v} >= 0.66 THEN 'long_term' WHEN {v} >= 0.33 THEN 'short_term' ELSE 'dormant' END"
_FIELDS = " ".join(
    f"WHEN '{kind}' THEN array_to_string([x FOR x IN [{', '.join(f'''CASE WHEN coalesce(m['{k}'], '') <> '' AND lower(trim(m['{k}'])) NOT IN ({', '.join(repr(v) for v in S.PLACEHOLDERS)}) THEN '{k}: ' || m['{k}'] END''' for k in keys)}] IF x IS NOT NULL], '; ')"
    for kind, keys in S.EXPECTED_FIELDS.items()
)

ORACLE = {
    "doc_meta_prefix": f"WITH {CHUNK} SELECT chunk_id, md5(CASE WHEN {_PRE} IS NOT NULL THEN {_PRE} || chr(10) || chr(10) || coalesce(text, '') ELSE text END) AS h FROM one",
    "extraction_scope": f"WITH {CHUNK} SELECT chunk_id FROM one WHERE NOT coalesce(skip_extraction, false)",
    "entity_type_filter": "SELECT entity_id, entity_type FROM entities WHERE lower(entity_type) IN ('person', 'location')",
    "extracted_name_clean": r"""WITH a AS (SELECT entity_id, CASE WHEN ((entity_id % 3) + 3) % 3 = 0 THEN name || '''s' WHEN ((entity_id % 7) + 7) % 7 = 0 THEN 'the ' || name ELSE name END AS name FROM entities WHERE name IS NOT NULL),
b AS (SELECT entity_id, regexp_replace(name, '[_’‘“”]', '', 'g') AS n FROM a), c AS (SELECT *, lower(trim(n)) AS low, [x FOR x IN regexp_split_to_array(lower(trim(n)), '\s+') IF x <> ''] AS w FROM b),
k AS (SELECT *, regexp_replace(trim(regexp_replace(trim(regexp_replace(n, '\s+', ' ', 'g')), '''s$', '')), '(?i)(\s+(limited|conference))+$', '') AS c FROM c)
SELECT entity_id, CASE WHEN NOT (low IN ('bapimgård') OR len(w) > 7 OR coalesce(w[1] = 'una', false) OR (len(w) <= 3 AND starts_with(low, 'the '))) AND c <> '' THEN c END AS clean FROM k""",
    "context_line": """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN nullif(doc_name, '') END AS title, CASE WHEN doc_id % 2 = 0 THEN nullif(source, '') END AS author, strftime(published_at, '%Y') AS year, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS isbn, nullif(topic, '') AS topic FROM documents)
SELECT doc_id, CASE WHEN coalesce(title, author, year, isbn, topic) IS NOT NULL THEN concat_ws(' ', '"' || coalesce(title, '(untitled document)') || '"' || coalesce(' by ' || author, ''), '(' || year || ')', 'ISBN: ' || isbn, 'Subject: ' || topic) END AS line FROM x""",
    "entity_name_normalize": r"""SELECT entity_id, trim(regexp_replace(trim(trim(regexp_replace(' [ ' || regexp_replace(name, ' ', ' ' || chr(10) || ' ', 'g') || '" ;,', '\s+', ' ', 'g')), '"''`“”‘’[](){}<>|'), '[;,:]+$', '')) AS name FROM entities""",
    "label_map": """WITH l AS (SELECT DISTINCT upper(entity_type) AS label FROM entities UNION SELECT unnest(['ORG', ' gpe ', 'work of art', 'FAC', 'WORK_OF_ART', 'DATE', 'river delta']))
SELECT label, CASE WHEN lower(trim(label)) IN ('person', 'organization', 'location', 'product', 'event', 'work', 'facility', 'date') THEN upper(trim(label)[1]) || lower(trim(label)[2:]) WHEN lower(trim(label)) = 'org' THEN 'Organization' WHEN lower(trim(label)) IN ('gpe', 'loc') THEN 'Location'
  WHEN lower(trim(label)) = 'work of art' THEN 'Work' WHEN lower(trim(label)) = 'fac' THEN 'Facility' ELSE array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(label, ' ')], ' ') END AS span_type,
  CASE label WHEN 'PERSON' THEN 'Person' WHEN 'ORG' THEN 'Organization' WHEN 'GPE' THEN 'Location' WHEN 'LOC' THEN 'Location' WHEN 'PRODUCT' THEN 'Product' WHEN 'EVENT' THEN 'Event' WHEN 'FAC' THEN 'Facility' WHEN 'WORK_OF_ART' THEN 'Work' WHEN 'DATE' THEN 'Date' END AS tag_type FROM l""",
    "field_description": f"""WITH v AS (SELECT entity_id, field_key, arg_min_null(value, (extracted_at, field_value_id)) AS value FROM (SELECT * REPLACE (coalesce(extracted_at, TIMESTAMP '0001-01-01') AS extracted_at) FROM field_values) WHERE entity_id IS NOT NULL AND field_key IS NOT NULL GROUP BY 1, 2),
g AS (SELECT entity_id, map_from_entries(list((field_key, coalesce(value, '')))) AS m FROM v GROUP BY 1), x AS (SELECT entity_id, name, CASE entity_type {_FIELDS} ELSE '' END AS f FROM entities JOIN g USING (entity_id))
SELECT entity_id, CASE WHEN f <> '' AND name IS NOT NULL THEN name || ' — ' || f ELSE '' END AS description FROM x""",
    "timestamp_parse": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN strftime(published_at, '%Y-%m-%d') || ' 00:00:00' ELSE strftime(published_at, '%Y-%m-%d %H:%M:%S') END AS at FROM documents",
    "embedding_prefix": "SELECT item_id, md5('search_query: ' || question) AS q, md5('search_document: ' || passage) AS p FROM eval_cases",
    "simple_ner": f"WITH {_SIMPLE} SELECT doc_id, name, entity_type FROM ner",
    "coref_candidates": _CAND("person", 1),
    "coref_places": f"SELECT chunk_id, entity_id, name, pos FROM ({_CAND('location', 1)})",
    "entity_contexts": f"""WITH {MEN}, {CHUNK}, sp AS (SELECT DISTINCT name, doc_name, chunk_index FROM men JOIN entities USING (entity_id) JOIN one USING (chunk_id) WHERE entity_type = 'Person' AND name IS NOT NULL AND doc_name IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, doc_name ORDER BY chunk_index) AS r FROM sp) WHERE r <= 3), w AS (SELECT DISTINCT name, doc_name, unnest([chunk_index - 1, chunk_index, chunk_index + 1]) AS chunk_index FROM f),
t AS (SELECT doc_name, chunk_index, min(coalesce(text, '')) AS text FROM one GROUP BY 1, 2)
SELECT name, doc_name, CAST(count(*) AS INTEGER) AS n_chunks, md5(string_agg(text, chr(10) || chr(10) || '[...]' || chr(10) || chr(10) ORDER BY chunk_index)) AS h FROM w JOIN t USING (doc_name, chunk_index) GROUP BY 1, 2""",
    "refine_targets": "SELECT entity_id, confidence FROM entities WHERE confidence < 0.6 AND lower(entity_type) IN ('person', 'organization') ORDER BY confidence, entity_id LIMIT 40",
    "relation_endpoints": f"""WITH {REL}, {MEN}, fe AS (SELECT src_id, dst_id, min(c) AS chunk_id, relation_type FROM ev GROUP BY ALL),
pr AS (SELECT DISTINCT chunk_id, CASE WHEN ((src_id % 3) + 3) % 3 = 0 THEN 'Old ' || a.name ELSE upper(a.name) END AS src, b.name AS dst FROM fe JOIN entities a ON a.entity_id = src_id JOIN entities b ON b.entity_id = dst_id WHERE a.name IS NOT NULL AND b.name IS NOT NULL AND chunk_id IS NOT NULL),
hx AS (SELECT entity_id, name, {_HASH('name', 'entity_type')} AS big FROM entities WHERE name IS NOT NULL),
own AS (SELECT chunk_id, lower(name) AS low, min({_ID}) AS own_id FROM men JOIN hx USING (entity_id) GROUP BY 1, 2),
nk AS (SELECT entity_id, mention_count, {norm('n')} AS key FROM (SELECT entity_id, mention_count, unnest(list_concat([name], coalesce(aliases, []))) AS n FROM entities)), fn AS (SELECT key, max_by(entity_id, (mention_count, -entity_id)) AS entity_id FROM nk WHERE key <> '' GROUP BY 1),
un AS (SELECT x, {_ID} AS unknown_id FROM (SELECT x, {_HASH('x', "'Unknown'")} AS big FROM (SELECT src AS x FROM pr UNION SELECT dst FROM pr)))
SELECT pr.chunk_id, src, dst, coalesce(os.own_id, ns.entity_id, us.unknown_id) AS src_id, coalesce(od.own_id, nd.entity_id, ud.unknown_id) AS dst_id FROM pr LEFT JOIN own os ON os.chunk_id = pr.chunk_id AND os.low = lower(src) LEFT JOIN own od ON od.chunk_id = pr.chunk_id AND od.low = lower(dst)
LEFT JOIN fn ns ON ns.key = {norm('src')} LEFT JOIN fn nd ON nd.key = {norm('dst')} JOIN un us ON us.x = src JOIN un ud ON ud.x = dst""",
    "corpus_graph_build": f"""WITH {_SIMPLE}, id AS (SELECT DISTINCT doc_id, name, entity_type, lower(name) || '::' || entity_type AS k FROM ner), e AS (SELECT k, min(name) AS name, min(entity_type) AS entity_type, count(DISTINCT doc_id) AS mention_count FROM id GROUP BY 1),
m AS (SELECT DISTINCT doc_id, k FROM id), nb AS (SELECT a.k, count(DISTINCT b.k) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.k <> b.k GROUP BY 1) SELECT name, entity_type, mention_count, coalesce(n, 0) AS n_neighbours FROM e LEFT JOIN nb USING (k)""",
    "forgetting_curves": f"SELECT CAST(r AS INTEGER) AS reinforcement, CAST(day AS INTEGER) AS day, round({_S('r', 'day')}, 4) AS strength FROM (SELECT unnest([1, 3, 10, 50]) AS r) CROSS JOIN (SELECT unnest({DAYS}) AS day)",
    "mention_histogram": "SELECT greatest(1, coalesce(mention_count, 1)) AS reinforcement, count(*) AS n FROM entities GROUP BY 1",
    "forgetting_examples": f"""WITH e AS (SELECT entity_id, name, greatest(1, coalesce(mention_count, 1)) AS r FROM entities), x AS (SELECT 'example' AS kind, * FROM (SELECT * FROM e WHERE r IN (1, 2, 3, 5, 10, 12) QUALIFY row_number() OVER (PARTITION BY r ORDER BY entity_id) = 1)
UNION ALL SELECT 'most', * FROM (SELECT * FROM e ORDER BY r DESC, coalesce(name, ''), entity_id LIMIT 8))
SELECT kind, entity_id, name, r AS reinforcement, round({_S('r', 30)}, 3) AS day30, round({_S('r', 90)}, 3) AS day90, round({_S('r', 365)}, 3) AS day365, {_STATE(_S('r', 90))} AS state_day90, {_STATE(_S('r', 365))} AS state_day365 FROM x""",
    "memory_json": "SELECT r AS reinforcement, '{\"n\":' || n || ',\"reinforcement\":' || r || '}' AS json FROM (SELECT greatest(1, coalesce(mention_count, 1)) AS r, count(*) AS n FROM entities GROUP BY 1)",
    "store_stats": f"WITH {MEN}, {CHUNK} SELECT count(DISTINCT doc_name) AS n_docs, count(*) AS n_chunks, (SELECT count(DISTINCT chunk_id) FROM men) AS n_mentioned, count(DISTINCT CASE WHEN chunk_id IN (SELECT chunk_id FROM men) THEN doc_name END) AS n_mapped FROM one",
    "doc_delete_ids": f"WITH {CHUNK} SELECT DISTINCT doc_name, chunk_id FROM one WHERE doc_name = 'listserv|tidal_discussion_full.txt' OR doc_name LIKE '%climate%'",
    "file_states": """WITH d AS (SELECT doc_name, min(doc_id) AS m, min(coalesce(n_chars, 0)) AS z FROM documents WHERE doc_name IS NOT NULL GROUP BY 1)
SELECT doc_name, m AS mtime_secs, z + 1 AS file_size FROM d WHERE m % 3 = 0 UNION ALL SELECT doc_name, m, z FROM d WHERE m % 3 <> 0 AND m % 2 = 0 AND m % 5 <> 0""",
}
