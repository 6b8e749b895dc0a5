"""Queries of entity resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import names as N
from quillgraph.functions import scalar as S
from quillgraph.operators import resolution as R
from quillgraph.plans.base import REL, entities, norm, relations


def dedup_exact(s, d):
    return R.exact(entities(s, d))


def dedup_honorific(s, d):
    return R.honorific(entities(s, d))


def dedup_alias(s, d):
    return R.alias_match(entities(s, d))


def dedup_subset(s, d):
    return R.subset(entities(s, d), relations(s, d), 1)


def dedup_fuzzy(s, d):
    return R.fuzzy(entities(s, d))


def _with_degrees(s, d):
    """The entities, and every fifth of them once more with a degree after the name."""
    e = entities(s, d)
    more = e.where("entity_id % 5 = 0").withColumn("name", F.concat("name", F.lit(" Ph.D. BA"))).withColumn("entity_id", F.col("entity_id") + 1_000_000_000)
    return e.unionByName(more)


def _with_parts(s, d):
    """The entities, and for every third one of its first and one of its last word alone."""
    e = entities(s, d)
    words = F.split(F.trim("name"), r"\s+")
    some = e.where("entity_id % 3 = 0 AND name IS NOT NULL")
    first = some.withColumn("name", F.element_at(words, 1)).withColumn("entity_id", F.col("entity_id") + 1_000_000_000)
    last = some.withColumn("name", F.element_at(words, -1)).withColumn("entity_id", F.col("entity_id") + 2_000_000_000)
    return e.unionByName(first).unionByName(last)


def dedup_qualification(s, d):
    return R.qualification(_with_degrees(s, d))


def dedup_first_name(s, d):
    return R.first_name_only(_with_parts(s, d))


def dedup_unique_surname(s, d):
    return R.unique_surname(_with_parts(s, d))


def dedup_bare_first_name(s, d):
    return R.bare_first_name(_with_parts(s, d), relations(s, d))


def _close_pairs(s, d):
    return R.neighbour_containment(entities(s, d), relations(s, d), 0.0, 1).select("keep_id", "drop_id")


def dedup_block_parents(s, d):
    """Pairs with a shared parent and other ones on both sides; employers stand for
    parents, since the hierarchies have one parent in each."""
    rel = relations(s, d).where("relation_type = 'works_at'").withColumn("relation_type", F.lit("child_of"))
    rel = rel.groupBy("src_id", "dst_id", "relation_type").agg(F.max("strength").alias("strength"))
    kids = rel.select("dst_id", "src_id")
    pairs = kids.withColumnRenamed("src_id", "keep_id").join(kids.withColumnRenamed("src_id", "drop_id"), "dst_id").where("keep_id < drop_id").select("keep_id", "drop_id").distinct()
    return R.different_parents(pairs, rel)


def dedup_block_surname(s, d):
    """For review: pairs of one surname that no common relation confirms, for the surnames of at least three entities."""
    e = entities(s, d).where("entity_type = 'Person'")
    frequent = R.named(e).groupBy(F.element_at("words", -1).alias("surname")).agg(F.count("*").alias("n")).where("n >= 3").select("surname")
    return R.unconfirmed_surnames(e, relations(s, d), frequent)


def trusted_parents(s, d):
    return R.trusted_parents(relations(s, d)).groupBy("entity_id").agg(F.count("*").alias("n_parents"), F.min("parent_id").alias("first_parent"))


def trusted_family(s, d):
    return R.trusted_family(relations(s, d)).select("entity_id", "other_id", F.array_join("relation_types", "|").alias("relation_types"))


def dedup_middle_drop(s, d):
    return R.middle_drop(entities(s, d))


def dedup_neighbour(s, d):
    return R.neighbour_containment(entities(s, d), relations(s, d), 0.3, 2)


def dedup_embedding(s, d):
    return R.by_embedding(entities(s, d), 0.6)


def dedup_greedy(s, d):
    return R.greedy_names(entities(s, d))


def dedup_blocks(s, d):
    pairs = R.neighbour_containment(entities(s, d), relations(s, d), 0.1, 1).select("keep_id", "drop_id")
    return R.role_contradictions(pairs, relations(s, d))


def desc_divergence(s, d):
    return R.descriptions_diverge(R.middle_drop(entities(s, d)).unionByName(R.fuzzy(entities(s, d))).distinct(), entities(s, d), 20, 0.5)


def normalize_name(s, d):
    e = entities(s, d)
    return e.select("entity_id", S.normalize_name(F.col("name")).alias("norm"))


def stripped_key(s, d):
    return entities(s, d).select("entity_id", S.stripped_key(F.col("name")).alias("key"))


def strip_qualifications(s, d):
    e = entities(s, d).select("entity_id", F.when(F.pmod("entity_id", F.lit(3)) == 0, F.concat("name", F.lit(" Ph.D. BA"))).otherwise(F.col("name")).alias("name"))
    return e.select("entity_id", S.strip_qualifications(F.col("name")).alias("bare"))


def name_validity(s, d):
    return entities(s, d).select("entity_id", S.is_valid_entity(F.col("name"), F.col("entity_type"), 0.5 + F.col("confidence") / 2).alias("valid"))


def entity_ids(s, d):
    return entities(s, d).select("entity_id", S.entity_id(F.col("name"), F.col("entity_type")).alias("computed"))


def entity_embed_text(s, d):
    return entities(s, d).select("entity_id", S.embed_text(F.col("name"), F.col("description"), F.col("aliases")).alias("text"))


def gender_inference(s, d):
    from quillgraph.common import table

    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", S.infer_gender(F.col("text")).alias("gender"))


def name_clean(s, d):
    e = entities(s, d).select("entity_id", F.regexp_replace("name", r"\.", "_").alias("name"))
    return e.select("entity_id", N.clean_entity_name(F.col("name")).alias("name"))


def jaro_winkler(s, d):
    """Without SQL: DuckDB's function halves an odd number of exchanged letters to
    a whole number, the rule here does not; the tests hold known values."""
    pairs = R.middle_drop(entities(s, d)).unionByName(R.fuzzy(entities(s, d))).distinct()
    names = entities(s, d).select("entity_id", S.normalize_name(F.col("name")).alias("n"))
    rows = pairs.join(names.toDF("keep_id", "a"), "keep_id").join(names.toDF("drop_id", "b"), "drop_id")
    return rows.select("keep_id", "drop_id", F.round(R.jaro_winkler_column("a", "b"), 4).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        name_clean, jaro_winkler, dedup_exact, dedup_honorific, dedup_alias, dedup_subset, dedup_fuzzy, dedup_qualification, dedup_first_name, dedup_unique_surname, dedup_middle_drop, dedup_neighbour, dedup_embedding,
        dedup_greedy, dedup_blocks, dedup_bare_first_name, dedup_block_parents, dedup_block_surname, trusted_parents, trusted_family, desc_divergence, normalize_name, stripped_key, strip_qualifications, name_validity, entity_ids, entity_embed_text, gender_inference,
    )
}

_LIST = lambda values: "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
_KEY = lambda x: f"array_to_string([w FOR w IN string_split({norm(x)}, ' ') IF w NOT IN {_LIST(S.HONORIFICS)} AND w <> ''], ' ')"
_N = f"n AS (SELECT entity_id, entity_type, mention_count, name, {norm('name')} AS norm, string_split({norm('name')}, ' ') AS words, {_KEY('name')} AS key FROM entities WHERE name IS NOT NULL AND {norm('name')} <> '')"


_MORE = "SELECT entity_id + {0} AS entity_id, entity_type, mention_count, description, {1} AS name FROM entities WHERE entity_id % {2} = 0 AND name IS NOT NULL"
_ALL = "SELECT entity_id, entity_type, mention_count, description, name FROM entities"
_DEGREES = f"more AS ({_ALL} UNION ALL {_MORE.format(1000000000, chr(39).join(['name || ', ' Ph.D. BA', '']), 5)})"
_SPLIT = r"regexp_split_to_array(trim(name), '\s+')"
_PARTS = f"more AS ({_ALL} UNION ALL {_MORE.format(1000000000, _SPLIT + '[1]', 3)} UNION ALL {_MORE.format(2000000000, _SPLIT + '[-1]', 3)})"


def _group(keys: str, source: str) -> str:
    return f"""SELECT keep_id, entity_id AS drop_id FROM (SELECT g.*, first_value(entity_id) OVER (PARTITION BY {keys} ORDER BY mention_count DESC, entity_id) AS keep_id FROM {source} g) WHERE keep_id <> entity_id"""


def _unique(token: str, least: int) -> str:
    return f"""WITH {_PARTS}, {_N.replace('FROM entities', 'FROM more')}, l AS (SELECT entity_type, words[{token}] AS w, min(entity_id) AS keep_id FROM n WHERE len(words) > 1 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT keep_id, n.entity_id AS drop_id FROM n JOIN l ON l.entity_type = n.entity_type AND l.w = n.norm WHERE len(words) = 1"""


_DEGREE = "|".join(r"\.?".join(x) + r"\.?" for x in S.DEGREES)
_BARE = lambda x: rf"regexp_replace(trim({x}), '(?i)(?:(?:^|\s+)(?:{_DEGREE}))+\s*$', '')"
_STRIP = lambda x: f"CASE WHEN {_BARE(x)} <> trim({x}) THEN {norm(_BARE(x))} END"
_CONTRA = " OR ".join(f"(ra = '{x}' AND rb = '{y}') OR (ra = '{y}' AND rb = '{x}')" for x, y in R.CONTRADICTIONS)
_FUZZY = """SELECT DISTINCT CASE WHEN a.mention_count > b.mention_count OR (a.mention_count = b.mention_count AND a.entity_id < b.entity_id) THEN a.entity_id ELSE b.entity_id END AS keep_id,
  CASE WHEN a.mention_count > b.mention_count OR (a.mention_count = b.mention_count AND a.entity_id < b.entity_id) THEN b.entity_id ELSE a.entity_id END AS drop_id
FROM n a JOIN n b ON a.entity_type = b.entity_type AND a.entity_id < b.entity_id AND a.norm <> b.norm
WHERE abs(length(a.norm) - length(b.norm)) <= 2 AND levenshtein(a.norm, b.norm) <= 2 AND len(list_intersect([w FOR w IN a.words IF length(w) >= 4], [w FOR w IN b.words IF length(w) >= 4])) > 0
  AND NOT (length(a.words[1]) = 1 AND length(b.words[1]) = 1 AND a.words[1] <> b.words[1]) AND a.words[1][1] = b.words[1][1]"""
_MIDDLE = """SELECT l.keep_id, n.entity_id AS drop_id FROM n JOIN (SELECT entity_type, words[1] AS f, words[-1] AS l, min(entity_id) AS keep_id FROM n WHERE len(words) >= 3 GROUP BY 1, 2, 3 HAVING count(*) = 1) l
ON l.entity_type = n.entity_type AND l.f = n.words[1] AND l.l = n.words[-1] WHERE len(words) = 2"""
_CONTAIN = """nk AS (SELECT node_id, neighbour_id, entity_type FROM nb JOIN entities ON entity_id = node_id WHERE neighbour_id IN (SELECT neighbour_id FROM nb GROUP BY 1 HAVING count(*) <= 25)),
sz AS (SELECT node_id, count(*) AS n FROM nk GROUP BY 1),
sh AS (SELECT a.node_id AS keep_id, b.node_id AS drop_id, count(*) AS shared FROM nk a JOIN nk b ON a.neighbour_id = b.neighbour_id AND a.entity_type = b.entity_type AND a.node_id <> b.node_id GROUP BY 1, 2)"""
# Fixed values, written out for the SQL on purpose.
_DESC_STOP = "'that', 'this', 'with', 'from', 'have', 'been', 'were', 'they', 'their', 'also', 'well', 'known', 'very', 'when', 'some', 'many', 'most', 'more', 'than', 'into', 'about', 'after', 'which', 'would', 'could', 'should', 'other', 'over'"
_SIG = lambda x: f"list_distinct([w FOR w IN regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}]+') IF length(w) >= 4 AND w NOT IN ({_DESC_STOP})])"
_ALPHA = r"length(regexp_replace(name, '[^\p{L}]', '', 'g'))"
_PHRASES = " OR ".join(f"(contains(low, '{g}') AND length(low) <= {len(g) + 8})" for g in S.GENERIC_NAMES if " " in g)

_EDGE = r"[^\p{L}\p{M}\p{N}_]"
_WORD = f"CAST(regexp_matches(lower(text), '(^|{_EDGE})?($|{_EDGE})') AS INTEGER)"

ORACLE = {
    "dedup_exact": f"WITH {_N} " + _group("norm", "n"),
    "dedup_honorific": f"""WITH {_N}, t AS (SELECT *, CASE WHEN list_contains(words, 'mrs') THEN 'mrs' WHEN list_contains(words, 'mr') THEN 'mr' ELSE '' END AS title FROM n WHERE key <> ''),
u AS (SELECT key, entity_type FROM t GROUP BY 1, 2 HAVING count(DISTINCT norm) > 1 AND NOT (bool_or(title = 'mr') AND bool_or(title = 'mrs'))), x AS (SELECT t.* FROM t SEMI JOIN u USING (key, entity_type)) """ + _group("key, entity_type", "x"),
    "dedup_alias": f"""WITH {_N}, a AS (SELECT entity_type, entity_id AS keep_id, {_KEY('alias')} AS key FROM (SELECT entity_type, entity_id, unnest(aliases) AS alias FROM entities))
SELECT DISTINCT keep_id, n.entity_id AS drop_id FROM a JOIN n ON n.entity_type = a.entity_type AND n.key = a.key WHERE n.key <> '' AND keep_id <> n.entity_id""",
    "dedup_subset": f"""WITH {REL}, {_N}, w AS (SELECT *, list_distinct([x FOR x IN words IF length(x) >= 4]) AS lw FROM n),
p AS (SELECT a.entity_id AS keep_id, b.entity_id AS drop_id FROM w a JOIN w b ON a.entity_type = b.entity_type AND a.entity_id <> b.entity_id WHERE len(b.lw) > 0 AND len(a.words) > len(b.words) AND list_has_all(a.lw, b.lw))
SELECT DISTINCT keep_id, drop_id FROM p WHERE (SELECT count(*) FROM nb x JOIN nb y ON x.neighbour_id = y.neighbour_id WHERE x.node_id = keep_id AND y.node_id = drop_id) >= 1""",
    "dedup_fuzzy": f"WITH {_N} {_FUZZY}",
    "dedup_qualification": f"""WITH {_DEGREES}, {_N.replace('FROM entities', 'FROM more')}, b AS (SELECT *, coalesce({_STRIP('name')}, norm) AS bare FROM n), c AS (SELECT * FROM b WHERE len(string_split(bare, ' ')) >= 2),
x AS (SELECT c.* FROM c SEMI JOIN (SELECT bare, entity_type FROM c GROUP BY 1, 2 HAVING count(DISTINCT norm) > 1) USING (bare, entity_type)) """ + _group("bare, entity_type", "x"),
    "dedup_first_name": _unique("1", 2),
    "dedup_unique_surname": _unique("-1", 2),
    "dedup_middle_drop": f"WITH {_N} {_MIDDLE}",
    "dedup_bare_first_name": f"""WITH {REL}, {_PARTS}, m AS (SELECT *, {_KEY('name')} AS key FROM more WHERE name IS NOT NULL), t AS (SELECT *, string_split(key, ' ') AS w FROM m WHERE key <> ''),
l AS (SELECT w[1] AS first, min(entity_id) AS keep_id, min(entity_type) AS entity_type FROM t WHERE len(w) >= 2 GROUP BY 1 HAVING count(*) = 1)
SELECT keep_id, t.entity_id AS drop_id FROM t JOIN l ON l.first = t.w[1] AND l.entity_type = t.entity_type
WHERE len(t.w) = 1 AND length(t.w[1]) >= 3 AND (coalesce(t.description, '') = '' OR EXISTS (SELECT 1 FROM nb x JOIN nb y ON x.neighbour_id = y.neighbour_id WHERE x.node_id = keep_id AND y.node_id = t.entity_id))
  AND NOT EXISTS (SELECT 1 FROM (SELECT {_SIG('a.description')} AS wa, {_SIG('b.description')} AS wb FROM more a, more b WHERE a.entity_id = keep_id AND b.entity_id = t.entity_id AND length(a.description) >= 100 AND length(b.description) >= 100) WHERE len(list_intersect(wa, wb)) / greatest(1, len(list_distinct(list_concat(wa, wb)))) < 0.12)""",
    "dedup_block_parents": f"""WITH {REL}, c AS (SELECT src_id AS e, dst_id AS p FROM rel WHERE relation_type = 'works_at' GROUP BY 1, 2 HAVING max(strength) >= 0.1),
n AS (SELECT e, count(*) AS n FROM c GROUP BY 1), sh AS (SELECT a.e AS keep_id, b.e AS drop_id, count(*) AS k FROM c a JOIN c b USING (p) WHERE a.e < b.e GROUP BY 1, 2)
SELECT keep_id, drop_id FROM sh JOIN n a ON a.e = keep_id JOIN n b ON b.e = drop_id WHERE k < a.n AND k < b.n""",
    "dedup_block_surname": f"""WITH {REL}, {_N}, p AS (SELECT entity_id, words[-1] AS surname FROM n WHERE entity_type = 'Person'), f AS (SELECT surname FROM p GROUP BY 1 HAVING count(*) >= 3),
fam AS (SELECT DISTINCT node_id, neighbour_id, relation_type FROM adj WHERE relation_type IN ('spouse_of', 'sibling_of', 'half_sibling_of', 'cousin_of') AND strength >= 0.1)
SELECT a.entity_id AS keep_id, b.entity_id AS drop_id FROM p a JOIN p b ON a.surname = b.surname AND a.entity_id < b.entity_id SEMI JOIN f ON f.surname = a.surname
WHERE NOT EXISTS (SELECT 1 FROM fam x JOIN fam y ON x.neighbour_id = y.neighbour_id AND x.relation_type = y.relation_type WHERE x.node_id = a.entity_id AND y.node_id = b.entity_id)""",
    "trusted_parents": f"WITH {REL} SELECT src_id AS entity_id, count(*) AS n_parents, min(dst_id) AS first_parent FROM rel WHERE relation_type = 'child_of' AND strength >= 0.1 GROUP BY 1",
    "trusted_family": f"""WITH {REL}, f AS (SELECT DISTINCT node_id, neighbour_id, relation_type FROM adj WHERE relation_type IN ('spouse_of', 'sibling_of', 'half_sibling_of', 'cousin_of') AND strength >= 0.1)
SELECT node_id AS entity_id, neighbour_id AS other_id, string_agg(relation_type, '|' ORDER BY relation_type) AS relation_types FROM f GROUP BY 1, 2""",
    "dedup_neighbour": f"WITH {REL}, {_CONTAIN} SELECT keep_id, drop_id, shared, round(shared / n, 6) AS share FROM sh JOIN sz ON node_id = drop_id WHERE shared >= 2 AND shared / n >= 0.3",
    "dedup_blocks": f"""WITH {REL}, {_CONTAIN}, p AS (SELECT keep_id, drop_id FROM sh JOIN sz ON node_id = drop_id WHERE shared / n >= 0.1)
SELECT DISTINCT keep_id, drop_id FROM (SELECT keep_id, drop_id, x.relation_type AS ra, y.relation_type AS rb FROM p JOIN rel x ON x.src_id = keep_id JOIN rel y ON y.src_id = drop_id AND y.dst_id = x.dst_id) WHERE {_CONTRA}""",
    "desc_divergence": f"""WITH {_N}, p AS ({_FUZZY} UNION {_MIDDLE}),
j AS (SELECT keep_id, drop_id, a.description AS da, b.description AS db, {_SIG('a.description')} AS wa, {_SIG('b.description')} AS wb FROM p JOIN entities a ON a.entity_id = keep_id JOIN entities b ON b.entity_id = drop_id)
SELECT keep_id, drop_id FROM j WHERE length(da) >= 20 AND length(db) >= 20 AND len(list_intersect(wa, wb)) / greatest(1, len(list_distinct(list_concat(wa, wb)))) < 0.5""",
    "normalize_name": f"SELECT entity_id, {norm('name')} AS norm FROM entities",
    "stripped_key": f"SELECT entity_id, {_KEY('name')} AS key FROM entities",
    "strip_qualifications": f"SELECT entity_id, {_STRIP('name')} AS bare FROM (SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN name || ' Ph.D. BA' ELSE name END AS name FROM entities)",
    "name_validity": rf"""WITH v AS (SELECT *, lower(trim(name)) AS low, len([t FOR t IN regexp_split_to_array(name, '\s+') IF t <> '']) AS nt, 0.5 + confidence / 2 AS sc FROM entities)
SELECT entity_id, coalesce(sc >= CASE entity_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in S.LEAST_SCORE.items())} ELSE 0.55 END AND length(name) BETWEEN 2 AND 80 AND {_ALPHA} >= 2 AND {_ALPHA} / length(name) >= 0.45
  AND NOT (low IN {_LIST(S.GENERIC_NAMES + S.COMMON_WORDS)} OR {_PHRASES}
    OR (entity_type = 'Person' AND ((nt = 1 AND NOT regexp_matches(name, '^\s*\p{{Lu}}')) OR low IN ('grass', 'typee', 'leaves', 'house', 'defendant', 'plaintiff') OR nt > 5))
    OR (entity_type = 'Location' AND (low IN ('cluster', 'paper', 'section', 'chapter', 'home', 'house') OR (nt = 1 AND regexp_matches(low, '(ing|tion|ment|ness)$'))))
    OR (entity_type IN ('Work', 'Event', 'Product') AND nt = 1 AND length(name) < 4 AND upper(name) <> name)
    OR (entity_type <> 'Organization' AND regexp_matches(low, '^[a-z0-9.-]+\.(com|org|net|edu|io|gov)$')) OR contains(name, '@')), false) AS valid FROM v""",
    "entity_ids": """WITH i AS (SELECT entity_id, sha256(lower(name) || '::' || entity_type) AS x FROM entities),
j AS (SELECT entity_id, CAST(CAST('0x' || x[15:16] || x[13:14] || x[11:12] || x[9:10] || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS UBIGINT) AS HUGEINT) AS big FROM i)
SELECT entity_id, CAST(CASE WHEN big >= 9223372036854775808 THEN big - 18446744073709551616 ELSE big END AS BIGINT) AS computed FROM j""",
    "entity_embed_text": "SELECT entity_id, name || CASE WHEN len(aliases) > 0 THEN ' (' || array_to_string(aliases, ', ') || ')' ELSE '' END || CASE WHEN coalesce(description, '') <> '' THEN ': ' || description ELSE '' END AS text FROM entities",
    "gender_inference": """WITH c AS (SELECT doc_id, {m} AS m, {f} AS f FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN m > f THEN 'Male' WHEN f > m THEN 'Female' END AS gender FROM c""".format(
        m=" + ".join(_WORD.replace("?", w) for w in ("he", "him", "his", "himself")), f=" + ".join(_WORD.replace("?", w) for w in ("she", "her", "hers", "herself"))
    ),
}
