"""Entities and relations out of text: rule-based extractors and resolvers.

Extractors return ``(doc_id, name, entity_type, confidence)``; models plug in as
callables that map lists of texts to lists of such rows (:func:`with_provider`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Titles and roles of persons, endings of organisations.
TITLES = [
    "mr", "mrs", "ms", "miss", "dr", "prof", "professor", "rev", "reverend", "sir", "lord", "lady", "captain", "general", "admiral",
    "president", "minister", "chancellor", "governor", "mayor", "judge", "justice",
]
ROLES = [
    "author", "writer", "scientist", "professor", "doctor", "engineer", "physicist", "chemist", "biologist", "astronomer", "explorer",
    "inventor", "artist", "composer", "musician", "actor", "director", "politician", "diplomat", "general", "admiral", "president",
    "founder", "ceo", "researcher", "mathematician",
]
ORGANISATIONS = [
    "inc", "corp", "corporation", "ltd", "limited", "llc", "plc", "university", "college", "institute", "academy", "school",
    "hospital", "clinic", "agency", "department", "division", "foundation", "association", "society", "organization", "company",
]
COMMON = ["the", "and", "or", "but", "that", "this", "from", "with", "for", "are", "was", "were", "been", "being", "have", "has", "which", "who", "what", "when", "where", "why", "how"]

# Phrases between two words that state a relation, with confidence.
RELATION_PHRASES = [
    (r"(?:married|wedded|spouse)", "spouse_of", 0.9), (r"(?:father|dad|papa)\s+(?:of|to)", "parent_of", 0.9), (r"(?:mother|mom|mama)\s+(?:of|to)", "parent_of", 0.9),
    (r"(?:son|daughter|child)\s+(?:of|to)", "child_of", 0.9), (r"(?:brother|sister|sibling)\s+of", "sibling_of", 0.9), (r"studied\s+under", "studied_under", 0.8),
    (r"mentored", "mentored", 0.8), (r"collaborated\s+with", "collaborated_with", 0.8), (r"worked\s+(?:with|for)", "worked_with", 0.7),
    (r"(?:founded|established|created)", "founded", 0.9), (r"(?:directed|led|headed)", "led", 0.8), (r"worked\s+at", "worked_at", 0.8), (r"employed\s+by", "employed_by", 0.8),
    (r"professor\s+at", "worked_at", 0.9), (r"located\s+in", "located_in", 0.8), (r"in\s+(?:the\s+)?", "located_in", 0.6), (r"(?:capital|city)\s+of", "capital_of", 0.9),
    (r"part\s+of", "part_of", 0.8), (r"subsidiary\s+of", "subsidiary_of", 0.9), (r"division\s+of", "division_of", 0.9), (r"(?:discovered|invented)", "discovered", 0.8),
]

# Words that begin no name.
STOP_WORDS = {
    "The", "A", "An", "This", "That", "These", "Those", "Its", "It", "He", "Him", "His", "She", "Her", "Hers", "They", "Them", "Their",
    "Theirs", "We", "Our", "You", "Your", "I", "My", "Me", "In", "On", "At", "By", "For", "From", "With", "Of", "About", "And",
    "Or", "But", "If", "As", "So", "Yet", "Nor", "Both", "Also", "To", "Into", "Up", "Between", "Among", "Before", "After", "During",
    "Through", "Within", "Over", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
}
PRONOUNS = {"he": "Male", "him": "Male", "his": "Male", "himself": "Male", "she": "Female", "her": "Female", "hers": "Female", "herself": "Female", "they": "Neutral", "them": "Neutral", "their": "Neutral", "theirs": "Neutral", "themselves": "Neutral"}

# Descriptions and the alias they stand for.
KINSHIP = [
    ("grandpa", "grandpa"), ("grandfather", "grandfather"), ("my grandfather", "my grandfather"), ("grandma", "grandma"), ("grandmother", "grandmother"),
    ("the author", "author"), ("the narrator", "narrator"), ("my mother", "mother"), ("his mother", "mother"), ("her mother", "mother"), ("my father", "father"),
    ("his father", "father"), ("her father", "father"), ("my wife", "wife"), ("his wife", "wife"), ("my husband", "husband"), ("her husband", "husband"),
]
PLACES = ["district", "area", "neighbourhood", "neighborhood", "suburb", "street", "road", "building", "mosque", "church", "field", "park"]
GROUPS = ["organization", "organisation", "group", "movement", "committee", "party", "league", "association", "college", "school", "congress", "council"]

_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"


def best_per_name(found: DataFrame) -> DataFrame:
    """Of equal names (apart from case) and types per document the most confident."""
    key = F.lower("name")
    return found.groupBy("doc_id", key.alias("key"), "entity_type").agg(F.max("confidence").alias("confidence"), F.min("name").alias("name")).select("doc_id", "name", "entity_type", "confidence")


def pattern_entities(docs: DataFrame) -> DataFrame:
    """Titles, roles and endings of organisations around capitalised runs."""
    families = [
        (rf"\b(?i:{'|'.join(TITLES)})\.?\s+({_NAME})\b", "Person", 0.85),
        (rf"({_NAME})\s+(?i:(?:is\s+)?(?:an?\s+)?(?:{'|'.join(ROLES)}))\b", "Person", 0.75),
        (rf"\b({_NAME}\s+(?i:{'|'.join(ORGANISATIONS)}))\b", "Organization", 0.8),
    ]
    hits = [F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p, _, _ in families]
    entries = F.concat(*(F.transform(h, _entry(kind, score)) for h, (_, kind, score) in zip(hits, families)))
    rows = docs.where("text IS NOT NULL").select("doc_id", F.explode(entries).alias("e"))
    return best_per_name(rows.select("doc_id", "e.name", "e.entity_type", "e.confidence"))


def _entry(kind: str, score: float):
    return lambda n: F.struct(F.regexp_replace(n, r"\s+", " ").alias("name"), F.lit(kind).alias("entity_type"), F.lit(score).alias("confidence"))


def capitalised_entities(docs: DataFrame, least: int = 2) -> DataFrame:
    """Capitalised runs that stand at least ``least`` times in a text."""
    runs = F.regexp_extract_all("text", F.lit(rf"\b({_NAME})\b"), F.lit(1))
    rows = docs.where("text IS NOT NULL").select("doc_id", F.explode(runs).alias("name")).where((F.length("name") > 2) & ~F.lower("name").isin(COMMON))
    counts = rows.groupBy("doc_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.select("doc_id", "name", F.lit("Person").alias("entity_type"), F.least(F.lit(0.6), 0.3 + 0.1 * F.col("n")).alias("confidence"), "n")


def phrase_relations(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``(doc_id, src, dst, relation_type, confidence)``: two words around a phrase,
    both of them among the document's one-word ``names`` (doc_id, name)."""
    parts = None
    for phrase, kind, score in RELATION_PHRASES:
        gap = r"\s*" if phrase.endswith("?") else r"\s+"
        pattern = rf"(?i)([a-z0-9_]+)\s+{phrase}{gap}([a-z0-9_]+)"
        src, dst = (F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in (1, 2))
        made = F.transform(F.arrays_zip(src.alias("a"), dst.alias("b")), _pair(kind, score))
        parts = made if parts is None else F.concat(parts, made)
    rows = docs.where("text IS NOT NULL").select("doc_id", F.explode(parts).alias("e")).select("doc_id", "e.*").distinct()
    known = names.select("doc_id", F.lower("name").alias("n")).where(~F.col("n").contains(" ")).distinct()
    return rows.join(known.toDF("doc_id", "src"), ["doc_id", "src"], "left_semi").join(known.toDF("doc_id", "dst"), ["doc_id", "dst"], "left_semi").where("src <> dst")


def _pair(kind: str, score: float):
    return lambda x: F.struct(F.lower(x["a"]).alias("src"), F.lower(x["b"]).alias("dst"), F.lit(kind).alias("relation_type"), F.lit(score).alias("confidence"))


def _core(word: str) -> str:
    return re.sub(r"^[\W_]+|[\W_]+$", "", word)


def proper_nouns(text: str, most: int | None = None, longest: int = 5) -> list[str]:
    """Capitalised runs of at most ``longest`` words, first seen first, none twice;
    at most ``most``, which is for short pieces of a text, not for whole ones."""
    names: dict[str, None] = {}
    run: list[str] = []

    def close() -> None:
        if run and (most is None or len(names) < most):
            names.setdefault(" ".join(run))
        run.clear()

    for word in text.split():
        core = _core(word)
        if len(core) > 1 and core[0].isupper() and core not in STOP_WORDS:
            if len(run) == longest:
                close()
            run.append(core)
            if word[-1] in ".!?,;:)\"'":
                close()
        else:
            close()
    close()
    return list(names)


def resolve_pronouns(text: str, people: list[tuple[str, str | None]], candidates: list[str]) -> list[tuple[str, str]]:
    """(pronoun, name) once per pronoun: the last person of its gender, else the
    nearest candidate before it, else the first name within 40 words after it."""
    words = text.split()
    cores = [_core(w) for w in words]
    out: dict[str, str] = {}
    seen: set[str] = set()
    for at, core in enumerate(cores):
        pronoun = core.lower()
        gender = PRONOUNS.get(pronoun)
        if gender is None or pronoun in seen:
            continue
        seen.add(pronoun)
        wanted = None if gender == "Neutral" else gender
        fitting = [name for name, g in people if g == wanted]
        if gender == "Neutral" and len(fitting) != 1:
            continue
        name = fitting[-1] if fitting else None
        if name is None:
            last = {c: i for i, c in enumerate(cores[:at])}
            places = [(max((last.get(w, -1) for w in n.split()), default=-1), n) for n in candidates]
            best = max((p for p, _ in places), default=-1)
            name = next((n for p, n in places if p == best), None) if best >= 0 else None
        if name is None:
            ahead = proper_nouns(" ".join(words[at + 1 : at + 41]), 1)
            name = ahead[0] if ahead else None
        if name:
            out[pronoun] = name
    return list(out.items())


def _rows_udf(make: Callable, schema: str):
    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            import pandas as pd

            rows = [(doc, *r) for doc, text in zip(pdf["doc_id"], pdf["text"]) if isinstance(text, str) for r in make(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return run


def proper_noun_rows(docs: DataFrame) -> DataFrame:
    schema = "doc_id bigint, pos int, name string"
    return docs.select("doc_id", "text").mapInPandas(_rows_udf(lambda t: enumerate(proper_nouns(t)), schema), schema)


def pronoun_rows(docs: DataFrame) -> DataFrame:
    """Pronouns resolved within each text by its own proper nouns."""
    schema = "doc_id bigint, pronoun string, name string"
    return docs.select("doc_id", "text").mapInPandas(_rows_udf(lambda t: resolve_pronouns(t, [], proper_nouns(t)), schema), schema)


def describe(docs: DataFrame, candidates: DataFrame, kind: str = "Person") -> DataFrame:
    """``(doc_id, surface, entity_name, offset)``: descriptions ("my father", "the
    committee") resolved to a candidate (doc_id, name, aliases): of a person by an
    equal alias, of places and groups by the description's word in name or alias."""
    pairs = KINSHIP if kind == "Person" else [(f"the {w}", w) for w in (PLACES if kind == "Location" else GROUPS)]
    surfaces = F.array(*(F.struct(F.lit(s).alias("surface"), F.lit(w).alias("word"), F.lit(i).alias("ord")) for i, (s, w) in enumerate(pairs)))
    rows = docs.where("text IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    rows = rows.select("doc_id", "low", F.filter(surfaces, lambda x: F.contains(F.col("low"), x["surface"])).alias("hits")).where("size(hits) > 0")
    rows = rows.select("doc_id", "low", F.explode("hits").alias("s")).select("doc_id", "s.surface", "s.word", (F.expr("instr(low, s.surface)") - 1).alias("offset")).where("offset >= 0")
    listed = F.coalesce("aliases", F.array().cast("array<string>"))
    if kind == "Person":
        words = candidates.select("doc_id", "name", F.explode(F.transform(listed, lambda a: F.lower(a))).alias("word"))
    else:
        words = candidates.select("doc_id", "name", F.explode(F.split(F.lower(F.concat_ws(" ", "name", listed)), r"[^\p{L}]+")).alias("word"))
    found = rows.join(words.distinct(), ["doc_id", "word"])
    return found.groupBy("doc_id", "surface", "offset").agg(F.min("name").alias("entity_name"))


def clean_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, text, label, score) without repeats of a text and label, and
    without spans inside a slightly longer one that scores about as much."""
    best = spans.groupBy("doc_id", F.lower("text").alias("key"), "label").agg(F.max("score").alias("score"), F.min("text").alias("text"))
    a, b = best.alias("a"), best.alias("b")
    inside = F.contains("b.key", "a.key") & (F.length("b.key") > F.length("a.key")) & (F.length("b.key") - F.length("a.key") <= 20) & (F.col("a.score") <= F.col("b.score") + 0.05)
    kept = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.label") == F.col("b.label")) & inside, "left_anti")
    return kept.select("doc_id", "text", "label", "score")


def with_provider(docs: DataFrame, provider: Callable[[list[str]], list[list[tuple[str, str, float]]]], batch: int = 64) -> DataFrame:
    """Entities by an external extractor, called in batches on the executors; a
    failing batch gives no rows."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                try:
                    answers = provider([t or "" for t in part["text"]])
                except Exception:
                    answers = []
                out += [(d, *e) for d, es in zip(part["doc_id"], answers) for e in es]
            yield pd.DataFrame(out, columns=["doc_id", "name", "entity_type", "confidence"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, name string, entity_type string, confidence double")


def inside_order(rows: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` least confident entities, for another extraction."""
    return rows.orderBy("confidence", "entity_id").limit(budget)


PAYLOAD = "entities array<struct<name:string,type:string,description:string,fields:map<string,string>>>, relations array<struct<`from`:string,`to`:string,relation:string>>"


def parse_payload(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (chunk_id, name, entity_type, description, fields) and relations
    (chunk_id, src, dst, relation_type) of a model's answers (chunk_id, answer):
    JSON, also fenced; what cannot be read gives no rows."""
    body = F.regexp_replace(F.trim("answer"), r"^```(json)?\s*|\s*```$", "")
    rows = answers.select("chunk_id", F.from_json(body, PAYLOAD, {"mode": "PERMISSIVE"}).alias("p"))
    e = rows.select("chunk_id", F.explode("p.entities").alias("e")).where(F.trim("e.name") != "")
    r = rows.select("chunk_id", F.explode("p.relations").alias("r")).where("r.`from` IS NOT NULL AND r.`to` IS NOT NULL")
    entities = e.select("chunk_id", F.trim("e.name").alias("name"), F.coalesce("e.type", F.lit("Unknown")).alias("entity_type"), "e.description", "e.fields")
    return entities, r.select("chunk_id", F.col("r.from").alias("src"), F.col("r.to").alias("dst"), F.col("r.relation").alias("relation_type"))


def parse_spans(answers: DataFrame) -> DataFrame:
    """``(doc_id, text, label, score)`` of a span model's answers (doc_id, answer): a JSON
    list, or an object with it under ``entities``; what cannot be read gives no rows."""
    span = "array<struct<text:string,label:string,score:double>>"
    inside = F.from_json("answer", f"struct<entities:{span}>").getField("entities")
    listed = F.when(F.ltrim("answer").startswith("{"), inside).otherwise(F.from_json("answer", span))
    rows = answers.select("doc_id", F.explode(listed).alias("s"))
    return rows.select("doc_id", "s.text", "s.label", "s.score").where("text IS NOT NULL AND trim(text) <> ''")
