"""Column expressions: identifiers, names, text measures, memory curve, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Honorifics that are dropped from a name's key.
HONORIFICS = [
    "dr", "mr", "mrs", "ms", "miss", "prof", "professor", "rev", "reverend",
    "sir", "haji", "hajj", "maulvi", "maulana", "imam", "sheikh", "shaykh",
    "auntie", "aunt", "uncle", "oom", "tannie", "oupa", "my",
]

# Degrees after a name.
DEGREES = ["ma", "ba", "bsc", "msc", "phd", "llb", "llm", "bed", "bcom", "mba", "mpa", "hons", "dip", "jp", "obe", "mbe", "mbbs"]

# Field values that state nothing.
PLACEHOLDERS = ["unknown", "undefined", "n/a", "none", "not stated", "not specified", "not mentioned", "not known", "not applicable", "unspecified"]

# The fields an entity of a type should have.
EXPECTED_FIELDS = {
    "Person": ["birthDate", "birthPlace", "deathDate", "nationality", "occupation", "affiliation", "spouse", "parent", "sibling", "child"],
    "Place": ["addressLocality", "addressRegion", "addressCountry", "locationType", "historicalNote"],
    "Location": ["addressLocality", "addressRegion", "addressCountry", "locationType", "historicalNote"],
    "Organization": ["foundingDate", "dissolutionDate", "location", "founder", "orgType"],
}

# Spans that are no entities, words, least scores by type.
GENERIC_NAMES = [
    "cluster", "paper", "review", "article", "document", "chapter", "section",
    "literature", "model", "framework", "system", "method", "approach",
    "house", "home", "court", "defendant", "plaintiff", "company", "organization",
    "university", "institute", "school", "department", "agency", "government",
    "person", "people", "man", "woman", "child", "children", "author", "writer",
    "grass", "leaves", "book", "poem", "poems", "novel", "story", "text",
    "node", "way", "relation", "tag", "tags", "map", "data",
    "purpose", "role", "version", "reference", "tutorial", "module",
    "function", "functions", "object", "type", "types", "class", "classes",
    "import", "scope", "namespace", "grammar", "statement", "statements",
    "near-miss", "cross-document", "observational", "uncertainty", "ensemble",
    "scholarly article", "discovery paper", "review paper",
    "whaling-industry literature", "historical event", "1820 historical event",
]
COMMON_WORDS = [
    "the", "and", "or", "but", "that", "this", "from", "with", "for", "are",
    "was", "were", "been", "being", "have", "has", "which", "who", "what",
    "when", "where", "why", "how", "into", "over", "under", "about", "also",
    "such", "than", "then", "them", "they", "their", "there", "these", "those",
    "one", "two", "three", "first", "second", "new", "old", "good", "great",
    "small", "large", "high", "low", "same", "other", "many", "most", "some",
    "any", "all", "each", "every", "own", "more", "less", "very", "just",
    "only", "even", "still", "already", "often", "never", "always", "yes", "no",
    "true", "false", "null", "none", "unknown", "n/a", "etc",
]
# Words that tell nothing in a description.
DESCRIPTION_STOP = [
    "that", "this", "with", "from", "have", "been", "were", "they", "their", "also", "well", "known", "very", "when", "some", "many", "most",
    "more", "than", "into", "about", "after", "which", "would", "could", "should", "other", "over",
]
LEAST_SCORE = {"Person": 0.55, "Organization": 0.55, "Location": 0.60, "Work": 0.65, "Event": 0.65, "Facility": 0.60, "Product": 0.75}


def _id_of(hashed: Column) -> Column:
    """The first 8 bytes of a hex digest as a little-endian signed number."""
    swapped = F.concat(*(F.substring(hashed, 2 * i + 1, 2) for i in range(7, -1, -1)))
    return F.conv(swapped, 16, -10).cast("long")


def entity_id(name: Column, entity_type: Column) -> Column:
    return _id_of(F.sha2(F.concat(F.lower(name), F.lit("::"), entity_type), 256))


def chunk_id(doc: Column, index: Column) -> Column:
    padded = F.lpad(F.hex(index.cast("long")), 8, "0")
    little = F.concat(*(F.substring(padded, 2 * i + 1, 2) for i in range(3, -1, -1)))
    return _id_of(F.sha2(F.concat(F.encode(doc, "utf-8"), F.encode(F.lit("::"), "utf-8"), F.unhex(little)), 256))


def normalize_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")))


def stripped_key(name: Column) -> Column:
    return F.array_join(F.filter(F.split(normalize_name(name), " "), lambda w: ~w.isin(HONORIFICS) & (w != "")), " ")


def strip_qualifications(name: Column) -> Column:
    """The normalised name without trailing degrees; null if it has none."""
    degree = "|".join(r"\.?".join(d) + r"\.?" for d in DEGREES)
    cut = F.regexp_replace(F.trim(name), rf"(?i)(?:(?:^|\s+)(?:{degree}))+\s*$", "")
    return F.when(cut != F.trim(name), normalize_name(cut))


def has_disambiguation_token(name: Column) -> Column:
    return name.rlike(r"\([^()]*\)\s*$") | name.rlike(r"\s(II|III|IV|VI|VII|VIII|IX)\s*$")


def tokens(text: Column) -> Column:
    """Lower-case blank-delimited tokens."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def token_core(token: Column) -> Column:
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def significant_words(text: Column) -> Column:
    """Different alphabetic words of at least 4 letters outside the stop list of descriptions."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(DESCRIPTION_STOP)))


def embed_text(name: Column, description: Column, aliases: Column | None = None) -> Column:
    listed = F.lit("") if aliases is None else F.when(F.size(F.coalesce(aliases, F.array())) > 0, F.concat(F.lit(" ("), F.array_join(aliases, ", "), F.lit(")"))).otherwise("")
    return F.concat(name, listed, F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(": "), description)).otherwise(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if a norm is zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def elapsed_days(then: Column, now: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then.cast("timestamp"))) / 86_400e6), F.lit(0.0))


def stability(reinforcement: Column, base: float = 30.0, boost: float = 1.5) -> Column:
    return F.lit(base) * (1 + F.lit(boost) * F.log1p(F.greatest(F.lit(0.0), reinforcement.cast("double"))))


def strength(reinforcement: Column, days: Column, base: float = 30.0, boost: float = 1.5) -> Column:
    """Retention after ``days``: exp(-days / stability)."""
    s = stability(reinforcement, base, boost)
    return F.when(s > 0, F.exp(-days / s)).otherwise(F.lit(0.0))


def memory_state(value: Column, promote: float = 0.66, demote: float = 0.33) -> Column:
    return F.when(value >= promote, "long_term").when(value >= demote, "short_term").otherwise("dormant")


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def dcg_gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)


def relative_reduction(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) / before).otherwise(F.lit(0.0))


def infer_gender(text: Column) -> Column:
    """The gender whose pronouns occur more, by whole words; null on a tie."""
    count = lambda words: sum((text.rlike(rf"(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_]){w}(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])").cast("int") for w in words), F.lit(0))
    male, female = count(["he", "him", "his", "himself"]), count(["she", "her", "hers", "herself"])
    return F.when(male > female, "Male").when(female > male, "Female")


def is_valid_entity(name: Column, kind: Column, score: Column) -> Column:
    """Whether an extracted span is a plausible entity."""
    low, alpha = F.lower(F.trim(name)), F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    n_tokens = F.size(F.filter(F.split(name, r"\s+"), lambda t: t != ""))
    least = F.lit(0.55)
    for k, v in LEAST_SCORE.items():
        least = F.when(kind == k, v).otherwise(least)
    near_blocked = F.lit(False)
    for phrase in (g for g in GENERIC_NAMES if " " in g):
        near_blocked = near_blocked | (F.contains(low, F.lit(phrase)) & (F.length(low) <= len(phrase) + 8))
    bad_person = (kind == "Person") & (((n_tokens == 1) & ~name.rlike(r"^\s*\p{Lu}")) | low.isin("grass", "typee", "leaves", "house", "defendant", "plaintiff") | (n_tokens > 5))
    bad_place = (kind == "Location") & (low.isin("cluster", "paper", "section", "chapter", "home", "house") | ((n_tokens == 1) & low.rlike("(ing|tion|ment|ness)$")))
    bad_work = kind.isin("Work", "Event", "Product") & (n_tokens == 1) & (F.length(name) < 4) & (F.upper(name) != name)
    domain = (kind != "Organization") & low.rlike(r"^[a-z0-9.-]+\.(com|org|net|edu|io|gov)$")
    fine = (score >= least) & F.length(name).between(2, 80) & (alpha >= 2) & (alpha / F.length(name) >= 0.45)
    blocked = low.isin(GENERIC_NAMES + COMMON_WORDS) | near_blocked | bad_person | bad_place | bad_work | domain | F.contains(name, F.lit("@"))
    return F.coalesce(fine & ~blocked, F.lit(False))


# Labels of span models and the types they stand for.
LABEL_TYPES = {
    "person": "Person", "organization": "Organization", "org": "Organization", "location": "Location", "gpe": "Location", "loc": "Location",
    "product": "Product", "event": "Event", "work": "Work", "work of art": "Work", "facility": "Facility", "fac": "Facility", "date": "Date",
}
TAGGER_TYPES = {"PERSON": "Person", "ORG": "Organization", "GPE": "Location", "LOC": "Location", "PRODUCT": "Product", "EVENT": "Event", "FAC": "Facility", "WORK_OF_ART": "Work", "DATE": "Date"}

# Prefixes of texts for the embedding model.
QUERY_PREFIX, DOCUMENT_PREFIX = "search_query: ", "search_document: "


def map_label(label: Column) -> Column:
    """The type that a span label stands for; another label in title case."""
    low = F.lower(F.trim(label))
    out = F.initcap(F.lower(label))
    for name, kind in LABEL_TYPES.items():
        out = F.when(low == name, kind).otherwise(out)
    return out


def map_tag(label: Column) -> Column:
    """The type that a tagger's label stands for; null for the others."""
    out = F.lit(None).cast("string")
    for name, kind in TAGGER_TYPES.items():
        out = F.when(label == name, kind).otherwise(out)
    return out


def normalize_entity_name(name: Column) -> Column:
    """One blank for several, no quotes and brackets around, no ``;,:`` at the end."""
    plain = F.trim(F.regexp_replace(F.translate(name, "\u00a0", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(F.btrim(plain, F.lit("\"'`“”‘’[](){}<>|")), "[;,:]+$", ""))


def description_from_fields(name: Column, kind: Column, values: Column) -> Column:
    """``Name — key: value; ...`` of the expected fields of a type that a map of
    values fills with something said; else the empty string."""
    out = F.lit("")
    for entity_type, fields in EXPECTED_FIELDS.items():
        said = [F.when((F.coalesce(v, F.lit("")) != "") & ~F.lower(F.trim(v)).isin(PLACEHOLDERS), F.concat(F.lit(f"{k}: "), v)) for k in fields for v in [F.try_element_at(values, F.lit(k))]]
        text = F.concat_ws("; ", *said)
        out = F.when(kind == entity_type, F.when(text != "", F.concat(name, F.lit(" — "), text)).otherwise("")).otherwise(out)
    return F.coalesce(out, F.lit(""))


def parse_timestamp(text: Column) -> Column:
    """An ISO time, also with ``Z``, as a timestamp; null if it is none."""
    return F.try_to_timestamp(text)


def query_text(text: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), text)


def document_text(text: Column) -> Column:
    return F.concat(F.lit(DOCUMENT_PREFIX), text)


def context_line(title: Column, author: Column, year: Column, isbn: Column, publisher: Column, subject: Column) -> Column:
    """One line about a document for a prompt; null if nothing is known of it."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    head = F.concat(F.lit('"'), F.when(given(title), title).otherwise("(untitled document)"), F.lit('"'))
    parts = [
        F.when(given(author), F.concat(head, F.lit(" by "), author)).otherwise(head),
        F.when(given(year), F.concat(F.lit("("), year, F.lit(")"))),
        *(F.when(given(c), F.concat(F.lit(f"{label}: "), c)) for label, c in (("ISBN", isbn), ("Publisher", publisher), ("Subject", subject))),
    ]
    known = given(title) | given(author) | given(year) | given(isbn) | given(publisher) | given(subject)
    return F.when(known, F.concat_ws(" ", *parts))
