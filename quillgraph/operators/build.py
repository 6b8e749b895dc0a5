"""From documents to a graph: extraction ensembles, duplicates within a document,
endpoints, contexts of an entity, refinement, and the two whole builds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.names import clean_entity_name, clean_extracted_name
from quillgraph.functions.scalar import EXPECTED_FIELDS, PLACEHOLDERS, description_from_fields, embed_text, entity_id, is_valid_entity, normalize_entity_name, normalize_name
from quillgraph.operators.extraction import inside_order, phrase_relations
from quillgraph.operators.graph import upsert_relations

# Places, endings of organisations and heads of concepts of the simple extractor.
SIMPLE_PLACES = ["United States", "Europe", "France", "Germany", "Russia", "China", "Japan", "India", "Brazil", "Canada", "Australia", "Mexico", "London", "Paris", "Berlin", "Moscow", "Tokyo", "New York"]
SIMPLE_ENDINGS = ["Inc", "Corp", "Ltd", "University", "College", "Institute", "Organization", "Company", "Department"]
SIMPLE_CONCEPTS = ["theory", "principle", "law", "method", "algorithm", "concept", "process", "system", "phenomenon"]

_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"


def simple_entities(docs: DataFrame) -> DataFrame:
    """``(doc_id, name, entity_type)``, each once: capitalised runs that stand twice,
    organisations by their ending, fixed places, and concepts ("theory of ...")."""
    rows = docs.where("text IS NOT NULL").select("doc_id", "text")
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"\b({_NAME})\b"), F.lit(1))).alias("name"))
    persons = runs.where((F.length("name") > 2) & ~F.col("name").isin("The", "And", "For", "With")).groupBy("doc_id", "name").agg(F.count("*").alias("n")).where("n >= 2")
    organisations = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"\b([A-Z][a-z]+(?:\s+(?:{'|'.join(SIMPLE_ENDINGS)})\.?))\b"), F.lit(1))).alias("name"))
    places = rows.select("doc_id", F.explode(F.filter(F.array(*(F.lit(p) for p in SIMPLE_PLACES)), lambda p: F.contains(F.col("text"), p))).alias("name"))
    concepts = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"(?i)\b((?:{'|'.join(SIMPLE_CONCEPTS)})\s+of\s+[a-z]+)\b"), F.lit(1))).alias("name"))
    parts = [(persons.select("doc_id", "name"), "Person"), (organisations.where(F.length("name") > 3), "Organization"), (places, "Location"), (concepts.where(F.length("name") > 3), "Concept")]
    out = None
    for part, kind in parts:
        named = part.select("doc_id", (F.col("name") if kind == "Location" else clean_entity_name(F.col("name"))).alias("name"), F.lit(kind).alias("entity_type"))
        out = named if out is None else out.unionByName(named)
    return out.distinct()


def ensemble(spans: DataFrame, tagged: DataFrame | None = None, patterns: DataFrame | None = None, capitalised: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """``(doc_id, name, entity_type, confidence)``: the spans of a model and of a tagger,
    patterns only for documents with fewer than two spans, capitalised runs (if given)
    only for those with none; names normalised, valid ones, the most confident of each
    name (apart from case) and type."""
    columns = ["doc_id", "name", "entity_type", "confidence"]
    known = spans.groupBy("doc_id").agg(F.count("*").alias("n"))
    parts = [spans.select(columns)] + ([tagged.select(columns)] if tagged is not None else [])
    for more, least in ((patterns, 2), (capitalised, 1)):
        if more is not None:
            parts.append(more.join(known.where(F.col("n") >= least), "doc_id", "left_anti").select(columns))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("name", normalize_entity_name(F.col("name"))).where((F.col("name") != "") & is_valid_entity(F.col("name"), F.col("entity_type"), F.col("confidence")))
    best = rows.groupBy("doc_id", F.lower("name").alias("key"), "entity_type").agg(F.max_by("name", F.struct("confidence", "name")).alias("name"), F.max("confidence").alias("confidence"))
    return best.select(columns)


def similar_names(a: str, b: str) -> bool:
    """Equal last words of two names of several, or 0.7 of the words of long ones."""
    one, two = a.split(), b.split()
    if len(one) > 1 and len(two) > 1 and one[-1] == two[-1]:
        return True
    if len(a) <= 10 or len(b) <= 10:
        return False
    x, y = {*one}, {*two}
    return len(x & y) / max(len(x), len(y)) >= 0.7


def merge_extracted(found: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Greedy: the most confident and longest names first; a similar one of the type, or
    one that ends with the other and has at most two words more, joins it. The longer
    name stays if its confidence is at most 0.1 lower."""
    kept: dict[str, tuple[str, str, float]] = {}
    for name, kind, score in sorted(found, key=lambda e: (-e[2], -len(e[0]), e[0], e[1])):
        key = name.lower().strip()
        if key in kept:
            if score > kept[key][2]:
                kept[key] = (name, kind, score)
            continue
        match = None
        for other, entry in kept.items():
            short, long = sorted((key, other), key=len)
            if entry[1] == kind and (similar_names(key, other) or long.endswith(short) and len(long.split()) - len(short.split()) <= 2):
                match = other
                break
        if match is None:
            kept[key] = (name, kind, score)
        elif len(name) > len(kept[match][0]) and score >= kept[match][2] - 0.1:
            del kept[match]
            kept[key] = (name, kind, score)
        elif score > kept[match][2]:
            kept[match] = (name, kind, score)
    return list(kept.values())


def merge_within(found: DataFrame, by: str = "doc_id") -> DataFrame:
    """:func:`merge_extracted` for each document: the entities of one text fit in a task."""
    kind = found.schema[by].dataType.simpleString()
    rows = found.where(is_valid_entity(F.col("name"), F.col("entity_type"), F.col("confidence"))).withColumn("name", normalize_entity_name(F.col("name"))).where("name <> ''")

    def choose(pdf):
        import pandas as pd

        out = merge_extracted([*zip(pdf["name"], pdf["entity_type"], pdf["confidence"])])
        return pd.DataFrame([(pdf[by].iloc[0], *e) for e in out], columns=[by, "name", "entity_type", "confidence"])

    return rows.select(by, "name", "entity_type", "confidence").groupBy(by).applyInPandas(choose, f"{by} {kind}, name string, entity_type string, confidence double")


def resolve_endpoints(pairs: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` (chunk_id, src, dst, ...) with ``src_id`` and ``dst_id``: of the chunk's
    own entities (chunk_id, name, entity_type) of that name, else of the graph's ``names``
    (key, entity_id), else of an entity of type Unknown."""
    own = found.groupBy("chunk_id", F.lower("name").alias("low")).agg(F.min(entity_id(F.col("name"), F.col("entity_type"))).alias("own_id"))
    out = pairs
    for end in ("src", "dst"):
        out = out.withColumns({"low": F.lower(end), "key": normalize_name(F.col(end))}).join(own, ["chunk_id", "low"], "left").join(names.select("key", "entity_id"), "key", "left")
        out = out.withColumn(f"{end}_id", F.coalesce("own_id", "entity_id", entity_id(F.col(end), F.lit("Unknown")))).drop("low", "key", "own_id", "entity_id")
    return out


def entity_contexts(spans: DataFrame, chunks: DataFrame, k: int = 1, most: int = 3, joint: str = "\n\n[...]\n\n") -> DataFrame:
    """``(name, doc_name, n_chunks, context)``: per name and document the windows of ``k``
    chunks around the first ``most`` chunks that hold it (name, doc_name, chunk_index),
    overlapping ones once, in order."""
    first = spans.select("name", "doc_name", "chunk_index").distinct().groupBy("name", "doc_name").agg(F.slice(F.array_sort(F.collect_list("chunk_index")), 1, most).alias("at"))
    wanted = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i - k, i + k))))
    rows = first.select("name", "doc_name", F.explode(wanted).alias("chunk_index"))
    texts = chunks.where("doc_name IS NOT NULL").groupBy("doc_name", "chunk_index").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = rows.join(texts, ["doc_name", "chunk_index"]).groupBy("name", "doc_name").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return found.select("name", "doc_name", F.size("c").alias("n_chunks"), F.array_join(F.transform("c", lambda x: x["text"]), joint).alias("context"))


def extract_in_context(contexts: DataFrame, provider: Callable[[list[str], list[str]], list[list[dict]]], batch: int = 32) -> DataFrame:
    """``(asked, name, entity_type, description, fields, error)``: a model's entities for
    each context (name, context), asked in batches on the executors. ``provider`` takes
    names and contexts and returns dictionaries; names are cleaned, nameless ones left
    out; a failing batch gives one row with its error for each name asked."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for i in range(0, len(pdf), batch):
                names, texts = list(pdf["name"][i : i + batch]), list(pdf["context"][i : i + batch])
                try:
                    answers = provider(names, texts)
                    out += [(asked, e.get("name"), e.get("type", "Unknown"), e.get("description", ""), e.get("fields") or {}, None) for asked, es in zip(names, answers) for e in es]
                except Exception as error:
                    out += [(asked, None, None, None, None, repr(error)) for asked in names]
            yield pd.DataFrame(out, columns=["asked", "name", "entity_type", "description", "fields", "error"])

    rows = contexts.select("name", "context").mapInPandas(run, "asked string, name string, entity_type string, description string, fields map<string,string>, error string")
    return rows.withColumn("name", clean_extracted_name(F.col("name"))).where("error IS NOT NULL OR name IS NOT NULL")


def refinement_targets(entities: DataFrame, threshold: float, budget: int, types: list[str] = ()) -> DataFrame:
    """The ``budget`` least confident entities below ``threshold``, of the given types
    (apart from case; none are all)."""
    rows = entities.where(F.col("confidence") < threshold)
    if types:
        rows = rows.where(F.lower("entity_type").isin([t.lower() for t in types]))
    return inside_order(rows, max(budget, 1))


def refine(entities: DataFrame, chunks: DataFrame, mentioned: DataFrame, provider: Callable, threshold: float = 0.5, budget: int = 50, types: list[str] = (), k: int = 1) -> DataFrame:
    """``(entity_id, old, new, improved)``: the targets of refinement after a model was
    asked for their fields again in the context of their evidence; confidence is the
    share of expected fields that are filled, and improved by more than 0.01."""
    targets = refinement_targets(entities, threshold, budget, types).select("entity_id", "name", "entity_type", "confidence")
    spans = targets.join(mentioned, "entity_id").join(chunks.select("chunk_id", "doc_name", "chunk_index"), "chunk_id").select("name", "doc_name", "chunk_index")
    found = extract_in_context(entity_contexts(spans, chunks, k), provider).where("error IS NULL")
    said = found.select("asked", F.explode("fields").alias("field", "value")).where((F.coalesce("value", F.lit("")) != "") & ~F.lower(F.trim("value")).isin(PLACEHOLDERS))
    expected = targets.select("entity_id", "name", "entity_type", F.explode(_expected(F.col("entity_type"))).alias("field"))
    filled = expected.join(said.select(F.col("asked").alias("name"), "field").distinct(), ["name", "field"]).groupBy("entity_id").agg(F.count("*").alias("filled"))
    rows = targets.join(filled, "entity_id", "left").withColumn("new", F.greatest("confidence", F.coalesce(F.col("filled") / F.size(_expected(F.col("entity_type"))), F.lit(0.0))))
    return rows.select("entity_id", F.col("confidence").alias("old"), "new", (F.col("new") > F.col("confidence") + 0.01).alias("improved"))


def _expected(kind: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, fields in EXPECTED_FIELDS.items():
        out = F.when(kind == name, F.array(*(F.lit(f) for f in fields))).otherwise(out)
    return out


def reembed(entities: DataFrame, fields: DataFrame, provider: Callable[[list[str]], list[list[float]]], only: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """``(entity_id, description, embedding)`` of all entities, or of those of ``only``: the
    description anew from their fields (entity_id, values: a map), where there are any,
    and the embedding of name and description, in batches on the executors."""
    rows = entities if only is None else entities.join(only.select("entity_id").distinct(), "entity_id", "left_semi")
    rows = rows.join(fields, "entity_id", "left")
    fresh = description_from_fields(F.col("name"), F.col("entity_type"), F.col("values"))
    rows = rows.withColumn("description", F.when(fresh != "", fresh).otherwise(F.coalesce("description", F.lit(""))))
    rows = rows.where("name IS NOT NULL").select("entity_id", "description", embed_text(F.col("name"), F.col("description"), F.col("aliases")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            vectors = [v for i in range(0, len(pdf), batch) for v in provider(list(pdf["text"][i : i + batch]))]
            yield pdf[["entity_id", "description"]].assign(embedding=vectors)

    return rows.mapInPandas(run, "entity_id bigint, description string, embedding array<float>")


def cooccurring(found: DataFrame) -> DataFrame:
    """``(src_id, dst_id, relation_type, evidence)``: co_occurs of the entities (doc_id,
    entity_id) of one document, the smaller id first. Pairs grow with the square of the
    entities of one text, which is what is asked for."""
    a, b = found.select("doc_id", F.col("entity_id").alias("src_id")), found.select("doc_id", F.col("entity_id").alias("dst_id"))
    return a.join(b, "doc_id").where("src_id < dst_id").select("src_id", "dst_id", F.lit("co_occurs").alias("relation_type"), F.array(F.col("doc_id")).alias("evidence"))


def graph_of(found: DataFrame, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (entity_id, name, entity_type, mention_count, first_doc), mentions (doc_id,
    entity_id) and relations out of extracted rows (doc_id, name, entity_type): those
    given, and co-occurrence within a document."""
    rows = found.select("doc_id", "name", "entity_type", entity_id(F.col("name"), F.col("entity_type")).alias("entity_id"))
    entities = rows.groupBy("entity_id").agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"), F.countDistinct("doc_id").alias("mention_count"), F.min("doc_id").alias("first_doc"))
    mentioned = rows.select("doc_id", "entity_id").distinct()
    pairs = cooccurring(mentioned)
    return entities, mentioned, upsert_relations(pairs if relations is None else relations.unionByName(pairs))


def corpus_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The co-occurrence graph of the simple extractor."""
    return graph_of(simple_entities(docs))


def improved_graph(docs: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of an extractor (documents to doc_id, name, entity_type, confidence) in
    four phases: entities, duplicates within a document, relations by phrases between
    its one-word names, co-occurrence. The evidence is the document."""
    from quillgraph.common import cut

    found = cut(merge_within(extract(docs)))
    ids = found.select("doc_id", F.lower("name").alias("low"), entity_id(F.col("name"), F.col("entity_type")).alias("entity_id")).groupBy("doc_id", "low").agg(F.min("entity_id").alias("entity_id"))
    stated = phrase_relations(docs, found.select("doc_id", "name"))
    stated = stated.join(ids.toDF("doc_id", "src", "src_id"), ["doc_id", "src"]).join(ids.toDF("doc_id", "dst", "dst_id"), ["doc_id", "dst"]).where("src_id <> dst_id")
    return graph_of(found, stated.select("src_id", "dst_id", "relation_type", F.array(F.col("doc_id")).alias("evidence")))
