"""Who is meant: candidates of a chunk, pronouns and place words resolved among them.

Candidates are rows (chunk_id, entity_id, name, aliases, gender, pos): the entities
of the chunk and of its neighbours in the document, the chunk's own first. The lists
of a chunk are as short as the chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.extraction import PRONOUNS, _core

# Words that point at a place.
PLACE_WORDS = ["there", "where"]


def candidates(chunks: DataFrame, mentioned: DataFrame, entities: DataFrame, kind: str = "Person", reach: int = 1, narrators: tuple[str, ...] = (), narrator_gender: str | None = None) -> DataFrame:
    """The entities of type ``kind`` (apart from case) that a chunk (chunk_id, doc_name,
    chunk_index) or one at most ``reach`` away mentions, each once, at the nearest place.

    ``narrators`` are aliases (lower case) whose bearers are candidates of every
    chunk, before all others; the list belongs to a corpus and is empty by default."""
    own = chunks.select("chunk_id", "doc_name", "chunk_index").where("doc_name IS NOT NULL").distinct()
    around = own.select("chunk_id", "doc_name", F.explode(F.array(*(F.lit(i) for i in range(-reach, reach + 1)))).alias("step"), "chunk_index")
    around = around.select("chunk_id", "doc_name", (F.col("chunk_index") + F.col("step")).alias("chunk_index"), F.abs("step").alias("pos"))
    near = around.join(own.select("doc_name", "chunk_index", F.col("chunk_id").alias("near_id")), ["doc_name", "chunk_index"]).where("pos > 0 OR near_id = chunk_id")
    persons = entities.where(F.lower("entity_type") == kind.lower()).select("entity_id", "name", "aliases", "gender")
    found = near.join(mentioned.select(F.col("chunk_id").alias("near_id"), "entity_id"), "near_id").groupBy("chunk_id", "entity_id").agg(F.min("pos").alias("pos"))
    out = found.join(persons, "entity_id")
    if narrators:
        telling = persons.where(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).isin(*narrators)))
        telling = telling.withColumn("gender", F.coalesce(F.lit(narrator_gender), "gender"))
        every = own.select("chunk_id").crossJoin(F.broadcast(telling)).withColumn("pos", F.lit(-1))
        out = out.join(telling.select("entity_id"), "entity_id", "left_anti").unionByName(every)
    return out.select("chunk_id", "entity_id", "name", "aliases", "gender", "pos")


def graph_pronouns(text: str, people: list[tuple[str, str | None]]) -> list[tuple[str, str, int, float]]:
    """(surface, name, offset, confidence) once a pronoun: the last candidate of its
    gender; a neutral one takes the last of any."""
    words, at, seen, out = text.split(), 0, set(), []
    for word in words:
        pronoun = _core(word).lower()
        gender = PRONOUNS.get(pronoun)
        if gender and pronoun not in seen:
            seen.add(pronoun)
            name = next((n for n, g in reversed(people) if gender == "Neutral" or g == gender), None)
            if name:
                out.append((word, name, at, 0.9))
        at += len(word) + 1
    return out


def place_words(text: str, places: list[tuple[str, list[str]]]) -> list[tuple[str, str, int, float]]:
    """(surface, name, offset, confidence) once for there and where: the place whose
    name or alias words of at least 4 letters stand last before it; of equal ones the first."""
    words, seen, out = text.split(), set(), []
    at = 0
    for i, word in enumerate(words):
        low = _core(word).lower()
        if low in PLACE_WORDS and low not in seen:
            seen.add(low)
            before = " ".join(words[:i]).lower()
            last = [max((before.rfind(w) for n in (name, *aliases) for w in n.lower().split() if len(w) >= 4), default=-1) for name, aliases in places]
            best = max(last, default=-1)
            if best >= 0:
                out.append((word, places[last.index(best)][0], at, 0.85))
        at += len(word) + 1
    return out


def resolve(chunks: DataFrame, found: DataFrame, people: bool = True) -> DataFrame:
    """``(chunk_id, surface, entity_name, offset, confidence)``: pronouns (or place words)
    of the chunks (chunk_id, text) among their candidates. Chunks without any have no row."""
    listed = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col("entity_id"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "gender"))).alias("c"))
    rows = chunks.where("text IS NOT NULL").select("chunk_id", "text").join(listed, "chunk_id")
    make: Callable = (lambda text, c: graph_pronouns(text, [(x["name"], x["gender"]) for x in c])) if people else (lambda text, c: place_words(text, [(x["name"], list(x["aliases"])) for x in c]))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = [(chunk, *r) for chunk, text, c in zip(pdf["chunk_id"], pdf["text"], pdf["c"]) for r in make(text, c)]
            yield pd.DataFrame(out, columns=["chunk_id", "surface", "entity_name", "offset", "confidence"])

    return rows.mapInPandas(run, "chunk_id bigint, surface string, entity_name string, offset int, confidence double")
