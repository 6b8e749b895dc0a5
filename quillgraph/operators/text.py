"""Chunking and sections: sliding windows, paragraphs, context, schemas, indexes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scalar import chunk_id

# Sections that form one narrative zone.
NARRATIVE = ["main", "chapter", "introduction", "preface"]

# Words of organisations and of places in an index.
ORGANISATION_WORDS = [
    "congress", "committee", "association", "league", "party", "union", "council", "institute", "museum", "school", "university", "college",
    "company", "corporation", "limited", "ltd", "inc", "foundation", "movement", "government", "ministry", "department", "church", "mosque",
]
PLACE_WORDS = [
    "street", "road", "avenue", "drive", "lane", "place", "square", "district", "city", "cape", "town", "province", "mountain", "river",
    "hall", "house", "building", "school", "museum", "station",
]


def character_chunks(docs: DataFrame, size: int = 800, overlap: int = 200, least: int = 20) -> DataFrame:
    """``(doc_id, chunk_index, start, text, surrounding)``: windows of ``size``
    characters; those shorter than ``least`` are dropped before they are counted.
    Only built-in expressions; null and empty texts give no chunks."""
    step = max(size - overlap, 1)
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("pos", "start"))
    part = F.substring(F.col("text"), F.col("start") + 1, F.lit(size))
    begin = F.greatest(F.lit(0), F.col("start") - size // 4)
    stop = F.least(F.length("text"), F.least(F.length("text"), F.col("start") + size) + size // 4)
    rows = rows.select("doc_id", "start", part.alias("part"), F.substring(F.col("text"), begin + 1, stop - begin).alias("surrounding")).where(F.length("part") >= least)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return rows.select("doc_id", index.alias("chunk_index"), "start", F.col("part").alias("text"), "surrounding")


def with_chunk_ids(chunks: DataFrame, doc: str = "doc_name") -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col(doc), F.col("chunk_index")))


def same_zone(a: Column, b: Column) -> Column:
    return a.isin(NARRATIVE) & b.isin(NARRATIVE)


def context_windows(chunks: DataFrame, k: int = 1, joint: str = "\n\n[...]\n\n") -> DataFrame:
    """Each chunk's text between those of its ``k`` neighbours in the same zone;
    the chunk itself always belongs to its window."""
    around = Window.partitionBy("doc_name").orderBy("chunk_index", "chunk_id").rowsBetween(-k, k)
    entry = F.struct("chunk_id", "section_type", F.coalesce("text", F.lit("")).alias("text"))
    listed = chunks.withColumn("w", F.collect_list(entry).over(around))
    kept = F.filter("w", lambda x: (x["chunk_id"] == F.col("chunk_id")) | same_zone(x["section_type"], F.col("section_type")))
    return listed.select("chunk_id", F.array_join(F.transform(kept, lambda x: x["text"]), joint).alias("window_text"))


def match_sections(headings: DataFrame, schema: DataFrame, most: int = 10_000) -> DataFrame:
    """``headings`` (id, heading) with the first definition (ord, pattern,
    section_type, skip) whose pattern the heading contains. A schema is a list of
    the sections of one document; it is counted, and more than ``most`` definitions
    fail instead of being cut."""
    hit = F.contains(F.lower("heading"), F.lower("pattern"))
    if (n := schema.count()) > most:
        raise ValueError(f"{n} section definitions, at most {most} are compared with every heading")
    found = headings.join(F.broadcast(schema), hit).groupBy("id").agg(F.min_by(F.struct("pattern", "section_type", "skip"), "ord").alias("s"))
    return headings.join(found, "id", "left").select("id", "heading", "s.pattern", F.coalesce("s.section_type", F.lit("main")).alias("section_type"), F.coalesce("s.skip", F.lit(False)).alias("skip"))


def detect_schema(docs: DataFrame, head: int = 3000) -> DataFrame:
    """ISBN, publisher, copyright year and holder, and author out of the first lines of
    each text; the year stands under its three names."""
    lines = F.split(F.substring("text", 1, head), "\n")
    first = lambda xs: F.when(F.size(xs) > 0, F.element_at(xs, 1))
    digits = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("ISBN"))), lambda x: F.regexp_replace(x, "[^0-9X]", ""))
    isbn = first(F.filter(digits, lambda x: F.length(x).isin(10, 13)))
    by = F.transform(F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("published by"))), lambda x: F.trim(F.regexp_extract(x, r"(?i)published by\s*([^,.]*)", 1)))
    publisher = first(F.filter(by, lambda x: (F.length(x) > 0) & (F.length(x) < 80)))
    rights = F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("copyright")) | F.contains(x, F.lit("©")))
    years = F.transform(rights, lambda x: F.regexp_extract(x, r"(1[89][0-9]{2}|20[0-9]{2}|2100)", 1))
    year = first(F.filter(years, lambda x: x != ""))
    after = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("©"))), lambda x: F.regexp_extract(x, r"©\s*(?:opyright)?\s*([^0-9]*)", 1))
    holder = first(F.filter(F.transform(after, lambda x: F.trim(F.regexp_replace(F.trim(x), ",+$", ""))), lambda x: F.length(x) > 2))
    named = F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.startswith("By ")), lambda x: F.trim(F.substring(x, 4, 200)))
    author = first(F.filter(named, lambda x: x.rlike(r"^\p{Lu}") & F.size(F.split(x, r"\s+")).between(2, 5)))
    return docs.where("text IS NOT NULL").select("doc_id", F.when(isbn.isNotNull(), "Book").alias("schema_type"), isbn.alias("isbn"), publisher.alias("publisher"), year.alias("year"), year.alias("copyright_year"), year.alias("date_published"), holder.alias("copyright_holder"), author.alias("author"))


def index_seeds(lines: DataFrame) -> DataFrame:
    """``(id, name, type_hint)`` of index lines: page numbers cut off, "Last, First"
    put in order, persons and organisations told by their words."""
    line = F.trim("line")
    rows = lines.where((F.length(line) >= 3) & ~line.rlike("^[0-9]")).select("id", F.trim(F.regexp_replace(line, r",\s*[0-9ivxlcIVXLC, \-–]+$", "")).alias("part")).where(F.length("part") >= 2)
    last, rest = F.regexp_extract("part", r"^(\p{Lu}\S*),\s*(\p{Lu}.*)$", 1), F.regexp_extract("part", r"^(\p{Lu}\S*),\s*(\p{Lu}.*)$", 2)
    low = F.lower("part")
    is_org = F.lit(False)
    for word in ORGANISATION_WORDS:
        is_org = is_org | F.contains(low, F.lit(word))
    is_org = is_org | (F.contains("part", F.lit("(")) & F.contains("part", F.lit(")")))
    words = F.split("part", r"\s+")
    is_person = F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}")) & ~F.exists(F.split(low, r"\s+"), lambda w: w.isin(PLACE_WORDS))
    name = F.when(last != "", F.concat_ws(" ", rest, last)).otherwise(F.col("part"))
    hint = F.when(last != "", "Person").when(is_org, "Organization").when(is_person, "Person")
    return rows.select("id", F.trim(name).alias("name"), hint.alias("type_hint"))


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def strip_vtt(text: Column) -> Column:
    """Without the header, cue numbers and times of a subtitle file."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("WEBVTT") & ~F.contains(x, F.lit("-->")) & ~x.rlike(r"^\s*[0-9]+\s*$"))
    return F.array_join(lines, "\n")


class Paragraphs:
    """Paragraph chunking of one text: units, headings, greedy packing."""

    def __init__(self, size: int = 800, overlap: int = 200, least: int = 20) -> None:
        self.size, self.overlap, self.least = size, overlap, least

    def windows(self, text: str) -> list[str]:
        step = max(self.size - self.overlap, 1)
        return [w for i in range(0, len(text), step) if len(w := text[i : i + self.size]) >= self.least]

    def sentences(self, text: str) -> list[str]:
        ends = [m.end(1) for m in re.finditer(r"([.!?])\s(?=[^\W\d_])", text)]
        out: list[str] = []
        for begin, end in zip([0, *(e + 1 for e in ends)], [*ends, len(text)]):
            part = text[begin:end].strip()
            out += self.windows(part) if len(part) > self.size else [part] if len(part) >= self.least else []
        return out

    def units(self, text: str) -> list[tuple[bool, str]]:
        """(is heading, text) of every unit; short paragraphs are gathered."""
        out: list[tuple[bool, str]] = []
        short: list[str] = []

        def flush() -> None:
            gathered = "\n".join(short)
            short.clear()
            if len(gathered) >= self.least:
                out.append((False, gathered))
            elif gathered and out:
                out[-1] = (out[-1][0], f"{out[-1][1]}\n{gathered}")

        for part in filter(None, (p.strip() for p in text.split("\n\n"))):
            heading = "\n" not in part and len(part) <= 80 and part[-1] not in ".!?"
            if not heading and len(part) < self.least:
                short.append(part)
                continue
            flush()
            if heading:
                out.append((True, part))
            else:
                out += [(False, p) for p in ([part] if len(part) <= self.size else self.sentences(part))]
        flush()
        return out

    def chunks(self, text: str, sections: list[tuple[str, str, bool]] = ()) -> list[tuple[str, str | None, str, bool]]:
        """(text, section name, section type, skip) of each packed chunk. ``sections``
        are (pattern, type, skip); a chunk never spans two zones."""
        packed: list[tuple[str, str | None, str, bool]] = []
        name, kind, skip = None, "main", False
        parts: list[str] = []
        meta = (name, kind, skip)
        alike = lambda a, b: a in NARRATIVE and b in NARRATIVE
        for heading, unit in self.units(text):
            if heading:
                found = next(((t, s) for p, t, s in sections if p.lower() in unit.lower()), ("main", False))
                name, (kind, skip) = unit, found
                continue
            length = sum(map(len, parts)) + len(parts)
            if parts and (not alike(meta[1], kind) or length + len(unit) > self.size):
                packed.append(("\n".join(parts), *meta))
                tail = packed[-1][0][-self.overlap :] if self.overlap and alike(packed[-1][2], kind) else ""
                parts = [tail] if tail else []
                meta = (name, kind, skip)
            elif not parts:
                meta = (name, kind, skip)
            parts.append(unit)
        if parts:
            packed.append(("\n".join(parts), *meta))
        return packed


def paragraph_chunks(docs: DataFrame, size: int = 800, overlap: int = 200, least: int = 20, sections: list[tuple[str, str, bool]] = (), full: bool = False) -> DataFrame:
    """``(doc_id, chunk_index, text, surrounding, section_name, section_type,
    skip_extraction)``: paragraphs packed up to ``size``; an Arrow step, since
    packing depends on what was packed before."""
    half = size // 4

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        packer = Paragraphs(size, overlap, least)
        names = ["doc_id", "chunk_index", "text", "surrounding", "section_name", "section_type", "skip_extraction"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed = packer.chunks(text or "", sections)
                index = 0
                for i, (chunk, name, kind, skip) in enumerate(packed):
                    if len(chunk) >= least:
                        before, after = packed[i - 1][0] if i else None, packed[i + 1][0] if i + 1 < len(packed) else None
                        near = [x for x in (before if full or before is None else before[-half:], chunk, after if full or after is None else after[:half]) if x is not None]
                        out.append((doc, index, chunk, " ".join(near), name, kind, skip))
                        index += 1
            columns = [*zip(*out)] or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, chunk_index int, text string, surrounding string, section_name string, section_type string, skip_extraction boolean")


def pack_units(units: list[str], size: int, overlap: int) -> list[str]:
    """Units packed up to ``size`` characters, each pack after the first begun with the
    last ``overlap`` characters of the one before."""
    packs: list[str] = []
    parts: list[str] = []
    for unit in units:
        if parts and sum(map(len, parts)) + len(parts) + len(unit) > size:
            packs.append("\n".join(parts))
            tail = packs[-1][max(0, len(packs[-1]) - overlap) :]
            parts = [tail] if tail and overlap else []
        parts.append(unit)
    return packs + (["\n".join(parts)] if parts else [])


def extraction_pieces(text: str, most: int = 3000) -> list[str]:
    """Paragraphs packed into pieces of at most ``most`` characters for an extractor;
    a longer paragraph is cut hard."""
    if len(text) <= most:
        return [text]
    packs: list[str] = []
    for part in filter(str.strip, re.split(r"\n\s*\n", text)):
        if packs and len(packs[-1]) + len(part) + 2 <= most:
            packs[-1] += f"\n\n{part}"
        else:
            packs.append(part)
    return [p[i : i + most] for p in packs for i in range(0, len(p), most)] or [text]


def extraction_chunks(docs: DataFrame, most: int = 3000) -> DataFrame:
    """``(doc_id, pos, text)``: :func:`extraction_pieces` of every text."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(doc, i, piece) for doc, text in zip(pdf["doc_id"], pdf["text"]) if isinstance(text, str) for i, piece in enumerate(extraction_pieces(text, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id bigint, pos int, text string")


def document_prefix(chunks: DataFrame, prefixes: DataFrame, most: int = 10_000) -> DataFrame:
    """``chunks`` with the text of the first of ``prefixes`` (ord, key, prefix) whose key
    the document's name contains (apart from case) and a blank line before theirs. The
    list is counted, and more than ``most`` fail instead of being cut."""
    if (n := prefixes.count()) > most:
        raise ValueError(f"{n} prefixes, at most {most} are compared with every document")
    names = chunks.select("doc_name").distinct()
    hit = F.contains(F.lower("doc_name"), F.lower("key"))
    found = names.join(F.broadcast(prefixes), hit).groupBy("doc_name").agg(F.min_by("prefix", "ord").alias("__prefix"))
    rows = chunks.join(found, "doc_name", "left")
    text = F.when(F.coalesce("__prefix", F.lit("")) != "", F.concat("__prefix", F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(chunks.columns)


def for_extraction(chunks: DataFrame) -> DataFrame:
    """Without the chunks that are marked to be skipped; an unmarked one stays."""
    return chunks.where(~F.coalesce("skip_extraction", F.lit(False)))


def of_types(entities: DataFrame, types: list[str]) -> DataFrame:
    """Entities of the given types, apart from case; an empty list is all."""
    return entities.where(F.lower("entity_type").isin([t.lower() for t in types])) if types else entities
