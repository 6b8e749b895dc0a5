"""Cleaning of extracted names, all in the JVM, and functions for SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def clean_entity_name(name: Column) -> Column:
    """Straight quotes; ``_Word_`` to ``(Word)``; ``_s`` to ``'s``; an underscore
    after a letter and before a blank, the end or a capital to a full stop; other
    underscores out; one blank for several."""
    name = F.translate(name, "’‘“”", "''\"\"")
    name = F.regexp_replace(name, r"(?<=\s)_([^_]+)_(?=\s|$)", "($1)")
    name = F.regexp_replace(name, r"_s(?=$|[^\p{L}]|\p{Lu})", "'s")
    name = F.regexp_replace(name, r"(?<=\p{L})_(?=\s|$|\p{Lu})", ".")
    return F.trim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit("")), r"\s+", " "))


def clean_extracted_name(name: Column, blocked: Sequence[str] = (), roles: Sequence[str] = (), starters: Sequence[str] = (), junk: Sequence[str] = ()) -> Column:
    """The cleaned name without possessive and trailing junk words; null for a
    blocked name, more than 7 words, a short name that begins with a role, a
    first word that starts a sentence, or when nothing is left. The lists belong
    to a corpus, so they are parameters and empty by default."""
    low = F.lower(F.trim(name))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    bad = low.isin(*blocked) if blocked else F.lit(False)
    bad = bad | (F.size(words) > 7) | (F.try_element_at(words, F.lit(1)).isin(*starters) if starters else F.lit(False))
    for role in roles:
        bad = bad | ((F.size(words) <= 3) & low.startswith(role))
    clean = F.trim(F.regexp_replace(clean_entity_name(name), r"('s|(?<=s)')$", ""))
    if junk:
        clean = F.regexp_replace(clean, rf"(?i)(\s+({'|'.join(junk)}))+$", "")
    return F.when(~bad & (clean != ""), clean)


def register(spark: SparkSession) -> None:
    """Names the functions that SQL lacks: ``jaro_winkler(a, b)``, and the table
    function ``paragraph_chunks(text, size, overlap)``."""
    from pyspark.sql.functions import udtf

    from quillgraph.operators.resolution import jaro_winkler_column
    from quillgraph.operators.text import Paragraphs

    class Chunks:
        def eval(self, text: str, size: int, overlap: int):
            for i, chunk in enumerate(Paragraphs(size, overlap).chunks(text or "")):
                yield i, chunk[0]

    spark.udf.register("jaro_winkler", jaro_winkler_column)
    spark.udtf.register("paragraph_chunks", udtf(Chunks, returnType="chunk_index int, text string"))
