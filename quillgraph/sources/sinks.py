"""Sinks: the state of memory, reports as JSON, schemas as files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_memory_state(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, path: str) -> None:
    """The three tables below ``path``, each replacing what was there."""
    for name, rows in (("memory_nodes", nodes), ("memory_edges", edges), ("memory_chunks", chunks)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_memory_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("memory_nodes", "memory_edges", "memory_chunks"))


def json_rows(rows: DataFrame, key: str) -> DataFrame:
    """``(key, json)``: every row as one JSON object, without its null fields."""
    return rows.select(key, F.to_json(F.struct(*sorted(rows.columns))).alias("json"))


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line in a folder of part files, replacing what was there."""
    rows.write.mode("overwrite").json(path)


def save_corpus_schema(schema: dict, path: str) -> None:
    """A corpus schema as JSON, for :func:`quillgraph.sources.readers.load_corpus_schema`."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(schema, file, indent=2, ensure_ascii=False)


# What a section definition has if it says nothing.
SECTION = {"skip": False, "narrator_note": None, "index_seeds": False, "section_type": "main"}


def load_section_schema(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(document's part, sections): the sections are ``(ord, pattern, skip, narrator_note,
    index_seeds, section_type)``. Files ending in .json are JSON, others YAML, which
    needs a YAML library; a definition without a pattern is an error."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML schemas need a YAML library; JSON ones do not") from error
        given = yaml.safe_load(text) or {}
    rows = [(i, part["pattern"], *(part.get(k, v) for k, v in SECTION.items())) for i, part in enumerate(given.get("sections") or [])]
    head = {k: given.get(k) for k in ("document_title", "default_narrator", "schema_type")} | {"metadata": given.get("metadata") or {}}
    return head, spark.createDataFrame(rows, "ord int, pattern string, skip boolean, narrator_note string, index_seeds boolean, section_type string")
