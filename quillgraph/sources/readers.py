"""Readers of document files: text, HTML, subtitles, OOXML, PDF (if a library is there)."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.text import strip_html, strip_vtt

# File endings that are read.
ENDINGS = ["txt", "md", "rst", "csv", "json", "yaml", "yml", "toml", "html", "htm", "vtt", "docx", "pdf", "doc"]


def list_files(spark: SparkSession, path: str, endings: list[str] = ENDINGS) -> DataFrame:
    """``(path, doc_name, mtime_secs, file_size, content)`` of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name != "README.md").select("path", name.alias("doc_name"), F.unix_timestamp("modificationTime").alias("mtime_secs"), F.col("length").alias("file_size"), "content")


def ooxml_text(content: bytes) -> str:
    """The text of word/document.xml: paragraphs as lines, breaks and tabs kept."""
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    out: list[str] = []
    for node in root.iter():
        tag = node.tag.rpartition("}")[2]
        if tag == "t":
            out.append(node.text or "")
        elif tag in ("br", "cr"):
            out.append("\n")
        elif tag == "tab":
            out.append("\t")
        elif tag == "p" and out:
            out.append("\n")
    return "".join(out).strip()


def repair_underscores(text: str) -> str:
    """Underscores that stand for lost glyphs: a possessive, a full stop, or nothing."""
    text = re.sub(r"_s(?![^\W\d_])|_s(?=[A-Z])", "'s", text)
    text = re.sub(r"(?<=[^\W\d_])_(?=\s|$|[A-Z])", ".", text)
    return text.replace("_", "")


def pdf_text(content: bytes) -> str | None:
    try:
        from pdfminer.high_level import extract_text
    except ImportError:
        return None
    return repair_underscores(extract_text(io.BytesIO(content)))


class UnreadableFormat(ValueError):
    """A format that no reader on the executors knows, such as the old binary .doc."""


def read_documents(files: DataFrame) -> DataFrame:
    """``(doc_name, text)``: :func:`read_with_errors` without the errors."""
    return read_with_errors(files).select("doc_name", "text")


def _binary_text(name: str, content: bytes) -> str:
    low = name.lower()
    if low.endswith(".doc"):
        raise UnreadableFormat("old binary .doc files have to be converted first")
    text = ooxml_text(content) if low.endswith("docx") else pdf_text(content)
    if text is None:
        raise UnreadableFormat("PDF files need the pdfminer library")
    return text


def read_with_errors(files: DataFrame) -> DataFrame:
    """``(doc_name, text, error)``: plain text in the JVM, only .docx, .pdf and .doc in
    Python. A file that cannot be read has a null text and says why."""
    ending = F.lower(F.element_at(F.split("doc_name", r"\."), -1))
    binary = ending.isin("docx", "pdf", "doc")
    raw = F.decode("content", "utf-8")
    text = F.when(ending.isin("html", "htm"), strip_html(raw)).when(ending == "vtt", strip_vtt(raw)).otherwise(raw)
    plain = files.where(~binary).select("doc_name", text.alias("text"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["doc_name"], pdf["content"]):
                try:
                    out.append((name, _binary_text(name, content), None))
                except Exception as error:
                    out.append((name, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["doc_name", "text", "error"])

    return plain.unionByName(files.where(binary).select("doc_name", "content").mapInPandas(run, "doc_name string, text string, error string"))


def load_corpus_schema(path: str, defaults: dict) -> dict:
    """A corpus schema out of JSON; an empty or missing list falls back to the default."""
    with open(path) as file:
        given = json.load(file)
    return {key: given.get(key) or value for key, value in defaults.items()} | {k: v for k, v in given.items() if k not in defaults}


def load_corpus(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """``(doc_id, topic, text)`` of the files ``<topic>/documents/<file>`` below
    ``path``; doc_id is ``topic|file``. ``longest`` cuts texts, if given."""
    files = list_files(spark, path).where(F.col("path").rlike("/documents/[^/]+$"))
    topic = F.element_at(F.split("path", "/"), -3)
    named = files.withColumn("doc_name", F.concat_ws("|", topic, "doc_name"))
    text = F.col("text") if longest is None else F.substring("text", 1, longest)
    return read_documents(named).select(F.col("doc_name").alias("doc_id"), F.substring_index("doc_name", "|", 1).alias("topic"), text.alias("text"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, topic, question, answer)`` of CSV files with a header, named by
    topic, the question in the first column and the answer in the second. A query's id
    is ``topic|q`` and the number of its row in the file, the header being row 1."""
    import csv

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path", F.decode("content", "utf-8").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for name, text in zip(pdf["path"], pdf["text"]):
                topic = name.rpartition("/")[2].removesuffix(".csv").replace("_", " ")
                for i, row in enumerate(csv.reader(io.StringIO(text, newline="")), 1):
                    if i > 1 and row and row[0].strip():
                        out.append((f"{topic}|q{i}", topic, row[0], row[1] if len(row) > 1 and row[1] else None))
            yield pd.DataFrame(out, columns=["query_id", "topic", "question", "answer"])

    return files.mapInPandas(run, "query_id string, topic string, question string, answer string")
