"""Texts that read the same but differ in code points (problem 10).

Texts are mapped letter by letter in SQL (width forms, ligatures, kinds of
blank and hyphen, look-alike letters; invisible characters vanish). The mapped
values are then grouped under the accent-sensitive, case-sensitive ``UNICODE``
collation, for which composed and decomposed accents are equal. The member with
the smallest key names the class and its mapped text is the canonical form.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.common import cut

# Letters of other scripts and the Latin letters they look like, for code
# without a JVM; with one, the public table of confusable characters is asked as well.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ё": "ë", "ї": "ï", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ї": "Ï", "Ӏ": "I",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ɡ": "g", "ɑ": "a", "օ": "o", "ո": "n", "ս": "u", "Օ": "O",
}

# Characters without a shape of their own.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b"
    "\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe00\ufe01\ufe02\ufe0e\ufe0f\ufeff"
)

# Kinds of blank and of hyphen.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d"

# Ligatures.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj", "ǆ": "dž"}


#: Blocks of scripts whose letters are looked up among the confusable characters:
#: Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu and their supplements.
SCRIPTS = [(0x370, 0x400), (0x400, 0x590), (0x13A0, 0x1400), (0x1C80, 0x1C90), (0x2C80, 0x2D00), (0x2DE0, 0x2E00), (0xA4D0, 0xA500), (0xA640, 0xA6A0), (0xAB70, 0xABC0)]

# Kinds of compatibility form that differ in nothing but their shape.
SHAPES = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

_letters: dict[str, str] = {}


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Letters of :data:`SCRIPTS` with the Latin letter they look like, out of the
    public table of confusable characters that comes with Spark's collations; of
    I and l the one of the letter's case. Accented letters follow their base."""
    if _letters:
        return _letters
    table = dict(LOOK_ALIKE)
    letters = [chr(c) for first, stop in SCRIPTS for c in range(first, stop) if unicodedata.category(chr(c))[0] == "L"]
    latin = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    try:
        skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(latin + letters)).split("\n")
    except Exception:  # no JVM to ask
        return table
    by_shape: dict[str, list[str]] = {}
    for letter, shape in zip(latin, skeletons):
        by_shape.setdefault(shape, []).append(letter)
    for letter, shape in zip(letters, skeletons[len(latin) :]):
        alike = by_shape.get(shape, [])
        table.setdefault(letter, next((x for x in alike if x.isupper() == letter.isupper()), alike[0])) if alike else None
    for letter in letters:
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and base in table:
            table.setdefault(letter, unicodedata.normalize("NFC", table[base] + "".join(marks)))
    _letters.update({c: x for c, x in table.items() if len(x) == 1})
    return _letters


def single_characters(letters: dict[str, str] = LOOK_ALIKE) -> dict[str, str]:
    """All replacements of one character by one, or by nothing (invisible ones):
    forms that differ in width, font or position, ``letters``, blanks, hyphens."""
    shapes = (chr(c) for c in range(0x80, 0x20000) if unicodedata.decomposition(chr(c)).startswith(SHAPES))
    table = {c: x for c in shapes if len(x := unicodedata.normalize("NFKC", c)) == 1 and x != c}
    return table | letters | dict.fromkeys(BLANKS, " ") | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(INVISIBLE, "")


def mapped(text: Column, letters: dict[str, str] = LOOK_ALIKE) -> Column:
    """``text`` with every replaced character mapped, all in the JVM.

    Composition is not touched; that is left to the collation.
    """
    table = single_characters(letters)
    kept = [c for c in table if table[c]]
    gone = [c for c in table if not table[c]]
    for ligature, plain in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(plain))
    return F.translate(text, "".join(kept + gone), "".join(table[c] for c in kept))


def code_table(letters: dict[str, str] = LOOK_ALIKE) -> dict[int, str]:
    """All replacements for code that is in Python anyway."""
    return {ord(k): v for k, v in (single_characters(letters) | LIGATURES).items()}


_TABLE = code_table()


def canonical(text: str, table: dict[int, str] = _TABLE) -> str:
    """The consistent form of one text by a table of :func:`code_table`."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(table))


def same_looking(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, class_id, text_id, canonical_text)`` of every text that is not blank.

    ``class_id`` is the smallest key among the texts that read the same,
    ``text_id`` the smallest key among the exact copies. Copies are collapsed
    before the grouping by collation, so a text that fills a third of the table
    is one row there. Null, empty and blank texts have no row; a repeated row
    (same key and text) counts once; a null key is dropped; other columns are
    not read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("key").isNotNull())
    rows = rows.withColumn("form", mapped(F.col("text"), confusable_letters(df.sparkSession))).where(F.col("form").rlike(r"[^\s]"))
    rows = rows.withColumn("copy", F.struct(F.xxhash64("text"), F.md5("text")))
    copies = rows.groupBy("copy").agg(F.min("key").alias("text_id"), F.min("form").alias("form"))
    alike = Window.partitionBy(F.collate("form", "UNICODE"))
    member = copies.select("copy", "text_id", F.min("text_id").over(alike).alias("class_id"), F.min_by("form", "text_id").over(alike).alias("canonical_text"))
    keys = rows.select("key", "copy").distinct()
    return keys.join(member, "copy").select(F.col("key").alias(key), "class_id", "text_id", "canonical_text")


def same_looking_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key_a, key_b)``: two keys of different texts that read the same, the smaller first.

    The pairs are formed between the different texts of a class and then spread
    to their copies; two exact copies of one text never meet.
    """
    member = cut(same_looking(df, key, text).select(F.col(key).alias("key"), "class_id", "text_id"))
    texts = member.select("class_id", "text_id").distinct()
    pairs = texts.alias("x").join(texts.alias("y"), F.expr("x.class_id = y.class_id AND x.text_id < y.text_id"))
    pairs = pairs.select(F.col("x.text_id").alias("t1"), F.col("y.text_id").alias("t2"))
    one = member.select(F.col("text_id").alias("t1"), F.col("key").alias("k1"))
    two = member.select(F.col("text_id").alias("t2"), F.col("key").alias("k2"))
    pairs = pairs.join(one, "t1").join(two, "t2")
    return pairs.select(F.least("k1", "k2").alias(f"{key}_a"), F.greatest("k1", "k2").alias(f"{key}_b")).distinct()
