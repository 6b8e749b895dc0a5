"""Repair of text from scanned pages (problem 5).

Words are grouped by the skeleton of their glyphs: letters are taken apart into
strokes, so forms that a reader of scans confuses (``rn`` and ``m``, ``cl`` and
``d``, ``1`` and ``l``) have one skeleton. A form that is rare beside another of
its group, one confusion away, is a misreading of it; where several forms may be
meant, or the rare one is a word as well, the words to its left and right decide.
Running headers are found by masking digits and comparing the first lines of a
document's pages; words cut at the end of a line are joined with the next line of
the body, on the next page if need be. :func:`repaired_text` reflows the pages into
paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.common import cut

# Right glyphs and what they are misread as.
CONFUSIONS = [
    ("m", "rn"), ("m", "in"), ("in", "m"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("n", "ri"), ("ri", "n"), ("u", "ii"), ("ii", "u"),
    ("h", "li"), ("li", "h"), ("w", "vv"), ("e", "c"), ("c", "e"), ("a", "o"), ("o", "a"), ("t", "f"), ("f", "t"), ("i", "l"), ("l", "i"),
    ("t", "l"), ("l", "t"), ("n", "u"), ("u", "n"), ("ni", "m"), ("m", "ni"), ("m", "nn"), ("h", "b"), ("b", "h"), ("tt", "u"), ("fi", "h"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "6"), ("g", "9"), ("z", "2"), ("e", "3"), ("a", "4"), ("t", "7"), ("b", "8"), ("q", "9"), ("c", "("), ("f", "{"),
]

# The strokes of glyphs in a skeleton.
STROKES = {
    "i": "|", "l": "|", "r": "|", "t": "|", "f": "|", "1": "|", "7": "|", "n": "||", "u": "||", "h": "||", "b": "||", "6": "||", "8": "||",
    "m": "|||", "d": "c|", "e": "c", "3": "c", "a": "o", "0": "o", "4": "o", "5": "s", "9": "g", "q": "g", "w": "vv", "2": "z", "(": "c", "{": "|",
}

# Letters read for digits.
DIGITS = {"l": "1", "I": "1", "i": "1", "|": "1", "o": "0", "O": "0", "b": "6", "B": "8", "S": "5", "s": "5", "g": "9", "q": "9", "Z": "2", "z": "2"}

_TOKEN = re.compile(r"[({]?[^\W_]+(?:['’({-][^\W_]+)*")
_CUT = re.compile(r"[^\W_]-[ \t\r]*$")
_ANY_CUT = re.compile(r"-[ \t\r]*(?:\n|$)")
_BROKEN = re.compile(r"\S*[^\W_]-[ \t\r]*(?:\n\s*\S*|$)")
_NUMBER = r"(?:[0-9lIioOSsBbZzgq]{1,5}|[ivxlcdm]{1,8}|[IVXLCDM]{1,8})"
_PAGE = re.compile(rf"\s*(?:[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|\(\s*{_NUMBER}\s*\)|[Pp][.,]\s*{_NUMBER}|[Pp][ao0]g[ec]\s+{_NUMBER}|{_NUMBER})\s*")
_BESIDE = re.compile(rf"^\s*(?:{_NUMBER}[ \t]{{2,}}(?P<a>\S.*?)|(?P<b>\S.*?)[ \t]{{2,}}{_NUMBER})\s*$")

#: A misread form is at most one in so many of the right form, and one in fewer
#: if it never stands in clean text.
RARE, RARE_UNSEEN = 20, 2
#: A form that is a word as well is misread where its neighbours stand so often
#: beside the right form, and never elsewhere beside it.
CONTEXT = 3
#: Misread forms that may be broadcast after they were counted; of more, all words are joined.
BROADCAST_FORMS = 500_000
#: Sites of scanned documents.
SCANNED = r"^[^|]*-(archive|records|papers)[0-9]+\|"


def skeleton(word: str) -> str:
    """The strokes of a word."""
    return "".join(STROKES.get(c, c) for c in word)


def one_confusion(wrong: str, right: str) -> bool:
    """Whether ``wrong`` is ``right`` with one glyph misread."""
    start = 0
    while start < min(len(wrong), len(right)) and wrong[start] == right[start]:
        start += 1
    for good, bad in CONFUSIONS:
        for at in range(max(0, start - 2), start + 1):
            if right.startswith(good, at) and wrong.startswith(bad, at) and right[:at] == wrong[:at] and right[at + len(good) :] == wrong[at + len(bad) :]:
                return True
    return False


def as_number(token: str) -> str | None:
    """The number that a token of digits and letters read for digits stands for."""
    digits = sum(c.isdigit() for c in token)
    if not digits or digits == len(token) or digits < len(token) - digits:
        return None
    read = "".join(DIGITS.get(c, c) for c in token)
    return read if read.isascii() and read.isdigit() else None


def header_key(line: str) -> str:
    """A line as headers are compared: no page number beside it, digits masked, strokes only."""
    beside = _BESIDE.match(line)
    text = (beside["a"] or beside["b"]) if beside else line
    return re.sub(r"\d+", "0", skeleton(re.sub(r"[\W_]+", "", text.lower())))


def _first(lines: list[str]) -> int | None:
    return next((i for i, line in enumerate(lines) if line.strip()), None)


def _page_numbers(lines: list[str], filled: list[int]) -> set[int]:
    """The lines (from 0) with only a page number: among the first two filled ones and the last."""
    ends = {*filled[:2], *filled[-1:]} if len(filled) > 1 else set()
    return {i for i in ends if len(lines[i]) < 60 and _PAGE.fullmatch(lines[i])}


def _pieces(text: str) -> list[str]:
    """A text without the words that line ends cut, parted at blanks; no token has one."""
    return (_BROKEN.sub("\n", text) if _ANY_CUT.search(text) else text).split()


def _counts(batches: Iterator) -> Iterator:
    """Words of whole lines, counted per task: (word, in scans, n)."""
    from collections import Counter

    import pyarrow as pa

    counts: list[Counter] = [Counter(), Counter()]

    def flush():
        rows = [(w, bool(s), n) for s in (0, 1) for piece, n in counts[s].items() for w in _TOKEN.findall(piece)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["word", "scanned", "n"])

    for batch in batches:
        for text, scanned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                counts[bool(scanned)].update(_pieces(text))
        if sum(map(len, counts)) > 200_000:
            yield flush()
    yield flush()


def _contexts(batches: Iterator, watched: set[str] | None) -> Iterator:
    """How often watched words (all, if not given) have a neighbour: (word, side, neighbour, n)."""
    from collections import Counter

    import pyarrow as pa

    counts: Counter = Counter()
    tokens: dict[str, list[str]] = {}
    hot: dict[str, bool] = {}

    def flush():
        rows = [(w, side, x, n) for (w, side, x), n in counts.items()]
        counts.clear()
        columns = [*zip(*rows)] or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["word", "side", "neighbour", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            pieces = _pieces(text or "")
            for piece in pieces:
                if piece not in tokens:
                    if len(tokens) > 300_000:
                        tokens.clear()
                        hot.clear()
                    tokens[piece] = [t.lower() for t in _TOKEN.findall(piece)]
                    hot[piece] = watched is None or any(t in watched for t in tokens[piece])
            places = [i for i, piece in enumerate(pieces) if hot.get(piece, True)]
            for i in places:
                near = [t for piece in pieces[max(0, i - 1) : i + 2] for t in tokens.get(piece) or [t.lower() for t in _TOKEN.findall(piece)]]
                own = tokens.get(pieces[i], ())
                first = near.index(own[0]) if own and i == 0 else len(tokens.get(pieces[i - 1], ())) if i else 0
                for k in range(first, first + len(own)):
                    if watched is None or near[k] in watched:
                        if k:
                            counts[near[k], 0, near[k - 1]] += 1
                        if k + 1 < len(near):
                            counts[near[k], 1, near[k + 1]] += 1
        if len(counts) > 200_000:
            yield flush()
    yield flush()


def _names(title: str) -> list[str]:
    """The capitalised words of a line that has several and begins with one, as skeletons."""
    names = {skeleton(w.lower()) for w in _TOKEN.findall(title) if w[0].isupper() and len(w) > 3}
    return sorted(names) if len(names) > 1 and title[0].isupper() else []


def _heads(batches: Iterator) -> Iterator:
    """Per page that may have a header: the key of its first line, whether it is
    sure to be one, and its names, the capitalised words."""
    import pyarrow as pa

    names = ["chunk", "doc", "head", "sure", "names"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())]
    for batch in batches:
        out = []
        for chunk, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            lines = text.split("\n")
            at = _first(lines)
            line = lines[at] if at is not None else ""
            beside = _BESIDE.match(line)
            title = (beside["a"] or beside["b"]) if beside else line.strip()
            letters = [c for c in title if c.isalpha()]
            bare = bool(letters) and not re.search(r"[.,;:?!()\[\]]", title) and not title.endswith("-")
            sure = bare and (bool(beside) and title[0].isupper() or sum(c.isupper() for c in letters) > 0.8 * len(letters) and len(letters) > 5)
            if bare:
                out.append((chunk, doc, header_key(line), sure, _names(title)))
        columns = [*zip(*out)] or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


_PLACES = "chunk bigint, doc string, page bigint, line_no int, kind string, top boolean, word string, rest string, before string, after string"
_LONE = re.compile("[" + "".join(c for c in DIGITS if c.isalpha()) + "]{1,3}")


def _places(batches: Iterator, wrong: set[str] | None) -> Iterator:
    """Page numbers, cut words, doubtful words of the body and the page's first word.

    Kinds: ``page_number``; ``cut`` (word: up to the hyphen, rest: what follows on
    the page, null at its end); ``word`` (with the words before and after it on
    the line; only forms in ``wrong``, if given, and what may be a number);
    ``first`` (the first word of the body); ``line`` (a first line). What stands
    on the first filled line, which may prove a header, is marked ``top``.
    """
    import pyarrow as pa

    names = [part.split()[0] for part in _PLACES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), *[pa.string()] * 4]
    for batch in batches:
        out = []
        for chunk, doc, page, text in zip(*(c.to_pylist() for c in batch.columns)):
            lines = text.split("\n")
            filled = [i for i, line in enumerate(lines) if line.strip()]
            numbers = _page_numbers(lines, filled)
            out += [(chunk, doc, page, i + 1, "page_number", False, None, None, None, None) for i in numbers]
            body = [i for i in filled if i not in numbers]
            if body and body[0] == filled[0]:
                out.append((chunk, doc, page, body[0] + 1, "line", True, None, None, None, None))
            starts_cut = False
            for k, i in enumerate(body):
                top = i == filled[0]
                tokens = _TOKEN.findall(lines[i])
                if k < 2 and tokens:
                    out.append((chunk, doc, page, i + 1, "first", top, tokens[0], None, None, None))
                skip_first, starts_cut = starts_cut, bool(_CUT.search(lines[i])) and bool(tokens)
                if starts_cut:
                    following = _TOKEN.findall(lines[body[k + 1]]) if k + 1 < len(body) else []
                    out.append((chunk, doc, page, i + 1, "cut", top, tokens[-1], following[0] if following else None, None, None))
                inner = tokens[skip_first : len(tokens) - starts_cut]
                for j, token in enumerate(inner):
                    if (token.islower() if wrong is None else token in wrong) or token.isdigit() or _LONE.fullmatch(token) or re.search(r"\d", token):
                        out.append((chunk, doc, page, i + 1, "word", top, token, "" if j else tokens[0], inner[j - 1] if j else None, inner[j + 1] if j + 1 < len(inner) else None))
        columns = [*zip(*out)] or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _with_skeleton(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([skeleton(w) for w in batch.column(0).to_pylist()], pa.string())], names=["word", "clean", "n", "bones"])


def _confused(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        kept = [i for i, (w, r) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if one_confusion(w, r)]
        yield batch.take(pa.array(kept, pa.int64()))


def candidate_forms(words: DataFrame, doubtful: DataFrame | None = None) -> DataFrame:
    """``(word, right, support, sure)``: the forms that each doubtful word (all ``words``
    if not given; word, clean, n: how often in clean text and at all) may be a
    misreading of: of the same skeleton, one confusion away and more frequent.
    ``sure``: so much more frequent that no context is needed."""
    boned = lambda df: df.mapInArrow(_with_skeleton, "word string, clean bigint, n bigint, bones string")
    good = boned(words.where((F.col("n") >= 2) & ~F.col("word").rlike("[0-9({]"))).select(F.col("word").alias("right"), F.col("n").alias("support"), "bones")
    pairs = boned(words if doubtful is None else doubtful).join(good, "bones").where(F.col("word") != F.col("right"))
    odd = F.col("word").rlike("[0-9({]")
    least = F.when(odd, 1).otherwise(RARE_UNSEEN * F.greatest("n", F.lit(1)))
    sure = odd | (F.col("clean") == 0) | (F.col("support") >= RARE * F.col("n"))
    pairs = pairs.where(F.col("support") >= least).select("word", "right", "support", sure.alias("sure")).mapInArrow(_confused, _CANDIDATES)
    return pairs


_CANDIDATES = "word string, right string, support bigint, sure boolean"


def right_forms(candidates: DataFrame) -> DataFrame:
    """``(word, right)``: the most frequent sure candidate of each word."""
    return candidates.where("sure").groupBy("word").agg(F.max_by("right", F.struct("support", "right")).alias("right"))


def _in_context(words: DataFrame, candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """``(chunk, line_no, word, right)`` of the occurrences (chunk, line_no, word,
    before, after) that their neighbours decide: words with several sure candidates,
    and words of clean text with one that is not sure.

    The right form is the one that stands most often beside the neighbours; a word
    of clean text is only given up where it never stands beside them elsewhere."""
    several = candidates.groupBy("word").agg(F.count_if("sure").alias("n_sure"), F.count("*").alias("n_all")).where("n_sure <> 1 OR n_all > 1")
    unclear = cut(candidates.join(several, "word"))
    if unclear.isEmpty():
        return words.select("chunk", "line_no", "word", F.lit("").alias("right")).limit(0)
    watched = unclear.select("word").unionByName(unclear.select(F.col("right").alias("word"))).distinct()
    known = None
    if watched.count() <= BROADCAST_FORMS:
        known = texts.sparkSession.sparkContext.broadcast({r.word for r in watched.toLocalIterator()})
    beside = texts.select("text").mapInArrow(lambda b: _contexts(b, known and known.value), "word string, side int, neighbour string, n bigint")
    beside = cut(beside.groupBy("word", "side", "neighbour").agg(F.sum("n").alias("n")))
    places = words.join(unclear.select("word", "right", "support", "sure", "n_sure"), "word").select("chunk", "line_no", "word", F.lower("before").alias("before"), F.lower("after").alias("after"), "right", "support", "sure", "n_sure")
    for form in ("word", "right"):
        for side, near in enumerate(("before", "after")):
            counts = beside.where(F.col("side") == side).select(F.col("word").alias(form), F.col("neighbour").alias(near), F.col("n").alias(f"{form}_{near}"))
            places = places.join(counts, [form, near], "left")
    beside_right = F.coalesce("right_before", F.lit(0)) + F.coalesce("right_after", F.lit(0))
    # the occurrence itself stands beside its neighbours once
    beside_word = F.greatest(F.coalesce("word_before", F.lit(0)) - 1, F.lit(0)) + F.greatest(F.coalesce("word_after", F.lit(0)) - 1, F.lit(0))
    both = F.coalesce("right_before", F.lit(0)) * F.coalesce("right_after", F.lit(0)) > 0
    fits = F.when(F.col("n_sure") == 0, both & (beside_right >= CONTEXT) & (beside_word == 0)).otherwise(F.col("sure"))
    best = places.where(fits).groupBy("chunk", "line_no", "word", "before", "after").agg(F.max_by("right", F.struct(beside_right, "support", "right")).alias("right"))
    return best.select("chunk", "line_no", "word", "right").distinct()


def _number(token: Column) -> Column:
    """:func:`as_number` in SQL."""
    read = F.translate(token, "".join(DIGITS), "".join(DIGITS.values()))
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    fits = (digits > 0) & (2 * digits >= F.length(token)) & (digits < F.length(token)) & read.rlike("^[0-9]+$")
    return F.when(fits, read)


def scan_faults(df: DataFrame, chunk: str = "chunk_id", doc: str = "doc_name", page: str = "chunk_index", text: str = "text", scanned: str = SCANNED) -> DataFrame:
    """``(chunk, line_no, kind, fixed)`` of every fault on a scanned page.

    Kinds and fixed: ``header`` and ``page_number`` (empty), ``hyphen`` (the
    whole word cut at the end of the line), ``misread`` (the right lower-case
    word or number). Counts of words are taken over all texts, scanned or not.
    Nothing is gathered by document: headers are counted per document and line,
    the next page is found by an equality join. A row delivered again counts
    once; null texts and document names have no faults; a cut word whose next
    page is missing is not reported; an empty table gives an empty table; other
    columns are not read.
    """
    rows = _rows(df, chunk, doc, page, text)
    return _faults(rows, scanned).select(F.col("chunk").alias(chunk), "line_no", "kind", "fixed").distinct()


def _rows(df: DataFrame, chunk: str, doc: str, page: str, text: str) -> DataFrame:
    rows = df.select(F.col(chunk).cast("long").alias("chunk"), F.col(doc).alias("doc"), F.col(page).cast("long").alias("page"), F.col(text).cast("string").alias("text"))
    return rows.where(F.col("chunk").isNotNull() & F.col("doc").isNotNull() & F.col("text").isNotNull())


def _faults(rows: DataFrame, scanned: str) -> DataFrame:
    """``(chunk, line_no, kind, word, fixed)``; word is what a misread word looks like,
    or the first part of a cut one."""
    is_scan = F.col("doc").rlike(scanned)
    pages = rows.where(is_scan)

    counted = rows.select("text", is_scan.alias("scanned")).mapInArrow(_counts, "word string, scanned boolean, n bigint")
    counted = counted.groupBy(F.lower("word").alias("word")).agg(F.sum(F.when(F.col("scanned"), 0).otherwise(F.col("n"))).alias("clean"), F.sum("n").alias("n"))
    counted = cut(counted)
    candidates = cut(candidate_forms(counted))
    repairs = cut(right_forms(candidates))
    doubtful = candidates.select("word").distinct()
    wrong = None
    if doubtful.count() <= BROADCAST_FORMS:
        wrong = rows.sparkSession.sparkContext.broadcast({r.word for r in doubtful.toLocalIterator()})
    places = pages.select("chunk", "doc", "page", "text").mapInArrow(lambda b: _places(b, wrong and wrong.value), _PLACES)

    heads = cut(pages.select("chunk", "doc", "text").mapInArrow(_heads, "chunk bigint, doc string, head string, sure boolean, names array<string>"))
    often = heads.groupBy("doc", "head").agg(F.countDistinct("chunk").alias("pages"), F.max("sure").alias("seen_sure")).where("pages > 1 OR seen_sure")
    repeated = heads.join(often.select("doc", "head"), ["doc", "head"], "left_semi")
    # headers that stand on one page each share a name with others of their document
    listed = heads.select("chunk", "doc", F.explode("names").alias("name"))
    names = listed.groupBy("doc", "name").agg(F.countDistinct("chunk").alias("pages")).where("pages > 1")
    named = listed.join(names, ["doc", "name"], "left_semi").select("chunk")
    headed = heads.where("sure").select("chunk").unionByName(named).unionByName(repeated.select("chunk")).distinct().withColumn("headed", F.lit(True))
    places = cut(places.join(headed, "chunk", "left").withColumn("headed", F.coalesce("headed", F.lit(False))))
    none = F.lit(None).cast("string")
    marks = places.where("kind = 'page_number' OR kind = 'line' AND headed").select("chunk", "line_no", F.when(F.col("kind") == "line", "header").otherwise("page_number").alias("kind"), none.alias("word"), F.lit("").alias("fixed"))
    places = places.where("NOT (top AND headed)")

    first = F.min_by("word", F.when(F.col("kind") == "first", F.col("line_no")))
    ends_cut = F.max((F.col("kind") == "cut") & F.col("rest").isNull())
    per_page = cut(places.where("kind IN ('first', 'cut')").groupBy("doc", "page", "chunk").agg(first.alias("first"), ends_cut.alias("ends_cut")))
    following = per_page.groupBy("doc", (F.col("page") - 1).alias("page")).agg(F.min_by("first", "chunk").alias("next"))
    before = per_page.where("ends_cut").select("doc", (F.col("page") + 1).alias("page"), F.lit(True).alias("continued")).distinct()
    linked = per_page.join(following, ["doc", "page"], "left").join(before, ["doc", "page"], "left")
    linked = cut(linked.select("chunk", "first", "next", F.coalesce("continued", F.lit(False)).alias("continued")))
    cuts = places.where("kind = 'cut'").join(linked.select("chunk", "next"), "chunk", "left").select("chunk", "line_no", "word", F.coalesce("rest", "next").alias("rest")).where("rest IS NOT NULL").distinct()
    cuts = cut(cuts.select("chunk", "line_no", F.col("word").alias("part"), F.concat("word", "rest").alias("closed"), F.concat_ws("-", "word", "rest").alias("hyphened")))

    joined = cuts.select(F.explode(F.array("closed", "hyphened")).alias("word")).select(F.lower("word").alias("word")).distinct()
    unseen = joined.join(counted, "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("clean"), F.lit(0).cast("bigint").alias("n"))
    seen = counted.unionByName(unseen)
    rights = cut(repairs.unionByName(right_forms(candidate_forms(seen, unseen))))
    known = lambda name: joined.join(counted, "word", "left").join(rights, "word", "left").select(F.col("word").alias(f"{name}_key"), F.coalesce("n", F.lit(0)).alias(f"{name}_n"), F.col("right").alias(f"{name}_right"))
    whole = cuts.withColumns({f"{c}_key": F.lower(c) for c in ("closed", "hyphened")}).join(known("closed"), "closed_key").join(known("hyphened"), "hyphened_key")
    case = lambda form, like: F.when(F.lower(like) == form, F.col(like)).when(F.lower(F.substring(like, 1, 1)) != F.substring(like, 1, 1), F.concat(F.upper(F.substring(form, 1, 1)), F.substring(form, 2, 10_000))).otherwise(form)
    fixed = (
        F.when(F.col("hyphened_n") > F.col("closed_n"), case(F.coalesce("hyphened_right", "hyphened_key"), "hyphened"))
        .when((F.col("closed_n") > 0) | F.col("closed_right").isNotNull(), case(F.coalesce("closed_right", "closed_key"), "closed"))
        .when(F.col("hyphened_right").isNotNull(), case(F.col("hyphened_right"), "hyphened"))
        .otherwise(F.col("closed"))
    )
    hyphens = whole.select("chunk", "line_no", F.lit("hyphen").alias("kind"), F.col("part").alias("word"), fixed.alias("fixed"))

    # the first word of a page may be the rest of a word cut on the page before
    words = places.where("kind = 'word'").join(linked.where("continued").select("chunk", F.col("first").alias("rest"), F.lit(True).alias("continued")), ["chunk", "rest"], "left")
    first_line = places.where("kind = 'first'").groupBy("chunk").agg(F.min("line_no").alias("first_line"))
    words = words.join(first_line, "chunk", "left").where("NOT (coalesce(continued, false) AND line_no = first_line AND before IS NULL AND word = rest)")
    number = _number(F.col("word"))
    # letters alone stand for a number where numbers stand between the same words
    lone = F.col("word").rlike(f"^{_LONE.pattern}$")
    slots = words.where("before IS NOT NULL AND after IS NOT NULL").groupBy("before", "after").agg(F.count_if(F.col("word").rlike("^[0-9]+$")).alias("numbers"), F.count_if(lone).alias("letters"))
    slots = slots.where("numbers >= 3 AND numbers > 2 * letters").select("before", "after")
    read = F.translate("word", "".join(DIGITS), "".join(DIGITS.values()))
    letters = words.where(lone).join(slots, ["before", "after"], "left_semi").select("chunk", "line_no", "word", read.alias("fixed"))
    numbers = words.where(number.isNotNull()).select("chunk", "line_no", "word", number.alias("fixed"))
    lower = words.where(number.isNull() & (F.lower("word") == F.col("word")) & (F.length("word") > 1) & F.col("word").rlike(r"\p{L}")).select("chunk", "line_no", "word", "before", "after")
    decided = cut(_in_context(lower, candidates, rows))
    spelt = lower.join(repairs, "word").join(decided, ["chunk", "line_no", "word"], "left_anti").select("chunk", "line_no", "word", F.col("right").alias("fixed"))
    misread = letters.unionByName(numbers).unionByName(spelt).unionByName(decided.withColumnRenamed("right", "fixed")).select("chunk", "line_no", F.lit("misread").alias("kind"), "word", "fixed")
    return marks.unionByName(hyphens).unionByName(misread).distinct()


#: Marks that end a sentence, and those that stand close after a word.
_ENDS, _CLOSE = r"[.!?:;…][\"'”’)\]]*$", r"^[.,;:!?…)\]”’\"']"


def _repaired(batches: Iterator) -> Iterator:
    """The paragraphs of each page, its faults (line_no, kind, word, fixed) mended."""
    import pyarrow as pa

    names = ["chunk", "doc", "page", "pieces", "cut", "open"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
    for batch in batches:
        out = []
        for chunk, doc, page, text, faults in zip(*(c.to_pylist() for c in batch.columns)):
            by_line: dict[int, list] = {}
            for f in faults or ():
                by_line.setdefault(f["line_no"], []).append(f)
            pieces: list[str] = []
            apart, carried = True, False
            for i, line in enumerate(text.split("\n"), 1):
                mine = by_line.get(i, [])
                if any(f["kind"] in ("header", "page_number") for f in mine):
                    continue
                if not line.strip():
                    apart = apart or not carried
                    continue
                if carried:  # what was cut is whole on the line before
                    line = re.sub(rf"^\s*{_TOKEN.pattern}", "", line, count=1)
                whole = next((f for f in mine if f["kind"] == "hyphen"), None)
                if whole:
                    line = re.sub(rf"{re.escape(whole['word'])}-[ \t\r]*$", lambda _, w=whole: w["fixed"], line)
                swaps = {f["word"]: f["fixed"] for f in mine if f["kind"] == "misread"}
                if swaps:
                    line = _TOKEN.sub(lambda m, s=swaps: s.get(m[0], m[0]), line)
                line = " ".join(line.split())
                if apart or not pieces:
                    pieces.append(line)
                elif line:
                    pieces[-1] += line if re.match(_CLOSE, line) else f" {line}"
                apart, carried = False, whole is not None
            ends = not pieces or carried or not re.search(_ENDS, pieces[-1])
            out.append((chunk, doc, page, pieces, carried, ends))
        columns = [*zip(*out)] or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def repaired_text(df: DataFrame, chunk: str = "chunk_id", doc: str = "doc_name", page: str = "chunk_index", text: str = "text", scanned: str = SCANNED) -> DataFrame:
    """``(chunk, paragraph_no, doc, text)``: the scanned pages as continuous paragraphs.

    Headers and page numbers are gone, cut words whole, misread ones right. A
    paragraph ends at a blank line of the body, or at the end of a page that ends a
    sentence; one that goes on over pages belongs to the page on which it begins.
    Pages are repaired one by one and joined with the next by equality; the chains
    of pages that one paragraph runs through are resolved as hierarchies, so no
    document is gathered. Of a page delivered under several keys every copy has its
    paragraphs. Null texts and names have none; an empty table gives an empty table.
    """
    from quillgraph.operators.hierarchy import full_hierarchies

    rows = _rows(df, chunk, doc, page, text)
    faults = _faults(rows, scanned)
    listed = faults.groupBy("chunk").agg(F.collect_list(F.struct("line_no", "kind", "word", "fixed")).alias("faults"))
    pages = rows.where(F.col("doc").rlike(scanned)).groupBy("chunk").agg(F.min(F.struct("doc", "page", "text")).alias("p")).select("chunk", "p.*").join(listed, "chunk", "left")
    fixed = cut(pages.select("chunk", "doc", "page", "text", "faults").mapInArrow(_repaired, "chunk bigint, doc string, page bigint, pieces array<string>, cut boolean, open boolean").where("size(pieces) > 0"))
    last = fixed.groupBy("doc", (F.col("page") + 1).alias("page")).agg(F.min_by(F.struct("chunk", "cut", "open", F.size("pieces").alias("n")), "chunk").alias("before"))
    with_last = cut(fixed.join(last, ["doc", "page"], "left").withColumn("joins", F.coalesce("before.open", F.lit(False))))
    # what a cut word left at the top of the page is whole on the page before
    token = r"^[({]?[\p{L}\p{N}]+(?:['’({-][\p{L}\p{N}]+)*"
    top = F.when(F.coalesce("before.cut", F.lit(False)), F.ltrim(F.regexp_replace(F.element_at("pieces", 1), token, ""))).otherwise(F.element_at("pieces", 1))
    chains = with_last.where("joins AND before.n = 1").select(F.lit("p").alias("hierarchy"), F.col("chunk").alias("child"), F.col("before.chunk").alias("parent"))
    roots = full_hierarchies(chains).select(F.col("node_id").alias("chunk"), "root_id", "depth")
    flat = with_last.select("chunk", "doc", "joins", "before", F.posexplode(F.concat(F.array(top), F.slice("pieces", 2, 1_000_000))).alias("no", "text"))
    owned = flat.join(roots, "chunk", "left")
    # a page that is one paragraph hands it on to the page before, down to the root of the chain
    first = (F.col("no") == 0) & F.col("joins")
    chained = F.col("before.n") == 1
    owner = F.when(first & chained, F.col("root_id")).when(first, F.col("before.chunk")).otherwise(F.col("chunk"))
    owned = owned.select("doc", owner.alias("owner"), F.when(first & ~chained, F.col("before.n") - 1).when(first, F.lit(0)).otherwise(F.col("no")).alias("no"), F.when(first, F.coalesce("depth", F.lit(0)) + 1).otherwise(0).alias("at"), "text")
    owned = cut(owned)
    # the root of a chain may itself go on from a page with several paragraphs
    moved = flat.where("no = 0 AND joins AND before.n > 1").select(F.col("chunk").alias("owner"), F.lit(0).alias("no"), F.col("before.chunk").alias("to"), (F.col("before.n") - 1).alias("to_no"))
    owned = owned.join(moved, ["owner", "no"], "left").withColumns({"owner": F.coalesce("to", "owner"), "no": F.coalesce("to_no", "no")})
    parts = owned.groupBy("owner", "no").agg(F.min("doc").alias("doc"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    glued = F.aggregate("parts", F.lit(""), lambda a, x: F.when((a == "") | (x["text"] == "") | x["text"].rlike(_CLOSE), F.concat(a, x["text"])).otherwise(F.concat(a, F.lit(" "), x["text"])))
    return parts.select(F.col("owner").alias(chunk), (F.col("no") + 1).cast("int").alias("paragraph_no"), F.col("doc").alias(doc), glued.alias("text"))
