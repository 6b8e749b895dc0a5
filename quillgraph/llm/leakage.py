"""Evaluation items that leaked into documents (problem 9).

Every passage of every document is a query against a BM25 inverted index of the
test items. A match of ``run`` consecutive words contributes at least the smallest
score that any such stretch of the item has, so impacts are divided by that score,
text by text, and 1 is a threshold below which nothing can be lost.

The index is searched as in block-max WAND, many passages at once. The words of a
passage are ordered by their largest impact; those whose sum stays below the
threshold cannot bring a text in on their own, and the word that crosses it is the
pivot: only the lists from the pivot on are opened. Posting lists carry the largest
impact of every block of texts; a block whose sum of maxima, with the bound of the
unopened lists, stays below the threshold is skipped, and only postings in the
other blocks are scored. What remains is verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.lookalike import canonical, code_table, confusable_letters

#: Words of the texts of one index at most (some 100,000 texts; about 30 bytes a
#: word); more are searched one index after the other.
INDEX_WORDS = 4_000_000
#: Texts of a block of the posting lists.
BLOCK = 16
#: What the sum of impacts of a true match may lack by rounding.
_SLACK = 1e-4
#: Lists are opened until the bounds of the others sum up to less than this part of
#: the threshold: an opened list is cheaper than looking up many texts in it.
UNOPENED = 0.3
#: Sums of one step of the search, few enough for the processor's cache.
_CELLS = 1 << 18
#: Pieces of text whose words are remembered; when full the memory starts anew.
_REMEMBERED = 300_000

_WORDS = re.compile(r"[^\W_]+")


class Words:
    """The words (runs of letters and digits) of texts in their consistent form, lower case.

    The consistent form never joins what a blank parts, so it is made, and
    remembered, for each piece between blanks.
    """

    def __init__(self, table: dict[int, str] | None = None) -> None:
        self.table = table or code_table()
        self.known: dict[str, list[str]] = {}

    def __getstate__(self) -> dict:
        return {"table": self.table, "known": {}}

    def __call__(self, text: str | None) -> list[str]:
        out: list[str] = []
        for piece in (text or "").split():
            words = self.known.get(piece)
            if words is None:
                words = _WORDS.findall(canonical(piece, self.table).lower())
                if len(piece) <= 100:
                    if len(self.known) >= _REMEMBERED:
                        self.known.clear()
                    self.known[piece] = words
            out += words
        return out


words_of = Words()


def _ranges(starts, ends):
    """All numbers of several ranges, and for each the range it is of."""
    import numpy as np

    sizes = ends - starts
    of = np.repeat(np.arange(len(starts)), sizes)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if len(starts) else starts
    return np.arange(len(of)) + shift, of


class LeakIndex:
    """Posting lists with block maxima of test texts, their impacts divided by
    each text's own threshold. Entries are (item, field, text)."""

    def __init__(self, entries: list[tuple[int, int, str]], run: int = 13, k1: float = 1.5, b: float = 0.75, block: int = BLOCK, words_of: Words = words_of) -> None:
        import numpy as np

        self.words_of = words_of
        texts = [(item, field, w) for item, field, text in entries if len(w := words_of(text)) >= run]
        self.run, self.block, n = run, block, len(texts)
        self.items = np.array([t[0] for t in texts], dtype=np.int64)
        self.fields = np.array([t[1] for t in texts], dtype=np.int64)
        self.terms: dict[str, int] = {}
        for _, _, w in texts:
            for word in w:
                self.terms.setdefault(word, len(self.terms))
        m = len(self.terms)
        sizes = np.array([len(w) for *_, w in texts], dtype=np.int64)
        self.flat = flat = np.fromiter((self.terms[x] for *_, w in texts for x in w), dtype=np.int64, count=int(sizes.sum()))
        text = np.repeat(np.arange(n), sizes)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        # (term, text) pairs in the order of the posting lists
        pairs, place, tf = np.unique(flat * max(1, n) + text, return_inverse=True, return_counts=True)
        self.pairs, self.term, self.text = pairs, pairs // max(1, n), pairs % max(1, n)
        df = np.bincount(self.term, minlength=m)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        mean = sizes.mean() if n else 1.0
        score = idf[self.term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[self.text] / mean))
        # the least sum over the different words of any stretch of a text
        at = np.arange(len(flat))
        order = np.argsort(place, kind="stable")
        before = np.full(len(flat), -1)
        same = place[order][1:] == place[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        begin = at[(at + run <= self.starts[text + 1])] if n else at
        sums = np.zeros(len(begin))
        for j in range(run):
            sums += score[place[begin + j]] * (before[begin + j] < begin)
        least = np.full(n, np.inf)
        np.minimum.at(least, text[begin], sums)
        self.impact = (score / least[self.text]).astype(np.float32)
        self.bound = np.zeros(m + 1)
        np.maximum.at(self.bound, self.term, self.impact)
        self.first = np.searchsorted(self.term, np.arange(m + 2))  # an unknown word has no postings
        # blocks of the posting lists
        self.blocks = -(-n // block)
        keys, opens = np.unique(self.term * max(1, self.blocks) + self.text // block, return_index=True)
        self.block_of, self.block_max = keys % max(1, self.blocks), np.maximum.reduceat(self.impact, opens) if len(opens) else np.zeros(0)
        self.first_block = np.searchsorted(keys // max(1, self.blocks), np.arange(m + 2))
        self.text, self.in_block = self.text.astype(np.int32), (self.text // block).astype(np.int32)
        # the stretches of each text, hashed together with the text
        self.grams = np.unique(self._hashed(flat, begin) ^ self._salt(text[begin]))

    def _hashed(self, ids, begin):
        import numpy as np

        out = np.zeros(len(begin), dtype=np.uint64)
        for j in range(self.run):
            out = (out ^ (ids[begin + j].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    @staticmethod
    def _salt(text):
        import numpy as np

        x = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))

    def retrieve(self, passages):
        """(passage, text) of every score above the threshold; ``passages`` is a
        matrix of term ids in which the number of terms stands for no word."""
        import numpy as np

        m, n = len(self.terms), len(self.items)
        terms = np.sort(passages, axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = m
        order = np.argsort(self.bound[terms], axis=1, kind="stable")
        terms = np.take_along_axis(terms, order, axis=1)
        reach = np.cumsum(self.bound[terms], axis=1)
        opened = (reach >= UNOPENED) & (reach[:, -1:] >= 1 - _SLACK)  # from the pivot on
        rest = np.where(opened, 0, reach).max(axis=1)
        p, c = np.nonzero(opened)
        t = terms[p, c]
        at, of = _ranges(self.first_block[t], self.first_block[t + 1])
        sums = np.bincount(p[of] * self.blocks + self.block_of[at], self.block_max[at], len(terms) * self.blocks)
        alive = sums.reshape(len(terms), self.blocks) + rest[:, None] >= 1 - _SLACK
        at, of = _ranges(self.first[t], self.first[t + 1])
        if not alive.all():
            inside = alive[p[of], self.in_block[at]]
            at, of = at[inside], of[inside]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = (p * n)[of] + self.text[at]
        if len(terms) * n <= 4 * _CELLS:
            total = np.bincount(key, self.impact[at], len(terms) * n)
            key = np.flatnonzero(total)
            total = total[key]
        else:
            order = np.argsort(key, kind="stable")
            key, opens = np.unique(key[order], return_index=True)
            total = np.add.reduceat(self.impact[at][order], opens)
        near = total + rest[key // n] >= 1 - _SLACK
        key, total = key[near], total[near]
        # the unopened lists, looked up for the texts that are left
        closed = np.where(opened, m, terms)
        for column in np.flatnonzero((closed < m).any(axis=0)):
            t = closed[key // n, column]
            at = np.flatnonzero(t < m)
            pair = t[at] * n + key[at] % n
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            total[at] += np.where(self.pairs[place] == pair, self.impact[place], 0)
        found = key[total >= 1 - _SLACK]
        return found // n, found % n

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, list[str]]]:
        """(position of the text, item, field, words of the text) of every leak, each once."""
        import numpy as np

        if not len(self.items):
            return
        run, unknown = self.run, len(self.terms)
        words = [self.words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        get = self.terms.get
        ids = np.fromiter((get(x, unknown) for w in words for x in w), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        # a match lies within a stretch of words of one text that the index knows
        open_ = ids < unknown
        cut = np.flatnonzero(~open_ | np.concatenate(([True], owner[1:] != owner[:-1]))[: len(ids)])
        edges = np.concatenate((cut, [len(ids)]))
        begin = np.where(open_[cut], cut, cut + 1) if len(cut) else cut
        long = edges[1:] - begin >= run
        begin, stop = begin[long], edges[1:][long]
        # passages of twice the run, so every stretch of one run lies within one
        width, step = 2 * run, run + 1
        count = -(-(stop - begin - run + 1) // step)
        k, of = _ranges(np.zeros(len(count), np.int64), count)
        first = begin[of] + k * step
        last = np.minimum(first + width, stop[of])
        size = max(1, _CELLS // max(len(self.items), width))
        padded = np.append(ids, unknown)
        seen: set[tuple[int, int]] = set()
        for i in range(0, len(first), size):
            spot = first[i : i + size, None] + np.arange(width)
            p, text = self.retrieve(padded[np.where(spot < last[i : i + size, None], spot, len(ids))])
            # the passage's stretches, looked up among those of the text
            at, of = _ranges(first[i + p], last[i + p] - run + 1)
            gram = self._hashed(ids, at) ^ self._salt(text[of])
            place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            for q, s in zip(at[self.grams[place] == gram], text[of[self.grams[place] == gram]]):
                if (owner[q], s) not in seen and self._stands(ids[q : q + run], s):
                    seen.add((owner[q], s))
                    yield int(owner[q]), int(self.items[s]), int(self.fields[s]), words[owner[q]]

    def _stands(self, run, text: int) -> bool:
        import numpy as np

        whole = self.flat[self.starts[text] : self.starts[text + 1]]
        return bool((np.lib.stride_tricks.sliding_window_view(whole, self.run) == run).all(axis=1).any())


def leaks(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    fields: tuple[str, ...] = ("question", "passage"),
    answer: str | None = "answer",
    run: int = 13,
    max_words: int = INDEX_WORDS,
) -> DataFrame:
    """``(key, item, field, answered)``: documents that hold ``run`` consecutive words
    of a field of an item, and whether they hold the words of its answer, too.

    One narrow pass over the documents; the index is broadcast. Its size is bounded:
    the items' texts are measured first, and of more than ``max_words`` words each
    portion has its own index and pass. Null, empty and short texts give no rows; a
    field of an item is reported once a document, however often it occurs; repeated
    rows of the documents count once; without a column ``answer``, or where it has no
    words, ``answered`` is false; other columns are not read.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    said = F.col(answer).cast("string") if answer else F.lit(None).cast("string")
    listed = F.array(*(F.struct(F.lit(i).alias("field"), F.col(f).cast("string").alias("text")) for i, f in enumerate(fields)))
    entries = items.select(F.col(item).alias("item"), said.alias("answer"), F.explode(listed).alias("e")).select("item", "answer", "e.field", "e.text")
    entries = entries.where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    total = entries.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    portions = max(1, -(-total // max_words))
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    words = Words(code_table(confusable_letters(documents.sparkSession)))
    found = None
    for portion in range(portions):
        mine = (entries if portions == 1 else entries.where(F.pmod(F.xxhash64("item"), F.lit(portions)) == portion)).collect()
        answers: dict[int, list[list[str]]] = {}
        for r in mine:
            if said := words(r.answer):
                answers.setdefault(r.item, []).append(said)
        index = documents.sparkSession.sparkContext.broadcast((LeakIndex([(r.item, r.field, r.text) for r in mine], run, words_of=words), answers))

        def search(batches: Iterator, index=index) -> Iterator:
            import pyarrow as pa

            parts = (large.slice(first, 1000) for large in batches for first in range(0, large.num_rows, 1000))
            for batch in parts:
                hits = [(k, i, f, any(_holds(words, a) for a in index.value[1].get(i, []))) for k, i, f, words in index.value[0].search(batch.column(1).to_pylist())]
                names, columns = ["key", "item", "field", "answered"], [*zip(*hits)] or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.bool_())], names=names)

        part = rows.mapInArrow(search, f"key {kind}, item bigint, field int, answered boolean")
        found = part if found is None else found.unionByName(part)
    field = F.element_at(F.array(*(F.lit(f) for f in fields)), F.col("field") + 1)
    return found.select(F.col("key").alias(key), F.col("item").cast(item_kind).alias(item), field.alias("field"), "answered").distinct()


def _holds(words: list[str], part: list[str]) -> bool:
    """Whether ``part`` stands in ``words`` one word after the other."""
    starts = (i for i, w in enumerate(words[: len(words) - len(part) + 1]) if w == part[0])
    return any(words[i : i + len(part)] == part for i in starts)


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", fields: tuple[str, ...] = ("question", "passage"), run: int = 13, max_words: int = INDEX_WORDS) -> DataFrame:
    """``(key, item)``: documents that hold ``run`` consecutive words of a field of an
    item, each once; see :func:`leaks`."""
    return leaks(documents, items, key, text, item, fields, None, run, max_words).select(key, item).distinct()


def leak_report(documents: DataFrame, items: DataFrame, item: str = "item_id", **columns) -> DataFrame:
    """``(item, n_docs, n_question, n_passage, n_answered)``: the documents into which
    an item leaked: any field, its question, its passage, and with its answer as well."""
    found = leaks(documents, items, item=item, **columns)
    key = columns.get("key", "doc_id")
    per_doc = found.groupBy(item, key).agg(F.max(F.col("field") == "question").alias("q"), F.max(F.col("field") == "passage").alias("p"), F.max("answered").alias("a"))
    return per_doc.groupBy(item).agg(F.count("*").alias("n_docs"), F.count_if("q").alias("n_question"), F.count_if("p").alias("n_passage"), F.count_if("a").alias("n_answered"))
