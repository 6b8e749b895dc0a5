"""Records that share most of their words (problem 4).

A text is the set of its lower-case words. Sets are the nodes: texts with equal
sets are collapsed first. MinHash samples are cut into bands; two sets that
agree in a whole band are a candidate pair. A second fold of the samples, the
odd sketch, is a bitmap of parities: the population count of the XOR of two
sketches estimates how many samples differ, most precisely for high
similarities, and discards nearly all candidates before the exact comparison.

Chance candidates grow with the square of the table, so a row of a band carries
the sketch and a pair is judged where its band is joined: only pairs that the
sketches let through are ever stored. The bands are joined a few at a time, and
the shuffle files of one round are deleted before the next.
"""

from __future__ import annotations

import contextlib
import functools
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.common import cut, tasks

#: Bands and rows of a band: a pair at the threshold 0.7 shares a band with
#: probability 0.968, one at 0.75 with 0.997, one at 0.8 with 0.9999.
BANDS, ROWS = 40, 7
#: Bands that are joined, and lie on disk, at once.
ROUND = 8
#: Bits of the odd sketch and the samples folded into it.
WORDS64, SAMPLES = 6, 210
#: Standard deviations that the sketch of a true pair may lie above its mean.
TOLERANCE = 3.0
#: Keys that may be broadcast (16 bytes each) after they were counted.
BROADCAST_KEYS = 1_000_000
#: Texts whose rows of a round (some 66 bytes a band) one task joins, on average.
TASK_TEXTS = 12_000

_LETTERS = re.compile(r"[^\W\d_]+")
_MASK = (1 << 64) - 1


def words_of(text: str | None) -> set[str]:
    """The set of lower-case words (longest runs of letters) of a text."""
    if not text:
        return set()
    if "\u0130" in text:  # the one letter whose lower case is more than a letter
        return {*"\n".join(_LETTERS.findall(text)).lower().split("\n")} - {""}
    return {*_LETTERS.findall(text.lower())}


class Signer:
    """Word hashes and their MinHash values, remembered for the words seen lately."""

    CAPACITY = 50_000
    #: Sets whose values are gathered at once, few enough for the processor's cache.
    SLICE = 32

    def __init__(self, samples: int) -> None:
        import numpy as np

        self.np, self.samples = np, samples
        rng = np.random.default_rng(20240131)
        self.factor = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.hashes = self.np.zeros(self.CAPACITY, dtype=self.np.uint64)
        self.values = self.np.zeros((self.CAPACITY, self.samples), dtype=self.np.uint32)

    def look_up(self, sets: list[set[str]]):
        """The places of all words of ``sets``, one set after the other."""
        import xxhash

        np = self.np
        new = [w for w in set().union(*sets) if w not in self.place]
        if len(self.place) + len(new) > self.CAPACITY:
            self.forget()
            new = [*set().union(*sets)]
            if len(new) > self.CAPACITY:
                self.hashes = np.zeros(len(new), dtype=np.uint64)
                self.values = np.zeros((len(new), self.samples), dtype=np.uint32)
        if new:
            first = len(self.place)
            at = slice(first, first + len(new))
            self.place.update(zip(new, range(first, first + len(new))))
            self.hashes[at] = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new), dtype=np.uint64, count=len(new))
            if self.samples:
                self.values[at] = (self.hashes[at, None] * self.factor + self.shift) >> np.uint64(32)
        get = self.place.__getitem__
        return np.fromiter((get(w) for s in sets for w in s), dtype=np.int64, count=sum(map(len, sets)))

    def sign(self, sets: list[set[str]]):
        """(set ids, MinHash values) of sets none of which is empty."""
        np = self.np
        flat = self.look_up(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        sums = np.add.reduceat(self.hashes[flat], starts)
        sizes = np.array([len(s) for s in sets], dtype=np.uint64)
        ids = (_mixed(sums ^ (sizes * np.uint64(0x9E3779B97F4A7C15)))).view(np.int64)
        if not self.samples:
            return ids, None
        bounds = np.append(starts, len(flat))
        parts = [slice(i, min(i + self.SLICE, len(sets))) for i in range(0, len(sets), self.SLICE)]
        least = [np.minimum.reduceat(self.values[flat[bounds[p.start] : bounds[p.stop]]], starts[p] - starts[p.start], axis=0) for p in parts]
        return ids, np.concatenate(least)


def _mixed(x):
    """A bijective scrambling of 64-bit numbers."""
    import numpy as np

    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_signers: dict[int, Signer] = {}


def _signer(samples: int) -> Signer:
    if samples not in _signers:
        _signers[samples] = Signer(samples)
    return _signers[samples]


def _batches(batches: Iterator, size: int = 400) -> Iterator:
    """(column of ids, word sets) of at most ``size`` rows whose set is not empty."""
    import pyarrow as pa

    for batch in batches:
        for first in range(0, batch.num_rows, size):
            part = batch.slice(first, size)
            sets = [words_of(t) for t in part.column(1).to_pylist()]
            kept = [i for i, s in enumerate(sets) if s]
            if kept:
                yield part.column(0).take(pa.array(kept)), [sets[i] for i in kept]


def _signatures(batches: Iterator) -> Iterator:
    """Of each text its set, odd sketch and, if the set is new to the task, band keys."""
    import numpy as np
    import pyarrow as pa

    signer, bits, seen = _signer(BANDS * ROWS), 64 * WORDS64, set()
    for key, sets in _batches(batches):
        ids, values = signer.sign(sets)
        n = len(ids)
        folded = values[:, -SAMPLES:].astype(np.uint64)
        bit = _mixed(folded ^ (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
        at = (bit.astype(np.int64) + np.arange(n)[:, None] * bits).ravel()
        odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
        sketch = np.packbits(odd, axis=1).view(np.int64)
        banded = values.reshape(n, BANDS, ROWS).astype(np.uint64)
        bands = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((n, 1), dtype=np.uint64)
        for j in range(ROWS):
            bands = _mixed(bands ^ banded[:, :, j])
        fresh = np.array([x not in seen and not seen.add(x) for x in ids.tolist()], dtype=bool)
        if len(seen) > 2_000_000:  # copies that come later are collapsed by their set_id
            seen.clear()
        offsets = np.concatenate([[0], np.cumsum(fresh * BANDS)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[fresh].view(np.int64).ravel()), mask=pa.array(~fresh))
        columns = [key, pa.array(ids), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(WORDS64)), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "set_id", "n", *(f"s{j}" for j in range(WORDS64)), "bands"])


def _word_hashes(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    signer = _signer(0)
    for _, sets in _batches(batches):
        ids, _ = signer.sign(sets)
        flat = signer.hashes[signer.look_up(sets)].view(np.int64)
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["set_id", "words"])


def largest_distance(threshold: float) -> float:
    """The largest XOR population count at which a pair at ``threshold`` is kept."""
    bits = 64 * WORDS64
    differing = 2 * SAMPLES * (1 - threshold)
    kept = math.exp(-2 * differing / bits)
    mean = bits / 2 * (1 - kept)
    spread = 4 * SAMPLES * threshold * (1 - threshold) * kept**2 + bits / 4 * (1 - kept**2)
    return mean + TOLERANCE * math.sqrt(spread)


@contextlib.contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Deletes the shuffle files of each query within as soon as it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_duplicate_sets(df: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs ``(set_a, set_b, similarity)`` of different word
    sets with at least ``threshold`` of their union in common, and ``(key,
    set_id)`` of every text that has a word.

    No text leaves its partition except those of the pairs that the sketches
    let through, and no other pair is stored. Copies meet only as one set, so a set that fills a third of the
    table is one row of each band. No bucket is capped.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    parts = max(tasks(df.sparkSession), -(-df.count() // TASK_TEXTS))
    sketch_names = [f"s{j}" for j in range(WORDS64)]
    schema = f"key {kind}, set_id bigint, n int, " + ", ".join(f"{s} bigint" for s in sketch_names) + ", bands array<bigint>"
    distance = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in sketch_names), F.lit(0))
    sizes = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9
    alike = F.expr("x.band = y.band AND x.set_id < y.set_id") & sizes & (distance <= largest_distance(threshold))
    with _freed_shuffles(df.sparkSession):
        signed = cut(rows.mapInArrow(_signatures, schema).withColumn("row", F.monotonically_increasing_id()))
        ids = cut(signed.select("key", "set_id", F.when(F.col("bands").isNotNull(), F.col("row")).alias("row")))
        members = ids.select("key", "set_id").distinct()
        # a set of which several tasks made band keys keeps those of one
        first = ids.where("row IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
        again = cut(ids.join(first, "set_id").where("row <> first").select("row"))
        few = again.count() <= BROADCAST_KEYS
        sets = signed.where("bands IS NOT NULL").join(F.broadcast(again) if few else again, "row", "left_anti")
        found = []
        for start in range(1, BANDS + 1, ROUND):
            own = sets.select("set_id", "n", *sketch_names, F.explode(F.slice("bands", start, ROUND)).alias("band")).repartition(parts, "band")
            pairs = own.alias("x").join(own.alias("y"), alike)
            found.append(cut(pairs.select(F.col("x.set_id").alias("set_a"), F.col("y.set_id").alias("set_b"))))
        likely = cut(functools.reduce(DataFrame.unionByName, found).distinct())

    wanted = likely.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).distinct()
    one_each = cut(members.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("key").alias("key")))
    few = one_each.count() <= BROADCAST_KEYS
    texts = rows.join(F.broadcast(one_each) if few else one_each, "key").select("set_id", "text")
    words = cut(texts.mapInArrow(_word_hashes, "set_id bigint, words array<bigint>").dropDuplicates(["set_id"]))
    both = likely.join(words.select(F.col("set_id").alias("set_a"), F.col("words").alias("w_a")), "set_a")
    both = both.join(words.select(F.col("set_id").alias("set_b"), F.col("words").alias("w_b")), "set_b")
    common = F.size(F.array_intersect("w_a", "w_b"))
    similarity = common / (F.size("w_a") + F.size("w_b") - common)
    return both.withColumn("similarity", similarity).where(F.col("similarity") >= threshold - 1e-9).select("set_a", "set_b", "similarity"), members


def near_duplicate_pairs(df: DataFrame, key: str = "chunk_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``(key_a, key_b)``: all pairs of different keys whose word sets share at
    least ``threshold`` of their union, the smaller key first, each once.

    Null, empty and wordless texts and null keys are in no pair; a repeated row
    counts once; a key with several texts stands for each of them. An empty
    table gives an empty table; other columns are not read.
    """
    links, members = near_duplicate_sets(df, key, text, threshold)
    links = links.select(F.col("set_a").alias("s1"), F.col("set_b").alias("s2"))
    one = members.select(F.col("set_id").alias("s1"), F.col("key").alias("k1"))
    two = members.select(F.col("set_id").alias("s2"), F.col("key").alias("k2"))
    different = links.join(one, "s1").join(two, "s2").select("k1", "k2")
    equal = one.join(two, F.col("s1") == F.col("s2")).where(F.col("k1") < F.col("k2")).select("k1", "k2")
    pairs = different.unionByName(equal).where(F.col("k1") != F.col("k2"))
    return pairs.select(F.least("k1", "k2").alias(f"{key}_a"), F.greatest("k1", "k2").alias(f"{key}_b")).distinct()


def near_duplicate_classes(df: DataFrame, key: str = "chunk_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``(key, class_id, n_links)``: one row per key; equal word sets have one
    class, named by their smallest key, and ``n_links`` counts the other
    classes linked to it."""
    links, members = near_duplicate_sets(df, key, text, threshold)
    counts = links.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    names = members.groupBy("set_id").agg(F.min("key").alias("class_id")).join(counts, "set_id", "left")
    rows = members.join(names, "set_id").groupBy("key").agg(F.min("class_id").alias("class_id"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return rows.withColumnRenamed("key", key)
