"""The most similar vectors of every vector (problem 1).

Multiprobe p-stable hashing: vectors of unit length are projected on Gaussian
directions, the projections cut into slots of one width, and the slots of a
table's directions form a bucket. A vector visits, in each table, the buckets
that differ from its own by perturbed slots, in the order of their estimated
success: the squared distances to the slot borders, sorted, are matched with a
sequence of perturbation sets that is generated once from their expected values.
A visited pair counts for both of its vectors, so two vectors meet if either
visits the other's bucket. The candidates of all tables are ranked by exact
cosine in double precision.

The first few directions of a table name the cell of a bucket. A cell is the
unit of work: a vector is sent once to each cell it visits, and the visits to the
cell's buckets are worked out there, so probes are never shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.common import cut

#: Tables, and buckets that a vector visits in each.
TABLES, PROBES = 8, 40
#: Width of a slot in units of the mean projection of a unit vector, 1/sqrt(dim).
WIDTH = 2.0
#: A table has GROWTH * log2(n) - SHALLOW directions. A direction halves the
#: buckets, so the vectors that one vector meets grow as the power 1 - GROWTH of n.
GROWTH, SHALLOW = 0.7, 0.8
#: Vectors of a cell, on average, and the bytes they may take.
CELL_VECTORS, CELL_BYTES = 65_536, 50_000_000
#: A cell with more vectors, or with more visitors, times its average is split into blocks.
CROWDED = 1.5
#: Split cells that may be broadcast (24 bytes each) after they were counted.
BROADCAST_CELLS = 500_000
#: Vectors without k candidates that are compared with all others in one pass.
LONELY = 4_096
#: What a cosine in single precision may differ by for equal vectors.
_NOISE = 2e-6
#: Vectors whose similarity gives each row of a cell a first bound.
_SAMPLE = 256


def perturbation_sets(directions: int, most: int) -> list[tuple[int, ...]]:
    """The first ``most`` sets of places among the 2 x directions sorted border
    distances, by the sum of their expected squares, the empty set first.

    Places j and 2 x directions - 1 - j are the two borders of one direction, so
    no set has both. The expected squares are those of sorted uniform numbers.
    """
    m = directions
    squares = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    squares += [1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    sets: list[tuple[int, ...]] = [()]
    heap = [(squares[0], (0,))] if m else []
    while heap and len(sets) < most:
        cost, places = heapq.heappop(heap)
        if not any(2 * m - 1 - p in places for p in places):
            sets.append(places)
        last = places[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - squares[last] + squares[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (cost + squares[last + 1], (*places, last + 1)))
    return sets


class Hasher:
    """The buckets and cells of vectors and those that they visit."""

    def __init__(self, dim: int, directions: int, coarse: int, tables: int = TABLES, seed: int = 17) -> None:
        import numpy as np

        rng = np.random.default_rng(seed)
        m = min(directions, dim)
        # orthogonal Gaussian directions: each is p-stable, together they repeat less
        self.axes = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :m].astype(np.float32) for _ in range(tables)]
        self.offsets = rng.random((tables, m)).astype(np.float32)
        self.width = WIDTH / math.sqrt(dim)
        self.mix = rng.integers(1, 1 << 62, (tables, m), dtype=np.int64) | 1
        self.tables, self.coarse = tables, min(coarse, m)
        sets = perturbation_sets(m, PROBES)
        longest = max(1, *map(len, sets))
        self.sets = np.array([[*s, *[2 * m] * (longest - len(s))] for s in sets])  # 2m: no shift

    def codes(self, unit, table: int, cells: bool):
        """(own, visited): the cells or the buckets of rows in a table."""
        import numpy as np

        at = unit @ self.axes[table] / np.float32(self.width) + self.offsets[table]
        slot = np.floor(at)
        left = at - slot
        mix = self.mix[table].copy()
        if cells:
            mix[self.coarse :] = 0
        own = (slot.astype(np.int64) * mix).sum(axis=1)
        m = len(mix)
        order = np.argsort(np.concatenate([left, 1 - left], axis=1), axis=1, kind="stable")
        shift = np.zeros((len(unit), 2 * m + 1), dtype=np.int64)
        shift[:, : 2 * m] = np.concatenate([-mix, mix])[order]
        return own, own[:, None] + shift[:, self.sets].sum(axis=2)


def _matrix(column, dim: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _unit(raw):
    import numpy as np

    wide = raw.astype(np.float64)
    wide /= np.abs(raw).max(axis=1)[:, None]
    wide /= np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
    return wide


def _unit32(raw):
    import numpy as np

    return np.concatenate([_unit(raw[i : i + 8192]).astype(np.float32) for i in range(0, len(raw), 8192)]) if len(raw) else raw


def usable_vectors(df: DataFrame, key: str, embedding: str) -> tuple[DataFrame, int]:
    """``(id, vec)`` of the usable vectors, and their length.

    Usable: no null in the row's key, vector or elements, only finite elements,
    the usual (most frequent, of several the largest) length, not all zero.
    Exact duplicates count once; of several vectors under one key the smallest
    in order is taken.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = usual[0].n if usual else 1
    fit = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fit).groupBy("id").agg(F.min("v").alias("v"))

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            flat = (batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False) + np.float32(0)).tobytes()  # -0 is 0
            step = 4 * dim
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[i : i + step] for i in range(0, len(flat), step)], pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(pack, "id bigint, vec binary"), dim


#: Bits of a packed candidate: row, distance and hit. A group of rows is kept below 1 << _ROW.
_ROW, _FAR = 18, 28


class _Best:
    """The best candidates of each row of a cell, as packed numbers.

    A pair comes at most twice, once from each side, so twice as many as wanted
    are kept until the end.
    """

    def __init__(self, rows: int, kept: int) -> None:
        import numpy as np

        self.np, self.kept = np, kept
        self.least = np.full(rows, -2.0, dtype=np.float32)
        self.packed = np.zeros(0, dtype=np.uint64)
        self.waiting: list = []
        self.pending = 0

    def add(self, a, b, score) -> None:
        self.waiting.append((a, b, score))
        self.pending += len(a)
        if self.pending > 1_000_000:
            self.settle()

    def settle(self) -> None:
        np = self.np
        if not self.pending:
            return
        a, b, score = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.pending = [], 0
        rows, hits, score = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])
        fit = (score >= self.least[rows] - _NOISE) & (rows != hits)
        rows, hits, score = rows[fit], hits[fit], score[fit].astype(np.float64)
        far = np.clip((1 - score) * (1 << (_FAR - 2)), 0, (1 << _FAR) - 1).astype(np.uint64)
        new = rows.astype(np.uint64) << np.uint64(_ROW + _FAR) | far << np.uint64(_ROW) | hits.astype(np.uint64)
        every = np.sort(np.concatenate([self.packed, new]))
        row = (every >> np.uint64(_ROW + _FAR)).astype(np.int64)
        starts = np.searchsorted(row, np.arange(len(self.least)))
        rank = np.arange(len(row)) - starts[row]
        last = rank == 2 * self.kept - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], self._score(every[last]))
        self.packed = every[rank < 2 * self.kept]

    def _score(self, packed):
        np = self.np
        far = (packed >> np.uint64(_ROW)) & np.uint64((1 << _FAR) - 1)
        return (1 - far.astype(np.float64) / (1 << (_FAR - 2))).astype(np.float32) - np.float32(_NOISE)

    def found(self):
        """(row, hit) of the best, each pair of them once."""
        np = self.np
        self.settle()
        pair = np.sort((self.packed >> np.uint64(_ROW + _FAR)) << np.uint64(_ROW) | self.packed & np.uint64((1 << _ROW) - 1))
        pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
        return (pair >> np.uint64(_ROW)).astype(np.int64), (pair & np.uint64((1 << _ROW) - 1)).astype(np.int64)


def compare_cell(hasher: Hasher, table: int, held, asks, ids, raw, k: int):
    """(row id, hit id, cosine, visits): the k most similar of each row of a cell, as
    far as the visits tell. ``held`` marks the rows whose buckets lie in the cell,
    ``asks`` those that visit; rows are different vectors."""
    import numpy as np

    rows, kept = len(ids), k + 3
    best = _Best(rows, kept)
    unit = _unit32(raw)
    holds = np.flatnonzero(held)
    visits = 0
    if len(holds) and asks.any():
        own = np.empty(len(holds), dtype=np.int64)
        for i in range(0, len(holds), 8192):
            own[i : i + 8192] = hasher.codes(unit[holds[i : i + 8192]], table, False)[0]
        order = np.argsort(own, kind="stable")
        holds, own = holds[order], own[order]
        buckets, starts = np.unique(own, return_index=True)
        ends = np.append(starts[1:], len(holds))
        # a first bound of each row: its rank among a sample, and in its own bucket
        some = np.unique(np.linspace(0, len(holds) - 1, _SAMPLE).astype(np.int64))
        for i in range(0, rows, 8192) if len(some) > kept + 1 else ():
            near = np.partition(unit[i : i + 8192] @ unit[holds[some]].T, len(some) - kept - 1, axis=1)
            best.least[i : i + 8192] = near[:, len(some) - kept - 1] - _NOISE
        for s, e in zip(starts, ends):
            if e - s > kept + 1:
                for i in range(s, e, 2048):
                    part = holds[i : min(i + 2048, e)]
                    near = np.partition(unit[part] @ unit[holds[s:e]].T, e - s - kept - 1, axis=1)[:, e - s - kept - 1]
                    best.least[part] = np.maximum(best.least[part], near - _NOISE)
        who, where = [], []
        for i in range(0, rows, 8192):
            part = i + np.flatnonzero(asks[i : i + 8192])
            probes = hasher.codes(unit[part], table, False)[1]
            at = np.minimum(np.searchsorted(buckets, probes), len(buckets) - 1)
            r, c = np.nonzero(buckets[at] == probes)
            who.append(part[r].astype(np.int32))
            where.append(at[r, c].astype(np.int32))
        who, where = np.concatenate(who), np.concatenate(where)
        order = np.argsort(where, kind="stable")
        who, where = who[order], where[order]
        first = np.searchsorted(where, np.arange(len(buckets) + 1))
        for b in range(len(buckets)):
            inside = holds[starts[b] : ends[b]]
            visits += (first[b + 1] - first[b]) * len(inside)
            for q in range(first[b], first[b + 1], 4096):
                asking = who[q : min(q + 4096, first[b + 1])]
                for h in range(0, len(inside), 4096):
                    part = inside[h : h + 4096]
                    score = unit[asking] @ unit[part].T
                    r, c = np.nonzero((score >= best.least[asking][:, None]) | (score >= best.least[part]))
                    if len(r):
                        best.add(asking[r], part[c], score[r, c])
    rows, hits = best.found()
    exact = np.empty(len(rows))
    for i in range(0, len(rows), 65_536):
        part = slice(i, i + 65_536)
        exact[part] = np.einsum("ij,ij->i", _unit(raw[rows[part]]), _unit(raw[hits[part]]))
    return *_first_k(ids[rows], ids[hits], exact, k), visits


def _first_k(keys, hits, scores, k: int):
    """The k best hits of each key: by the score to 14 digits, then the smaller id."""
    import numpy as np

    order = np.lexsort((hits, -np.round(scores, 14), keys))
    keys, hits, scores = keys[order], hits[order], scores[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    return keys[rank < k], hits[rank < k], scores[rank < k]


_FOUND = "item_id bigint, ids array<bigint>, cosines array<double>"


def _listed(keys, hits, scores):
    """An Arrow table of :data:`_FOUND` out of rows sorted by key."""
    import numpy as np
    import pyarrow as pa

    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
    return pa.Table.from_arrays([pa.array(keys[starts]), pa.ListArray.from_arrays(offsets, pa.array(hits)), pa.ListArray.from_arrays(offsets, pa.array(scores))], names=["item_id", "ids", "cosines"])


def directions_for(n: int) -> int:
    """The directions of a table for n vectors."""
    return max(1, round(GROWTH * math.log2(max(2, n)) - SHALLOW))


def _cell_search(vectors: DataFrame, dim: int, k: int, n: int, directions: int, tables: int = TABLES, asking: DataFrame | None = None, visits=None) -> DataFrame:
    """One round of hashing: what the rows of ``asking`` (all, if not given) meet."""
    size = max(1, min(CELL_VECTORS, CELL_BYTES // (4 * dim)))
    coarse = max(0, math.ceil(math.log2(max(1, n / size))))
    roles = vectors.withColumn("asks", F.lit(True)) if asking is None else vectors.join(asking.select("id", F.lit(True).alias("asks")), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))

    def place(batches: Iterator, full: bool) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(dim, directions, coarse, tables)
        for large in batches:
            for first in range(0, large.num_rows, 2000):
                batch = large.slice(first, 2000)
                unit, asks = _unit32(_matrix(batch.column("vec"), dim)), batch.column("asks").to_numpy(zero_copy_only=False)
                for t in range(tables):
                    if hasher.coarse:
                        own, visited = hasher.codes(unit, t, True)
                        visited = np.where(asks[:, None], visited, own[:, None])
                        visited = np.sort(visited, axis=1)
                        fresh = np.concatenate([np.ones((len(own), 1), dtype=bool), visited[:, 1:] != visited[:, :-1]], axis=1)
                        r, c = np.nonzero(fresh)
                        cell, held = visited[r, c], visited[r, c] == own[r]
                    else:
                        r = np.arange(len(unit))
                        cell, held = np.zeros(len(unit), dtype=np.int64), np.ones(len(unit), dtype=bool)
                    columns = [pa.array(cell * tables + t), pa.array(held)]
                    if full:
                        columns += [pa.array(asks[r]), batch.column("id").take(pa.array(r)), batch.column("vec").take(pa.array(r))]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "held", "asks", "id", "vec"][: len(columns)])

    rows = roles.mapInArrow(lambda b: place(b, True), "cell bigint, held boolean, asks boolean, id bigint, vec binary")
    block = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    one = lambda column: F.array(column)
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    # a cell with very many vectors or visitors becomes nv x nq blocks: its own vectors
    # lie in one of nv and in all nq, those that visit in one of nq and in all nv
    if coarse or n > CROWDED * size:
        sizes = roles.mapInArrow(lambda b: place(b, False), "cell bigint, held boolean").groupBy("cell").agg(F.count_if("held").alias("own"), F.count("*").alias("all"))
        split = cut(sizes.select("cell", F.ceil(F.col("own") / (CROWDED * size)).cast("int").alias("nv"), F.ceil(F.col("all") / (2 * CROWDED * size)).cast("int").alias("nq")).where("nv > 1 OR nq > 1 AND nv > 0"))
        few = split.count() <= BROADCAST_CELLS
        rows = rows.join(F.broadcast(split) if few else split, "cell", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("nv", "nq")})
        rows = rows.withColumn("mv", block("nv")).withColumn("bv", F.explode(F.when(F.col("asks"), every("nv")).otherwise(one(F.col("mv")))))
        rows = rows.withColumn("held", F.col("held") & (F.col("bv") == F.col("mv"))).withColumn("mq", block("nq"))
        rows = rows.withColumn("bq", F.explode(F.when(F.col("held"), every("nq")).otherwise(one(F.col("mq")))))
        rows = rows.select("cell", "bv", "bq", "held", (F.col("asks") & (F.col("bq") == F.col("mq"))).alias("asks"), "id", "vec")
    else:
        rows = rows.select("cell", F.lit(0).alias("bv"), F.lit(0).alias("bq"), "held", "asks", "id", "vec")

    def compare(part):
        hasher = Hasher(dim, directions, coarse, tables)
        column = lambda name: part.column(name).combine_chunks()
        flag = lambda name: column(name).to_numpy(zero_copy_only=False)
        table = int(column("cell")[0].as_py() % tables)
        keys, hits, exact, seen = compare_cell(hasher, table, flag("held"), flag("asks"), column("id").to_numpy(), _matrix(part.column("vec"), dim), k)
        if visits is not None:
            visits.add(int(seen))
        return _listed(keys, hits, exact)

    return rows.groupBy("cell", "bv", "bq").applyInArrow(compare, _FOUND)


def _against_all(vectors: DataFrame, lonely: DataFrame, dim: int, k: int) -> DataFrame:
    """The exact way for at most :data:`LONELY` rows: one pass over all vectors."""
    import numpy as np

    rows = lonely.collect()
    names, raw = np.array([r.id for r in rows], dtype=np.int64), np.frombuffer(b"".join(r.vec for r in rows), dtype=np.float32).reshape(-1, dim)
    shared = vectors.sparkSession.sparkContext.broadcast((names, raw))

    def search(batches: Iterator) -> Iterator:
        import numpy as np

        names, raw = shared.value
        unit = _unit(raw)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for large in batches:
            for first in range(0, large.num_rows, 2000):
                batch = large.slice(first, 2000)
                ids = batch.column(0).to_numpy()
                score = unit @ _unit(_matrix(batch.column(1), dim)).T
                score[names[:, None] == ids] = -2
                top = np.argpartition(-score, min(k, len(ids)) - 1, axis=1)[:, : k + 3]
                floor = np.take_along_axis(score, top, 1).min(axis=1) if len(ids) > k else np.full(len(names), -1.5)
                r, c = np.nonzero((score >= floor[:, None]) & (score > -1.5))
                best = _first_k(*(np.concatenate(x) for x in zip(best, (names[r], ids[c], score[r, c]))), k)
        yield from _listed(*best).to_batches()

    return vectors.select("id", "vec").mapInArrow(search, _FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``(item_id, e)``: the k best of all that was found for an item, as (d, id), d the negative cosine."""
    entries = F.transform(F.arrays_zip("ids", "cosines"), lambda x: F.struct((-x["cosines"]).alias("d"), x["ids"].alias("id")))
    merged = found.groupBy("item_id").agg(F.flatten(F.collect_list(entries)).alias("e"))
    return merged.select("item_id", F.slice(F.array_sort(F.array_distinct("e")), 1, k).alias("e"))


def most_similar(df: DataFrame, key: str, embedding: str = "embedding", k: int = 5, visits=None) -> DataFrame:
    """``(item_id, neighbour_id, similarity)``: the k vectors of highest cosine for
    each usable vector (see :func:`usable_vectors`), ties by the smaller id.

    Approximate: a pair none of whose vectors visits the other's bucket is missed
    (recall against brute force is in the README). Every vector is indexed and
    asks. Equal vectors under several keys are one vector with its k + 1 smallest
    keys, so a vector that a third of the keys have is one row. A vector that met
    fewer than k others asks again in ever coarser buckets; the few that still
    did are compared with all. With fewer than k + 1 vectors there are fewer rows;
    an empty table gives an empty table; other columns are not read. ``visits``,
    an accumulator, gets the number of comparisons.
    """
    usable, dim = usable_vectors(df, key, embedding)
    usable = cut(usable)
    vectors = cut(usable.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    n, most = vectors.agg(F.count("*"), F.max("n")).first()
    directions = directions_for(n)
    best = cut(_merged(_cell_search(vectors, dim, k, n, directions, visits=visits), k))
    lonely = lambda: cut(vectors.select("id", "vec").join(best.where(F.size("e") >= min(k, n - 1)).select(F.col("item_id").alias("id")), "id", "left_anti"))
    alone = lonely()
    while (left := alone.count()) > LONELY and directions > 1:
        directions //= 2
        again = _merged(_cell_search(vectors, dim, k, n, directions, 2, alone, visits), k).join(alone.select(F.col("id").alias("item_id")), "item_id", "left_semi")
        best = cut(best.join(again.select("item_id"), "item_id", "left_anti").unionByName(again))
        alone = lonely()
    for part in range(blocks := -(-left // LONELY)):
        mine = alone if blocks == 1 else alone.where(F.pmod(F.xxhash64("id"), F.lit(2 * blocks)).between(2 * part, 2 * part + 1))
        again = _merged(_against_all(vectors, mine, dim, k), k)
        best = cut(best.join(again.select("item_id"), "item_id", "left_anti").unionByName(again))
    if not most or most == 1:
        return best.select("item_id", F.explode("e").alias("e")).select("item_id", F.col("e.id").alias("neighbour_id"), (-F.col("e.d")).alias("similarity"))
    # every vector's smallest keys take its place; its own other keys have cosine 1
    shared = usable.join(vectors.select("vec", F.col("id").alias("rep")), "vec").select("id", "rep")
    order = Window.partitionBy("rep").orderBy("id")
    smallest = cut(shared.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("keys")))
    other = best.select("item_id", F.explode("e").alias("e")).select("item_id", F.col("e.d").alias("d"), F.col("e.id").alias("rep")).join(smallest, "rep")
    other = other.select("item_id", F.transform("keys", lambda x: F.struct(F.col("d"), x.alias("id"))).alias("e")).groupBy("item_id").agg(F.flatten(F.collect_list("e")).alias("e"))
    own = smallest.select(F.col("rep").alias("item_id"), F.transform("keys", lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("id"))).alias("mine"))
    both = own.join(other, "item_id", "left").select(F.col("item_id").alias("rep"), F.concat("mine", F.coalesce("e", F.array().cast("array<struct<d:double,id:bigint>>"))).alias("e"))
    rows = shared.join(both, "rep").select("id", F.slice(F.array_sort(F.filter("e", lambda x: x["id"] != F.col("id"))), 1, k).alias("e"))
    return rows.select(F.col("id").alias("item_id"), F.explode("e").alias("e")).select("item_id", F.col("e.id").alias("neighbour_id"), (-F.col("e.d")).alias("similarity"))
