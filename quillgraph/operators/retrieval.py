"""Ranking: BM25, vector search, fusion, re-ranking, diversity, and metrics of runs.

A run has ``query_id, doc_id, rank`` (and mostly ``score``); ties are broken by
the document's id, so every rank is defined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.common import tasks
from quillgraph.functions.scalar import bm25_idf, cosine, dcg_gain, tokens


#: Terms of queries that may be broadcast (some 50 bytes each) after they were counted.
BROADCAST_TERMS = 500_000


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best documents of each query; Spark prunes each partition to k first."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 6)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query_id, doc_id, score)`` of every document that has a term of the query.

    ``docs``: doc_id, text; ``queries``: query_id, text. Words that no query has leave
    the plan before anything is shuffled; the postings are shuffled once, by document,
    and stay there until the best of each query are chosen. The queries' terms are
    counted and broadcast up to :data:`BROADCAST_TERMS`, beyond joined by a shuffle. A
    term repeated in a query counts repeatedly. Null texts have no terms; documents
    without a term of the query have no row (the reference fills its top k with them,
    at score 0; :func:`with_zero_scores` does).
    """
    terms = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    small = terms.count() <= BROADCAST_TERMS
    near = F.broadcast if small else (lambda df: df)
    sized = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("len", F.size("t"))
    totals = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    found = sized.select("doc_id", "len", F.explode("t").alias("term")).join(near(terms.select("term").distinct()), "term", "left_semi")
    # few bytes, but many scores: the number of partitions is stated, so they stay apart
    parts = max(tasks(docs.sparkSession), docs.sparkSession.sparkContext.defaultParallelism)
    postings = found.repartition(parts, "doc_id").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = bm25_idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighted = postings.join(near(frequency), "term").crossJoin(F.broadcast(totals)).select("doc_id", "term", weight.alias("w"))
    return weighted.join(near(terms), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))


def with_zero_scores(run: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A run of the k best (query_id, doc_id, score, rank) filled up to k with the documents
    of the smallest ids that it does not have, at score 0."""
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    every = queries.select("query_id").distinct().crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    more = every.join(run.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top_k(run.select("query_id", "doc_id", "score").unionByName(more.select("query_id", "doc_id", "score")), k)


def bm25_idf_table(docs: DataFrame) -> DataFrame:
    """``(term, df, idf)`` of the whole corpus."""
    terms = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(docs.agg(F.count("*").alias("n"))).select("term", "df", bm25_idf(F.col("n"), F.col("df")).alias("idf"))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine search: ``vectors`` (doc_id, embedding) for ``queries`` (query_id, embedding).

    A stated query set: it is counted, and split by a hash into blocks of about 4,096,
    one of which at a time is fetched and broadcast; each partition
    of vectors keeps its best k of every query (an Arrow step), so k rows a
    query and partition are shuffled, not all scores. Vectors without a norm or
    of another length have cosine 0 and are skipped.
    """
    import numpy as np

    spark = vectors.sparkSession
    out = None
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    blocks = max(1, -(-asked.count() // 4096))
    for number in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        by_size: dict[int, list] = {}
        for r in part.collect():
            by_size.setdefault(len(r.embedding), []).append((r.query_id, r.embedding))
        for dim, block in by_size.items():
            matrix = np.array([v for _, v in block], dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1)
            keep = norms > 0
            shared = spark.sparkContext.broadcast((np.array([n for n, _ in block])[keep], matrix[keep] / norms[keep, None]))

            def search(batches: Iterator, shared=shared, dim=dim) -> Iterator:
                import pyarrow as pa

                names, unit = shared.value
                best = None
                for batch in batches:
                    rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == dim and None not in v]
                    if not rows or not len(names):
                        continue
                    ids = np.array([i for i, _ in rows])
                    values = np.array([v for _, v in rows], dtype=np.float64)
                    size = np.linalg.norm(values, axis=1)
                    ids, values = ids[size > 0], values[size > 0] / size[size > 0, None]
                    found = [(ids, unit @ values.T)]
                    if best is not None:
                        found.append(best)
                    ids = [np.broadcast_to(i, s.shape) for i, s in found]
                    ids, scores = np.concatenate(ids, axis=1), np.concatenate([s for _, s in found], axis=1)
                    order = np.lexsort((ids, -np.round(scores, 6)), axis=1)[:, :k]
                    best = (np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1))
                if best is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best[0].shape[1])), pa.array(best[0].ravel()), pa.array(best[1].ravel())], names=["query_id", "doc_id", "score"])

            part = vectors.select("doc_id", "embedding").mapInArrow(search, f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id bigint, score double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id bigint, score double")
    return top_k(out, k)


def reciprocal_rank_fusion(runs: list[DataFrame], k: int, constant: float = 60.0, weights: list[float] | None = None) -> DataFrame:
    """Sum of weight / (constant + rank) over the runs; ties by the smaller id."""
    parts = [r.select("query_id", "doc_id", (F.lit(w) / (constant + F.col("rank"))).alias("s")) for r, w in zip(runs, weights or [1.0] * len(runs))]
    return top_k(reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score")), k)


def linear_rerank(features: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Weighted sum of feature columns, a missing one counting 0."""
    score = reduce(Column.__add__, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()))
    return top_k(features.withColumn("score", score), k)


def entity_boost(run: DataFrame, docs: DataFrame, names: DataFrame, k: int, rank_weight: float = 0.7, name_weight: float = 0.3) -> DataFrame:
    """Re-ranks a run by 1/rank and the share of the query's names (``query_id,
    names``) that the document's text contains."""
    texts = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    rows = run.select("query_id", "doc_id", "rank").join(texts, "doc_id").join(names, "query_id", "left")
    listed = F.coalesce("names", F.array())
    share = F.size(F.filter(listed, lambda n: F.contains(F.col("text"), F.lower(n)))) / F.greatest(F.lit(1), F.size(listed))
    return top_k(rows.select("query_id", "doc_id", (rank_weight / F.col("rank") + name_weight * F.least(F.lit(1.0), share)).alias("score")), k)


def maximal_marginal_relevance(candidates: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """Greedy choice of k candidates (``query_id, doc_id, score, embedding``) by
    trade * score - (1 - trade) * largest cosine to one already chosen.

    Sequential by nature: one task handles the candidates of a query, which are
    the top of another ranking. Candidates without a vector are never chosen.
    """

    def choose(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf[pdf["embedding"].notna()].sort_values("doc_id")
        chosen: list[int] = []
        if len(pdf):
            matrix = np.stack(pdf["embedding"].to_numpy()).astype(float)
            norm = np.linalg.norm(matrix, axis=1)
            unit = matrix / np.where(norm > 0, norm, 1)[:, None]
            score, nearest, free = pdf["score"].to_numpy(), None, np.ones(len(pdf), dtype=bool)
            while free.any() and len(chosen) < k:
                value = trade * score - (1 - trade) * (0 if nearest is None else nearest)
                best = int(np.argmax(np.where(free, np.round(value, 9), -np.inf)))
                chosen.append(best)
                free[best] = False
                near = unit @ unit[best]
                nearest = near if nearest is None else np.maximum(nearest, near)
        out = pdf.iloc[chosen][["query_id", "doc_id"]]
        return pd.DataFrame({"query_id": out["query_id"], "doc_id": out["doc_id"], "rank": range(1, len(out) + 1)})

    kind = candidates.schema["query_id"].dataType.simpleString()
    return candidates.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, doc_id bigint, rank int")


def model_rerank(pairs: DataFrame, predict: Callable, k: int) -> DataFrame:
    """Re-ranks ``(query_id, doc_id, query, text)`` by a model: ``predict`` takes
    two lists of texts and returns scores. Pairs without text are dropped."""

    @F.pandas_udf("double")
    def score(query, text):
        import pandas as pd

        return pd.Series(predict(list(query), list(text)), dtype=float)

    known = pairs.where(F.col("text").isNotNull() & F.col("query").isNotNull())
    return top_k(known.withColumn("score", score("query", "text")).drop("query", "text"), k)


def exact_similarity(left: Column, right: Column) -> Column:
    return cosine(left, right)


# Metrics -----------------------------------------------------------------


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with each document's relevance (0 if not judged)."""
    return run.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def per_query_metrics(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query of the run: hit at each cut, reciprocal rank, nDCG at each cut."""
    rows = judged(run, qrels)
    hit = F.col("relevance") > 0
    gains = [F.coalesce(F.sum(F.when(F.col("rank") <= c, dcg_gain(F.col("relevance"), F.col("rank")))), F.lit(0.0)).alias(f"dcg_{c}") for c in cuts]
    measured = rows.groupBy("query_id").agg(*(F.max(F.when(hit & (F.col("rank") <= c), 1).otherwise(0)).alias(f"hit_{c}") for c in cuts), F.coalesce(F.max(F.when(hit, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"), *gains)
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    best = qrels.where("relevance > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(cuts))
    ideal = best.groupBy("query_id").agg(*(F.sum(F.when(F.col("r") <= c, dcg_gain(F.col("relevance"), F.col("r")))).alias(f"ideal_{c}") for c in cuts))
    joined = measured.join(ideal, "query_id", "left")
    shares = [F.when(F.col(f"ideal_{c}") > 0, F.col(f"dcg_{c}") / F.col(f"ideal_{c}")).otherwise(0.0).alias(f"ndcg_{c}") for c in cuts]
    return joined.select("query_id", *(f"hit_{c}" for c in cuts), "rr", *shares)


def run_metrics(run: DataFrame, qrels: DataFrame, cases: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: hit rates and MRR over all cases, nDCG over the queries of the run."""
    rows = cases.select("query_id").distinct().join(per_query_metrics(run, qrels, cuts), "query_id", "left")
    hits = [F.round(F.avg(F.coalesce(f"hit_{c}", F.lit(0))), 6).alias(f"hit_rate_{c}") for c in cuts]
    ndcg = [F.round(F.avg(f"ndcg_{c}"), 6).alias(f"ndcg_{c}") for c in cuts]
    return rows.agg(*hits, F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"), *ndcg)


def sample_report(run: DataFrame, qrels: DataFrame, n: int = 3) -> DataFrame:
    """``(query_id, rank, doc_id, relevant, n_relevant)`` of the n smallest query ids of a
    run: what was found, whether it is relevant, and how many are."""
    some = run.select("query_id").distinct().orderBy("query_id").limit(n)
    counts = qrels.where("relevance > 0").join(some, "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    rows = judged(run.join(some, "query_id", "left_semi"), qrels).join(counts, "query_id", "left")
    return rows.select("query_id", "rank", "doc_id", (F.col("relevance") > 0).alias("relevant"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))
