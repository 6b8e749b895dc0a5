"""Queries of ranking and its metrics, with their SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.common import table
from quillgraph.operators import retrieval as R


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def _cases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_cases").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"), "topic")


def _qrels(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "topic")
    return _cases(s, d).select("query_id", "topic").join(docs, "topic").select("query_id", "doc_id", F.lit(1.0).alias("relevance"))


def _bm25(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    return R.top_k(R.bm25_scores(_docs(s, d), _cases(s, d)), k)


def _overlap(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    """A second run: the number of different query terms a document has."""
    terms = _cases(s, d).select("query_id", F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("term"))
    docs = _docs(s, d).select("doc_id", F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("term"))
    return R.top_k(docs.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score")), k)


def bm25_topk(s, d):
    return _bm25(s, d).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def bm25_idf(s, d):
    return R.bm25_idf_table(_docs(s, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def rrf_fusion(s, d):
    return R.reciprocal_rank_fusion([_bm25(s, d), _overlap(s, d)], 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def linear_ltr(s, d):
    run = _bm25(s, d, 20).join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    run = run.withColumnRenamed("score", "bm25").withColumn("inverse_rank", 1 / F.col("rank")).drop("rank")
    return R.linear_rerank(run, {"bm25": 0.5, "inverse_rank": 2.0, "n_chars": 0.001}, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def simple_hybrid(s, d):
    words = F.filter(F.split("text", r"\s+"), lambda t: t.rlike(r"^\p{Lu}") & (F.length(t) > 2))
    names = _cases(s, d).select("query_id", words.alias("names"))
    return R.entity_boost(_bm25(s, d, 20), _docs(s, d), names, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def metrics(s, d):
    return R.run_metrics(_bm25(s, d), _qrels(s, d), _cases(s, d))


def hit_rate_at_k(s, d):
    return metrics(s, d).select("hit_rate_1", "hit_rate_3", "hit_rate_5", "hit_rate_10")


def mrr(s, d):
    return metrics(s, d).select("mrr")


def ndcg_at_k(s, d):
    return metrics(s, d).select("ndcg_1", "ndcg_3", "ndcg_5", "ndcg_10")


def metrics_by_topic(s, d):
    rows = _cases(s, d).select("query_id", "topic").join(R.per_query_metrics(_bm25(s, d), _qrels(s, d)), "query_id", "left")
    rows = rows.na.fill(0, ["hit_1", "hit_10"]).na.fill(0.0, ["rr"])
    return rows.rollup("topic").agg(F.count("*").alias("n_queries"), F.round(F.avg("hit_1"), 6).alias("hit_rate_1"), F.round(F.avg("hit_10"), 6).alias("hit_rate_10"), F.round(F.avg("rr"), 6).alias("mrr"), F.grouping("topic").cast("int").alias("overall"))


def retriever_comparison(s, d):
    from functools import reduce

    from pyspark.sql import Window

    runs = {"bm25": _bm25(s, d), "overlap": _overlap(s, d), "fused": R.reciprocal_rank_fusion([_bm25(s, d), _overlap(s, d)], 10)}
    rows = reduce(DataFrame.unionByName, (R.run_metrics(run, _qrels(s, d), _cases(s, d)).select(F.lit(name).alias("retriever"), "hit_rate_1", "hit_rate_10", "mrr") for name, run in runs.items()))
    base = F.max(F.when(F.col("retriever") == "bm25", F.col("mrr"))).over(Window.partitionBy())
    winner = F.max_by("retriever", F.struct("mrr", "retriever")).over(Window.partitionBy())
    return rows.withColumn("mrr_delta_pct", F.round(F.when(base > 0, (F.col("mrr") - base) / base * 100).otherwise(0.0), 4)).withColumn("winner", (F.col("retriever") == winner).cast("int"))


def sample_report(s, d):
    return R.sample_report(_bm25(s, d, 5), _qrels(s, d))


def _queries_of(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.where(F.col(key) % 100 == 0).select(F.col(key).alias("query_id"), "embedding")


def cosine_topk(s, d):
    v = table(s, d, "embeddings")
    found = R.vector_top_k(v.select(F.col("vec_id").alias("doc_id"), "embedding"), _queries_of(v, "vec_id"), 10)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def entity_vector_search(s, d):
    e = table(s, d, "entities").where("embedding IS NOT NULL")
    found = R.vector_top_k(e.select(F.col("entity_id").alias("doc_id"), "embedding"), _queries_of(e, "entity_id"), 5)
    return found.select("query_id", "rank", "doc_id", F.round("score", 5).alias("score"))


def mmr(s, d):
    v = table(s, d, "embeddings")
    found = R.vector_top_k(v.select(F.col("vec_id").alias("doc_id"), "embedding"), _queries_of(v, "vec_id"), 30)
    return R.maximal_marginal_relevance(found.drop("rank").join(v.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id"), 10)


def cross_encoder(s, d):
    def predict(queries, texts):
        sets = [({*q.lower().split()}, {*t.lower().split()}) for q, t in zip(queries, texts)]
        return [len(a & b) / max(1, len(a | b)) for a, b in sets]

    pairs = _bm25(s, d, 20).select("query_id", "doc_id").join(_docs(s, d), "doc_id").join(_cases(s, d).select("query_id", F.col("text").alias("query")), "query_id")
    return R.model_rerank(pairs, predict, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_idf, rrf_fusion, linear_ltr, simple_hybrid, hit_rate_at_k, mrr, ndcg_at_k, metrics_by_topic, retriever_comparison, sample_report, cosine_topk, entity_vector_search, mmr, cross_encoder)}

_RUN = r"""
tok AS (SELECT doc_id, unnest([x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '\s+') IF x <> '']) AS term FROM documents),
size AS (SELECT d.doc_id, count(t.term) AS len FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest([x FOR x IN regexp_split_to_array(lower(question), '\s+') IF x <> '']) AS term FROM eval_cases),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY 1, 2),
bm AS (
  SELECT query_id, doc_id, sum(qtf * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM size)))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id) GROUP BY 1, 2
),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm),
ov AS (SELECT query_id, doc_id, CAST(count(*) AS DOUBLE) AS score FROM (SELECT DISTINCT query_id, term FROM q) JOIN (SELECT DISTINCT doc_id, term FROM tok) USING (term) GROUP BY 1, 2),
overlap AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ov),
fz AS (SELECT query_id, doc_id, sum(1 / (60.0 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, rank FROM overlap WHERE rank <= 10) GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM fz),
qrels AS (SELECT item_id AS query_id, doc_id FROM eval_cases e JOIN documents d ON d.topic = e.topic WHERE d.text IS NOT NULL),
n_rel AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1),
runs AS (
  SELECT 'bm25' AS retriever, query_id, doc_id, rank FROM bm25 WHERE rank <= 10
  UNION ALL SELECT 'overlap', query_id, doc_id, rank FROM overlap WHERE rank <= 10
  UNION ALL SELECT 'fused', query_id, doc_id, rank FROM fused WHERE rank <= 10
),
hits AS (SELECT r.*, x.doc_id IS NOT NULL AS hit FROM runs r LEFT JOIN qrels x USING (query_id, doc_id)),
perq AS (
  SELECT retriever, query_id, {cuts}, coalesce(max(CASE WHEN hit THEN 1.0 / rank END), 0) AS rr
  FROM hits LEFT JOIN n_rel USING (query_id) GROUP BY 1, 2
),
total AS (
  SELECT retriever, {means}, round(avg(coalesce(rr, 0)), 6) AS mrr
  FROM (SELECT DISTINCT retriever FROM runs) CROSS JOIN (SELECT item_id AS query_id, topic FROM eval_cases) LEFT JOIN perq USING (retriever, query_id) GROUP BY 1
)"""
_CUTS = ", ".join(
    f"max(CASE WHEN hit AND rank <= {c} THEN 1 ELSE 0 END) AS hit_{c}, CASE WHEN any_value(n) > 0 THEN coalesce(sum(CASE WHEN hit AND rank <= {c} THEN 1 / log2(rank + 1) END), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least({c}, any_value(n)) + 1)]) ELSE 0 END AS ndcg_{c}"
    for c in (1, 3, 5, 10)
)
_MEANS = ", ".join(f"round(avg(coalesce(hit_{c}, 0)), 6) AS hit_rate_{c}, round(avg(ndcg_{c}), 6) AS ndcg_{c}" for c in (1, 3, 5, 10))


@cache
def _with(select: str) -> str:
    return f"WITH {_RUN.format(cuts=_CUTS, means=_MEANS)}\n{select}"


def _nearest(name: str, key: str, k: int, where: str, digits: int) -> str:
    return f"""WITH v AS (SELECT {key} AS id, CAST(embedding AS DOUBLE[]) AS e FROM {name} WHERE {where}),
ok AS (SELECT * FROM v WHERE list_sum([x * x FOR x IN e]) > 0),
s AS (SELECT q.id AS query_id, d.id AS doc_id, list_cosine_similarity(q.e, d.e) AS score FROM ok q JOIN ok d ON len(q.e) = len(d.e) WHERE q.id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, {digits}) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""


ORACLE = {
    "bm25_topk": _with("SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM bm25 WHERE rank <= 10"),
    "bm25_idf": _with("SELECT term, df, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 6) AS idf FROM df"),
    "rrf_fusion": _with("SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM fused WHERE rank <= 10"),
    "linear_ltr": _with("""SELECT query_id, CAST(r AS INTEGER) AS rank, doc_id, round(s, 6) AS score FROM (
  SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS r
  FROM (SELECT query_id, doc_id, 0.5 * score + 2.0 / rank + 0.001 * coalesce(n_chars, 0) AS s FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 20)) WHERE r <= 10"""),
    "simple_hybrid": _with(r""", names AS (SELECT item_id AS query_id, [x FOR x IN regexp_split_to_array(question, '\s+') IF regexp_matches(x, '^\p{Lu}') AND length(x) > 2] AS names FROM eval_cases),
sc AS (SELECT b.query_id, b.doc_id, 0.7 / rank + 0.3 * least(1.0, len([x FOR x IN names IF contains(lower(coalesce(text, '')), lower(x))]) / greatest(1, len(names))) AS s
  FROM bm25 b JOIN documents d USING (doc_id) JOIN names n ON n.query_id = b.query_id WHERE rank <= 20)
SELECT query_id, CAST(r AS INTEGER) AS rank, doc_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS r FROM sc) WHERE r <= 10""".lstrip("\n")).replace(")\n, names", "),\nnames"),
    "hit_rate_at_k": _with("SELECT hit_rate_1, hit_rate_3, hit_rate_5, hit_rate_10 FROM total WHERE retriever = 'bm25'"),
    "mrr": _with("SELECT mrr FROM total WHERE retriever = 'bm25'"),
    "ndcg_at_k": _with("SELECT ndcg_1, ndcg_3, ndcg_5, ndcg_10 FROM total WHERE retriever = 'bm25'"),
    "metrics_by_topic": _with("""SELECT topic, count(*) AS n_queries, round(avg(coalesce(hit_1, 0)), 6) AS hit_rate_1, round(avg(coalesce(hit_10, 0)), 6) AS hit_rate_10, round(avg(coalesce(rr, 0)), 6) AS mrr, CAST(grouping(topic) AS INTEGER) AS overall
FROM (SELECT item_id AS query_id, topic FROM eval_cases) LEFT JOIN (SELECT * FROM perq WHERE retriever = 'bm25') USING (query_id) GROUP BY ROLLUP (topic)"""),
    "retriever_comparison": _with("""SELECT retriever, hit_rate_1, hit_rate_10, mrr, round(CASE WHEN b > 0 THEN (mrr - b) / b * 100 ELSE 0 END, 4) AS mrr_delta_pct, CAST(retriever = w AS INTEGER) AS winner
FROM total CROSS JOIN (SELECT max(CASE WHEN retriever = 'bm25' THEN mrr END) AS b, max_by(retriever, (mrr, retriever)) AS w FROM total)"""),
    "sample_report": _with("""SELECT h.query_id, CAST(rank AS INTEGER) AS rank, doc_id, hit AS relevant, coalesce(n, 0) AS n_relevant FROM hits h LEFT JOIN n_rel USING (query_id)
WHERE retriever = 'bm25' AND rank <= 5 AND h.query_id IN (SELECT query_id FROM bm25 WHERE rank <= 5 GROUP BY 1 ORDER BY 1 LIMIT 3)"""),
    "cosine_topk": _nearest("embeddings", "vec_id", 10, "embedding IS NOT NULL", 6),
    "entity_vector_search": _nearest("entities", "entity_id", 5, "embedding IS NOT NULL", 5),
}
