"""Queries for ranking and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import evaluation, search

from . import views as V

K, DEPTH = 10, 50


def dense_topk(spark, sf_dir):
    hits = search.dense_topk(V.vector_queries(spark, sf_dir), V.vectors(spark, sf_dir), K)
    return hits.select("query_id", "rank", "paper_id", F.round("score", 6).alias("score"))


def bm25_stats(spark, sf_dir):
    s = search.term_statistics(V.texts(spark, sf_dir))
    return s.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    hits = search.bm25_topk(V.text_queries(spark, sf_dir), V.texts(spark, sf_dir), K)
    return hits.select("query_id", "rank", "paper_id", F.round("score", 6).alias("score"))


def _match(spark, sf_dir, **how):
    return search.field_match(V.field_queries(spark, sf_dir), V.fields(spark, sf_dir), K, **how)


def _hits(df):
    return df.select("query_id", "rank", "paper_id", F.round("score", 6).alias("score"), "n_fields")


def field_match(spark, sf_dir):
    return _hits(_match(spark, sf_dir))


def field_match_norm(spark, sf_dir):
    return _hits(_match(spark, sf_dir, normalised=True))


def field_match_norm2(spark, sf_dir):
    return _hits(_match(spark, sf_dir, normalised=True, least_fields=2))


def field_cosines(spark, sf_dir):
    return _match(spark, sf_dir).select("query_id", "rank", "paper_id", *[F.round(f, 6).alias(f) for f in V.FIELDS])


def _item_vectors(spark, sf_dir):
    """The dense query of a test item is the vector with its number."""
    return V.text_queries(spark, sf_dir).join(V.vectors(spark, sf_dir), F.col("query_id") == F.col("paper_id")).select("query_id", "embedding")


def signals(spark, sf_dir, *, anchored):
    dense = search.dense_topk(_item_vectors(spark, sf_dir), V.vectors(spark, sf_dir), DEPTH)
    lexical = search.bm25_topk(V.text_queries(spark, sf_dir), V.texts(spark, sf_dir), DEPTH)
    found = search.signal(dense, "dense").unionByName(search.signal(lexical, "bm25"))
    if anchored:
        cards = V.fields(spark, sf_dir)
        items = V.text_queries(spark, sf_dir).select("query_id").join(cards.withColumnRenamed("paper_id", "query_id"), "query_id")
        found = found.unionByName(search.signal(search.field_match(items, cards, DEPTH), "method_match"))
    return found


def _fused(df):
    return df.select("query_id", "rank", "paper_id", *[F.round(c, 6).alias(c) for c in ("score", "dense", "bm25", "method_match")])


def rrf_hybrid(spark, sf_dir):
    return _fused(search.fuse(signals(spark, sf_dir, anchored=False), K))


def rrf_hybrid_anchored(spark, sf_dir):
    return _fused(search.fuse(signals(spark, sf_dir, anchored=True), K))


def search_enriched(spark, sf_dir):
    hits = search.fuse(signals(spark, sf_dir, anchored=False), K).select("query_id", "rank", "paper_id")
    papers = V.papers(spark, sf_dir).select("paper_id", F.md5("title").alias("title_md5"), "origin")
    cards = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), F.col("label").alias("card"))
    return search.enriched(hits, papers, cards)


def score_spread(spark, sf_dir):
    s = signals(spark, sf_dir, anchored=True).where("query_id <> paper_id OR signal = 'bm25'")
    return search.spread(s, 5, ("query_id", "signal")).select("query_id", "signal", F.round("spread", 6).alias("spread"))


def rerank_topk(spark, sf_dir):
    """Reranks lexical hits by shared words, in place of a model."""

    def shared_words(a, b):
        return [len(set(x.lower().split()) & set(y.lower().split())) / (1 + len(set(x.lower().split()))) for x, y in zip(a, b, strict=True)]

    queries, docs = V.text_queries(spark, sf_dir), V.texts(spark, sf_dir)
    hits = search.bm25_topk(queries, docs, K)
    return search.rerank(hits, queries, docs, shared_words, K).select("query_id", "rank", "paper_id", F.round("score", 6).alias("score"))


METHODS = ["dense", "bm25", "method_match", "method_match_norm", "method_match_norm2", "hybrid"]


def _anchored(spark, sf_dir):
    """The test items whose number is a card with a field."""
    cards = V.fields(spark, sf_dir).where(F.coalesce(*[F.size(f) for f in V.FIELDS]).isNotNull())
    return V.text_queries(spark, sf_dir).join(cards, F.col("query_id") == F.col("paper_id"), "left_semi").select("query_id")


def runs(spark, sf_dir):
    s = signals(spark, sf_dir, anchored=True)
    found = s.where(F.col("rank") <= K).select("query_id", "paper_id", F.col("signal").alias("method"), "rank")
    cards = V.fields(spark, sf_dir)
    items = V.text_queries(spark, sf_dir).select("query_id").join(cards.withColumnRenamed("paper_id", "query_id"), "query_id")
    for name, least in (("method_match_norm", 1), ("method_match_norm2", 2)):
        hits = search.field_match(items, cards, K, normalised=True, least_fields=least)
        found = found.unionByName(hits.select("query_id", "paper_id", F.lit(name).alias("method"), "rank"))
    return found.unionByName(search.fuse(s, K).select("query_id", "paper_id", F.lit("hybrid").alias("method"), "rank"))


def _metrics(spark, sf_dir):
    return evaluation.per_query(runs(spark, sf_dir), V.gold(spark, sf_dir), methods=METHODS, anchored=_anchored(spark, sf_dir))


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in ("ndcg", "mrr", "recall") else F.col(c) for c in (names or df.columns)])


def eval_per_query(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir))


def eval_full(spark, sf_dir):
    return _rounded(evaluation.by_method(_metrics(spark, sf_dir)))


def eval_same_subset(spark, sf_dir):
    return _rounded(evaluation.by_method(evaluation.same_subset(_metrics(spark, sf_dir), _anchored(spark, sf_dir))))


def eval_verdict(spark, sf_dir):
    return evaluation.verdict(evaluation.by_method(evaluation.same_subset(_metrics(spark, sf_dir), _anchored(spark, sf_dir))))


def eval_low_score(spark, sf_dir):
    return _rounded(evaluation.low_scores(_metrics(spark, sf_dir)).select("method", "query_id", "ndcg", F.lit("!").alias("flag")))


DENSE_SQL = f"""
WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS paper_id, {V.dot_sql("a.embedding", "b.embedding")} AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, round(score, 6) AS score FROM r WHERE rank <= {K}
"""

STATISTICS = f"""words AS MATERIALIZED (SELECT doc_id AS paper_id, {V.tokens_sql("text")} AS t FROM documents),
dl AS (SELECT paper_id, len(t) AS dl FROM words),
tf AS MATERIALIZED (SELECT paper_id, term, count(*) AS tf FROM (SELECT paper_id, unnest(t) AS term FROM words) GROUP BY ALL),
totals AS MATERIALIZED (SELECT count(*) AS n FROM words),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean)"""


def _bm25(k: int) -> str:
    return f"""{STATISTICS},
terms AS (
  SELECT query_id, term, count(*) AS times
  FROM (SELECT item_id AS query_id, unnest({V.tokens_sql("text")}) AS term FROM benchmark) GROUP BY ALL),
sums AS (
  SELECT query_id, tf.paper_id,
         sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))) AS score
  FROM terms JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.paper_id = tf.paper_id GROUP BY ALL),
every AS (
  SELECT q.query_id, d.doc_id AS paper_id, coalesce(score, 0.0) AS score
  FROM (SELECT DISTINCT query_id FROM terms) q CROSS JOIN documents d
  LEFT JOIN sums ON sums.query_id = q.query_id AND sums.paper_id = d.doc_id),
lexical AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) AS rank FROM every)
  WHERE rank <= {k})"""


BM25_SQL = f"WITH {_bm25(K)} SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, round(score, 6) AS score FROM lexical"


def _match_sql(score: str, columns: str) -> str:
    return f"""
WITH {V.FIELD_TABLE}, {V.COSINES},
r AS (
  SELECT *, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, paper_id) AS rank FROM matches)
SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, {columns} FROM r WHERE rank <= {K}
"""


NORM = "CASE WHEN n_fields >= {} THEN plain / used ELSE 0.0 END"
HITS = "round(score, 6) AS score, CAST(n_fields AS INTEGER) AS n_fields"

_COSINES_ALL = V.COSINES.replace("WHERE a.paper_id % 50 = 0 AND", "WHERE a.paper_id IN (SELECT item_id FROM benchmark) AND")


def _signals(anchored: bool) -> str:
    match = f""",
{V.FIELD_TABLE}, {_COSINES_ALL},
matched AS (
  SELECT * FROM (SELECT query_id, paper_id, plain AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(plain, 9) DESC, paper_id) AS rank FROM matches)
  WHERE rank <= {DEPTH})"""
    return f"""{_bm25(DEPTH)},
dense_all AS (
  SELECT a.vec_id AS query_id, b.vec_id AS paper_id, {V.dot_sql("a.embedding", "b.embedding")} AS score
  FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
dense AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) AS rank FROM dense_all)
  WHERE rank <= {DEPTH}){match if anchored else ""},
signals AS (
  SELECT query_id, paper_id, 'dense' AS signal, 0.4 AS w, score, rank FROM dense
  UNION ALL SELECT query_id, paper_id, 'bm25', 0.2, score, rank FROM lexical
  {"UNION ALL SELECT query_id, paper_id, 'method_match', 0.4, score, rank FROM matched" if anchored else ""}),
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) AS rank FROM (
      SELECT query_id, paper_id, sum(CAST(w AS DOUBLE) / (60 + rank)) AS score, max(CASE WHEN signal = 'dense' THEN score END) AS dense,
             max(CASE WHEN signal = 'bm25' THEN score END) AS bm25, max(CASE WHEN signal = 'method_match' THEN score END) AS method_match
      FROM signals GROUP BY ALL)) WHERE rank <= {K})"""


FUSED = "SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, round(score, 6) AS score, round(dense, 6) AS dense, round(bm25, 6) AS bm25, round(CAST(method_match AS DOUBLE), 6) AS method_match FROM fused"

METRICS = f"""{_signals(True)}, {V.GOLD},
runs AS (
  SELECT query_id, paper_id, signal AS method, rank FROM signals WHERE rank <= {K}
  UNION ALL SELECT query_id, paper_id, 'method_match_norm', row_number() OVER (PARTITION BY query_id ORDER BY round({NORM.format(1)}, 9) DESC, paper_id) AS r FROM matches QUALIFY r <= {K}
  UNION ALL SELECT query_id, paper_id, 'method_match_norm2', row_number() OVER (PARTITION BY query_id ORDER BY round({NORM.format(2)}, 9) DESC, paper_id) AS r FROM matches QUALIFY r <= {K}
  UNION ALL SELECT query_id, paper_id, 'hybrid', rank FROM fused),
sizes AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
anchored AS (SELECT paper_id AS query_id FROM fields WHERE coalesce(task, backbone, loss, key_idea) IS NOT NULL),
asked AS (
  SELECT method, query_id, n_gold FROM sizes, (SELECT unnest({METHODS}) AS method)
  WHERE NOT starts_with(method, 'method_match') OR query_id IN (SELECT query_id FROM anchored)),
hits AS (SELECT r.* FROM runs r JOIN gold g ON g.query_id = r.query_id AND g.paper_id = r.paper_id),
per_query AS (
  SELECT method, query_id,
         coalesce(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0) ELSE 0 END), 0)
           / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda i: 1 / log2(i + 1.0))) AS ndcg,
         coalesce(1.0 / min(rank), 0) AS mrr, count(rank) / n_gold AS recall
  FROM asked LEFT JOIN hits USING (method, query_id) GROUP BY method, query_id, n_gold),
same AS (SELECT * FROM per_query WHERE method <> 'bm25' AND query_id IN (SELECT query_id FROM anchored)),
by_method AS (SELECT method, count(*) AS n, avg(ndcg) AS ndcg, avg(mrr) AS mrr, avg(recall) AS recall FROM per_query GROUP BY 1),
by_same AS (SELECT method, count(*) AS n, avg(ndcg) AS ndcg, avg(mrr) AS mrr, avg(recall) AS recall FROM same GROUP BY 1)"""

ROUNDED = "round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(recall, 6) AS recall"

ORACLE = {
    "dense_topk": DENSE_SQL,
    "bm25_stats": f"WITH {STATISTICS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": BM25_SQL,
    "field_match": _match_sql("plain", HITS),
    "field_match_norm": _match_sql(NORM.format(1), HITS),
    "field_match_norm2": _match_sql(NORM.format(2), HITS),
    "field_cosines": _match_sql("plain", ", ".join(f"round({f}, 6) AS {f}" for f in V.FIELDS)),
    "rrf_hybrid": f"WITH {_signals(False)} {FUSED}",
    "rrf_hybrid_anchored": f"WITH {_signals(True)} {FUSED}",
    "search_enriched": f"WITH {_signals(False)}, {V.PAPERS} SELECT query_id, CAST(rank AS INTEGER) AS rank, f.paper_id, md5(title) AS title_md5, origin, label AS card FROM fused f LEFT JOIN papers p ON p.paper_id = f.paper_id LEFT JOIN embeddings e ON e.vec_id = f.paper_id",
    "score_spread": f"WITH {_signals(True)} SELECT query_id, signal, round(max(score) - min(score), 6) AS spread FROM signals WHERE rank <= 5 AND (query_id <> paper_id OR signal = 'bm25') GROUP BY ALL",
    "eval_per_query": f"WITH {METRICS} SELECT method, query_id, {ROUNDED} FROM per_query",
    "eval_full": f"WITH {METRICS} SELECT method, n, {ROUNDED} FROM by_method",
    "eval_same_subset": f"WITH {METRICS} SELECT method, n, {ROUNDED} FROM by_same",
    "eval_verdict": f"WITH {METRICS}, d AS (SELECT s.method, round(s.ndcg - b.ndcg, 6) AS delta FROM by_same s, by_same b WHERE b.method = 'dense' AND b.ndcg > 0 AND s.method <> 'dense') SELECT method, delta, CASE WHEN delta > 0 THEN 'BEATS' WHEN delta = 0 THEN 'matches' ELSE 'BELOW' END AS verdict, CASE WHEN delta < 0 THEN 2 ELSE 0 END AS code FROM d",
    "eval_low_score": f"WITH {METRICS} SELECT method, query_id, round(ndcg, 6) AS ndcg, '!' AS flag FROM per_query WHERE coalesce(ndcg, 0) < 0.3",
}

QUERIES = (
    dense_topk, bm25_stats, bm25_topk, field_match, field_match_norm, field_match_norm2, field_cosines, rrf_hybrid,
    rrf_hybrid_anchored, search_enriched, score_spread, rerank_topk, eval_per_query, eval_full, eval_same_subset,
    eval_verdict, eval_low_score,
)
