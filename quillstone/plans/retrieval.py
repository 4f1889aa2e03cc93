"""Registered retrieval queries: questions are the benchmark items, chunks the documents; vectors join on the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import collection, dense, fusion, lexicon, metrics, rerank
from ..sources import store
from ..sources.tables import spread
from ..sources.tables import table as _table
from . import search
from .indexes import documents_index, index_of

K = 10


def table(spark, sf, name):
    """A table; long texts of one small file are dealt over all cores."""
    df = _table(spark, sf, name)
    return spread(df) if name in ("documents", "pages") else df


def _corpus(spark: SparkSession, sf: str) -> search.Corpus:
    vectors = table(spark, sf, "embeddings")
    items = table(spark, sf, "benchmark")
    return search.Corpus(
        table(spark, sf, "documents").select("doc_id", "text"), vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), items,
        vectors.select(F.col("vec_id").alias("item_id"), "embedding").join(items.select("item_id"), "item_id", "left_semi"),
        index=index_of(spark, sf),
    )


def tokenize_legal(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.tokenize_legal(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


def tokenize_code(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.tokenize_code(F.concat(F.lit("Điều "), F.col("doc_id").cast("string"), F.lit(". 12/2024/TT-NHNN "), F.col("text"))).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.get("t", 0).alias("first_token"), F.md5(F.array_join("t", " ")).alias("digest"))


def term_stats(spark, sf):
    terms = lexicon.statistics(documents_index(spark, sf, "legal"), lexicon.views_of(spark, {"all": None}))
    return terms.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf):
    found = search.lexical(_corpus(spark, sf), K)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_positive_only(spark, sf):
    return search.lexical(_corpus(spark, sf), K, "code").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.cosine_top_k(v, q, "vec_id", "query_id", "embedding", K)


def collection_topk(spark, sf):
    """A stored collection, every tenth vector of which was another one before an upsert."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    path, tenth = store.fresh_folder(spark, "collection"), F.col("vec_id") % 10 == 3
    before = F.transform("embedding", lambda x: (x * F.lit(-1)).cast("float"))
    collection.build(v.withColumn("embedding", F.when(tenth, before).otherwise(F.col("embedding"))), path, "vec_id", "embedding", 64)
    collection.upsert(v.filter(tenth), path)
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return collection.search(spark, path, q, "query_id", K)[0].select("query_id", "vec_id", "similarity", "distance", "rank")


def l2_normalize(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", T.l2_normalize(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(T.norm(F.col("u")), 6).alias("length"), F.round(F.get("u", 0), 6).alias("first"))


def validate_vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    spoiled = F.when(F.col("vec_id") % 5 == 1, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 5 == 2, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 5 == 3, F.concat(F.slice("embedding", 1, 63), F.array(F.lit("NaN").cast("float")))).otherwise(F.col("embedding"))
    return v.select("vec_id", F.array_join(dense.vector_faults(spoiled, 64), ",").alias("faults"))


def _fused(spark, sf, weights=(1.0, 1.0)) -> DataFrame:
    return search.hybrid(_corpus(spark, sf), search.SearchConfig(top_k=K, candidate_k=20), weights)


def rrf_hybrid(spark, sf):
    return _fused(spark, sf).select("item_id", "doc_id", "bm25_rank", "semantic_rank", F.round("rrf_score", 9).alias("rrf_score"), "fused_rank", "matched_by")


def rrf_weighted(spark, sf):
    return _fused(spark, sf, (0.7, 0.3)).select("item_id", "doc_id", F.round("rrf_score", 9).alias("rrf_score"), "fused_rank")


def rrf_overlap_stats(spark, sf):
    return fusion.overlap(_fused(spark, sf), "item_id")


def cross_query_rrf(spark, sf):
    # four items stand for the queries of one question
    hits = search.lexical(_corpus(spark, sf), 20).select(F.floor(F.col("item_id") / 4).alias("question_id"), "item_id", "doc_id", F.col("rank").alias("fused_rank"))
    found = fusion.fuse_queries(hits, "question_id", "item_id", "doc_id")
    ranks = F.array_join(F.transform(F.map_entries("per_query_ranks"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("question_id", "doc_id", F.round("score", 9).alias("score"), "support", "best_rank", "multi_query_rank", ranks.alias("ranks"))


def query_matrix_pivot(spark, sf):
    hits = search.lexical(_corpus(spark, sf), 20).select(F.floor(F.col("item_id") / 4).alias("question_id"), F.concat(F.lit("q"), (F.col("item_id") % 4).cast("string")).alias("mode"), "doc_id", "rank")
    return metrics.compare_modes(hits, "question_id", "doc_id", ["q0", "q1", "q2", "q3"])


def rerank_lexical(spark, sf):
    found = search.reranked(_corpus(spark, sf), search.SearchConfig(top_k=K))
    return found.select("item_id", "doc_id", "fused_rank", F.round("rerank_score", 4).alias("rerank_score"))


def rank_change(spark, sf):
    c = _corpus(spark, sf)
    both = search.lexical(c, 20).select("item_id", "doc_id", F.col("rank").alias("before"), F.length(F.col("doc_id").cast("string")).alias("n"))
    ranked = rerank.rerank(both.withColumn("s", F.col("doc_id") % 7), "item_id", "doc_id", "s", "before", 20, 20)
    return ranked.select("item_id", "doc_id", "before", F.col("final_rank").alias("after"), "rank_change")


def sigmoid_gate(spark, sf):
    found = search.evidence(_corpus(spark, sf), "semantic", search.SearchConfig(top_k=K, max_distance=0.75))
    return found.select("item_id", "doc_id", "rank", "accepted", "label", F.round(T.sigmoid(F.col("score")), 6).alias("squashed"))


def _qrels(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").filter("quality = 1").select((F.col("doc_id") % table(spark, sf, "benchmark").count()).alias("item_id"), "doc_id")


def recall_mrr_ndcg(spark, sf):
    c = _corpus(spark, sf)
    out = metrics.ranking_metrics(search.lexical(c, K), _qrels(spark, sf), c.questions, "item_id", "doc_id", K)
    return out.select("item_id", *(F.round(m, 6).alias(m) for m in ("recall", "mrr", "ndcg")))


def _modes(spark, sf) -> DataFrame:
    return search.retrieve_modes(_corpus(spark, sf), ["bm25", "semantic", "hybrid"], search.SearchConfig(top_k=K))


def hit_at_k_grouping(spark, sf):
    # an item's gold document is the one of its id; its kind is the parity of the id
    hits = _modes(spark, sf).filter("doc_id = item_id").select("mode", "item_id", "rank")
    grid = table(spark, sf, "benchmark").select("item_id").withColumn("mode", F.explode(F.array(*map(F.lit, ["bm25", "semantic", "hybrid"]))))
    ranks = grid.join(hits, ["mode", "item_id"], "left").withColumn("kind", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")).withColumn("doc_rank", F.col("rank"))
    return metrics.hit_rates(ranks, "mode", "kind", "rank", "doc_rank")


def mode_compare(spark, sf):
    return metrics.compare_modes(_modes(spark, sf), "item_id", "doc_id", ["bm25", "semantic", "hybrid"])


def top_changed(spark, sf):
    return metrics.top_changed(_modes(spark, sf), "item_id", "doc_id", "bm25", "hybrid")


def latency_p50(spark, sf):
    out = metrics.latency(table(spark, sf, "events"), "event_type", "value")
    return out.select("event_type", F.round("mean", 4).alias("mean"), F.round("p50", 4).alias("p50"), "n")


def judge_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (1 - F.col("l_discount")).alias("faithfulness"), (1 - F.col("l_tax")).alias("relevancy"), (F.col("l_quantity") / 50).alias("precision"))
    return metrics.worst_metric(rows, ["faithfulness", "relevancy", "precision"], 0.3).groupBy("worst", "low").agg(F.count("*").alias("n"), F.round(F.avg("worst_value"), 4).alias("mean_worst"))


_TOKENS = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"
_CODE = r"""list_concat(list_transform(regexp_extract_all(lower({text}), 'điều\s+(\d+[a-zà-ỹ]?)', 1), lambda n: 'điều_' || n),
 flatten(list_transform(regexp_extract_all(lower({text}), '[0-9a-zA-ZÀ-ỹ]+(?:[/\-][0-9a-zA-ZÀ-ỹ]+)*'), lambda t: CASE WHEN regexp_matches(t, '[/\-]') THEN list_concat([t], list_filter(regexp_split_to_array(t, '[/\-]'), lambda p: length(p) >= 2)) ELSE [t] END)))"""


def bm25_sql(tokens: str = _TOKENS, docs: str = "documents", fill: bool = True, k: int = K, positive: bool = False) -> str:
    """WITH parts that end in lex(item_id, doc_id, score, rank)."""
    own = tokens.format(text="text")
    zero = f"UNION ALL SELECT item_id, doc_id, 0.0 FROM benchmark, (SELECT doc_id FROM {docs} ORDER BY doc_id LIMIT {k})" if fill else ""
    return f"""
sizes AS MATERIALIZED (SELECT doc_id, {own} AS toks FROM {docs}),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM sizes) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS av FROM sizes),
raw AS MATERIALIZED (SELECT term, df, cf, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term), tot),
terms AS (SELECT term, df, cf, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw, (SELECT avg(r) AS m FROM raw)),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({own}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / av))) AS score FROM post JOIN asked USING (term) JOIN terms USING (term), tot GROUP BY ALL),
padded AS (SELECT item_id, doc_id, max(score) AS score FROM (SELECT * FROM scored {zero}) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM padded) WHERE rank <= {k} {"AND score > 0" if positive else ""})"""


def cosine_sql(k: int) -> str:
    """WITH parts that end in sem(item_id, doc_id, similarity, rank)."""
    return f"""
simi AS (SELECT q.vec_id AS item_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM simi) WHERE rank <= {k})"""


def fused_sql(a: float = 1.0, b: float = 1.0, k: int = 20) -> str:
    return f"""{bm25_sql(k=k)}, {cosine_sql(k)},
both_ AS (SELECT item_id, doc_id, l.rank AS bm25_rank, s.rank AS semantic_rank, s.similarity, coalesce({a} / (60 + l.rank), 0.0) + coalesce({b} / (60 + s.rank), 0.0) AS rrf_score FROM lex l FULL JOIN sem s USING (item_id, doc_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf_score, 9) DESC, least(bm25_rank, semantic_rank), semantic_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST, doc_id) AS fused_rank FROM both_)"""


def modes_sql() -> str:
    return f"""{fused_sql()},
modes AS (SELECT item_id, doc_id, rank, 'bm25' AS mode FROM lex WHERE rank <= {K} UNION ALL SELECT item_id, doc_id, rank, 'semantic' FROM sem WHERE rank <= {K} UNION ALL SELECT item_id, doc_id, fused_rank, 'hybrid' FROM fused WHERE fused_rank <= {K})"""


_LEX20 = bm25_sql(k=20)
_CQ = "floor(item_id / 4)::BIGINT"

QUERIES = {
    f.__name__: f
    for f in (
        tokenize_legal, tokenize_code, term_stats, bm25_topk, bm25_positive_only, cosine_topk, collection_topk, l2_normalize, validate_vectors, rrf_hybrid, rrf_weighted, rrf_overlap_stats, cross_query_rrf,
        query_matrix_pivot, rerank_lexical, rank_change, sigmoid_gate, recall_mrr_ndcg, hit_at_k_grouping, mode_compare, top_changed, latency_p50, judge_metrics,
    )
}

ORACLES = {
    "tokenize_legal": f"SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS.format(text='text')} AS t FROM documents)",
    "tokenize_code": "SELECT doc_id, len(t)::INTEGER AS n_tokens, t[1] AS first_token, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, " + _CODE.format(text="('Điều ' || doc_id || '. 12/2024/TT-NHNN ' || text)") + " AS t FROM documents)",
    "term_stats": f"WITH toks AS MATERIALIZED (SELECT doc_id, {_TOKENS.format(text='text')} AS t FROM documents), counted AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY term), raw AS (SELECT term, df, cf, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM counted, (SELECT count(*) AS n FROM documents)) SELECT term, df, cf, round(CASE WHEN r < 0 THEN 0.25 * m ELSE r END, 6) AS idf FROM raw, (SELECT avg(r) AS m FROM raw)",
    "bm25_topk": f"WITH {bm25_sql()} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM lex",
    "bm25_positive_only": f"WITH {bm25_sql(_CODE, fill=False, positive=True)} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM lex",
    "cosine_topk": f"SELECT query_id, vec_id, similarity, round(1 - similarity, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= {K}",
    "l2_normalize": "SELECT vec_id, round(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, 6) AS length, round(embedding[1]::DOUBLE / CASE WHEN n > 0 THEN n ELSE 1 END, 6) AS first FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)",
    "validate_vectors": "SELECT vec_id, CASE vec_id % 5 WHEN 1 THEN 'dimension' WHEN 2 THEN 'zero' WHEN 3 THEN 'nan' ELSE '' END AS faults FROM embeddings",
    "rrf_hybrid": f"WITH {fused_sql()} SELECT item_id, doc_id, bm25_rank, semantic_rank, round(rrf_score, 9) AS rrf_score, fused_rank, concat_ws('+', CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN semantic_rank IS NOT NULL THEN 'semantic' END) AS matched_by FROM fused",
    "rrf_weighted": f"WITH {fused_sql(0.7, 0.3)} SELECT item_id, doc_id, round(rrf_score, 9) AS rrf_score, fused_rank FROM fused",
    "rrf_overlap_stats": f"WITH {fused_sql()} SELECT item_id, count(*) AS n_union, count(*) FILTER (bm25_rank IS NOT NULL AND semantic_rank IS NOT NULL) AS n_overlap, count(*) FILTER (semantic_rank IS NULL) AS n_bm25_only, count(*) FILTER (bm25_rank IS NULL) AS n_semantic_only FROM fused GROUP BY item_id",
    "cross_query_rrf": f"WITH {_LEX20}, g AS (SELECT {_CQ} AS question_id, doc_id, sum(1.0 / (60 + rank)) AS score, count(*) AS support, min(rank) AS best_rank, string_agg(item_id || '=' || rank, ',' ORDER BY item_id::VARCHAR) AS ranks FROM lex GROUP BY ALL) SELECT question_id, doc_id, round(score, 9) AS score, support, best_rank, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, support DESC, best_rank, doc_id) AS multi_query_rank, ranks FROM g",
    "query_matrix_pivot": f"WITH {_LEX20} SELECT {_CQ} AS question_id, doc_id, " + ", ".join(f"min(rank) FILTER (item_id % 4 = {i}) AS q{i}" for i in range(4)) + " FROM lex GROUP BY 1, 2",
    "rank_change": f"WITH {_LEX20} SELECT item_id, doc_id, rank AS before, after, rank - after AS rank_change FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id % 7 DESC, rank, doc_id) AS after FROM lex)",
    "sigmoid_gate": f"WITH {cosine_sql(K)}, a AS (SELECT item_id, doc_id, rank, round(1 - similarity, 6) <= 0.75 AS accepted, similarity FROM sem) SELECT item_id, doc_id, rank, accepted, CASE WHEN accepted THEN 'E' || sum(accepted::INTEGER) OVER (PARTITION BY item_id ORDER BY rank)::BIGINT END AS label, round(1 / (1 + exp(-similarity)), 6) AS squashed FROM a",
    "recall_mrr_ndcg": f"WITH {bm25_sql()}, rel AS (SELECT DISTINCT doc_id % (SELECT count(*) FROM benchmark) AS item_id, doc_id FROM labels WHERE quality = 1), hit AS (SELECT item_id, count(*) AS h, min(rank) AS f, sum(1.0 / log2(rank + 1)) AS dcg FROM lex JOIN rel USING (item_id, doc_id) GROUP BY item_id), n AS (SELECT item_id, count(*) AS n FROM rel GROUP BY item_id) SELECT item_id, round(coalesce(h / n, 0), 6) AS recall, round(coalesce(1.0 / f, 0), 6) AS mrr, round(coalesce(dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(n, {K}) + 1) r(i)), 0), 6) AS ndcg FROM benchmark LEFT JOIN n USING (item_id) LEFT JOIN hit USING (item_id)",
    "hit_at_k_grouping": f"WITH {modes_sql()}, grid AS (SELECT item_id, m AS mode, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM benchmark, unnest(['bm25', 'semantic', 'hybrid']) u(m)), r AS (SELECT grid.*, rank FROM grid LEFT JOIN modes ON modes.item_id = grid.item_id AND modes.mode = grid.mode AND doc_id = grid.item_id) SELECT mode, kind, count(*) AS n, " + ", ".join(f"round(avg((coalesce(rank, 99) <= {k})::INTEGER), 4) AS hit_{k}" for k in (1, 3, 5)) + ", round(avg(coalesce(CASE WHEN rank <= 5 THEN 1.0 / rank END, 0)), 4) AS mrr, round(avg((coalesce(rank, 99) <= 5)::INTEGER), 4) AS doc_hit_5 FROM r GROUP BY GROUPING SETS ((mode), (mode, kind))",
    "mode_compare": f"WITH {modes_sql()} SELECT item_id, doc_id, " + ", ".join(f"min(rank) FILTER (mode = '{m}') AS {m}" for m in ("bm25", "semantic", "hybrid")) + " FROM modes GROUP BY item_id, doc_id",
    "top_changed": f"WITH {modes_sql()}, f AS (SELECT item_id, max(doc_id) FILTER (mode = 'bm25') AS a, max(doc_id) FILTER (mode = 'hybrid') AS b FROM modes WHERE rank = 1 GROUP BY item_id) SELECT count(*) FILTER (a IS DISTINCT FROM b) AS changed, count(*) AS n_questions FROM f",
    "latency_p50": "SELECT event_type, round(avg(value), 4) AS mean, round(median(value), 4) AS p50, count(value) AS n FROM events GROUP BY event_type",
    "judge_metrics": "WITH m AS (SELECT 1 - l_discount AS f, 1 - l_tax AS r, l_quantity / 50 AS p FROM lineitem), w AS (SELECT *, least(f, r, p) AS v FROM m) SELECT CASE WHEN f = v THEN 'faithfulness' WHEN p = v THEN 'precision' ELSE 'relevancy' END AS worst, v < 0.3 AS low, count(*) AS n, round(avg(v), 4) AS mean_worst FROM w GROUP BY ALL",
    "rerank_lexical": f"WITH {fused_sql()}, cand AS (SELECT item_id, doc_id, fused_rank, d.text AS ct, b.text AS qt FROM fused JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE fused_rank <= 20), ctok AS (SELECT doc_id, list_distinct({_CODE.format(text='text')}) AS t FROM documents), cdf AS (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM ctok) GROUP BY term), n AS (SELECT count(*) AS n FROM documents), q AS (SELECT item_id, unnest(list_distinct({_CODE.format(text='text')})) AS term FROM benchmark), w AS (SELECT item_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w FROM q LEFT JOIN cdf USING (term), n), cover AS (SELECT c.item_id, c.doc_id, sum(CASE WHEN list_contains(t, term) THEN w ELSE 0 END) / sum(w) AS c FROM cand c JOIN ctok USING (doc_id) JOIN w USING (item_id) GROUP BY ALL), ph AS (SELECT item_id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) AS p FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS ws FROM benchmark)), s AS (SELECT cand.item_id, cand.doc_id, fused_rank, round((coalesce(c, 0) + 0.3 * CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: contains(lower(ct), x))) / len(p) ELSE 0 END) / (1 + greatest(0, length(ct) - 2500) / 5000.0), 6) AS rerank_score FROM cand JOIN cover USING (item_id, doc_id) JOIN ph USING (item_id)) SELECT item_id, doc_id, fused_rank, round(rerank_score, 4) AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, fused_rank, doc_id) AS r FROM s) WHERE r <= {K}",
}

ORACLES["collection_topk"] = ORACLES["cosine_topk"]  # lists are skipped only where bounds prove it
