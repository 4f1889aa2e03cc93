"""Reciprocal rank fusion of rankings, of sources and of several queries of one question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
RANK_DIGITS = 9


def fuse(lexical: DataFrame, semantic: DataFrame, query_key: str | list[str], key: str, k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Full outer union of two rankings: rrf_score, fused_rank, both ranks (null: not found there), matched_by.

    Order: score down, better of the ranks, semantic rank, lexical rank (nulls last), key.
    """
    by = [query_key] if isinstance(query_key, str) else list(query_key)
    a = lexical.select(*by, key, F.col("rank").alias("bm25_rank"))
    b = semantic.select(*by, key, F.col("rank").alias("semantic_rank"))
    both = a.join(b, [*by, key], "full_outer")
    part = lambda c, w: F.coalesce(F.lit(float(w)) / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf_score", part("bm25_rank", weights[0]) + part("semantic_rank", weights[1]))
    order = W.partitionBy(query_key).orderBy(F.round("rrf_score", RANK_DIGITS).desc(), F.least("bm25_rank", "semantic_rank"), F.col("semantic_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), key)
    found = F.array_compact(F.array(F.when(F.col("bm25_rank").isNotNull(), "bm25"), F.when(F.col("semantic_rank").isNotNull(), "semantic")))
    return scored.withColumn("fused_rank", F.row_number().over(order)).withColumn("matched_by", F.array_join(found, "+"))


def overlap(fused: DataFrame, query_key: str) -> DataFrame:
    """Per query: candidates, those found by both, by one only."""
    both = F.col("bm25_rank").isNotNull() & F.col("semantic_rank").isNotNull()
    return fused.groupBy(query_key).agg(
        F.count("*").alias("n_union"), F.count_if(both).alias("n_overlap"),
        F.count_if(F.col("semantic_rank").isNull()).alias("n_bm25_only"), F.count_if(F.col("bm25_rank").isNull()).alias("n_semantic_only"),
    )


def fuse_queries(hits: DataFrame, question: str, query: str, key: str, rank: str = "fused_rank", k: int = RRF_K) -> DataFrame:
    """Fusion over the queries of a question: score, support, best rank, ranks by query.

    Order: score down, support down, best rank, key.
    """
    grouped = hits.groupBy(question, key).agg(
        F.sum(1.0 / (k + F.col(rank))).alias("score"), F.count("*").alias("support"), F.min(rank).alias("best_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(query).cast("string"), F.col(rank))))).alias("per_query_ranks"),
    )
    order = W.partitionBy(question).orderBy(F.round("score", RANK_DIGITS).desc(), F.col("support").desc(), "best_rank", key)
    return grouped.withColumn("multi_query_rank", F.row_number().over(order))


def support_distribution(fused: DataFrame, question: str) -> DataFrame:
    """Per question: how many candidates were found by so many queries."""
    return fused.groupBy(question, "support").agg(F.count("*").alias("n"))


def rank_change(ranked: DataFrame, query_key: str, before: str, after: str) -> DataFrame:
    """Places gained (positive) or lost."""
    return ranked.withColumn("rank_change", F.col(before) - F.col(after))


def fuse_by_id(lexical: DataFrame, semantic: DataFrame, query_key: str | list[str], key: str, k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The other family's order: score down, then key; the score on eight digits."""
    fused = fuse(lexical, semantic, query_key, key, k, weights)
    order = W.partitionBy(query_key).orderBy(F.round("rrf_score", RANK_DIGITS).desc(), key)
    return fused.withColumn("fused_rank", F.row_number().over(order)).withColumn("rrf_score", F.round("rrf_score", 8))
