"""BM25 retrieval of many questions over many chunks.

Index: one row per (term, chunk) with frequency and length; one row per term with document frequency and idf. Scoring joins the
questions' terms with the index on the term and sums: no question is compared with a chunk that shares no term with it. Two
families differ in tokens, ties and the treatment of zero scores:
legal keeps zero scores (chunks of the smallest ids fill up to k); code cuts to k, then drops scores of zero and less.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the scoring formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Digits on which scores are ranked: sums depend on their order beyond.
RANK_DIGITS = 9


@dataclass(frozen=True)
class Index:
    """postings: chunk, term, tf, length; terms: term, df, cf, idf; totals: one row of n_chunks, avg_length."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def term_frequencies(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, tf, length."""
    listed = rows.select(F.col(key), tokens.alias("tokens"))
    exploded = listed.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    # every use keeps the length, so that statistics and scores share one exchange of the postings
    return exploded.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("length").alias("length")).filter("length > 0")


def build_index(chunks: DataFrame, key: str, tokens: Column) -> Index:
    """The index of all chunks."""
    postings = term_frequencies(chunks, key, tokens)
    counted = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    # the mean length from the terms' counts: texts are cut into tokens once
    totals = counted.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("cf")).crossJoin(chunks.agg(F.count("*").alias("n_chunks"))).select("n_chunks", (F.col("cf") / F.col("n_chunks")).alias("avg_length"))  # one row each
    counted = counted.crossJoin(F.broadcast(totals.select("n_chunks")))  # one row
    raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    counted = counted.withColumn("raw", raw)
    mean = counted.agg(F.avg("raw").alias("mean"))
    terms = counted.crossJoin(F.broadcast(mean)).select("term", "df", "cf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row
    return Index(chunks.select(key), postings, terms, totals)


#: Question terms that are broadcast at most; beyond, the join with the tokens is left to Spark.
TERMS = 500_000


def build_search_index(chunks: DataFrame, questions: DataFrame, key: str, tokens: Column, query_tokens: Column) -> Index:
    """The part of the index that these questions need.

    Document frequencies of all terms are counted in the tasks before anything is shuffled (a term's count per task, not a row per
    posting); only tokens of the questions' terms are shuffled as postings.
    """
    listed = chunks.select(F.col(key), tokens.alias("tokens"))
    # beside its distinct terms each chunk gives a row without a term, which carries its length
    each = listed.select(F.size("tokens").alias("n"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("tokens"))).alias("term"))
    counted = each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("cf"))
    totals = counted.filter("term IS NULL").select(F.col("df").alias("n_chunks"), (F.col("cf") / F.col("df")).alias("avg_length"))  # one row
    raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    known = counted.filter("term IS NOT NULL").select("term", "df").crossJoin(F.broadcast(totals.select("n_chunks"))).withColumn("raw", raw)  # one row
    asked = questions.select(F.explode(query_tokens).alias("term")).distinct()
    few = asked.limit(TERMS + 1).count() <= TERMS
    asked = F.broadcast(asked) if few else asked
    mean = known.agg(F.avg("raw").alias("mean"))
    terms = known.join(asked, "term", "left_semi").crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row
    exploded = listed.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(asked, "term", "left_semi")
    postings = exploded.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    return Index(chunks.select(key), postings, terms, totals)


def scores(index: Index, questions: DataFrame, query_key: str, tokens: Column, key: str) -> DataFrame:
    """query, chunk, score for every pair that shares a term; a repeated question token adds repeatedly."""
    asked = term_frequencies(questions, query_key, tokens).select(query_key, "term", F.col("tf").alias("times"))
    weighed = asked.join(index.terms.select("term", "idf"), "term").crossJoin(F.broadcast(index.totals))  # one row
    met = index.postings.join(weighed, "term")
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return met.groupBy(query_key, key).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, query_key: str, key: str, k: int, index: Index | None = None, questions: DataFrame | None = None, positive_only: bool = False) -> DataFrame:
    """query, chunk, score, rank: score down, then key. With index and questions, zero scores fill up to k."""
    if index is not None and questions is not None:
        fillers = index.chunks.orderBy(key).limit(k)  # k rows
        zero = questions.select(query_key).crossJoin(F.broadcast(fillers)).withColumn("score", F.lit(0.0))
        scored = scored.unionByName(zero).groupBy(query_key, key).agg(F.max("score").alias("score"))
    order = W.partitionBy(query_key).orderBy(F.round("score", RANK_DIGITS).desc(), F.col(key))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.filter(F.col("score") > 0) if positive_only else ranked


def search_legal(chunks: DataFrame, questions: DataFrame, tokens: Column, query_tokens: Column, key: str, query_key: str, k: int) -> DataFrame:
    index = build_search_index(chunks, questions, key, tokens, query_tokens)
    return top_k(scores(index, questions, query_key, query_tokens, key), query_key, key, k, index, questions)


def search_code(chunks: DataFrame, questions: DataFrame, tokens: Column, query_tokens: Column, key: str, query_key: str, k: int) -> DataFrame:
    index = build_search_index(chunks, questions, key, tokens, query_tokens)
    found = top_k(scores(index, questions, query_key, query_tokens, key), query_key, key, k, positive_only=True)
    return found.withColumn("score", F.round("score", 6))
