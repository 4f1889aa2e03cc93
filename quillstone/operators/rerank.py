"""Reranking of retrieved candidates, gates and evidence labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sigmoid, tokenize_code

# Fixed values of the lexical score.
PHRASE, CODE, ARTICLE, FREE_LENGTH, LENGTH_SCALE = 0.30, 0.25, 0.20, 2500, 5000.0
DOC_CODE = r"(\d+/\d{4}/[0-9a-zA-ZÀ-ỹ\-]+)"
ARTICLE_NAME = r"(điều\s+\d+)"


def corpus_frequencies(corpus: DataFrame, text: str, pairs: DataFrame, question_text: str) -> tuple[DataFrame, DataFrame]:
    """(term, df; n) of a whole corpus for the pairs' question terms: others are dropped before anything is shuffled."""
    terms = pairs.select(F.explode(tokenize_code(F.col(question_text))).alias("term")).distinct()
    each = corpus.select(F.explode(F.array_distinct(tokenize_code(F.col(text)))).alias("term"))
    return each.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")), corpus.agg(F.count("*").alias("n"))


def lexical_scores(pairs: DataFrame, frequencies: DataFrame, sizes: DataFrame, question_text: str, chunk_text: str, view: str | None = None) -> DataFrame:
    """pairs with rerank_score: idf-weighted cover of the question's tokens, shares of its three-word phrases, codes and articles found.

    frequencies: term, df; sizes: n, one row. With view, a column of all three, each view's own: a row of sizes for each view.
    """
    by = [view] if view else []
    rows = pairs.withColumn("__row", F.xxhash64(*pairs.columns)).withColumn("__q", F.array_distinct(tokenize_code(F.col(question_text))))
    cut = rows.select("__row", *by, "__q", F.array_distinct(tokenize_code(F.col(chunk_text))).alias("__t"))  # once per pair, before the explode
    terms = cut.select("__row", *by, "__t", F.explode("__q").alias("__term"))
    known = frequencies.select(*by, F.col("term").alias("__term"), F.col("df").alias("__df"))
    n = F.broadcast(sizes.select(*by, F.col("n").alias("__n")))  # one row, or one a view
    weight = F.log(1.0 + (F.col("__n") - F.coalesce("__df", F.lit(0)) + 0.5) / (F.coalesce("__df", F.lit(0)) + 0.5))
    weighed = terms.join(known, [*by, "__term"], "left")
    weighed = (weighed.join(n, view) if view else weighed.crossJoin(n)).withColumn("__w", weight)
    cover = weighed.groupBy("__row").agg((F.sum(F.when(F.array_contains("__t", F.col("__term")), F.col("__w")).otherwise(0.0)) / F.sum("__w")).alias("__cover"))
    low, words = F.lower(chunk_text), F.filter(F.split(F.lower(question_text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    phrases = F.when(F.size(words) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " ")))).otherwise(F.array().cast("array<string>"))
    share = F.when(F.size(phrases) > 0, F.size(F.filter(phrases, lambda p: F.contains(low, p))) / F.size(phrases)).otherwise(0.0)
    any_of = lambda pattern: F.exists(F.regexp_extract_all(F.lower(question_text), F.lit(pattern), F.lit(1)), lambda c: F.contains(low, c)).cast("double")
    bonus = PHRASE * share + CODE * any_of(DOC_CODE) + ARTICLE * any_of(ARTICLE_NAME)
    penalty = 1.0 / (1.0 + F.greatest(F.lit(0), F.length(chunk_text) - FREE_LENGTH) / LENGTH_SCALE)
    out = rows.join(cover, "__row", "left").withColumn("rerank_score", F.round((F.coalesce("__cover", F.lit(0.0)) + bonus) * penalty, 6))
    return out.drop("__row", "__q", "__cover")


def rerank(candidates: DataFrame, query_key: str, key: str, score: str, before: str, limit: int, k: int) -> DataFrame:
    """The first `limit` candidates by their rank, ordered by score, cut to k; ranks are given before the cut."""
    order = W.partitionBy(query_key).orderBy(F.col(score).desc(), before, key)
    ranked = candidates.filter(F.col(before) <= limit).withColumn("final_rank", F.row_number().over(order))
    return ranked.withColumn("rank_change", F.col(before) - F.col("final_rank")).filter(F.col("final_rank") <= k)


def gate(mode: Column, distance: Column, score: Column, max_distance: float, min_score: float) -> Column:
    """Whether evidence is accepted: rerank mode by score, the others by semantic distance; bounds included, null fails."""
    return F.coalesce(F.when(mode == "hybrid_rerank", score >= min_score).otherwise(distance <= max_distance), F.lit(False))


def label_accepted(evidence: DataFrame, query_key: str, rank: str, accepted: str, letter: str = "E") -> DataFrame:
    """Labels E1, E2 … over accepted evidence only, in rank order; null for the rest."""
    order = W.partitionBy(query_key).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    number = F.sum(F.col(accepted).cast("int")).over(order)
    return evidence.withColumn("label", F.when(F.col(accepted), F.concat(F.lit(letter), number.cast("string"))))


def normalized(score: Column) -> Column:
    """A model's logit as 0 to 1."""
    return sigmoid(score)


def citation_check(answers: DataFrame, evidence: DataFrame, query_key: str, answer: str) -> DataFrame:
    """Per answer: cited labels that exist, in order of first use, those that don't, and the answer without the latter."""
    from ..functions.text import cited_labels, drop_labels

    known = evidence.filter(F.col("label").isNotNull()).groupBy(query_key).agg(F.collect_set("label").alias("__known"))
    rows = answers.join(known, query_key, "left").withColumn("__known", F.coalesce("__known", F.array().cast("array<string>"))).withColumn("__used", cited_labels(F.col(answer)))
    valid = F.filter("__used", lambda x: F.array_contains("__known", x))
    invalid = F.array_except("__used", "__known")
    return rows.select(*answers.columns, valid.alias("cited"), invalid.alias("unknown"), drop_labels(F.col(answer), invalid).alias("clean_answer"))


def rerank_parents(parents: DataFrame, question: str, parent: str, logit: str, limit: int) -> DataFrame:
    """The first `limit` parents by parent_rank with a model's score between 0 and 1, their new rank and the places gained.

    Order: score down, former rank, id.
    """
    from .fusion import RANK_DIGITS

    scored = parents.filter(F.col("parent_rank") <= limit).withColumn("parent_rerank_score", sigmoid(F.col(logit)))
    order = W.partitionBy(question).orderBy(F.round("parent_rerank_score", RANK_DIGITS).desc(), "parent_rank", parent)
    ranked = scored.withColumn("parent_rerank_rank", F.row_number().over(order))
    return ranked.withColumn("parent_rank_change", F.col("parent_rank") - F.col("parent_rerank_rank"))


def parent_gate(parents: DataFrame, min_score: float) -> DataFrame:
    """Adds accepted (score at least the bound; null fails) and warned: an accepted parent whose place was inferred stays, with a warning."""
    accepted = F.coalesce(F.col("parent_rerank_score") >= min_score, F.lit(False))
    return parents.withColumn("accepted", accepted).withColumn("warned", accepted & F.coalesce(F.col("ambiguous"), F.lit(False)))


def final_parents(parents: DataFrame, question: str, parent: str, logit: str, length: str, limit: int, top_k: int, min_score: float, most: int) -> DataFrame:
    """Rerank, gate, the best top_k accepted ones, and the context budget once more over them in their new order."""
    from .hierarchy import context_budget

    accepted = parent_gate(rerank_parents(parents, question, parent, logit, limit), min_score).filter("accepted")
    place = F.row_number().over(W.partitionBy(question).orderBy("parent_rerank_rank"))
    kept = accepted.withColumn("final_parent_rank", place).filter(F.col("final_parent_rank") <= top_k)
    return context_budget(kept, question, parent, "final_parent_rank", length, most)
