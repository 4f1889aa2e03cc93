import math

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import bm25, dense, fusion, metrics, rerank
from quillstone.plans.search import SearchConfig


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "e f"), (4, "")], "id long, text string")


def test_bm25_scores(spark, corpus):
    index = bm25.build_index(corpus, "id", T.tokenize_legal(F.col("text")))
    found = {r["term"]: r["idf"] for r in index.terms.collect()}
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}.items()}
    mean = sum(raw.values()) / len(raw)
    assert all(abs(found[t] - (0.25 * mean if r < 0 else r)) < 1e-12 for t, r in raw.items())
    q = spark.createDataFrame([(9, "b d b")], "q long, text string")
    got = {r["id"]: r["score"] for r in bm25.scores(index, q, "q", T.tokenize_legal(F.col("text")), "id").collect()}
    part = lambda dl: 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / 2))
    assert abs(got[1] - 2 * raw["b"] * part(3)) < 1e-9 and abs(got[2] - raw["d"] * part(3)) < 1e-9 and set(got) == {1, 2}


def test_zero_scores_fill_or_go(spark, corpus):
    q = spark.createDataFrame([(9, "e")], "q long, text string")
    t = T.tokenize_legal(F.col("text"))
    legal = bm25.search_legal(corpus, q, t, t, "id", "q", 3)
    assert [(r["id"], r["rank"]) for r in legal.orderBy("rank").collect()] == [(3, 1), (1, 2), (2, 3)]
    assert bm25.search_code(corpus, q, T.tokenize_code(F.col("text")), T.tokenize_code(F.col("text")), "id", "q", 3).count() == 1


def test_vector_faults(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert [r["f"] for r in df.select(dense.vector_faults(F.col("v"), 2).alias("f")).collect()] == [[], ["zero"], ["nan"], ["infinite"], ["dimension"], ["null"]]


def test_fusion_order(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q int, id string, rank int")
    sem = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "q int, id string, rank int")
    got = rows(fusion.fuse(lex, sem, "q", "id").select("fused_rank", "id", "matched_by"), "fused_rank")
    assert got == [(1, "b", "bm25+semantic"), (2, "a", "bm25"), (3, "c", "semantic")]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3)], "q int, id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z")], "q int, id string")
    q = spark.createDataFrame([(1,), (2,)], "q int")
    got = {r["q"]: r for r in metrics.ranking_metrics(hits, rel, q, "q", "id", 3).collect()}
    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(4), 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert abs(got[1]["recall"] - 2 / 3) < 1e-12 and got[1]["mrr"] == 0.5 and abs(got[1]["ndcg"] - dcg / ideal) < 1e-12
    assert got[2]["recall"] == 0.0
    assert metrics.ranking_metrics(hits, rel, q, "q", "id", 3, empty_is_null=True).filter("q = 2").first()["recall"] is None


def test_gate_and_labels(spark):
    df = spark.createDataFrame([(1, 1, "semantic", 0.6, None), (1, 2, "semantic", None, None), (1, 3, "hybrid_rerank", None, 0.5), (1, 4, "semantic", 0.61, None)], "q int, rank int, mode string, d double, s double")
    df = df.withColumn("ok", rerank.gate(F.col("mode"), F.col("d"), F.col("s"), 0.6, 0.5))
    assert rows(rerank.label_accepted(df, "q", "rank", "ok").select("rank", "label"), "rank") == [(1, "E1"), (2, None), (3, "E2"), (4, None)]


def test_config_bounds():
    for bad in ({"top_k": 0}, {"top_k": 30}, {"max_distance": 3}, {"parent_max_chars": 99999}):
        with pytest.raises(ValueError):
            SearchConfig(**bad)


def test_latent_vectors(spark):
    docs = spark.createDataFrame([(i, "cat dog cat" if i % 2 else "sun moon star") for i in range(12)], "id long, text string")
    got = {r["id"]: r["vector"] for r in dense.latent_vectors(docs, "id", T.tokenize_legal(F.col("text")), dimensions=2).collect()}
    near = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert near(got[1], got[3]) > 0.99 > abs(near(got[1], got[2])) + 0.9
