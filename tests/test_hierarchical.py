"""Hierarchical answers by mode: statuses, gate, labels, budget, failing models; evaluation that keeps what fails late."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import metrics
from quillstone.plans import hierarchical
from quillstone.plans.search import SearchConfig

CFG = SearchConfig(top_k=2, candidate_k=5, rerank_candidates=3, min_rerank_score=0.5, parent_max_chars=40, context_max_chars=40)


@pytest.fixture(scope="module")
def made(spark):
    hits = spark.createDataFrame([(10, k, k) for k in (1, 2, 3, 4)] + [(11, k, 5 - k) for k in (1, 2, 3, 4)] + [(20, 1, 1)], "query long, key long, fused_rank int")
    variants = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "q long, query long")
    questions = spark.createDataFrame([(1, "first"), (2, None), (3, "nothing found")], "q long, text string")
    chunks = spark.createDataFrame([(1, 100, "0.9 one"), (2, 100, "0.4 two"), (3, 200, "0.8 three"), (4, 200, None)], "key long, parent_id long, text string")
    parents = spark.createDataFrame([(100, "0.7 " + "p" * 30, True), (200, "0.6 " + "r" * 30, None)], "parent_id long, text string, ambiguous boolean")
    return hits, variants, questions, chunks, parents


def leading_number(rows):
    return rows.withColumn("score", F.coalesce(F.regexp_extract("text", r"^([0-9.]+)", 1), F.lit("0")).cast("double"))


def run(made, score=leading_number, answer=lambda q, parts: f"said [{parts[0][0]}]", built=True):
    hits, variants, questions, chunks, parents = made
    found = hierarchical.evidence(hierarchical.units(hits, variants, chunks, parents if built else None, "q", "query", "key", CFG), questions, "q", score, CFG)
    out = hierarchical.answered(found, questions, variants, "q", hierarchical.said(found, questions, "q", answer), built)
    return found, {(r["mode"], r["q"]): r for r in out.collect()}


def test_every_mode_has_every_question(made):
    found, got = run(made)
    assert len(got) == 12 and {r["status"] for (_, q), r in got.items() if q == 3} == {"insufficient_evidence"}
    flat = got["single_flat", 1]  # keys 1, 2, 3 are reranked: 0.9, 0.4, 0.8; the best two pass
    assert (flat["status"], flat["labels"], flat["answer"], flat["citations"], flat["n_reranked"]) == ("answered", ["E1", "E2"], "said [E1]", ["E1"], 3)
    many = got["multi_flat", 1]  # the two rankings are mirrored: ends win over the middle, two of three are kept
    assert many["n_reranked"] == 3 and many["n_accepted"] == 1 and many["warnings"] == []
    parent = got["single_parent", 1]  # both parents would pass; the budget of 40 holds one
    assert (parent["labels"], parent["dropped"], parent["warnings"], parent["context_chars"]) == (["P1"], ["200"], ["over_budget", "inferred_place"], 34)
    assert got["multi_flat", 2]["warnings"] == ["query_generation_unavailable"]
    rows = {(r["q"], r["kind"], r["unit"]): r for r in hierarchical.compared(found, "q").collect()}
    assert rows[1, "child", "3"]["single_flat"] == 2 and rows[1, "parent", "100"]["single_parent"] == 1 and (1, "parent", "200") not in rows


def test_failing_models(made):
    def bad(question, parts):
        raise RuntimeError

    assert {r["status"] for r in run(made, answer=bad)[1].values()} == {"retrieval_only", "insufficient_evidence"}
    got = run(made, answer=lambda q, p: "[E77]")[1]["single_flat", 1]
    assert got["status"] == "retrieval_only" and got["answer"] is None and got["warnings"] == ["unknown_citations", "nothing_but_unknown_citations"]
    lost = lambda rows: leading_number(rows).withColumn("score", F.when(F.col("unit") != "3", F.col("score")))
    got = run(made, score=lost)[1]["single_flat", 1]
    assert got["status"] == "reranker_unavailable" and got["n_accepted"] == 0 and got["labels"] == []


def test_a_hierarchy_that_is_not_built(made):
    got = run(made, built=False)[1]
    assert {r["status"] for (m, _), r in got.items() if m.endswith("parent")} == {"hierarchy_not_ready"} and got["single_flat", 1]["status"] == "answered"


def test_no_questions(spark, made):
    hits, variants, questions, chunks, parents = made
    found, got = run((hits, variants, questions.limit(0), chunks, parents))
    assert got == {} and found.count() == 0


def test_evaluation_keeps_late_failures_and_latencies(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    rel = spark.createDataFrame([(1, 10)], "q long, d long")

    def late(_):
        return q.select("q", F.lit(10).cast("long").alias("d"), F.when(F.col("q") < 0, 1).otherwise(F.raise_error(F.lit("gone")).cast("int")).alias("rank"))

    told = spark.createDataFrame([(1, 10, 1, 4.0, None), (2, None, None, 9.0, "timeout")], "q long, d long, rank int, latency_ms double, error string")
    rows = metrics.evaluate({"late": late, "told": lambda _: told}, q, rel, "q", "d", 5)
    got = {(r["mode"], r["q"]): r for r in rows.collect()}
    assert len(got) == 6 and all("gone" in got["late", i]["error"] and got["late", i]["recall"] is None for i in (1, 2, 3))
    assert (got["told", 1]["recall"], got["told", 1]["latency_ms"]) == (1.0, 4.0) and (got["told", 2]["recall"], got["told", 2]["error"]) == (None, "timeout")
    assert got["told", 3]["error"] is None and got["told", 3]["recall"] == 0.0 and got["told", 3]["latency_ms"] > 0
    assert {r["mode"]: r["n_failed"] for r in metrics.evaluation_summary(rows).collect()} == {"late": 3, "told": 1}
