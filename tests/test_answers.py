"""Composites against plain re-implementations and their rules."""

import math

import pytest

from quillstone.operators import graph, metrics, providers, rerank, validation
from quillstone.plans import answers, catalog, search
from quillstone.sources import sinks

SF = "/root/testdata/sf0.001"


def test_unknown_roles_and_methods_are_errors(spark):
    c = answers._secured(spark, SF)
    with pytest.raises(ValueError):
        search.secure_retrieve(c, "allowed", ["Intruder"])
    with pytest.raises(ValueError):
        search.secure_retrieve(c, "allowed", ["Staff"], "guess")
    got, events = search.internal_lookup(c, "allowed", [], "source")
    assert {r["status"] for r in got.collect()} == {r["status"] for r in events.collect()} == {"DENIED"}


def test_secure_rerank_shows_permitted_chunks_only(spark):
    c = answers._secured(spark, SF)
    allowed = {r["doc_id"]: r["allowed"] for r in c.chunks.select("doc_id", "allowed").collect()}
    found = search.secure_retrieve(c, "allowed", ["Guest"], "hybrid_rerank", search.SearchConfig(top_k=5, candidate_k=10)).collect()
    assert found and all("Guest" in allowed[r["doc_id"]] for r in found) and max(r["rank"] for r in found) == 5


def test_final_parents(spark):
    rows = answers._parents(spark, SF).collect()
    want = []
    for q in {r["question_id"] for r in rows}:
        own = sorted((-round(1 / (1 + math.exp(-r["logit"])), 9), r["parent_rank"], r["parent_id"], r["char_count"]) for r in rows if r["question_id"] == q and r["parent_rank"] <= 10)
        used, held = 0, 0
        for place, (_, _, parent, n) in enumerate([x for x in own if -x[0] >= 0.5][:5], 1):
            take = used + n <= 1500 or held == 0
            used, held = used + n * take, held + take
            want.append((q, parent, place, take))
    got = [tuple(r) for r in catalog.QUERIES["final_parents"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_hierarchical_modes(spark):
    """Questions whose hits are given: the flat modes count the best k, the parent modes what the budget takes."""
    rows = {(r["question_id"], r["mode"]): r for r in catalog.QUERIES["hierarchical_modes"](spark, SF).collect()}
    assert {m for _, m in rows} == {"single_flat", "single_parent", "multi_flat", "multi_parent"} and len(rows) == 40
    assert all(r["n_hits"] == 5 for (_, m), r in rows.items() if m.endswith("flat"))
    assert all(r["n_parents"] <= r["n_hits"] and (r["n_parents"] == 1 or r["context_chars"] <= 6000) for r in rows.values() if r["mode"].endswith("parent"))


def test_evaluation_keeps_failures_and_the_last_report(spark, tmp_path):
    q = spark.createDataFrame([(1,), (2,)], "q long")
    rel = spark.createDataFrame([(1, 10)], "q long, d long")
    hits = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], "q long, d long, rank int")

    def bad(_):
        raise KeyError("x")

    rows = metrics.evaluate({"good": lambda _: hits, "bad": bad}, q, rel, "q", "d", 5)
    got = {(r["mode"], r["q"]): (r["recall"], r["mrr"], r["error"]) for r in rows.collect()}
    assert got == {("good", 1): (1.0, 0.5, None), ("good", 2): (0.0, 0.0, None), ("bad", 1): (None, None, "KeyError: 'x'"), ("bad", 2): (None, None, "KeyError: 'x'")}
    path = f"file://{tmp_path}/reports"
    sinks.write_evaluation(metrics.evaluation_summary(rows), path, ["mode", "n_failed"])
    with pytest.raises(ValueError):
        sinks.write_evaluation(rows, path, ["absent"])
    assert {r["mode"]: r["n_failed"] for r in sinks.latest_evaluation(spark, path).collect()} == {"good": 0, "bad": 2}


def test_ocr_provider(spark):
    class Reader:
        def read(self, image):
            if image == b"broken":
                raise OSError
            return image.decode().upper()

    pages = spark.createDataFrame([(1, b"text"), (2, b"broken"), (3, None)], "page long, image binary")
    assert {r["page"]: r["text"] for r in providers.recognise(pages, "image", Reader).collect()} == {1: "TEXT", 2: None, 3: None}


def test_small_rules(spark):
    with pytest.raises(ValueError):
        graph.GraphSession(None, None, {}).run("absent")
    nodes = spark.createDataFrame([("d", 1, None, 0, "x"), ("d", 2, 1, 1, " ")], "g string, k long, p long, o long, t string")
    assert graph.tree_integrity(nodes, "g", "k", "p", "o", "t").first()["blank_texts"] == 1
    p = spark.createDataFrame([(1, 1, 1, 0.0, True), (1, 2, 2, None, None)], "q long, parent long, parent_rank int, logit double, ambiguous boolean")
    got = {r["parent"]: (r["accepted"], r["warned"]) for r in rerank.parent_gate(rerank.rerank_parents(p, "q", "parent", "logit", 5), 0.5).collect()}
    assert got == {1: (True, True), 2: (False, False)}
    hits = spark.createDataFrame([(1, 9, 1), (1, 8, 2), (1, 7, 3)], "q long, k long, rank int")
    stored = spark.createDataFrame([(7, "c"), (9, "a")], "k long, t string")
    assert [(r["k"], r["place"]) for r in validation.in_hit_order(hits, stored, "q", "k", "rank").orderBy("place").collect()] == [(9, 1), (7, 2)]


def test_seeded_sample(spark):
    from pyspark.sql import functions as F

    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("lang"), F.col("id").alias("doc_id"))
    first, again, other = (sorted(map(tuple, validation.seeded_sample(rows.repartition(n), "lang", "doc_id", 5, seed).collect())) for n, seed in ((1, 42), (7, 42), (1, 43)))
    assert first == again != other and len(first) == 15 and {x[0] for x in first} == {"0", "1", "2"}
    assert validation.seeded_sample(rows.filter("doc_id < 4"), "lang", "doc_id", 5, 42).count() == 4


def test_html_text_of_pages(spark):
    """Every word of the pages' visible blocks, and nothing of scripts and styles."""
    rows = catalog.QUERIES["html_text"](spark, SF).collect()
    assert len(rows) == 50 and all(v is not None for r in rows for v in r)


def audit_rows(spark):
    c, cases = answers._audit_corpus(spark, SF)
    c = search.Corpus(c.chunks, c.vectors, c.questions, c.query_vectors)  # an index of its own: nothing kept from another run
    return search.leak_audit(c, "allowed", cases, answers._AUDIT, answers._CFG).collect()


def test_leak_audit_finds_every_target_once_the_filter_is_gone(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillstone.operators import rbac

    sound = audit_rows(spark)
    assert len(sound) >= 20 and not any(r["leaked"] for r in sound)
    assert all(r["authorized_rank"] is not None for r in sound)  # whoever may see the target finds it by every method
    monkeypatch.setattr(rbac, "overlaps", lambda allowed, roles: F.lit(True))
    assert all(r["leaked"] for r in audit_rows(spark))
