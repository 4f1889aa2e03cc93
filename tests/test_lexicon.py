"""The stored index against an index of each view's own chunks, and the search by bounds against the whole one."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import bm25, lexicon
from quillstone.sources import store

def tokens():
    return T.tokenize_code(F.col("text"))


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    word = lambda: f"w{min(rng.randrange(50), rng.randrange(50))}"
    sets = [["Admin"], ["Admin", "HR"], ["Staff", "Guest"], None, [], ["Guest", "nobody"]]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 30))), sets[rng.randrange(6)]) for i in range(120)]
    rows += [(500, None, ["Guest"]), (501, rows[3][1], rows[3][2]), (502, rows[3][1], rows[3][2])]
    asked = [(q, " ".join(word() for _ in range(rng.randrange(1, 9)))) for q in range(12)] + [(50, ""), (51, None), (52, "absent words")]
    return spark.createDataFrame(rows, "id long, text string, allowed array<string>"), spark.createDataFrame(asked, "q long, text string")


@pytest.fixture(scope="module")
def index(spark, made):
    return lexicon.build(made[0], "id", tokens(), store.fresh_folder(spark, "test"), {"a": 1}, lexicon.role_mask(F.col("allowed")))


VIEWS = {"all": None, "guest": ["Guest"], "both": ["HR", "Staff"], "none": ["Risk_Manager"]}


def own_rows(chunks, roles):
    return chunks if roles is None else chunks.filter(F.arrays_overlap("allowed", F.array(*map(F.lit, roles))))


@pytest.mark.parametrize("family", ["code", "legal"])
def test_one_index_answers_every_view(spark, made, index, family):
    chunks, asked = made
    grid = asked.crossJoin(spark.createDataFrame([(v,) for v in VIEWS], "view string"))
    found = lexicon.search(index, lexicon.views_of(spark, VIEWS), grid, "q", tokens(), 4, family).collect()
    for view, roles in VIEWS.items():
        plain = (bm25.search_code if family == "code" else bm25.search_legal)(own_rows(chunks, roles), asked, tokens(), tokens(), "id", "q", 4).collect()
        assert sorted((r["q"], r["rank"], r["id"], round(r["score"], 6)) for r in found if r["view"] == view) == sorted((r["q"], r["rank"], r["id"], round(r["score"], 6)) for r in plain)


def test_statistics_are_sums_over_masks(spark, made, index):
    chunks, _ = made
    got = {(r["view"], r["term"]): (r["df"], r["cf"], round(r["idf"], 9)) for r in lexicon.statistics(index, lexicon.views_of(spark, VIEWS)).collect()}
    want = {}
    for view, roles in VIEWS.items():
        for r in bm25.build_index(own_rows(chunks, roles), "id", tokens()).terms.collect():
            want[view, r["term"]] = r["df"], r["cf"], round(r["idf"], 9)
    assert got == want


def test_bounds_lose_nothing(spark, made, index, monkeypatch):
    monkeypatch.setattr(lexicon, "FIRST", 6)
    monkeypatch.setattr(lexicon, "AHEAD", 2)
    _, asked = made
    views = lexicon.views_of(spark, VIEWS)
    grid = asked.crossJoin(views.select("view"))
    for k in (1, 3):
        found, share = lexicon.bounded_top_k(index, views, grid, "q", tokens(), k)
        plain = lexicon.search(index, views, grid, "q", tokens(), k, "code").collect()
        assert sorted((r["view"], r["q"], r["rank"], r["id"], round(r["score"], 6)) for r in found.collect()) == sorted((r["view"], r["q"], r["rank"], r["id"], round(r["score"], 6)) for r in plain)
        n = share.first()
        assert n["n_met"] < n["n_postings"]


def test_an_index_is_kept_until_its_inputs_change(spark, made, index):
    assert lexicon.opened(spark, index.path, "id", {"a": 1}).number == index.number
    assert lexicon.opened(spark, index.path, "id", {"a": 2}) is None
    assert lexicon.build(made[0].limit(3), "id", tokens(), index.path, {"a": 2}).number == index.number + 1
    assert lexicon.opened(spark, index.path, "id", {"a": 2}).table("chunks").count() == 3 and index.table("chunks").count() == 123
    with pytest.raises(ValueError):
        lexicon.view_bits(["Intruder"])


def test_an_empty_corpus(spark, made):
    ix = lexicon.build(made[0].limit(0), "id", tokens(), store.fresh_folder(spark, "empty"))
    views = lexicon.views_of(spark, {"all": None})
    asked = made[1].withColumn("view", F.lit("all"))
    assert lexicon.search(ix, views, asked, "q", tokens(), 3, "code").count() == 0 and lexicon.search(ix, views, asked, "q", tokens(), 3, "legal").count() == 0
    assert lexicon.bounded_top_k(ix, views, asked, "q", tokens(), 1)[0].count() == 0
