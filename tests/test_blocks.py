"""Top k by blocks against brute force; queries that use it store no index."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.operators import blocks, lexicon
from quillstone.plans import catalog

SF = "/root/testdata/sf0.001"


def brute(rows, questions, k):
    """question -> its k best (row, score) by BM25, scores above zero."""
    n, average = len(rows), sum(len(t) for t in rows.values()) / len(rows)
    df = Counter(w for t in rows.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if r < 0 else r for w, r in raw.items()}
    out = {}
    for q, asked in questions.items():
        times, found = Counter(asked), []
        for key, text in rows.items():
            tf = Counter(text)
            score = sum(times[w] * idf[w] * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(text) / average)) for w, c in tf.items() if w in times)
            found += [(-round(score, 9), key, score)] if score > 0 else []
        out[q] = [(key, round(score, 6)) for _, key, score in sorted(found)[:k]]
    return out


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return {i: [f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 60))) if x < 400] for i in range(n)}


@pytest.mark.parametrize("k", [1, 4, 500])
def test_top_k_is_that_of_all_pairs(spark, k):
    rows = texts(130, 1)
    rows |= {200: rows[7], 201: rows[7], 202: ["rare"] * 3000}
    questions = texts(30, 2) | {40: rows[7] * 2, 41: ["rare", "unknown"], 42: []}
    chunks = spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], "id long, text string").repartition(3)
    # one question comes in two rows
    asked = spark.createDataFrame([(q, " ".join(t)) for q, t in questions.items() if q != 40] + [(40, " ".join(rows[7]))] * 2, "q long, text string")
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    got = {}
    for r in blocks.top_k(chunks, asked, "id", "q", tokens, tokens, k).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["id"], round(r["score"], 6)))
    want = {q: found for q, found in brute(rows, questions, k).items() if found}
    assert {q: [key for key, _ in found] for q, found in got.items()} == {q: [key for key, _ in found] for q, found in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("dense, columns, step", [(0, 1, 7), (10**6, 3, 50), (10**6, 10**6, 1)])
def test_frequent_and_rare_terms_add_up_alike(monkeypatch, dense, columns, step):
    def block(rows):
        found = blocks._arrays(blocks._block(pa.array(list(rows)), pa.array(list(rows.values()), pa.list_(pa.string())))[0])
        return {n: v if n in ("key", "term") else v.to_numpy() for n, v in found.items()}

    rows, questions = texts(50, 3), texts(20, 4)
    q, d = block(questions), block(rows)
    q["weight"], d["part"] = q["times"] * 1.0, d["times"] * 1.0
    for name, value in (("DENSE", dense), ("COLUMNS", columns), ("STEP", step)):
        monkeypatch.setattr(blocks, name, value)
    want = [[sum(Counter(a)[w] * c for w, c in Counter(b).items()) for b in rows.values()] for a in questions.values()]
    assert np.allclose(blocks._products(q, d), want)


def test_best_cells_take_equal_values_by_place():
    scores = np.array([[1.0, 3, 3, 0, 3], [0, 0, 0, 0, 0]])
    assert [x.tolist() for x in blocks.best_cells(scores, 2)] == [[0, 0, 1, 1], [1, 2, 0, 1]]
    assert [x.tolist() for x in blocks.best_cells(scores, 1)] == [[0, 1], [1, 0]]


def test_blocks_are_bounded_and_long_rows_stand_alone(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 4)
    monkeypatch.setattr(blocks, "TOKENS", 10)
    sizes = [1, 2, 30, 3, 3, 3, 3, 0, 0, 0, 0, 0, 12]
    batch = pa.record_batch([pa.array(range(len(sizes))), pa.array([["w"] * n for n in sizes], pa.list_(pa.string()))], ["key", "tokens"])
    found = pa.Table.from_batches(list(blocks._pack(iter([batch.slice(0, 5), batch.slice(5)]))))
    assert sum(found["rows"].to_pylist()) == len(sizes) and sum(found["tokens"].to_pylist()) == sum(sizes)
    assert all(r <= 4 and (t <= 10 or r == 1) for r, t in zip(found["rows"].to_pylist(), found["tokens"].to_pylist()))


@pytest.mark.parametrize("name", ["conflict_check", "gap_report", "best_match", "top_changed", "hit_at_k_grouping", "mode_compare"])
def test_searches_asked_once_need_no_index(spark, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("an index of all terms is built")

    monkeypatch.setattr(lexicon, "build", never)
    monkeypatch.setattr(lexicon, "opened", lambda *_, **__: None)
    assert catalog.QUERIES[name](spark, SF).count()
