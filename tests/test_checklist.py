"""The checklist reads every document; external items are the best by BM25 against the domain's texts."""

import math
from collections import Counter

import pandas as pd

from quillstone.operators import compliance
from quillstone.plans import catalog

SF = "/root/testdata/sf0.001"


def okapi(docs, asked):
    """Scores of each document for one question's tokens."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    least = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else least for t, x in raw.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(k * idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t, k in asked.items() if t in tf))
    return out


def test_external_rows_by_score(spark):
    columns = "doc_id long, text string, citation string"
    own = spark.createDataFrame([(i, "cash vault keys are counted daily", f"i{i}") for i in range(120)], columns)
    other = [(1, "weather and music", "e1"), (2, "vault keys", "e2"), (3, "the cash vault keys", "e3"), (4, "gardens", "e4"), (5, "music", "e5"), (6, "rain", "e6"), (7, "snow", "e7")]
    rows = compliance.checklist(own, spark.createDataFrame(other, columns), "Cash", "KHO", "doc_id", "text", "citation").collect()
    got = {r["item_id"]: r["source_citation"] for r in rows}
    scores = dict(zip((x[2] for x in other), okapi([x[1].split() for x in other], Counter("cash vault keys are counted daily".split() * 120)), strict=True))
    best = sorted((x for x in scores if scores[x] > 0), key=lambda x: -scores[x])
    assert got == {f"CHK_KHO_{n:02d}": c for n, c in enumerate([f"i{i}" for i in range(120)] + best, 1)}  # numbers of three digits too


def test_every_document_is_read(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    own = d.source.str.contains("[02468]$")
    got = {r["item_id"]: r["source_citation"] for r in catalog.QUERIES["checklist"](spark, SF).collect()}
    inside = [f"c{i}" for i in d.doc_id[own]]
    assert [got[f"CHK_KHO_{n:02d}"] for n in range(1, len(inside) + 1)] == inside
    from pyspark.sql import functions as F

    from quillstone.functions import text as T

    tokens = {r["doc_id"]: r["t"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", T.tokenize_code(F.col("text")).alias("t")).collect()}
    outside = list(d.doc_id[~own])
    scores = dict(zip(outside, okapi([tokens[i] for i in outside], Counter(t for i in d.doc_id[own] for t in tokens[i])), strict=True))
    best = sorted((i for i in outside if scores[i] > 0), key=lambda i: (-round(scores[i], 9), i))[:5]
    assert [got[f"CHK_KHO_{n:02d}"] for n in range(len(inside) + 1, len(got) + 1)] == [f"c{i}" for i in best]
