"""The pipeline's stages against brute force, on the smallest tables and on odd rows."""

import pandas as pd
from test_operators import SF, classes, contaminated, windows

import corpus_pipeline


def test_stages(spark):
    from quillstone.llm.common import materialize
    from quillstone.sources.tables import table

    docs = table(spark, SF, "documents")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = materialize(stage(spark, docs, SF), name)
        held[name] = before
        if name != "packing":
            assert docs.columns == columns
    after = {r["doc_id"] for r in docs.collect()}
    kept = [i for i, c in classes(held["near_duplicates"]).items() if c == i]
    assert sorted(kept) == sorted(i for i, _ in held["decontamination"])
    wins = windows(pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False))
    clean = [i for i, t in held["decontamination"] if not contaminated(t, wins)[4]]
    assert sorted(clean) == sorted(i for i, _ in held["secrets"]) and after == set(clean)


def test_odd_rows(spark, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
        docs.count()
        docs = docs if name != "quality" else odd
