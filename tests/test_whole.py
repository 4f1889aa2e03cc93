"""Queries over whole tables and whole texts."""

from quillstone.plans import catalog

def test_questions_grow_with_the_conversations(spark, tmp_path):
    rows = [(c, t, "x" * (1 + (c * 7 + t) % 90)) for c in range(1200) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["child_to_parent"](spark, str(tmp_path)).collect()
    assert sorted(r["child_id"] for r in got) == [c * 100 + t for c, t, _ in rows]
    assert {r["question_id"] for r in got} == set(range(24)) and all(r["question_id"] == r["parent_id"] % 24 for r in got)


def test_neighbours_have_their_best_chunks_however_far_down(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    # one document fills the first hundreds of ranks; its neighbours lie far from the question
    vectors = [(i, 5, (np.eye(8)[0] + rng.normal(0, 0.01, 8)).tolist()) for i in range(400)] + [(400 + i, (4, 6, 7, 9)[i % 4], rng.normal(0, 1, 8).tolist()) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = {i: np.array(e) / np.linalg.norm(e) for i, _, e in vectors}
    labels = {i: d for i, d, _ in vectors}
    near: dict[int, set] = {}
    for d in set(labels.values()):
        if (d + 1) % 4:
            near.setdefault(d, set()).add(d + 1)
            near.setdefault(d + 1, set()).add(d)
    want = set()
    for q in range(0, 440, 100):
        order = sorted(unit, key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))
        hops = dict.fromkeys((labels[i] for i in order[:5]), 0)
        for hop in (1, 2):
            for d in [x for x, h in hops.items() if h == hop - 1]:
                for other in near.get(d, ()):
                    hops.setdefault(other, hop)
        want |= {(q, i, 0) for i in order[:5]} | {(q, i, h) for d, h in hops.items() if h for i in [x for x in order if labels[x] == d][:2]}
    got = catalog.QUERIES["context_search"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["vec_id"], r["hop"]) for r in got} == want and len(got) == len(want)
    assert any(h for _, _, h in want)
