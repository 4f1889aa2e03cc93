"""Versioned stores: keyed upserts and deletions touch their buckets only, and a writer that stops leaves the former version."""

import pytest
from pyspark.sql import functions as F

from quillstone.sources import sinks, store


def rows(spark, path, name="t"):
    return sorted(tuple(r) for r in store.load(spark, path, name).collect())


@pytest.fixture
def kept(spark, tmp_path):
    path = f"{tmp_path}/store"
    df = spark.range(200).select("id", (F.col("id") % 7).alias("tenant"), F.lit("old").alias("text"))
    assert store.save({"t": (df, "id", None, ()), "whole": spark.range(3).toDF("x")}, path, {"v": 1}, buckets=16) == 1
    return path


def folders(spark, path):
    return store.manifest(spark, path)["tables"]["t"]["buckets"]


def test_upsert_rewrites_only_its_buckets(spark, kept):
    before = folders(spark, kept)
    new = spark.createDataFrame([(5, 1, "new"), (5, 1, "new"), (900, 2, "new")], "id long, tenant long, text string")
    n = store.upsert(spark, kept, "t", new)
    after = folders(spark, kept)
    assert n <= 2 and sum(before[b] != after.get(b) for b in before) <= 2
    got = {r[0]: r for r in rows(spark, kept)}
    assert len(got) == 201 and got[5] == (5, 1, "new") and got[900][2] == "new" and got[6][2] == "old"
    assert store.load(spark, kept, "t", 1).count() == 200 and rows(spark, kept, "whole") == [(0,), (1,), (2,)]
    store.upsert(spark, kept, "t", spark.createDataFrame([(6, "set"), (901, "set")], "id long, text string"), only=["text"])
    got = {r[0]: r for r in rows(spark, kept)}
    assert got[6] == (6, 6, "set") and got[901] == (901, None, "set")
    assert store.upsert(spark, kept, "t", new.limit(0)) == 0


def test_delete_and_vacuum(spark, kept):
    assert store.delete(spark, kept, "t", F.col("id") == 17) == 1
    assert store.delete(spark, kept, "t", F.col("tenant") == 3) > 1
    assert store.delete(spark, kept, "t", F.col("tenant") == 99) == 0
    want = sorted((i, i % 7, "old") for i in range(200) if i != 17 and i % 7 != 3)
    assert rows(spark, kept) == want
    assert store.delete(spark, kept, "t", F.lit(True)) == 16 and rows(spark, kept) == []
    store.upsert(spark, kept, "t", spark.createDataFrame([(1, 1, "again")], "id long, tenant long, text string"))
    assert rows(spark, kept) == [(1, 1, "again")]
    assert store.vacuum(spark, kept, keep=1) > 0 and rows(spark, kept) == [(1, 1, "again")] and store.manifest(spark, kept, 1) is None


@pytest.mark.parametrize("step", ["_write_buckets", "commit", "put_text"])
def test_a_stop_between_steps_leaves_the_former_version(spark, kept, monkeypatch, step):
    want = rows(spark, kept)

    def stopped(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, step, stopped)
        for change in (lambda: store.upsert(spark, kept, "t", spark.createDataFrame([(5, 1, "new")], "id long, tenant long, text string")), lambda: store.delete(spark, kept, "t", F.col("tenant") == 3), lambda: store.save({"t": (spark.range(1), "id", None, ())}, kept)):
            with pytest.raises(KeyboardInterrupt):
                change()
            assert rows(spark, kept) == want and store.state(spark, kept, {"v": 1}) == "ready"
    assert store.delete(spark, kept, "t", F.col("tenant") == 3) > 0 and len(rows(spark, kept)) < 200


def test_second_writer_fails(spark, kept):
    found = store.manifest(spark, kept)
    store.delete(spark, kept, "t", F.col("id") == 1)
    with pytest.raises(Exception, match="exists"):
        store.commit(spark, kept, found["number"] + 1, {}, {})
    assert len(rows(spark, kept)) == 199


def test_vectors_are_upserted_by_key(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    df = spark.range(50).select("id", F.array(F.col("id") + 1.0, F.lit(2.0)).alias("v"))
    sinks.write_vectors(df, path, "id", "v", 2)
    assert sinks.write_vectors(spark.createDataFrame([(3, [9.0, 9.0]), (77, [1.0, 1.0])], "id long, v array<double>"), path, "id", "v", 2) <= 2
    got = {r["id"]: list(r["v"]) for r in store.load(spark, path, "vectors").collect()}
    assert len(got) == 51 and got[3] == [9.0, 9.0] and got[4] == [5.0, 2.0]
    with pytest.raises(ValueError, match="invalid"):
        sinks.write_vectors(spark.createDataFrame([(1, [0.0, 0.0])], "id long, v array<double>"), path, "id", "v", 2)
    with pytest.raises(ValueError, match="dimension"):
        sinks.write_vectors(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), path, "id", "v", 1)
    assert len(store.load(spark, path, "vectors").collect()) == 51
    sinks.write_vectors(df.limit(4), path, "id", "v", 2, reset=True)
    assert store.load(spark, path, "vectors").count() == 4


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = f"{tmp_path}/x.parquet"
    spark.range(3).write.parquet(path)
    first = store.fingerprint(spark, path)
    assert first == store.fingerprint(spark, path)
    spark.range(4).write.mode("append").parquet(path)
    assert first != store.fingerprint(spark, path)


def test_texts_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/latest.txt"
    store.put_text(spark, path, "één\nline")
    assert store.get_text(spark, path) == "één\nline"
    with pytest.raises(Exception, match="exists"):
        store.put_text(spark, path, "other")
    store.put_text(spark, path, "other", replace=True)
    assert store.get_text(spark, path) == "other"


def test_a_hierarchy_is_refreshed_by_source(spark, tmp_path):
    from quillstone.operators import hierarchy, stored_hierarchy

    def chunks(texts):
        rows = [(s, f"{s}_{i}", "Chương I > Điều 1" if i < 3 else None, t, i) for s, own in texts.items() for i, t in enumerate(own)]
        return spark.createDataFrame(rows, "source string, id string, path string, text string, page int")

    def whole(df):
        parents, _ = hierarchy.build_parents(hierarchy.resolve_levels(df, "source", "id", "path", "text"), "source", "id", "text", "page", 40)
        return sorted(map(str, parents.collect()))

    path = f"{tmp_path}/hierarchy"
    refresh = lambda df: {r["source"]: r["state"] for r in stored_hierarchy.refresh(df, path, "source", "id", "path", "text", "page", 40).collect()}
    texts = {f"s{i}": [f"text {i} {j} " + "x" * (7 * j) for j in range(5)] for i in range(12)} | {None: ["no source"]}
    assert set(refresh(chunks(texts)).values()) == {"missing"}
    assert set(refresh(chunks(texts)).values()) == {"ready"} and store.manifest(spark, path)["number"] == 1  # nothing to do, nothing written
    texts["s3"] = [*texts["s3"], "one more"]
    texts["s20"] = ["new"]
    del texts["s7"]
    before = store.manifest(spark, path)["tables"]["parents"]["buckets"]
    states = refresh(chunks(texts))
    assert {s: v for s, v in states.items() if v != "ready"} == {"s3": "stale", "s20": "missing", "s7": "removed"}
    after = store.manifest(spark, path)["tables"]["parents"]["buckets"]
    assert sum(before.get(b) != after.get(b) for b in before.keys() | after.keys()) <= 3 and store.manifest(spark, path)["number"] == 2
    assert sorted(map(str, store.load(spark, path, "parents").collect())) == whole(chunks(texts))
    assert set(refresh(chunks(texts)).values()) == {"ready"}
