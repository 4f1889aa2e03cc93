"""Nearest vectors by blocks against every pair scored by Spark's own expressions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.text import dot, l2_normalize
from quillstone.operators import dense
from quillstone.plans import catalog

KIND = "id long, v array<double>, mask long, doc string"


def odd(n, seed):
    """Vectors with equal ones, zeros, nulls, other dimensions, holes and NaN among them."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=6).round(1).tolist(), int(rng.integers(0, 4)), f"d{i % 5}") for i in range(n)]
    for i in range(0, n, 9):
        rows[i] = (i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], 3, "d1")
    strange = [[0.0] * 6, None, [1.0, 2.0], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, []]
    rows += [(n + i, v, 1 + i % 3, "d2") for i, v in enumerate(strange)]
    return rows + [(-1, [0.5] * 6, None, None)]


def every_pair(v, q, on):
    pairs = v.join(q, on) if on is not None else v.crossJoin(q)
    return pairs.withColumn("similarity", F.round(dot(l2_normalize(F.col("w")), l2_normalize(F.col("v"))), 6))


def told(rows, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("k", [1, 4, 60])
@pytest.mark.parametrize("masked", [False, True])
def test_top_k_is_that_of_every_pair(spark, monkeypatch, k, masked):
    v = spark.createDataFrame(odd(40, 1), KIND).repartition(3)
    q = v.filter("id % 4 = 0 OR id >= 40").select(F.col("id").alias("q"), F.col("v").alias("w"), F.col("mask").alias("bits"))
    pairs = every_pair(v, q, None)
    pairs = pairs.filter(F.col("mask").bitwiseAND(F.col("bits")) != 0) if masked else pairs
    order = W.partitionBy("q").orderBy(F.col("similarity").desc(), "id")
    want = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect()
    named = {"mask": "mask", "bits": "bits"} if masked else {}
    monkeypatch.setattr("quillstone.operators.blocks.GROUP_BYTES", 1)  # every block of questions is a group of its own
    asked = q.withColumnRenamed("w", "v")
    got = dense.cosine_top_k(v, asked.unionByName(asked.limit(0)).repartition(2), "id", "q", "v", k, **named).collect()
    assert told(got, ["q", "id", "similarity", "rank"]) == told(want, ["q", "id", "similarity", "rank"])


def test_best_of_asked_groups(spark):
    v = spark.createDataFrame(odd(60, 2), KIND).repartition(3)
    q = v.filter("id % 6 = 0").select(F.col("id").alias("q"), "v")
    asked = q.select("q", F.explode(F.array(F.concat(F.lit("d"), (F.col("q") % 5).cast("string")), F.lit("d2"), F.lit("none"))).alias("doc"))
    pairs = every_pair(v, asked.distinct().join(q.withColumnRenamed("v", "w"), "q"), "doc")
    order = W.partitionBy("q", "doc").orderBy(F.col("similarity").desc(), "id")
    want = pairs.withColumn("r", F.row_number().over(order)).filter("r <= 3").collect()
    got = dense.cosine_top_k_within(v, asked, q, "id", "q", "doc", "v", 3).collect()
    assert told(got, ["q", "doc", "id", "similarity"]) == told(want, ["q", "doc", "id", "similarity"])


def test_no_pair_is_a_row_of_spark(spark):
    v = spark.createDataFrame(odd(40, 3), KIND)
    plan = dense.cosine_top_k(v, v.select(F.col("id").alias("q"), "v"), "id", "q", "v", 2)._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def test_packs_are_bounded_and_keep_buckets_apart(monkeypatch):
    monkeypatch.setattr(dense, "ROWS", 3)
    batch = pa.record_batch([pa.array([0] * 5 + [1] * 2 + [4], pa.int32()), pa.array(range(8, 0, -1)), pa.array([[1.0]] * 8)], ["b", "key", "__vector"])
    found = pa.Table.from_batches(list(dense._pack(True)(iter([batch.slice(0, 2), batch.slice(2)]))))
    keys = [pa.ipc.open_stream(x).read_next_batch().column("key").to_pylist() for x in found["data"].to_pylist()]
    assert found["bucket"].to_pylist() == [0, 0, 1, 4] and keys == [[6, 7, 8], [4, 5], [2, 3], [1]]


def test_half_goes_up_as_spark_rounds(spark):
    x = [0.1234565, -0.1234565, 0.0000005, 0.9999995, 0.3, 1.0000000000000002]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert dense._half_up(np.array(x), 6).tolist() == want


@pytest.mark.parametrize("name", ["cosine_topk"])
def test_registered_search_meets_in_blocks(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "zip_with" not in plan
