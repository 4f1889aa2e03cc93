"""Vector search: exact cosine top k by blocks, over all vectors or within groups, validation, and latent semantic vectors by MLlib."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import l2_normalize, norm
from ..sources import store
from ..sources.tables import spread
from .blocks import in_groups

#: Vectors of a block at most; pairs whose sums are taken at a time.
ROWS, STEP = 2048, 50_000


def vector_faults(c: Column, dimension: int) -> Column:
    """Codes of what is wrong with a vector: null, dimension, nan, infinite, zero."""
    bad = lambda test: F.exists(c, test)
    value = lambda x: x.cast("double")
    return F.array_compact(
        F.array(
            F.when(c.isNull(), "null"),
            F.when(F.size(c) != dimension, "dimension"),
            F.when(bad(lambda x: x.isNull() | F.isnan(value(x))), "nan"),
            F.when(bad(lambda x: F.abs(value(x)) == float("inf")), "infinite"),
            F.when((F.size(c) > 0) & F.forall(c, lambda x: value(x) == 0), "zero"),
        )
    )


def _pack(bucketed: bool):
    """Rows as values of bounded size: Arrow batches of at most ROWS rows by their first column (the key), of one bucket each."""

    def blob(rows: pa.RecordBatch) -> bytes:
        rows = rows.take(pc.sort_indices(rows.column(0), null_placement="at_start"))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        return sink.getvalue().to_pybytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None

        def out():
            data = blob(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            return pa.record_batch([pa.array([last], pa.int32()), pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], ["bucket", "data", "bytes"])

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), batch.num_rows] if bucketed else [0, batch.num_rows]
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                while low < high:
                    if held and (n == ROWS or last != int(bucket[low])):
                        yield out()
                        held, n = [], 0
                    last, to = int(bucket[low]), min(int(high), int(low) + ROWS - n)
                    part = batch.slice(low, to - low)
                    held.append(pa.RecordBatch.from_arrays(part.columns[1:], names=part.schema.names[1:]))
                    n, low = n + to - low, to
        if held:
            yield out()

    return pack


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) by dimension; what is null or holds a null has none. Sums go in order, as `dot` takes them."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).copy()
    values = column.flatten()
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    hole = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    size[(size >= 0) & (hole[start + np.maximum(size, 0)] > hole[start])] = -1
    values, found = values.to_numpy(zero_copy_only=False), []
    for dimension in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == dimension)
        m = values[start[at, None] + np.arange(dimension)].astype(np.float64)
        n = np.sqrt(_in_order(m, m))[:, None]
        found.append((at, m / np.where((n > 0) | np.isnan(n), n, 1.0)))
    return found


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first value to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: ties of the decimal form go away from zero."""
    out, scaled = np.round(x, digits), np.abs(x) * 10.0**digits
    for i in np.flatnonzero(np.abs(scaled % 1 - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


#: In a block's scores: no such pair, and a pair whose similarity is null (the last one); NaN is the greatest, as Spark orders it.
ABSENT, NULL = -np.inf, -9.0


def _similar(q: pa.RecordBatch, d: pa.RecordBatch, vectors: tuple, allowed: np.ndarray | None, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, similarity) of each question's k best rows. A matrix product finds the candidates, sums in order decide."""
    near = np.full((q.num_rows, d.num_rows), NULL)
    same = [(x, y) for x in vectors[0] for y in vectors[1] if x[1].shape[1] == y[1].shape[1]]
    with np.errstate(invalid="ignore"):
        for (qa, qm), (da, dm) in same:
            if len(qa) == q.num_rows and len(da) == d.num_rows:
                near = qm @ dm.T
            else:
                near[np.ix_(qa, da)] = qm @ dm.T
    near[np.isnan(near)] = np.inf
    if allowed is not None:
        near[~allowed] = ABSENT
    if k < d.num_rows:
        least = np.partition(near, d.num_rows - k, axis=1)[:, d.num_rows - k, None]
        row, column = np.nonzero((near >= least - 2 * 10.0**-digits) & (near > ABSENT))
    else:
        row, column = np.nonzero(near > ABSENT)
    found = near[row, column]
    for (qa, qm), (da, dm) in same:
        qi, di = np.full(q.num_rows, -1), np.full(d.num_rows, -1)
        qi[qa], di[da] = np.arange(len(qa)), np.arange(len(da))
        own = np.flatnonzero((qi[row] >= 0) & (di[column] >= 0) & np.isfinite(found))
        for at in range(0, len(own), STEP):
            some = own[at : at + STEP]
            found[some] = _in_order(qm[qi[row[some]]], dm[di[column[some]]])
    rounded = found.copy()
    real = np.flatnonzero(np.isfinite(found) & (found > NULL))
    rounded[real] = _half_up(found[real], digits)
    order = np.lexsort((column, -rounded, row))
    row, column, found = row[order], column[order], found[order]
    first = np.searchsorted(row, row)  # the place of its question's best
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep], found[keep]


def _nearest(asked: list[str], key: str, k: int, digits: int, mask: bool, group: bool):
    def open_block(blob) -> tuple[pa.RecordBatch, list]:
        rows = pa.ipc.open_stream(blob).read_next_batch()
        return rows, _matrices(rows.column("__vector"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, d = None, None
        for batch in batches:
            for asking, data in zip(batch.column("asked"), batch.column("data"), strict=True):
                if last is None or not data.as_buffer().equals(last):
                    last = pa.py_buffer(data.as_buffer().to_pybytes())
                    d = open_block(last)
                q = open_block(asking.as_buffer())
                allowed = None
                if mask:
                    allowed = (q[0].column("__bits").fill_null(0).to_numpy()[:, None] & d[0].column("__mask").fill_null(0).to_numpy()) != 0
                if group:
                    codes = pa.chunked_array([q[0].column("__group"), d[0].column("__group")]).dictionary_encode().unify_dictionaries()
                    codes = [c.indices.to_numpy(zero_copy_only=False) for c in codes.chunks]
                    allowed = codes[0][:, None] == codes[1]
                row, column, found = _similar(q[0], d[0], (q[1], d[1]), allowed, k, digits)
                value = pa.array(np.where(found == np.inf, np.nan, found), mask=found == NULL)
                yield pa.record_batch([*(q[0].column(c).take(pa.array(row)) for c in asked), d[0].column(key).take(pa.array(column)), value], [*asked, key, "similarity"])

    return find


def _met(rows: DataFrame, questions: DataFrame, key: str, asked: list[str], k: int, digits: int, mask: bool = False, buckets: bool = False) -> DataFrame:
    """asked, key, similarity, rank: every block of questions meets every block of rows, or those of its bucket; one group of question blocks after another."""
    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    schema = ", ".join([*(kind(questions, c) for c in asked), kind(rows, key), "similarity double"])
    blob = "bucket int, data binary, bytes long"
    held = store.spill(rows.mapInArrow(_pack(buckets), blob).select("bucket", "data"), "vectors")
    q = store.spill(questions.mapInArrow(_pack(buckets), blob).withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("data", "asked"), "asked")
    dealt, parts = spread(held), []
    best = W.partitionBy(*asked).orderBy(F.col("similarity").desc(), F.col(key))
    first = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    groups = in_groups(q.select("id", "bytes").collect())  # a row for each block
    for some in groups:
        own = F.broadcast(q.filter(F.col("id").isin(some)).select("bucket", "asked"))  # of bounded bytes
        pairs = dealt.join(own, "bucket").mapInArrow(_nearest(asked, key, k, digits, mask, buckets), schema)
        pairs = first(pairs.withColumn("similarity", F.round("similarity", digits)))
        parts.append(store.spill(pairs, "nearest") if len(groups) > 1 else pairs)
    # rows of one question may lie in several groups
    return first(reduce(DataFrame.unionByName, parts)) if len(groups) > 1 else parts[0]


def cosine_top_k(vectors: DataFrame, questions: DataFrame, key: str, query_key: str | list[str], vector: str, k: int, digits: int = 6, mask: str | None = None, bits: str | None = None) -> DataFrame:
    """query, key, similarity, distance, rank. Every question meets every vector, block by block: a stated query set.

    Each pair of blocks gives a question's k best, found by a matrix product and decided by sums in order; each task keeps the best k
    of its own blocks (WindowGroupLimit) before anything is shuffled. With mask (of the vectors) and bits (of the questions) only
    pairs that share a bit exist.
    """
    asked = [query_key] if isinstance(query_key, str) else list(query_key)
    value = F.col(vector).cast("array<double>").alias("__vector")
    q = questions.select(F.lit(0).alias("__bucket"), *asked, *([F.col(bits).alias("__bits")] if bits else []), value)
    v = vectors.select(F.lit(0).alias("__bucket"), F.col(key), *([F.col(mask).alias("__mask")] if mask else []), value)
    found = _met(spread(v), q, key, asked, k, digits, mask=mask is not None)
    return found.withColumn("distance", F.round(1 - F.col("similarity"), digits))


def cosine_top_k_within(vectors: DataFrame, asked: DataFrame, questions: DataFrame, key: str, query_key: str, group: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """query, group, key, similarity: of each asked (query, group) the k best vectors of the group.

    Groups are dealt to buckets by hash; only blocks of one bucket meet. A group of any size spreads over many blocks.
    """
    value, n = F.col(vector).cast("array<double>").alias("__vector"), max(1, vectors.count() // ROWS)
    bucket = F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(n)).cast("int").alias("__bucket")
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, vectors.rdd.getNumPartitions())
    named = F.col(group).cast("string").alias("__group")
    v = vectors.filter(F.col(group).isNotNull()).select(bucket, F.col(key), named, value).repartitionByRange(parts, "__bucket", "__group", key).sortWithinPartitions("__bucket")
    q = asked.select(query_key, group).distinct().join(questions.select(query_key, vector), query_key).filter(F.col(group).isNotNull())
    q = q.select(bucket, query_key, group, named, value).sortWithinPartitions("__bucket")
    return _met(v, q, key, [query_key, group], k, digits, buckets=True).drop("rank")


def latent_vectors(chunks: DataFrame, key: str, tokens: Column, dimensions: int = 256, terms: int = 4096, min_df: int = 2):
    """TF-IDF with log frequency, truncated SVD, unit length. (key, vector) rows. The vocabulary's size bounds the driver's part."""
    from pyspark.ml.feature import IDF, CountVectorizer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = chunks.select(F.col(key), tokens.alias("tokens"))
    counted = CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=terms, minDF=min_df).fit(rows).transform(rows)
    logged = counted.withColumn("tf", array_to_vector(F.transform(vector_to_array("tf"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))))
    weighed = IDF(inputCol="tf", outputCol="weights").fit(logged).transform(logged).select(key, "weights")
    matrix = RowMatrix(weighed.select("weights").rdd.map(lambda r: Vectors.dense(r[0].toArray())))
    svd = matrix.computeSVD(min(dimensions, matrix.numCols() - 1))
    basis = svd.V.toArray()
    shared = chunks.sparkSession.sparkContext.broadcast(basis)  # terms times dimensions

    def project(weights):
        import numpy as np
        import pandas as pd

        return pd.Series(list(np.vstack(weights.to_numpy()) @ shared.value)) if len(weights) else pd.Series([], dtype=object)

    out = weighed.withColumn("vector", F.pandas_udf(project, "array<double>")(vector_to_array("weights")))
    return out.select(key, l2_normalize(F.col("vector")).alias("vector"))


__all__ = ["cosine_top_k", "cosine_top_k_within", "latent_vectors", "norm", "vector_faults"]
