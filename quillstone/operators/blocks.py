"""Exact BM25 top k of many questions over many rows, by blocks of rows in numpy: no posting is shuffled and no index is stored.

A block holds the distinct terms of some rows and their (row, term, times), packed into one binary value by the task that cuts the
tokens. Document frequencies are counted in the blocks and summed by Spark. Every block of questions then meets every block of rows:
terms that are frequent on both sides are one matrix product, all others are added up along the postings that both blocks share; each
pair of blocks keeps the k best rows of a question, and a window keeps the k best of all.

Terms are compared as strings. Blocks are bounded by rows and tokens (a longer row is a block of its own); blocks of questions travel in
groups of bounded bytes, one after another, so that neither the driver nor a task holds a side. Where both sides grow, the work is
that of all pairs, evenly dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import store
from ..sources.tables import spread
from .bm25 import EPSILON, K1, RANK_DIGITS, B

#: Rows and tokens of a block at most.
ROWS, TOKENS = 2048, 1_000_000
#: Bytes of question blocks that are broadcast at a time.
GROUP_BYTES = 32 << 20
#: A term goes into the matrix product where its pairs, times this, are more than the pairs of rows; at most so many terms.
DENSE, COLUMNS = 300, 2048
#: Shared postings that are added up at a time.
STEP = 50_000


def _blob(columns: dict) -> bytes:
    """Arrays of any lengths as one value."""
    batch = pa.record_batch([pa.array([v], pa.list_(v.type)) if not len(v) else pa.ListArray.from_arrays([0, len(v)], v) for v in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _arrays(blob: bytes) -> dict:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return {n: batch.column(i).values if len(batch.column(i).values) else pa.array([], batch.column(i).type.value_type) for i, n in enumerate(batch.schema.names)}


def _block(keys: pa.Array, tokens: pa.Array) -> tuple[bytes, int, int]:
    """(blob, rows, tokens): rows by key, their lengths, distinct terms, and times by (row, term)."""
    order = pc.sort_indices(keys, null_placement="at_start")
    keys, tokens = keys.take(order), tokens.take(order)
    length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    code, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    each, times = np.unique(np.repeat(np.arange(len(length)), length) * n + code, return_counts=True)
    columns = {"key": keys, "length": length, "row": (each // n).astype(np.int32), "code": (each % n).astype(np.int32), "times": times.astype(np.int32), "term": coded.dictionary}
    return _blob({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}), len(length), int(length.sum())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, size = [], 0, 0

    def out():
        both = pa.Table.from_batches(held).combine_chunks()
        parts = [both.column(i).chunk(0) for i in range(2)]
        blob, rows, tokens = _block(*parts)
        return pa.record_batch([pa.array([blob], pa.binary()), pa.array([rows], pa.int64()), pa.array([tokens], pa.int64())], ["data", "rows", "tokens"])

    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(upto, upto[at] + TOKENS - size, side="right")) - 1
            to = min(room, at + ROWS - n, batch.num_rows)
            if to <= at and not held:
                to = at + 1  # a longer row stands alone
            if to > at:
                held.append(batch.slice(at, to - at))
                n, size, at = n + to - at, size + int(upto[to] - upto[at]), to
            if at < batch.num_rows:
                yield out()
                held, n, size = [], 0, 0
    if held:
        yield out()


def packed(rows: DataFrame, key: str, tokens: Column, name: str) -> DataFrame:
    """data, rows, tokens: the rows in blocks, written."""
    return store.spill(rows.select(F.col(key), tokens.alias("tokens")).mapInArrow(_pack, "data binary, rows long, tokens long"), name)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("data"):
            own = _arrays(blob.as_buffer())
            yield pa.record_batch([own["term"], pa.array(np.bincount(own["code"].to_numpy(), minlength=len(own["term"])))], ["term", "df"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, blob in zip(batch.column("block"), batch.column("data"), strict=True):
            term = _arrays(blob.as_buffer())["term"]
            yield pa.record_batch([pa.array(np.full(len(term), block.as_py())), pa.array(np.arange(len(term), dtype=np.int32)), term], ["block", "code", "term"])


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions' blocks with weights (times x idf) in place of times; terms that no row has are dropped."""
    for batch in batches:
        for blob, code, idf in zip(batch.column("data"), batch.column("code"), batch.column("idf"), strict=True):
            own = _arrays(blob.as_buffer())
            weight = np.zeros(len(own["term"]))
            if code.is_valid:
                weight[code.values.to_numpy()] = idf.values.to_numpy()
            term = own["code"].to_numpy()
            data = _blob({"key": own["key"], "row": own["row"], "code": own["code"], "weight": pa.array(weight[term] * own["times"].to_numpy()), "term": own["term"]})
            yield pa.record_batch([pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], ["asked", "bytes"])


def _products(q: dict, d: dict) -> np.ndarray:
    """Scores of all pairs of two blocks."""
    nq, nd, n = len(q["key"]), len(d["key"]), len(q["term"])
    code = pc.fill_null(pc.index_in(d["term"], value_set=q["term"]), -1).to_numpy(zero_copy_only=False)[d["code"]]
    own = code >= 0
    drow, code, part = d["row"][own], code[own], d["part"][own]
    cq, cd = np.bincount(q["code"], minlength=n), np.bincount(code, minlength=n)
    shared = cq.astype(np.int64) * cd
    often = np.flatnonzero(shared * DENSE > nq * nd)
    often = often[np.argsort(-shared[often], kind="stable")[:COLUMNS]]
    column = np.full(n, -1, dtype=np.int64)
    column[often] = np.arange(len(often))
    qc, dc = column[q["code"]], column[code]
    if len(often):
        a, b = np.zeros((nq, len(often))), np.zeros((nd, len(often)))
        a[q["row"][qc >= 0], qc[qc >= 0]] = q["weight"][qc >= 0]
        b[drow[dc >= 0], dc[dc >= 0]] = part[dc >= 0]
        scores = a @ b.T
    else:
        scores = np.zeros((nq, nd))
    rare = dc < 0
    drow, code, part = drow[rare], code[rare], part[rare]
    by = np.argsort(code, kind="stable")
    drow, part, count = drow[by].astype(np.int64), part[by], np.bincount(code, minlength=n)
    first = np.cumsum(count) - count
    some = (qc < 0) & (count[q["code"]] > 0)
    qrow, qcode, weight = q["row"][some].astype(np.int64), q["code"][some], q["weight"][some]
    upto = np.concatenate([[0], np.cumsum(count[qcode])])
    at = 0
    while at < len(qrow):  # questions' postings are in the order of their rows: each step adds to a few rows of the scores
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + STEP, side="right")) - 1)
        n_each = count[qcode[at:to]]
        each = np.repeat(np.arange(at, to), n_each)
        place = np.arange(len(each)) - np.repeat(upto[at:to] - upto[at], n_each) + first[qcode[each]]
        low, high = int(qrow[at]), int(qrow[to - 1]) + 1
        scores[low:high] += np.bincount((qrow[each] - low) * nd + drow[place], weights=weight[each] * part[place], minlength=(high - low) * nd).reshape(high - low, nd)
        at = to
    return scores


def best_cells(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest values of each row, equal ones by column. No NaN."""
    if k >= scores.shape[1]:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    if k == 1:
        return np.arange(len(scores)), scores.argmax(axis=1)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, level = scores > least, scores == least
    left = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= left)))


def _scorer(query: str, key: str, k: int, average: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, d = None, {}
        for batch in batches:
            for asked, data in zip(batch.column("asked"), batch.column("data"), strict=True):
                q = _arrays(asked.as_buffer())
                q = {n: v if n in ("key", "term") else v.to_numpy() for n, v in q.items()}
                blob = data.as_buffer()
                if last is None or not blob.equals(last):
                    last, d = pa.py_buffer(blob.to_pybytes()), _arrays(blob)
                    d = {n: v if n in ("key", "term") else v.to_numpy() for n, v in d.items()}
                    tf = d["times"]
                    d["part"] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * d["length"][d["row"]] / average))
                scores = _products(q, d)
                row, column = best_cells(np.round(scores, RANK_DIGITS), k)
                found = scores[row, column]
                row, column, found = row[found > 0], column[found > 0], found[found > 0]
                yield pa.record_batch([q["key"].take(pa.array(row)), d["key"].take(pa.array(column)), pa.array(found)], [query, key, "score"])

    return score


def in_groups(blocks: list) -> list[list[int]]:
    """The ids of blocks (id, bytes) in groups of bounded bytes; one empty group where there are none."""
    groups, size = [[]], 0
    for b in blocks:
        if groups[-1] and size + b["bytes"] > GROUP_BYTES:
            groups, size = [*groups, []], 0
        groups[-1].append(b["id"])
        size += b["bytes"]
    return groups


def top_k(chunks: DataFrame, questions: DataFrame, key: str, query: str, tokens: Column, query_tokens: Column, k: int) -> DataFrame:
    """query, key, score, rank of each question's k best rows with scores above zero: score down on nine digits, then key. Keys are unique."""
    spark = chunks.sparkSession
    rows = packed(chunks, key, tokens, "rows")
    size = rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    n, average = size["n"], size["tokens"] / max(1, size["n"])
    counted = store.spill(rows.mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = counted.agg(F.avg(raw)).first()[0] or 0.0
    idf = counted.select("term", F.when(raw < 0, F.lit(EPSILON * mean)).otherwise(raw).alias("idf"))
    asked = questions.select(F.col(query), query_tokens.alias("__tokens"))
    if not questions.groupBy(query).count().filter("count > 1").isEmpty():  # rows of one id are one question
        asked = asked.groupBy(query).agg(F.flatten(F.collect_list("__tokens")).alias("__tokens"))
    asked = packed(asked, query, F.col("__tokens"), "questions").withColumn("block", F.monotonically_increasing_id())
    asked = store.spill(asked, "questions")
    known = asked.select("block", "data").mapInArrow(_terms, "block long, code int, term string").join(idf, "term").groupBy("block")
    known = known.agg(F.collect_list(F.struct("code", "idf")).alias("known")).select("block", F.col("known.code").alias("code"), F.col("known.idf").alias("idf"))
    weighed = asked.select("block", "data").join(known, "block").select("data", "code", "idf").mapInArrow(_weigh, "asked binary, bytes long")
    weighed = store.spill(weighed.withColumn("id", F.monotonically_increasing_id()), "asked")
    blocks, kinds = weighed.select("id", "bytes").collect(), [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((questions, query), (chunks, key))]  # a row for each block
    schema = f"`{kinds[0].replace(' ', '` ', 1)}, `{kinds[1].replace(' ', '` ', 1)}, score double"
    order = W.partitionBy(query).orderBy(F.round("score", RANK_DIGITS).desc(), F.col(key))
    dealt, out = spread(rows.select("data")), None
    for some in in_groups(blocks):
        own = weighed.filter(F.col("id").isin(some)).select("asked")
        met = dealt.crossJoin(F.broadcast(own)).mapInArrow(_scorer(query, key, k, average), schema)
        met = store.spill(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        out = met if out is None else out.unionByName(met)  # groups hold different questions
    return out
