"""Quality by nearest-neighbour voting over labelled latent-semantic vectors.

A text's terms are its words (hashed), its byte-class trigrams (letters, capitals, digits, spaces, line ends and each sign are
classes) and a few measures of repetition. Weighted by log count and inverse document frequency, a truncated singular value
decomposition of a bounded sample of labelled texts gives latent vectors. The sample's vectors are broadcast (their number is a parameter); every
text's cosine with all of them is computed exactly in blocks, and its nearest neighbours vote with their similarity.

Only labelled rows that are not held out are learnt from; language, source, id and label of a text are never inputs of its
score. Whole texts are read, however long. Null and empty texts score 0. Without labels every other text scores 0.5. Repeated rows
give one result each, but only one row of an id is learnt from; a null id is not held out. Neighbours that tie with the last one vote
too. Empty tables give empty results. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_TABLE, Hasher, batches, chunks, fresh

#: Most labelled texts that the model holds; with more labels, those of the smallest hashes of their id.
MAX_LABELLED = 4000
#: Buckets of class trigrams and of words, and the words' weight beside the trigrams' unit norm.
BUCKETS, WORDS, WORD_WEIGHT = 2039, 2048, 0.5
#: Latent dimensions, neighbours that vote, power of the similarity in a vote.
DIMENSIONS, NEIGHBOURS, POWER = 48, 15, 6
#: Texts whose vectors are made at a time.
BLOCK = 500
THRESHOLD = 0.7
#: Weights of the measures of repetition beside the trigrams' unit norm.
_SHAPES = 6
_CLASS = np.array([2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 5 if b == 10 else 4 if b in (9, 11, 12, 13, 32) else 1 if b > 127 or 97 <= b <= 122 else 6 + b % 41 for b in range(256)], dtype=np.int64)
_HASHER = Hasher(8)


def text_terms(texts: list) -> np.ndarray:
    """Logarithmic counts of each text's trigrams and words, then its measures of repetition, as one row each."""
    out = np.zeros((len(texts), BUCKETS + WORDS + _SHAPES), dtype=np.float32)
    for first, low, start, end, bound in chunks(texts, SPACE_TABLE):
        words = _HASHER.words(low, start, end)
        for k in range(len(bound) - 1):
            a, b = bound[k], bound[k + 1]
            if a == b:
                continue
            raw = np.frombuffer(texts[first + k].encode("utf-8", "surrogatepass"), dtype=np.uint8)
            c = _CLASS[raw]
            if len(c) > 2:
                out[first + k, :BUCKETS] = np.bincount((c[:-2] * 2209 + c[1:-1] * 47 + c[2:]) % BUCKETS, minlength=BUCKETS)
            w, n = words[a:b], b - a
            out[first + k, BUCKETS : BUCKETS + WORDS] = np.bincount((w % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
            np.log1p(out[first + k], out=out[first + k])
            _, counts = np.unique(w, return_counts=True)
            pairs = np.unique(w[:-1] * np.uint64(3) + w[1:]).size / max(1, n - 1)
            out[first + k, BUCKETS + WORDS :] = (
                (w[1:] == w[:-1]).mean() if n > 1 else 0,
                (w[2:] == w[:-2]).mean() if n > 2 else 0,
                1 - pairs if n > 1 else 0,
                counts.max() / n if n > 20 else 0,
                min(1.0, np.log1p(n) / 12),
                np.minimum(end[a:b] - start[a:b], 40).mean() / 40,
            )
    return out


class Model:
    """What is broadcast: term weights, projection and the labelled vectors."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, seed: int = 8):
        self.labels = labels.astype(np.float32)
        seen = (terms[:, : BUCKETS + WORDS] > 0).sum(axis=0)
        self.idf = np.log((1 + len(terms)) / (1 + seen)).astype(np.float32) + 0.1
        x = np.empty(terms.shape, dtype=np.float32)
        for at in range(0, len(terms), BLOCK):
            x[at : at + BLOCK] = self.weigh(terms[at : at + BLOCK])
        rng = np.random.default_rng(seed)
        size = min(DIMENSIONS, *x.shape)
        q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(size + 12, x.shape[1]))).astype(np.float32))[0]
        for _ in range(4):  # subspace iteration
            q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
        _, s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
        self.projection = np.ascontiguousarray(vt[:size].T)
        self.vectors = np.concatenate([self.place(terms[at : at + BLOCK]) for at in range(0, len(terms), BLOCK)])

    def weigh(self, terms: np.ndarray) -> np.ndarray:
        x = terms.astype(np.float32)
        x[:, : BUCKETS + WORDS] *= self.idf
        for part, weight in ((x[:, :BUCKETS], 1.0), (x[:, BUCKETS : BUCKETS + WORDS], WORD_WEIGHT)):
            norm = np.linalg.norm(part, axis=1, keepdims=True)
            part *= weight / np.where(norm > 0, norm, 1)
        return x

    def place(self, terms: np.ndarray) -> np.ndarray:
        z = self.weigh(terms) @ self.projection
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of good labels among the nearest labelled texts."""
        out, k = np.zeros(len(terms)), min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(terms), BLOCK):
            sims = np.round(self.place(terms[at : at + BLOCK]) @ self.vectors.T, 5)
            least = np.partition(sims, -k, axis=1)[:, -k][:, None]
            votes = np.where(sims >= least, np.maximum(sims, 1e-3) ** POWER, 0)
            out[at : at + BLOCK] = (votes @ self.labels) / votes.sum(axis=1)
        return out.clip(0, 1)  # rounding may pass the bounds


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> Model | None:
    """Learn from at most `most` labelled texts; None without any."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(most)

    def terms(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            yield pd.DataFrame({"id": pdf["id"].astype(str), "label": pdf["label"], "terms": [x.tobytes() for x in text_terms(list(pdf["text"])).astype(np.float16)]})

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("id") == F.col("__id")).filter(F.length("text") > 0)  # at most `most` ids
    found = found.groupBy("id", "label").agg(F.min("text").alias("text"))  # of rows that share an id, one
    rows = found.select("id", "label", "text").mapInPandas(terms, "id string, label int, terms binary").toPandas()
    if not len(rows):
        return None
    rows = rows.assign(n=rows["id"].str.len()).sort_values(["n", "id", "terms"])
    return Model(np.stack([np.frombuffer(x, dtype=np.float16) for x in rows["terms"]]), rows["label"].to_numpy())


def quality_scores(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """The rows and columns of docs and a score column named out. Map-only."""
    batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LABELLED vectors

    def score(texts: pd.Series) -> pd.Series:
        held = shared.value
        values = list(texts)
        full = np.array([isinstance(t, str) and bool(t.strip()) for t in values])
        if held is None:
            return pd.Series(np.where(full, 0.5, 0.0))
        return pd.Series(np.where(full, held.score(text_terms(values)), 0.0))

    return docs.withColumn(out, F.pandas_udf(score, "double")(F.coalesce(F.col(text_col), F.lit(""))))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold; same columns."""
    own = fresh(docs, "__quality")
    scored = quality_scores(docs, fit(docs, labels, id_col, text_col, label_col), text_col, own)
    return scored.filter(F.col(own) >= threshold).select(*docs.columns)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per text: id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = quality_scores(docs.select(F.col(id_col), F.col(text_col)), model, text_col)
    return scored.select(F.col(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
