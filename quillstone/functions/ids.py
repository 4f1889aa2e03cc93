"""Stable identifiers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent_id(source: Column, article: Column, window: Column) -> Column:
    """P_ and 16 digits of the SHA-256 of source, article and window."""
    return F.concat(F.lit("P_"), F.substring(F.sha2(F.concat_ws("||", source, article, window.cast("string")), 256), 1, 16))


def tree_id(doc: Column, path: Column) -> Column:
    """16 digits of the SHA-1 of document and path."""
    return F.substring(F.sha1(F.concat_ws("::", doc, path)), 1, 16)


def document_id(meta: Column, stem: Column) -> Column:
    """The stated id, else 12 digits of the SHA-1 of the file's stem."""
    return F.coalesce(F.when(F.trim(meta) != "", F.trim(meta)), F.substring(F.sha1(stem), 1, 12))


def chunk_id(doc: Column, article: Column, clause: Column, seq: Column) -> Column:
    """doc_D{article}K{clause}_{seq}; MD where there is no article."""
    part = F.when(F.coalesce(article, F.lit("")) == "", F.lit("MD")).otherwise(F.concat(F.lit("D"), article, F.when(F.coalesce(clause, F.lit("")) != "", F.concat(F.lit("K"), clause)).otherwise("")))
    return F.concat(doc, F.lit("_"), part, F.lit("_"), F.lpad(seq.cast("string"), 3, "0"))


def collection_name(strategy: str, dimension: int, model: str) -> str:
    """Name of a vector collection: strategy, dimension and 8 digits of the model's SHA-256."""
    import hashlib

    return f"nhnn-{strategy}-{dimension}-{hashlib.sha256(model.encode()).hexdigest()[:8]}"


def numeric_suffix(c: Column) -> list[Column]:
    """Sort keys: ids with a number at their end by it, then the others; then the id."""
    digits = F.regexp_extract(c, r"(\d+)\s*$", 1)
    return [F.when(digits == "", 1).otherwise(0), F.when(digits == "", 0).otherwise(digits.try_cast("bigint")), c]


def fingerprint(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: a digest of all ids and text lengths, whatever their order, and the row count.

    Row digests are summed (modulo 2**64 in two halves) so that no task holds all ids.
    """
    row = F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("string")), 256)
    half = lambda at: F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(half(1)).alias("digest_a"), F.sum(half(13)).alias("digest_b"))
