"""Sinks: partitioned JSON, keyed upserts, versioned stores, appended audit lines, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dense import vector_faults
from . import store


def write_chunks(chunks: DataFrame, path: str, dry_run: bool = True) -> DataFrame:
    """Chunks as JSON, a folder per strategy; a dry run writes nothing. Returns counts by strategy."""
    if not dry_run:
        chunks.write.mode("overwrite").partitionBy("strategy").json(path)
    return chunks.groupBy("strategy").agg(F.count("*").alias("n"))


def upsert(known: DataFrame, new: DataFrame, key: str, only: list[str] | None = None) -> DataFrame:
    """Rows by key: new ones replace known ones, or only set some columns of them; unknown keys are added."""
    return store.upsert_rows(known, new, key, only)


def write_store(tables: dict[str, DataFrame], path: str, manifest: dict) -> None:
    """Tables as a new version of a store, its manifest last: a reader finds whole tables, a writer that stops leaves the former version."""
    store.save(tables, path, manifest)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What the newest version says of its inputs and settings; None where there is no whole store."""
    found = store.manifest(spark, path)
    return found and found["identity"]


def store_state(spark: SparkSession, path: str, identity: dict) -> str:
    """ready, stale (built from other inputs or settings) or missing."""
    return store.state(spark, path, identity)


def write_vectors(new: DataFrame, path: str, key: str, vector: str, dimension: int, reset: bool = False) -> int:
    """Vectors by key into a store; returns the buckets rewritten. All are checked before anything is touched; reset leaves only the new ones."""
    spark = new.sparkSession
    faulty = new.filter(F.size(vector_faults(F.col(vector), dimension)) > 0).limit(1).count()
    if faulty:
        raise ValueError("some vectors are invalid; the store is unchanged")
    if reset or store.manifest(spark, path) is None:
        rows = store.last_wins(new, [key], [F.xxhash64(*new.columns)])
        store.save({"vectors": (rows, key, None, ())}, path, {"dimension": dimension})
        return store.BUCKETS
    if store.manifest(spark, path)["identity"].get("dimension") != dimension:
        raise ValueError("the store holds vectors of another dimension")
    return store.upsert(spark, path, "vectors", new)


def append_audit(events: DataFrame, path: str) -> None:
    """Append audit events as JSON lines."""
    events.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str, order: list[str]) -> None:
    """A CSV of one file, for small aggregates."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A small aggregate as a Markdown table."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect())])


def encrypt(c: Column, key: Column) -> Column:
    """AES-GCM with a random vector, base64."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def decrypt(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


def write_evaluation(rows: DataFrame, path: str, required: list[str]) -> str:
    """A report in a folder of its own, and only then the pointer latest.txt to it: a failed run leaves the last good one in place."""
    missing = set(required) - set(rows.columns)
    if missing:
        raise ValueError(f"the report lacks {sorted(missing)}")
    spark, name = rows.sparkSession, f"report-{uuid.uuid4().hex[:12]}"
    rows.write.json(f"{path}/{name}")
    store.put_text(spark, f"{path}/latest.txt", name, replace=True)
    return f"{path}/{name}"


def latest_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """The report that latest.txt names."""
    name = store.get_text(spark, f"{path}/latest.txt")
    return spark.read.json(f"{path}/{name}")
