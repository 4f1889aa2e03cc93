"""A stored parent hierarchy that is refreshed by source.

A tree of digests tells what changed: a digest of each chunk, of each source (the sum of its chunks' digests) and of the corpus (the
sum of its sources'). A refresh joins the sources' digests with the stored ones and rebuilds changed and new sources only; sources
that are gone go. Parents, children and digests change in one version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from .hierarchy import build_parents, resolve_levels


def _sum_of(row) -> tuple:
    """Two numbers that add up over rows in any order, from a SHA-256 in hex."""
    half = lambda at: F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)"))
    return half(1), half(13)


def source_digests(chunks: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """source, n_chunks, digest: added up inside each task first, whatever the order."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    a, b = _sum_of(row)
    return chunks.groupBy(source).agg(F.count("*").alias("n_chunks"), a.cast("string").alias("a"), b.cast("string").alias("b")).select(source, "n_chunks", F.concat_ws("-", "n_chunks", "a", "b").alias("digest"))


def corpus_digest(digests: DataFrame, source: str) -> str:
    """One text for all sources and their digests."""
    a, b = _sum_of(F.sha2(F.concat_ws(":", F.coalesce(F.col(source).cast("string"), F.lit("")), "digest"), 256))
    row = digests.agg(F.count("*").alias("n"), a.alias("a"), b.alias("b")).first()
    return f"{row['n']}-{row['a'] or 0}-{row['b'] or 0}"


def source_states(spark: SparkSession, path: str, digests: DataFrame, source: str) -> DataFrame:
    """source, state: ready, stale (changed), missing (new) or removed, for sources of the store and of the corpus."""
    now = digests.select(F.col(source).alias("__s"), F.col("digest").alias("__now"))
    if store.manifest(spark, path) is None:
        return digests.select(source, F.lit("missing").alias("state"))
    known = store.load(spark, path, "sources").select(F.col(source).alias("__k"), F.col("digest").alias("__then"))
    both = now.join(known, F.col("__s").eqNullSafe(F.col("__k")), "full_outer")
    state = F.when(F.col("__now").isNull(), "removed").when(F.col("__then").isNull(), "missing").when(F.col("__now") == F.col("__then"), "ready").otherwise("stale")
    return both.select(F.coalesce("__s", "__k").alias(source), state.alias("state"))


def refresh(chunks: DataFrame, path: str, source: str, key: str, structure: str, text: str, page: str, most: int) -> DataFrame:
    """Bring the store up to the chunks; returns source, state as they were before. Unchanged sources are neither read nor written."""
    spark = chunks.sparkSession
    digests = store.spill(source_digests(chunks, source, [key, structure, text, page]), "digests")
    states = store.spill(source_states(spark, path, digests, source), "states")
    changed = states.filter("state IN ('stale', 'missing')").select(source)
    own = chunks.join(changed.withColumnRenamed(source, "__c"), F.col(source).eqNullSafe(F.col("__c")), "left_semi")
    parents, placed = build_parents(resolve_levels(own, source, key, structure, text), source, key, text, page, most)
    children = placed.select(source, key, "parent_id", "method", "ambiguous")
    fresh = digests.join(changed.withColumnRenamed(source, "__c"), F.col(source).eqNullSafe(F.col("__c")), "left_semi")
    if store.manifest(spark, path) is None:
        identity = {"digest": corpus_digest(digests, source), "most": most}
        store.save({"parents": (parents, "parent_id", source, ()), "children": (children, key, source, ()), "sources": (fresh, source, None, ())}, path, identity)
        return states
    if store.manifest(spark, path)["identity"].get("most") != most:
        raise ValueError("the store was built with other windows")
    values = states.filter("state <> 'ready'").select(source)
    store.replace_groups(spark, path, values, {"parents": parents, "children": children, "sources": fresh})
    return states
