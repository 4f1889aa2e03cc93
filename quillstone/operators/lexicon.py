"""A stored BM25 index whose statistics are right for every set of roles.

Each chunk carries a mask: a bit for each role that may see it and one bit that all chunks have. Stored are the postings (term, chunk,
frequency, length, mask) in hash buckets of the term, the chunks (length, mask), and per (term, mask) the numbers of chunks and
occurrences. A view is a set of bits: its document frequencies, chunk count and mean length are sums over the masks that meet it, so
that no corpus is cut into tokens anew for another set of roles. Postings are filtered by the view before anything is scored.

Views are a column of the questions: one search answers questions of many views at once.

Top k by bounds: a term can add its times x idf x greatest part of any posting at most. The terms whose bounds together fall short
of the k-th best score can't bring a chunk in by themselves; only the other terms' postings are met, rare terms first to raise the
k-th best, and only chunks whose bound reaches it are scored over all terms. The result is the same as without.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import store
from ..sources.store import spill as spilled
from . import rbac
from .bm25 import EPSILON, K1, RANK_DIGITS, B
from .rbac import ROLES, validate_roles

#: The bit of all chunks; roles take the bits below.
EVERY = 1 << 40
#: Slack of bounds that are sums of doubles in another order.
SLACK = 1e-6
#: Question terms, levels and candidates that are broadcast at most; beyond, Spark shuffles.
SMALL = 200_000
#: Postings that a question takes first to learn its k-th best score, and chunks that are scored whole for it.
FIRST, AHEAD = 2_000, 20


def role_mask(allowed: Column | None, roles: list[str] = ROLES) -> Column:
    """A bit for each role in the list; null, unknown and no roles give none but the bit of all."""
    mask = F.lit(EVERY)
    for i, role in enumerate(roles):
        if allowed is not None:
            mask = mask.bitwiseOR(F.when(rbac.overlaps(allowed, [role]), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask


def view_bits(roles: list[str] | None, known: list[str] = ROLES) -> int:
    """The bits of a set of roles; None: everything. Unknown or no roles are an error."""
    return EVERY if roles is None else sum(1 << known.index(r) for r in validate_roles(roles, known))


def views_of(spark: SparkSession, named: dict[str, list[str] | None]) -> DataFrame:
    """view, bits: a row for each named set of roles."""
    return spark.createDataFrame([(name, view_bits(roles)) for name, roles in named.items()], "view string, bits long")


@dataclass(frozen=True)
class Lexicon:
    """A stored index: path, version and the name of its chunk key."""

    spark: SparkSession
    path: str
    number: int
    key: str

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """postings (of some buckets), chunks, stats, sizes or every."""
        if name == "chunks":
            return store.load(self.spark, self.path, "postings", self.number, [NO_TERM]).filter("term IS NULL").select(self.key, "mask", "length")
        rows = store.load(self.spark, self.path, name, self.number, only)
        return rows.filter("term IS NOT NULL") if name == "postings" else rows

    def buckets(self, rows: DataFrame) -> list[int]:
        """The posting buckets of the rows' terms."""
        return store.touched(self.spark, self.path, "postings", rows, "term")


#: The bucket of rows without a term, which stand for the chunks themselves: the hash of null is its seed.
NO_TERM = 42 % store.BUCKETS
#: Chunks whose tokens a task holds at a time.
HELD = 100


def _counted(batches):
    """Frequencies are counted where the tokens are: one row for each term of a chunk and one without a term, nothing shuffled."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            some = batch.slice(at, HELD)
            rows, terms, tf, length = [], [], [], []
            for i, own in enumerate(some.column("tokens").to_pylist()):
                counts = Counter(own or ())
                rows += [i] * (len(counts) + 1)
                terms += [None, *counts]
                tf += [0, *counts.values()]
                length += [sum(counts.values())] * (len(counts) + 1)
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([pa.array(terms, pa.string()), some.column("key").take(take), pa.array(tf, pa.int32()), pa.array(length, pa.int32()), some.column("mask").take(take)], ["term", "key", "tf", "length", "mask"])


def build(chunks: DataFrame, key: str, tokens: Column, path: str, identity: dict | None = None, mask: Column | None = None) -> Lexicon:
    """Write the index of all chunks as a new version. Texts are cut into tokens once."""
    spark = chunks.sparkSession
    listed = chunks.select(F.col(key).alias("key"), (mask if mask is not None else F.lit(EVERY)).alias("mask"), tokens.alias("tokens"))
    kind = chunks.schema[key].dataType.simpleString()
    postings = listed.mapInArrow(_counted, f"term string, key {kind}, tf int, length int, mask long").withColumnRenamed("key", key)
    entry = store.write_table(postings, path, "postings", key, "term", ("term",))
    rows = store.read_table(spark, path, "postings", entry)
    met, whole = rows.filter("term IS NOT NULL"), rows.filter("term IS NULL")
    stats = met.groupBy("term", "mask").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats_entry = store.write_table(stats, path, "stats")
    stats = store.read_table(spark, path, "stats", stats_entry)
    sizes = whole.groupBy("mask").agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("n_tokens"))
    n = whole.count()
    # what sees everything is asked most: its weights are stored
    counted = stats.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = counted.agg(F.avg("raw")).first()[0]
    every = counted.select("term", "df", "cf", F.when(F.col("raw") < 0, F.lit(EPSILON * (mean or 0.0))).otherwise(F.col("raw")).alias("idf"))
    tables = {"every": every, "postings": entry, "stats": stats_entry, "sizes": sizes.coalesce(1)}
    return Lexicon(spark, path, store.save(tables, path, identity), key)


def opened(spark: SparkSession, path: str, key: str, identity: dict | None = None) -> Lexicon | None:
    """The stored index if it is ready: there, and built from the same inputs and settings."""
    if store.state(spark, path, identity or {}) != "ready":
        return None
    return Lexicon(spark, path, store.manifest(spark, path)["number"], key)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where the counted rows allow it."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def totals(ix: Lexicon, views: DataFrame) -> DataFrame:
    """view, n_chunks, avg_length of what each view may see; views that see nothing have no row. At most a row for each mask and view meet."""
    met = ix.table("sizes").join(F.broadcast(views), F.col("mask").bitwiseAND(F.col("bits")) != 0)
    return met.groupBy("view").agg(F.sum("n_chunks").alias("n_chunks"), (F.sum("n_tokens") / F.sum("n_chunks")).alias("avg_length"))


def statistics(ix: Lexicon, views: DataFrame) -> DataFrame:
    """view, term, df, cf, idf: sums over the masks that meet the view. One pass over the vocabulary for all views; what sees everything is stored."""
    if all(r["bits"] == EVERY for r in views.collect()):  # a few named views
        return ix.table("every").crossJoin(F.broadcast(views.select("view"))).select("view", "term", "df", "cf", "idf")
    met = ix.table("stats").join(F.broadcast(views), F.col("mask").bitwiseAND(F.col("bits")) != 0)
    counted = met.groupBy("view", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    counted = counted.join(F.broadcast(totals(ix, views)), "view").withColumn("raw", raw)  # a row for each view
    mean = counted.groupBy("view").agg(F.avg("raw").alias("mean"))
    return counted.join(F.broadcast(mean), "view").select("view", "term", "df", "cf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def asked_terms(ix: Lexicon, views: DataFrame, questions: DataFrame, query: str, tokens: Column) -> DataFrame:
    """view, query, term, times, idf, bits, avg_length of the questions' known terms. A repeated question token adds repeatedly."""
    each = questions.select("view", F.col(query), F.explode(tokens).alias("term")).groupBy("view", query, "term").agg(F.count("*").alias("times"))
    weighed = each.join(statistics(ix, views).select("view", "term", "idf"), ["view", "term"])
    return weighed.join(F.broadcast(views), "view").join(F.broadcast(totals(ix, views).drop("n_chunks")), "view")


def part(tf: Column, length: Column, average: Column) -> Column:
    """What an occurrence count adds, before idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def scores(ix: Lexicon, asked: DataFrame, query: str) -> DataFrame:
    """view, query, chunk, score for every pair that shares a term and whose chunk the view may see."""
    postings = ix.table("postings", ix.buckets(asked))
    asks = spilled(asked.select("view", query).distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")  # one number for the rows that are added up
    met = postings.join(_small(asked.join(_small(asks), ["view", query]).drop("view", query)), "term").filter(F.col("mask").bitwiseAND(F.col("bits")) != 0)
    added = F.col("times") * F.col("idf") * part(F.col("tf"), F.col("length"), F.col("avg_length"))
    return met.groupBy("ask", ix.key).agg(F.sum(added).alias("score")).join(_small(asks), "ask").drop("ask")


def ranked(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Score down, then key, the first k of each view and question."""
    order = W.partitionBy("view", query).orderBy(F.round("score", RANK_DIGITS).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(ix: Lexicon, views: DataFrame, questions: DataFrame, query: str, tokens: Column, k: int, family: str) -> DataFrame:
    """view, query, chunk, score, rank. legal: zero scores fill up to k with the smallest keys; code: only scores above zero, rounded."""
    asked = asked_terms(ix, views, questions, query, tokens)
    asked = spilled(asked, "asked")
    scored = scores(ix, asked, query)
    if family == "legal":
        seen = ix.table("chunks").join(F.broadcast(views), F.col("mask").bitwiseAND(F.col("bits")) != 0)
        fill = seen.withColumn("r", F.row_number().over(W.partitionBy("view").orderBy(ix.key))).filter(F.col("r") <= k).select("view", ix.key)  # k rows a view
        zero = questions.select("view", query).distinct().join(F.broadcast(fill), "view").withColumn("score", F.lit(0.0))
        # the k best first: a filler can displace only these, and one that was scored below them stays below them
        scored = ranked(scored, query, ix.key, k).drop("rank").unionByName(zero).groupBy("view", query, ix.key).agg(F.max("score").alias("score"))
        return ranked(scored, query, ix.key, k)
    return ranked(scored, query, ix.key, k).filter(F.col("score") > 0).withColumn("score", F.round("score", 6))


# --- top k by bounds --------------------------------------------------------------------------


def bounded_top_k(ix: Lexicon, views: DataFrame, questions: DataFrame, query: str, tokens: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(view, query, chunk, score, rank of scores above zero; one row of counts: pairs sharing a term, pairs met, pairs scored whole)."""
    key = ix.key
    asked = spilled(asked_terms(ix, views, questions, query, tokens), "asked")
    postings = ix.table("postings", ix.buckets(asked))
    # the greatest part of any posting of a term, per view, and how many postings the view sees
    terms = asked.select("view", "term", "bits", "avg_length").distinct()
    best = postings.join(_small(terms), "term").filter(F.col("mask").bitwiseAND(F.col("bits")) != 0)
    best = best.groupBy("view", "term").agg(F.max(part(F.col("tf"), F.col("length"), F.col("avg_length"))).alias("most"), F.count("*").alias("n"))
    asked = spilled(asked.join(best, ["view", "term"]).withColumn("bound", F.col("times") * F.col("idf") * F.col("most")).filter("bound > 0"), "bounds")
    group = ["view", query]
    falling = W.partitionBy(*group).orderBy(F.desc("bound"), "term")
    before = F.coalesce(F.sum("n").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    added = F.col("times") * F.col("idf") * part(F.col("tf"), F.col("length"), F.col("avg_length"))

    def met(some: DataFrame) -> DataFrame:
        rows = postings.join(_small(some), "term").filter(F.col("mask").bitwiseAND(F.col("bits")) != 0)
        return rows.groupBy(*group, key).agg(F.sum(added).alias("score"))

    def whole(pairs: DataFrame) -> DataFrame:
        rows = postings.join(_small(pairs), key).join(_small(asked), [*group, "term"])
        return rows.filter(F.col("mask").bitwiseAND(F.col("bits")) != 0).groupBy(*group, key).agg(F.sum(added).alias("score"))

    # the heaviest terms first: their best chunks, scored whole, give a k-th best that the final one can't be below
    heavy = spilled(asked.withColumn("before", before).filter(F.col("before") < FIRST).drop("before"), "heavy")
    first = met(heavy).withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), key))).filter(F.col("r") <= max(k, AHEAD))
    tried = spilled(whole(spilled(first.select(*group, key), "first")), "tried")
    kth = tried.withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score")))).filter(F.col("r") == k).select(*group, F.col("score").alias("kth"))
    # the lightest terms whose bounds together fall short of it are left out
    rising = W.partitionBy(*group).orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0)
    placed = asked.withColumn("upto", F.sum("bound").over(rising)).join(kth, group, "left").withColumn("kth", F.coalesce("kth", F.lit(0.0)))
    placed = spilled(placed.withColumn("needed", F.col("upto") >= F.col("kth") - SLACK), "placed")
    light = placed.groupBy(*group).agg(F.max("kth").alias("kth"), F.coalesce(F.max(F.when(~F.col("needed"), F.col("upto"))), F.lit(0.0)).alias("light"))
    part_scores = spilled(met(placed.filter("needed").drop("upto", "kth", "needed")), "met")
    reach = part_scores.join(light, group).filter(F.col("score") + F.col("light") >= F.col("kth") - SLACK)
    scored = spilled(whole(spilled(reach.select(*group, key), "reach")), "whole")
    found = ranked(scored, query, key, k).filter(F.col("score") > 0)
    share = asked.agg(F.sum("n").cast("long").alias("n_postings")).crossJoin(placed.filter("needed").agg(F.sum("n").cast("long").alias("n_met"))).crossJoin(scored.agg(F.count("*").alias("n_scored")))  # one row each
    return found, share
