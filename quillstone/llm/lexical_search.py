"""Ranked lexical search for a set of items by impact-ordered, score-at-a-time processing with exact integer scores.

Index: a posting is (term, impact, document), its impact being the whole contribution of the term to that document's score.
Postings are written in order of term and falling impact, so that those of one impact stand together and a scan from an impact
upwards skips the rest. Terms that no item asks for are dropped before anything is shuffled.

Rounds: each item takes its postings by falling impact down to a level, first a few, then sixteen times as many. What it has not
taken of a term can add the level at most, so that a document's score lies between the sum it has met and that sum plus these
bounds. An item stops only when the bounds of all its terms together fall short of its k-th best score: then no document outside
can enter. The levels that prove this follow from the terms' greatest impacts, so an item never goes deeper than the proof needs.
Documents whose upper bound reaches the k-th best are then scored over all their postings. The k-th best comes from whole scores
of the best documents met, which raises it early.

Rows of one item id, null included, are one item with all their terms; an item without terms has no rows. Every row of the
documents is a document of its own: repeated rows tie and are ranked one after another. Null and empty texts have no terms and are
not counted. A null document id sorts first. Documents of score 0 are not returned. A very long text is one row of one task.
Empty tables give an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_TABLE, batches, materialize, release
from .native_text import bounded

#: Results of an item.
K = 10
#: Postings that an item takes in its first round, and by how many times the next rounds take more.
FIRST, GROWTH = 2_000, 16
#: Documents of an item that a round scores whole, to raise the k-th best.
AHEAD = 50


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def _items(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        items, terms = [], []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = sorted(set(terms_of(text)))
            items += [item] * len(own)
            terms += own
        yield pa.record_batch([pa.array(items, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string())], ["item", "term"])


def _postings(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct term of a document, and one of the empty term that stands for the document itself."""
    for batch in rows:
        at, n, term, tf = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = terms_of(text)
            if words:
                own = Counter(words)
                at += [i] * (len(own) + 1)
                n += [len(words)] * (len(own) + 1)
                term += [b"", *own]
                tf += [0, *own.values()]
        at = pa.array(at, pa.int64())
        columns = [batch.column("doc").take(at), batch.column("id").take(at), pa.array(n, pa.int64()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())]
        yield pa.record_batch(columns, ["doc", "id", "n", "term", "tf"])


def whole_div(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs."""
    return F.call_function("div", a, b)


def impacts(postings: DataFrame, terms: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """t, impact, doc of postings (doc, n, t, tf), given the terms' document frequencies; impacts of zero add nothing."""
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    m = F.lit(10) + whole_div(F.col("n") * F.lit(90 * n_docs), F.lit(n_terms))
    impact = F.col("w") * whole_div(F.col("tf") * 1_000_000_000, F.col("tf") * 1000 + m * 8)
    joined = postings.join(terms.select("t", weight.alias("w")), "t")
    return joined.select("t", impact.alias("impact"), "doc").filter("impact > 0")


def proof_levels(asked: DataFrame, best: DataFrame) -> DataFrame:
    """item, level: the highest level at which the untaken rest of all terms, least(top, level) each, sums to less than the k-th best.

    asked: item, t, top (the term's greatest impact); best: item, kth. At level 0 everything is taken.
    """
    rising = W.partitionBy("item").orderBy("top", "t")
    below = F.coalesce(F.sum("top").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = asked.join(best, "item").select("item", "kth", "top", below.alias("below"), F.count("*").over(W.partitionBy("item")).alias("all"), F.row_number().over(rising).alias("i"))
    room = F.greatest(F.col("kth") - 1 - F.col("below"), F.lit(0))
    # the terms before this one give all they have, this one and those above it give the level
    level = F.least(F.call_function("div", room, F.col("all") - F.col("i") + 1), F.col("top"))
    return placed.groupBy("item").agg(F.max(level).alias("level"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """item, kth: the k-th best of known scores, 0 where there are fewer."""
    ranked = scored.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("r") <= k)
    return ranked.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("kth"))


def _whole(pairs: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """item, doc, score: all postings of the paired documents, by way of the document."""
    pairs = small(pairs, "pairs")
    return index.join(pairs, "doc").join(bounded(asked.select("item", "t")), ["item", "t"]).groupBy("item", "doc").agg(F.sum("impact").alias("score"))


def _met(index: DataFrame, asked: DataFrame, levels: DataFrame) -> DataFrame:
    """item, doc, met (sum of the impacts above the item's level), n_met."""
    wanted = asked.join(levels, "item").filter(F.col("top") > F.col("level"))
    wanted = materialize(wanted.select("item", "t", "level"), "wanted")
    least = wanted.groupBy("t").agg(F.min("level").alias("least"))
    taken = index.join(bounded(least), "t").filter(F.col("impact") > F.col("least")).select("t", "impact", "doc")
    taken = taken.join(bounded(wanted), "t").filter(F.col("impact") > F.col("level"))
    return taken.groupBy("item", "doc").agg(F.sum("impact").alias("met"), F.count("*").alias("n_met"))


def _budget_levels(asked: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """item, wide: the level below which an item has taken about `size` postings; groups: t, impact, n."""
    falling = W.partitionBy("t").orderBy(F.desc("impact")).rowsBetween(W.unboundedPreceding, -1)
    heads = groups.withColumn("before", F.coalesce(F.sum("n").over(falling), F.lit(0))).filter(F.col("before") < size)
    over = W.partitionBy("item").orderBy(F.desc("impact"), "t").rowsBetween(W.unboundedPreceding, -1)
    held = heads.join(bounded(asked.select("item", "t")), "t").withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    taken = held.filter(F.col("before") < size).groupBy("item").agg((F.min("impact") - 1).alias("wide"), F.sum("n").alias("taken"))
    every = asked.groupBy("item").agg(F.sum("n").alias("every"))
    return taken.join(every, "item").select("item", F.when(F.col("taken") < F.col("every"), F.col("wide")).otherwise(0).alias("wide"))


def small(df: DataFrame, name: str) -> DataFrame:
    """Written, and broadcast where its counted size allows."""
    return bounded(materialize(df, name))


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, doc, score under the given id columns' names: each item's k best documents."""
    spark = docs.sparkSession
    batches(spark)
    numbered = small(items.select(F.col(item_col).alias("item_id")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    texts = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    texts = texts.join(numbered, texts["item_id"].eqNullSafe(numbered["item_id"])).select("item", "text")
    asked = materialize(texts.mapInArrow(_items, "item long, term string").distinct(), "asked")
    terms = materialize(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    known = bounded(terms.unionByName(spark.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("t"))))

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    postings = materialize(rows.mapInArrow(_postings, f"doc long, id {kind}, n long, term string, tf long").join(known, "term").drop("term"), "postings")
    names = postings.filter("t = -1")
    size = names.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    asked_postings = postings.filter("t >= 0")
    df = small(asked_postings.groupBy("t").agg(F.count("*").alias("df")), "df")
    index = impacts(asked_postings, df, size["docs"], max(1, size["terms"]))
    index = materialize(index.repartitionByRange(F.col("t"), F.desc("impact"), F.col("doc")).sortWithinPartitions("t", F.desc("impact")), "index")
    groups = materialize(index.groupBy("t", "impact").agg(F.count("*").alias("n")), "groups")
    tops = groups.groupBy("t").agg(F.max("impact").alias("top"), F.sum("n").alias("n"))
    asked = materialize(asked.join(terms, "term").join(tops, "t").select("item", "t", "top", "n"), "asked")

    best = asked.select("item").distinct().withColumn("kth", F.lit(0).cast("long"))
    done, take = None, FIRST
    while True:
        proof = proof_levels(asked, best)
        wide = _budget_levels(asked, groups, take)
        levels = materialize(proof.join(wide, "item").select("item", F.greatest("level", "wide").alias("level"), (F.col("wide") <= F.col("level")).alias("proven")), "levels")
        met = materialize(_met(index, asked, levels), "met")
        ahead = met.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("met"), "doc"))).filter(F.col("r") <= AHEAD)
        scored = materialize(_whole(ahead.select("item", "doc"), index, asked), "scored")
        best = materialize(best.join(_kth(scored, k).withColumnRenamed("kth", "new"), "item", "left").select("item", F.greatest("kth", F.coalesce("new", F.lit(0))).alias("kth")), "best")
        # proven: nothing below the level can reach the k-th best known, so only the documents met need whole scores
        rest = asked.join(levels, "item").groupBy("item", "level", "proven").agg(F.sum(F.least("top", "level")).alias("rest")).join(best, "item")
        over = rest.filter(F.col("proven") | (F.col("rest") < F.col("kth")))
        reach = met.join(over, "item").filter(F.col("met") - F.col("n_met") * F.col("level") + F.col("rest") >= F.col("kth")).select("item", "doc")
        found = materialize(_whole(reach, index, asked), "found")
        done = found if done is None else done.unionByName(found)
        asked = materialize(asked.join(over.select("item"), "item", "left_anti"), "asked")
        best = best.join(asked.select("item").distinct(), "item", "left_semi")
        release(met, scored, levels)
        if asked.isEmpty():
            break
        take *= GROWTH
    named = done.join(names.select("doc", "id"), "doc")
    order = W.partitionBy("item").orderBy(F.desc("score"), "id", "doc")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(numbered, "item")
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
