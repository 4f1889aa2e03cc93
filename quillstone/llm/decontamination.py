"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The corpus frequency of every test term is counted over all texts. Each test window (10 consecutive words; a shorter item is
one window) takes the places of its rarest terms as anchors. The index stores the training postings of the anchor terms:
term, text, position. Postings are shifted by the anchor's offset in its item, so that matches of one item in one text meet
on the same start; starts on which a window's anchors all meet are kept, and the window's words there are compared.

Proximity: with a slop, a window has one anchor more than must meet, so that any one of its words may be exchanged or missing; anchors
meet when their starts differ by at most slop words (words inserted, missing or exchanged between them). Such a place is a near match when at least NEAR of the window's distinct words occur between slop words before the smallest
start and slop words after the window's end, in any order. Exact matches are near matches too.

Null and empty texts have no words; very long ones are one row of one task; null ids are kept; repeated rows give one result each.
Items without words have no windows; repeated items and ties between rarest terms change nothing. An empty table of documents gives
an empty result, an empty one of items no matches. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize
from .native_text import bounded, text_key, words_of

WINDOW = 10
#: Rarest terms of each window whose lists are intersected before its words are compared: for exact matches all of them must meet.
ANCHORS = 2
#: For near matches, any AGREE of NEAR_ANCHORS must: one word exchanged or missing, whichever it is, leaves enough of them.
NEAR_ANCHORS, AGREE = 3, 2
#: Words by which a near match may be stretched; share of a window's distinct words that it must hold.
SLOP, NEAR = 3, 0.8


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (distinct texts of an id), item_id as a string, words."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.filter(F.size("words") > 0).dropDuplicates()
    return rows.withColumn("item", F.xxhash64("item_id", "words"))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """item, s (first word of the window), len."""
    n = F.size("words")
    return items.select("item", F.least(n, F.lit(window)).alias("len"), F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("s"))


def term_frequencies(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """Occurrences over all texts of each term; counted in the tasks before the shuffle."""
    words = docs.select(F.explode(words_of(F.col(text_col))).alias("word")).select(F.xxhash64("word").alias("term"))
    return words.join(bounded(terms), "term").groupBy("term").agg(F.count("*").alias("df"))


def anchors_of(items: DataFrame, window: int, frequencies: DataFrame, most: int = ANCHORS) -> DataFrame:
    """item, s, len and the places of the window's rarest terms."""
    places = items.select("item", F.posexplode("words").alias("at", "word")).select("item", "at", F.xxhash64("word").alias("term"))
    ranked = places.join(frequencies, "term", "left").select("item", "at", "term", F.coalesce("df", F.lit(0)).alias("df"))
    inside = windows_of(items, window).select("item", "s", "len", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("at"))
    rarest = W.partitionBy("item", "s").orderBy("df", "at")
    picked = inside.join(ranked, ["item", "at"]).withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= most)
    return picked.select("item", "s", "len", "at", "term")


def posting_index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """The stored index: id, key, term, position; and for each row of docs one with no term, whose position is its word count."""
    texts = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("key"), words_of(F.col(text_col)).alias("words"))
    placed = texts.select("id", "key", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    placed = placed.select("id", "key", "pos", (F.col("word") == "").alias("end"), F.xxhash64("word").alias("term"))
    known = terms.select(F.col("term"), F.lit(True).alias("known"))
    met = placed.join(bounded(known), "term", "left").filter(F.col("end") | F.col("known"))
    return materialize(met.select("id", "key", F.when(~F.col("end"), F.col("term")).alias("term"), "pos"), "postings")


def phrase_matches(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(one row per text: id, key, n_words; matches: id, key, item_id, start, len, exact). Near matches need a slop of 1 or more."""
    words = materialize(item_words(items, item_col, item_text_col), "items")
    terms = words.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("term")).distinct()
    frequencies = term_frequencies(docs, text_col, materialize(terms, "terms"))
    anchors = materialize(anchors_of(words, window, frequencies, NEAR_ANCHORS if slop else ANCHORS), "anchors")
    index = posting_index(docs, id_col, text_col, anchors.select("term").distinct())
    texts = index.filter(F.col("term").isNull()).select("id", "key", F.col("pos").cast("long").alias("n_words"))

    # shift each posting by its anchor's place in the item; what meets on one start belongs to one placement of the item
    places = anchors.select("item", "term", "at").distinct()
    shifted = index.join(bounded(places), "term").select("id", "key", "item", (F.col("pos") - F.col("at")).alias("shift"), "at")
    if slop:
        # starts up to slop words on: a frame holds at most the item's anchors for each of its few starts
        reach = W.partitionBy("id", "key", "item").orderBy("shift").rangeBetween(0, slop)
        met = shifted.select("id", "key", "item", "shift", "at", F.collect_set("at").over(reach).alias("met"))
        met = met.groupBy("id", "key", "item", "shift").agg(F.first("met").alias("met"), F.collect_set("at").alias("here"))
    else:
        met = shifted.groupBy("id", "key", "item", "shift").agg(F.collect_set("at").alias("met"))  # at most the item's anchors
        met = met.withColumn("here", F.col("met"))
    needed = anchors.groupBy("item", "s", "len").agg(F.collect_set("at").alias("needed"))
    enough = lambda anchors: F.least(F.size(anchors), F.lit(AGREE if slop else ANCHORS))
    wanted = needed.groupBy("item").agg(F.collect_set(F.struct("s", "len", "needed")).alias("windows"), F.min(enough(F.col("needed"))).alias("least"))
    cand = (
        met.join(bounded(wanted), "item")
        .filter(F.size("met") >= F.col("least"))
        .withColumn("windows", F.filter("windows", lambda w: F.arrays_overlap(w["needed"], F.col("here")) & (F.size(F.array_intersect(w["needed"], F.col("met"))) >= enough(w["needed"]))))
        .filter(F.size("windows") > 0)
        .select("id", "key", "item", "shift", F.transform("windows", lambda w: F.struct(w["s"].alias("s"), w["len"].alias("len"))).alias("windows"))
    )
    cand = materialize(cand, "candidates")

    # the words at a candidate's place must be the window's: texts with candidates only
    own = F.slice("own", F.col("w.s") + 1, F.col("w.len"))
    placed = cand.select("id", "key", "item", "shift", F.explode("windows").alias("w")).join(bounded(words.select("item", "item_id", F.col("words").alias("own"))), "item")
    placed = placed.select("id", "key", "item_id", (F.col("shift") + F.col("w.s")).alias("start"), F.col("w.len").alias("len"), own.alias("own"))
    placed = placed if slop else placed.filter("start >= 0")
    # one row for each text: its words are cut once and never repeated; there are at most as many placements as words and items allow
    placed = materialize(placed.groupBy(F.col("id").alias("__id"), "key").agg(F.collect_set(F.struct("item_id", "start", "len", "own")).alias("places")), "places")
    rows = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    met = rows.join(bounded(placed), (rows.key == placed.key) & rows.id.eqNullSafe(F.col("__id"))).select("id", rows.key, "places", words_of(F.col("text")).alias("words"))

    def exact(p: Column) -> Column:
        return (p["start"] >= 0) & (F.slice(F.col("words"), F.greatest(p["start"], F.lit(0)) + 1, p["len"]) == p["own"])

    def near(p: Column) -> Column:
        begin = F.greatest(p["start"] - slop, F.lit(0))
        stretch = F.slice(F.col("words"), begin + 1, F.greatest(p["start"] + p["len"] + slop - begin, F.lit(0)))
        return F.size(F.array_intersect(p["own"], stretch)) >= NEAR * F.size(F.array_distinct(p["own"]))

    judged = F.transform("places", lambda p: F.struct(p["item_id"].alias("item_id"), p["start"].alias("start"), p["len"].alias("len"), exact(p).alias("exact"), (near(p) if slop else F.lit(False)).alias("near")))
    found = met.select("id", "key", F.inline(F.filter(judged, lambda p: p["exact"] | p["near"])))
    return texts, found.drop("near")


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Exact and near matches: id, key, item_id, start, len, exact."""
    return phrase_matches(docs, items, window, id_col, text_col, item_col, item_text_col, slop)[1]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int = SLOP) -> DataFrame:
    """Per text: n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated; n_near_items (items with exact or near matches)."""
    texts, found = phrase_matches(docs, items, window, id_col, text_col, item_col, item_text_col, slop)
    # exact and near matches of a text meet in one group: starts without an exact match have no length and no items
    said = F.when(F.col("exact"), F.col("item_id"))
    spans = found.groupBy("id", "key", "start").agg(F.max(F.when(F.col("exact"), F.col("len"))).alias("len"), F.collect_set(said).alias("items"), F.collect_set("item_id").alias("near"))
    order = W.partitionBy("id", "key").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("covered", F.coalesce(F.max(F.col("start") + F.col("len")).over(order), F.lit(0)))
    hits = spans.groupBy("id", "key").agg(
        F.sum(F.when(F.col("len").isNotNull(), F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", "covered")))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_list("near")))).cast("long").alias("n_near"),
    )
    hits = hits.withColumnRenamed("id", "__id").withColumnRenamed("key", "__key")
    out = texts.join(hits, (texts.key == F.col("__key")) & texts.id.eqNullSafe(F.col("__id")), "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without any window of an item; same columns."""
    _, found = phrase_matches(docs, items, window, id_col, text_col, item_col, item_text_col)
    hit = bounded(materialize(found.select(F.col("id").alias("__id"), F.col("key").alias("__hit")).distinct(), "contaminated"))
    own, key, other = fresh(docs, "__key"), fresh(docs, "__hit"), fresh(docs, "__id")
    hit = hit.withColumnsRenamed({"__hit": key, "__id": other})
    return docs.withColumn(own, text_key(id_col, text_col)).join(hit, (F.col(own) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(other)), "left_anti").select(*docs.columns)
