"""Licence scan by diagonal voting, in DataFrame operations only.

Every rolling word 2-gram of every text meets the 2-grams of the licence templates in a join on their hash, with the words
compared. A match votes for its diagonal: word position minus template position. Votes are a bit set of template positions,
aggregated by (text, template, diagonal); diagonals a few words apart (inserted or missing words) merge. A merged run is verified:
of its votes the longest chain counts whose places rise in the template's order; it is kept when these votes cover enough of the
template. Base phrases merge nothing and need every vote: a run is then a place where the phrase's words stand
consecutively. Templates longer than 64 words (whole licences) are searched in parts that each name the licence.

An empty table gives an empty result. Very long texts are rows of words like others; places that tie or repeat are reported each.
Null and empty texts: no words, score 0. Repeated rows give one result each; null ids are kept. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .native_text import small_rows, text_key, words_of

# Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Licence notices as their publishers word them.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
# A 2-gram of two of these words doesn't vote for a notice.
COMMON = frozenset("a all and any are by for in is of on or that the this to with without under".split())
#: Words by which diagonals of one notice may differ and still merge; share of a notice's votes that a run needs.
MERGE_GAP, COVERAGE = 2, 0.8
#: Notices of up to so many votes need all of them: their few words tell versions apart.
SHORT_NOTICE = 10


#: Most words of a template: its votes are the bits of one long.
TEMPLATE_WORDS = 64


def parts(text: str) -> list[str]:
    """A template's text in parts of about equal length, of at most TEMPLATE_WORDS words."""
    words = text.split()
    n = max(1, -(-len(words) // TEMPLATE_WORDS))
    return [" ".join(words[k * len(words) // n : (k + 1) * len(words) // n]) for k in range(n)]


def all_templates(base=BASE, notices=NOTICES) -> list[tuple[str, str, bool]]:
    """(text, label, base) of every template."""
    return [(p, label, True) for p, label in base] + [(part, label, False) for p, label in notices for part in parts(p)]


def template_grams(templates: list[tuple[str, str, bool]]) -> list[tuple]:
    """(template, label, base, position, word, next word, votes of the whole template, bit) for each voting 2-gram."""
    rows = []
    for t, (text, label, base) in enumerate(templates):
        words = text.split()
        votes = [j for j in range(len(words) - 1) if base or not {words[j], words[j + 1]} <= COMMON]
        if not votes or len(words) > TEMPLATE_WORDS:
            raise ValueError(f"a template needs 2 to 64 words, not all common: {text!r}")
        rows += [(t, label, base, j, words[j], words[j + 1], len(votes), 1 << j) for j in votes]
    return rows


def in_order(diagonals: Column) -> Column:
    """Most votes of a merged run whose places rise in the template's order; diagonals: array of (diagonal, bits).

    Any place of a vote may count. Places follow in the template's order, those of one vote from the last, so that at most one of them
    is in a rising chain; the state holds the least last place of a chain of each length.
    """

    def places(j: Column) -> Column:
        return F.sort_array(F.transform(F.filter(diagonals, lambda d: F.bit_get(d["bits"], j) == 1), lambda d: (d["diagonal"] + j).cast("int")), False)

    def step(ends: Column, place: Column) -> Column:
        shorter = F.size(F.filter(ends, lambda e: e < place))
        return F.concat(F.slice(ends, F.lit(1), shorter), F.array(place), F.slice(ends, shorter + 2, F.lit(TEMPLATE_WORDS)))

    points = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TEMPLATE_WORDS - 1)), places))
    return F.size(F.aggregate(points, F.array().cast("array<int>"), step))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """Per text: n_words, n_base, first_word, last_word, base_labels, labels, score (best cover of a template), spans (label:first word:end of each run)."""
    spark: SparkSession = docs.sparkSession
    grams = template_grams(all_templates(base, notices))
    templates = small_rows(
        spark,
        grams,
        [("t", "int"), ("label", "string"), ("base", "boolean"), ("j", "int"), ("w1", "string"), ("w2", "string"), ("votes", "int"), ("bit", "long")],
    ).withColumn("gram", F.xxhash64("w1", "w2"))

    texts = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("key"), words_of(F.col(text_col)).alias("words"))
    # one row more than words: the last stands for the text itself and tells its word count
    placed = texts.select("id", "key", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    placed = placed.select("id", "key", "pos", "word", F.get("words", F.col("pos") + 1).alias("next"), (F.size("words") == F.col("pos")).alias("end"))
    placed = placed.withColumn("gram", F.xxhash64("word", "next"))
    met = placed.join(
        F.broadcast(templates),  # parameter rows: a few hundred
        (placed.gram == templates.gram) & (placed.word == templates.w1) & (placed.next == templates.w2),
        "left",
    ).filter(F.col("end") | F.col("t").isNotNull())
    met = met.select("id", "key", "t", "label", "base", "votes", (F.col("pos") - F.col("j")).alias("diagonal"), "bit", F.when(F.col("end"), F.col("pos")).alias("n_words"), F.when(F.col("t").isNotNull(), F.col("pos")).alias("pos"))

    # all later groups are inside a text: one shuffle of matches
    diagonals = (
        met.repartition("id", "key")
        .groupBy("id", "key", "t", F.when(F.col("t").isNotNull(), F.col("diagonal")).alias("diagonal"))
        .agg(F.first("label").alias("label"), F.first("base").alias("base"), F.first("votes").alias("votes"), F.bit_or("bit").alias("bits"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"))
    )
    by_template = W.partitionBy("id", "key", "t").orderBy("diagonal")
    apart = F.when(F.col("base"), 0).otherwise(MERGE_GAP)
    runs = (
        diagonals.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(by_template) <= apart, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(by_template.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("id", "key", "t", "run")
        .agg(
            F.first("label").alias("label"), F.first("base").alias("base"), F.min("diagonal").alias("start"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.first("votes").alias("votes"),
            F.min("first").alias("first"), F.max("last").alias("last"), F.bit_count(F.bit_or("bits")).alias("voted"), F.collect_list(F.struct("diagonal", "bits")).alias("diagonals"),
        )
    )
    needed = F.when(F.col("base") | (F.col("votes") <= SHORT_NOTICE), 1.0).otherwise(COVERAGE)
    # only runs of enough votes on several diagonals are verified: on one diagonal places rise with the template's
    runs = runs.withColumn("cover", F.col("voted") / F.col("votes"))
    runs = runs.withColumn("cover", F.when((F.size("diagonals") > 1) & (F.col("cover") >= needed), in_order(F.col("diagonals")) / F.col("votes")).otherwise(F.col("cover"))).drop("diagonals")
    kept = F.col("t").isNotNull() & (F.col("cover") >= needed)
    span = F.struct("first", "last", "label")
    place = kept & F.col("base")
    out = runs.groupBy("id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(kept, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(kept, span))), lambda s: F.concat_ws(":", s["label"], s["first"].cast("string"), (s["last"] + 2).cast("string"))), ",").alias("spans"),
        F.max("copies").alias("copies"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
