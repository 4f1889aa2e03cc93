"""Spelling variants of the corpus's words by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so that anagrams share it and one edit moves it by a
known amount: two words differ by one exchanged letter only if their keys, each less one of its own letters, agree; by one removed
or added letter only if the longer word's key less one letter is the shorter's. Those reduced keys are join keys. As one edit leaves
the first two or the last two letters of a word of five letters alone, these ends go with the key, which splits the anagrams of
a frequent letter set. The order of the letters is verified by the edit distance, and every pair is kept once.

Words are lower-cased runs of Latin letters. By a rule that depends on the document and the run alone, some occurrences lose one
letter, as misspellings do. Words of too few letters or occurrences are left out.

A word's form is its most frequent near word if that is at least twice as frequent; following forms ends at the root, as every
step doubles the count. Roots are found by pointer jumping.

Null and empty texts have no words. A null id is the empty text in the rule. Repeated rows count again. Ties of frequency go to the
smallest word in code-point order. A very long text or run is one row of one task. An empty table gives an empty result. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cased runs; A-Z were lower-cased before.
RUN = "[a-zÀ-ÿ]+"
#: One occurrence in so many loses a letter.
SLIP = 97
LETTERS, OCCURRENCES = 5, 3
#: A form is at least so many times as frequent as the word.
DOMINANT = 2


def runs_of(text: Column) -> Column:
    """The lower-cased runs of Latin letters of a text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(RUN), F.lit(0))


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, or the run without the letter that its document and its own letters choose."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % SLIP == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: counts are added up inside each task before the shuffle."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(runs_of(F.col(text_col))).alias("run"))
    words = runs.select(slipped(F.col("id"), F.col("run")).alias("word")).filter(F.char_length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def power(letter: Column) -> Column:
    """A letter's fifth power: at most 255**5, so that sums of millions of letters are exact."""
    x = F.ascii(letter).cast("long")
    return x * x * x * x * x


def keyed(words: DataFrame) -> DataFrame:
    """word, n, key, letters (distinct), ends (the first two and the last two letters)."""
    split = words.withColumn("all", F.split("word", ""))
    key = F.aggregate("all", F.lit(0).cast("long"), lambda s, c: s + power(c))
    ends = F.array(F.concat(F.lit("<"), F.substring("word", 1, 2)), F.concat(F.lit(">"), F.substring("word", -2, 2)))
    return split.select("word", "n", key.alias("key"), F.array_distinct("all").alias("letters"), ends.alias("ends"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: words that differ by one inserted, deleted or replaced letter, each pair once, a < b."""
    own = keyed(words).select("word", "n", "key", "letters", F.explode("ends").alias("end"))
    less = own.select("word", "n", "key", "end", F.explode("letters").alias("letter"))
    less = less.select((F.col("key") - power(F.col("letter"))).alias("met"), "end", "word", "n", "key", F.lit(True).alias("less"))
    whole = own.select(F.col("key").alias("met"), "end", "word", "n", "key", F.lit(False).alias("less"))
    other = less.unionByName(whole).withColumnsRenamed({"word": "word2", "n": "n2", "key": "key2", "less": "less2"})
    exchange = F.col("less2") & (F.col("word") < F.col("word2")) & (F.col("key") != F.col("key2"))
    met = less.drop("less").join(other, ["met", "end"]).filter(exchange | ~F.col("less2"))
    near = met.filter(F.levenshtein("word", "word2", 1) == 1)
    small = F.col("word") < F.col("word2")
    pick = lambda x, y: F.when(small, F.col(x)).otherwise(F.col(y))
    return near.select(pick("word", "word2").alias("a"), pick("n", "n2").alias("n_a"), pick("word2", "word").alias("b"), pick("n2", "n").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form; form null at a root). Each round doubles the steps that are taken."""
    known = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        up = known.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = materialize(known.join(up, "root").select("word", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
        moved = new.filter("moved").limit(1).count()
        release(known)
        known = new.drop("moved")
        known.__dict__["written"] = new.__dict__["written"]
        if not moved:
            return known


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    pairs = near_pairs(words)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    both = pairs.select(F.inline(ways))  # each pair is found once and read in both directions
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    held = -F.col("best.m") >= DOMINANT * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", F.when(held, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, -F.col("best.m")).alias("form_n"))
    found = materialize(found, "forms")
    release(words)
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")
