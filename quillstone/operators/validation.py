"""Contracts and profiles: every check is a column or an aggregate, never a driver loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Strategies and page checks.
STRATEGIES = ["fixed-size", "semantic", "hierarchical"]
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F�]"
DIACRITIC = r"[àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐ]"
MAX_CONTROL, LONG_PAGE, MIN_DIACRITIC = 0.01, 200, 0.01


def codes(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that hold."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in checks)))


def canonical_strategy(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))


def chunk_faults(chunk_id: str = "chunk_id", strategy: str = "strategy", source: str = "source", start: str = "page_start", end: str = "page_end", text: str = "text") -> Column:
    """Codes of what is wrong with a chunk: missing or blank fields, unknown strategy, page bounds."""
    blank = lambda c: F.col(c).isNull() | ~F.col(c).cast("string").rlike(r"\S")
    return codes(
        (blank(chunk_id), "chunk_id"), (blank(source), "source"), (F.col(text).isNull(), "text"), (blank(strategy) | ~canonical_strategy(F.col(strategy)).isin(STRATEGIES), "strategy"),
        (F.col(start).isNull() | F.col(end).isNull(), "page_missing"), (F.col(start) < 1, "page_start"), (F.col(end) < F.col(start), "page_order"),
    )


def load_chunks(rows: DataFrame, strategy: str, chunk_id: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(valid chunks of a strategy, one row of statistics): the strategy is chosen before anything is validated; blank texts are skipped and counted.

    Repeated ids count as faults of all rows that carry them.
    """
    own = rows.filter(canonical_strategy(F.col("strategy")) == canonical_strategy(F.lit(strategy)))
    checked = own.withColumn("__faults", chunk_faults(chunk_id=chunk_id, text=text)).withColumn("__same", F.count("*").over(W.partitionBy(chunk_id)))
    checked = checked.withColumn("__blank", F.coalesce(~F.col(text).rlike(r"\S"), F.lit(False))).withColumn("__bad", (F.size("__faults") > 0) | (F.col("__same") > 1))
    stats = checked.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("__blank")).alias("n_blank"), F.count_if(F.size("__faults") > 0).alias("n_invalid"),
        F.count_if(F.col("__same") > 1).alias("n_duplicate"), F.count_if(~F.col("__bad") & ~F.col("__blank")).alias("n_valid"),
    )
    valid = checked.filter(~F.col("__bad") & ~F.col("__blank")).withColumn(text, F.trim(text)).withColumn("strategy", canonical_strategy(F.col("strategy")))
    return valid.drop("__faults", "__same", "__blank", "__bad"), stats


def page_faults(c: Column) -> Column:
    """Codes: empty, control (over 1 % control characters), diacritics (a long page almost without)."""
    text = F.coalesce(c, F.lit(""))
    body = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    empty = body == ""
    control = F.regexp_count(text, F.lit(CONTROL)) / F.greatest(F.length(text), F.lit(1)) > MAX_CONTROL
    plain = (F.length(body) >= LONG_PAGE) & (F.regexp_count(body, F.lit(DIACRITIC)) / F.greatest(F.length(body), F.lit(1)) < MIN_DIACRITIC)
    return F.when(empty, F.array(F.lit("empty"))).otherwise(codes((control, "control"), (plain, "diacritics")))


def null_profile(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_rows, n_blank (null or white space), n_distinct, from one pass."""
    names = columns or rows.columns
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    wide = rows.agg(F.count("*").alias("n"), *(F.struct(blank(c).alias("n_blank"), F.countDistinct(c).alias("n_distinct")).alias(f"c{i}") for i, c in enumerate(names)))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"c{i}.n_blank").alias("n_blank"), F.col(f"c{i}.n_distinct").alias("n_distinct")) for i, c in enumerate(names)))
    return wide.select(F.inline(each))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def group_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """what, value, n: counts of a column's values in several tables."""
    parts = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n") for what, (df, c) in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def catalog(rows: DataFrame, group: str, order: str, firsts: list[str]) -> DataFrame:
    """Per group: rows and the first values by an order."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), *(F.min_by(c, order).alias(c) for c in firsts))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only in the first, only in the second."""
    left, right = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, key, "full_outer")
    return both.agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"), F.count_if(F.col("__b").isNull()).alias("only_first"), F.count_if(F.col("__a").isNull()).alias("only_second"))


def round_robin(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first rows dealt across groups: every group's first, then every group's second, and so on."""
    ranked = rows.withColumn("round", F.row_number().over(W.partitionBy(group).orderBy(order)))
    return ranked.orderBy("round", group, order).limit(most)


def seeded_sample(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """So many rows of each group by a hash of key and seed: the same rows on every run."""
    w = W.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def accept_variants(variants: DataFrame, originals: DataFrame, question: str, text: str, order: str, most: int, least_length: int = 5, longest: int = 400) -> DataFrame:
    """Query variants with a status: length, duplicate (of the original or an earlier one), invented_reference, surplus or accepted."""
    from ..functions.text import legal_refs, normalize_for_dedupe

    base = originals.select(question, normalize_for_dedupe(F.col(text)).alias("__q"), legal_refs(F.col(text)).alias("__refs"))
    rows = variants.join(base, question, "left").withColumn("__n", normalize_for_dedupe(F.col(text)))
    first = F.row_number().over(W.partitionBy(question, "__n").orderBy(order))
    size = F.length(F.trim(F.col(text)))
    status = (
        F.when(F.coalesce(~size.between(least_length, longest), F.lit(True)), "length")
        .when((F.col("__n") == F.col("__q")) | (F.col("__first") > 1), "duplicate")
        .when(F.size(F.array_except(legal_refs(F.col(text)), "__refs")) > 0, "invented_reference")
    )
    rows = rows.withColumn("__first", first).withColumn("status", status)
    number = F.sum(F.col("status").isNull().cast("int")).over(W.partitionBy(question).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("status", F.when(F.col("status").isNotNull(), F.col("status")).when(number > most, "surplus").otherwise("accepted"))
    return rows.drop("__q", "__refs", "__n", "__first")


def unique_headings(rows: DataFrame, key: str, text: str, least: int = 12, most: int = 110) -> DataFrame:
    """Lower-cased headings of that many characters that a single row has: key, heading."""
    from ..functions.text import heading_of

    said = rows.select(F.col(key), F.lower(heading_of(F.col(text))).alias("heading")).filter(F.length("heading").between(least, most))
    return said.groupBy("heading").agg(F.count("*").alias("__n"), F.min(key).alias(key)).filter("__n = 1").select(key, "heading")


def long_texts(rows: DataFrame, key: str, text: str, tokens: int = 512, chars_per_token: int = 3) -> DataFrame:
    """Rows whose text a model of so many tokens would probably cut: key, n_chars."""
    return rows.select(F.col(key), F.length(text).alias("n_chars")).filter(F.col("n_chars") > tokens * chars_per_token)


def with_metadata(content: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Content rows with their metadata; those without keep nulls. A repeated metadata id counts once."""
    return content.join(metadata.dropDuplicates([key]), key, "left")


def running_sequence(pieces: DataFrame, doc: str, order: list[str], text: str, least: int) -> DataFrame:
    """Pieces of enough trimmed characters with their number in their document, from 1."""
    kept = pieces.withColumn(text, F.trim(text)).filter(F.length(text) >= least)
    return kept.withColumn("seq", F.row_number().over(W.partitionBy(doc).orderBy(*order)))


def in_hit_order(hits: DataFrame, rows: DataFrame, query: str, key: str, rank: str) -> DataFrame:
    """The stored rows of hits by id, in the order of their rank; ids that are not stored drop out and leave no gap in place."""
    found = hits.select(query, key, rank).join(rows, key)
    return found.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(rank, key)))


def domain_catalog(chunks: DataFrame, domains: DataFrame, doc: str, domain: str, unknown: str = "UNCLASSIFIED") -> DataFrame:
    """Per domain: documents and chunks; documents without a domain count under the name given."""
    per_doc = chunks.groupBy(doc).agg(F.count("*").alias("n"))
    named = per_doc.join(domains.select(doc, domain).dropDuplicates([doc]), doc, "left").withColumn(domain, F.coalesce(domain, F.lit(unknown)))
    return named.groupBy(domain).agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_chunks"))
