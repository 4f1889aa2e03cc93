"""Cutting documents into chunks: fixed windows, paragraphs, headings, articles and clauses.

Each document is cut on its own, inside one row: arrays and ordered folds, no shuffle, until chunks are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squeeze

SIZE, OVERLAP, SEMANTIC_SIZE, TINY, LONG_BLOCK, MIN_CHUNK = 800, 120, 1000, 20, 3000, 40
# How headings begin a line.
HEADINGS = [r"(?iu)^#{0,6}\s*(ch[uư][ơo]ng\s+[IVXLCDM\d]+)(?![\p{L}\p{N}_])", r"(?iu)^#{0,6}\s*(mục\s+\d+)(?![\p{L}\p{N}_])", r"(?iu)^#{0,6}\s*(điều\s+\d+[a-zđ]?)\.", r"^\s*(\d{1,3})\.\s+\S", r"^\s*([a-zđ])\)\s+\S"]
LABELS = ["", "", "", "Khoản ", "Điểm "]
ARTICLE_LINE = r"^\s*Điều\s+(\d+[a-zA-ZÀ-ỹ]?)\s*[.:]\s*(.*)$"
CHAPTER_LINE, SECTION_LINE, CLAUSE_LINE = r"(?iu)^\s*(chương\s+[IVXLCDM\d]+[.:]?\s*.*)$", r"(?iu)^\s*(mục\s+[IVXLCDM\d]+[.:]?\s*.*)$", r"^\s*(\d{1,2})\s*\.\s+(?=\S)"


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fixed_chunks(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, n (from 1), start, end, text: windows of `size` characters that share `overlap`; blank ones have no number."""
    n = F.length(text)
    step = size - overlap
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end"), F.substring(F.col(text), s + 1, F.lit(size)).alias("text")))
    kept = F.filter(pieces, lambda p: p["text"].rlike(r"\S"))
    return docs.select(key, F.posexplode(kept).alias("n", "piece")).select(key, (F.col("n") + 1).alias("n"), "piece.start", "piece.end", trimmed(F.col("piece.text")).alias("text"))


def paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines, trimmed; one shorter than 20 characters joins the one before it."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n+"), lambda p: p.rlike(r"\S"))
    parts = F.transform(parts, trimmed)
    return F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when((F.size(done) > 0) & (F.length(p) < TINY), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit("\n\n"), p)))).otherwise(F.concat(done, F.array(p))),
    )


def greedy_groups(lengths: Column, most: int, gap: int = 0) -> Column:
    """Number of the group of each element: a group closes when the next element would pass `most`; it never splits one.

    gap counts for each element held but not in the test, as the established rule has it.
    """
    start = F.struct(F.lit(1).alias("group"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("groups"))

    def step(s, n):
        full = (s["used"] > 0) & (s["used"] + n > most)
        group = F.when(full, s["group"] + 1).otherwise(s["group"])
        return F.struct(group.alias("group"), (F.when(full, 0).otherwise(s["used"]) + n + gap).alias("used"), F.concat(s["groups"], F.array(group)).alias("groups"))

    return F.aggregate(lengths, start, step, lambda s: s["groups"])


def semantic_chunks(docs: DataFrame, key: str, text: str, most: int = SEMANTIC_SIZE) -> DataFrame:
    """key, n, text: whole paragraphs up to `most` characters, separators not counted."""
    rows = docs.select(key, paragraphs(F.col(text)).alias("p"))
    rows = rows.select(key, "p", greedy_groups(F.transform("p", lambda x: F.length(x)), most).alias("g"))
    each = rows.select(key, F.posexplode(F.arrays_zip("p", "g")).alias("at", "z")).select(key, "at", F.col("z.p").alias("p"), F.col("z.g").alias("n"))
    grouped = each.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("parts"))
    return grouped.select(key, "n", F.array_join(F.transform("parts", lambda x: x["p"]), "\n\n").alias("text"))


def heading_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, at (line number), line, level (0 to 4; null: no heading) and label."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line"))
    level, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k in reversed(range(5)):
        hit = F.regexp_extract("line", HEADINGS[k], 1)
        said = squeeze(hit) if k < 3 else F.concat(F.lit(LABELS[k]), hit, F.lit(")" if k == 4 else ""))
        level, label = F.when(hit != "", k).otherwise(level), F.when(hit != "", said).otherwise(label)
    return lines.withColumn("level", level).withColumn("label", label)


def live_labels(rows: DataFrame, key: str, at: str, level: str, label: str, levels: int = 5) -> DataFrame:
    """Adds path: the labels in force at each row. A label is live while no label of a higher level came after it."""
    before = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    for k in range(levels):
        rows = rows.withColumn(f"__at{k}", F.last(F.when(F.col(level) == k, F.col(at)), ignorenulls=True).over(before)).withColumn(f"__l{k}", F.last(F.when(F.col(level) == k, F.col(label)), ignorenulls=True).over(before))
    parts = []
    for k in range(levels):
        later = F.greatest(F.lit(-1), *(F.coalesce(f"__at{j}", F.lit(-1)) for j in range(k))) if k else F.lit(-1)
        parts.append(F.when(F.col(f"__at{k}") > later, F.col(f"__l{k}")))
    return rows.withColumn("path", F.concat_ws(" > ", *parts)).drop(*(f"__at{k}" for k in range(levels)), *(f"__l{k}" for k in range(levels)))


def hierarchical_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, text, path, detected: one chunk per heading; text before the first is left out; without headings the whole text."""
    lines = live_labels(heading_lines(docs, key, text), key, "at", "level", "label")
    order = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("n", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(order))
    grouped = lines.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts"), F.min_by("path", "at").alias("path"))
    chunks = grouped.select(key, "n", trimmed(F.array_join(F.transform("parts", lambda x: x["line"]), "\n")).alias("text"), "path", (F.col("n") > 0).alias("detected"))
    most = W.partitionBy(key)
    chunks = chunks.withColumn("__most", F.max("n").over(most)).filter(((F.col("n") > 0) | (F.col("__most") == 0)) & (F.col("text") != ""))
    return chunks.select(key, F.greatest("n", F.lit(1)).alias("n"), "text", F.when(F.col("detected"), F.col("path")).alias("path"), "detected")


def page_at(pages: DataFrame, offsets: DataFrame, key: str, page: str, text: str, offset: str) -> DataFrame:
    """The page of each offset in a file whose pages are joined by two characters: last page that starts at or before it."""
    order = W.partitionBy(key).orderBy(page)
    starts = pages.select(key, F.col(page).alias("page"), (F.sum(F.length(text) + 2).over(order) - F.length(text) - 2).alias(offset))
    marks = starts.select(key, F.col(offset), F.col("page"), F.lit(0).alias("__asked"))
    asked = offsets.select(key, F.col(offset), F.lit(None).cast(pages.schema[page].dataType).alias("page"), F.lit(1).alias("__asked"))
    upto = W.partitionBy(key).orderBy(offset, "__asked").rowsBetween(W.unboundedPreceding, 0)
    return marks.unionByName(asked).withColumn("page", F.last("page", ignorenulls=True).over(upto)).filter("__asked = 1").drop("__asked")


def split_articles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, article, heading, chapter, section, text: blocks that begin at an article's line; a preamble of 40 and more characters."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line"))
    short = F.length("line") < 200
    line = F.col("line")
    chapter = F.when(short & line.rlike(CHAPTER_LINE), trimmed(line))
    section = F.when(chapter.isNull() & short & line.rlike(SECTION_LINE), trimmed(line))
    article = F.when(chapter.isNull() & section.isNull(), F.nullif(F.regexp_extract(line, ARTICLE_LINE, 1), F.lit("")))
    order = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.select(key, "at", "line", article.alias("article"), F.when(article.isNotNull(), trimmed(F.regexp_extract(line, ARTICLE_LINE, 2))).alias("heading"), F.last(chapter, ignorenulls=True).over(order).alias("chapter"), F.last(section, ignorenulls=True).over(order).alias("section"))
    rows = rows.withColumn("block", F.count("article").over(order))
    blocks = rows.groupBy(key, "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts"), *(F.min_by(c, "at").alias(c) for c in ("article", "heading", "chapter", "section"))
    )
    joined = trimmed(F.regexp_replace(F.array_join(F.transform("parts", lambda x: trimmed(x["line"])), "\n"), "\n{3,}", "\n\n"))
    front = F.col("block") == 0
    out = blocks.select(key, "block", F.coalesce("article", F.lit("")).alias("article"), F.when(front, "Phần mở đầu").otherwise(F.col("heading")).alias("heading"), *(F.when(front, "").otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in ("chapter", "section")), joined.alias("text"))
    return out.filter(~front | (F.length("text") >= MIN_CHUNK))


def keep_longest(blocks: DataFrame, key: str, article: str, at: str, text: str) -> DataFrame:
    """Of a document's blocks of one article the longest (the first of equals), at the place of the first; blocks without article stay."""
    group = [key, article, F.when(F.col(article) == "", F.col(at))]
    w = W.partitionBy(*group)
    ranked = blocks.withColumn("__r", F.row_number().over(w.orderBy(F.length(text).desc(), at))).withColumn("__first", F.min(at).over(w))
    return ranked.filter("__r = 1").drop("__r").withColumn(at, F.col("__first")).drop("__first")


def split_clauses(blocks: DataFrame, keys: list[str], text: str, most: int = LONG_BLOCK) -> DataFrame:
    """Blocks of more than `most` characters cut at their clauses ('1. '), each after the block's first line; longer clauses cut hard.

    clause: its number, with p1, p2 … for hard cuts; '' for a block that stays whole. Parts under 40 characters go.
    """
    whole = blocks.filter(F.length(text) <= most).withColumn("part", F.lit(0)).withColumn("clause", F.lit(""))
    long = blocks.filter(F.length(text) > most).withColumn("__head", F.substring_index(text, "\n", 1))
    lines = long.select(*blocks.columns, "__head", F.posexplode(F.split(text, "\n")).alias("__at", "__line")).filter("__at > 0")
    order = W.partitionBy(*keys).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    number = F.nullif(F.regexp_extract("__line", CLAUSE_LINE, 1), F.lit(""))
    lines = lines.withColumn("__no", number).withColumn("__g", F.count("__no").over(order))
    rest = [c for c in blocks.columns if c not in keys]
    parts = lines.groupBy(*keys, "__g").agg(F.array_sort(F.collect_list(F.struct("__at", "__line"))).alias("__lines"), F.first("__no", ignorenulls=True).alias("__no"), F.first("__head").alias("__head"), *(F.first(c).alias(c) for c in rest))
    body = F.array_join(F.transform("__lines", lambda x: x["__line"]), "\n")
    parts = parts.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).withColumn("__body", F.when(F.col("__n") > 1, trimmed(body)).otherwise(body))
    parts = parts.filter((F.col("__n") == 1) | (F.length("__body") >= MIN_CHUNK)).withColumn("__no", F.when(F.col("__n") > 1, F.coalesce("__no", F.lit(""))).otherwise(""))
    cuts = F.sequence(F.lit(0), (F.greatest(F.length("__body") - 1, F.lit(0)) / most).cast("int"))
    each = parts.withColumn("__cuts", F.size(cuts)).select("*", F.explode(cuts).alias("__i"))
    clause = F.when(F.col("__cuts") > 1, F.concat("__no", F.lit("p"), (F.col("__i") + 1).cast("string"))).otherwise(F.col("__no"))
    said = trimmed(F.concat_ws("\n", "__head", F.substring(F.col("__body"), F.col("__i") * most + 1, F.lit(most))))
    out = each.select(*keys, *(said.alias(text) if c == text else F.col(c) for c in rest), (F.col("__g") * 1000 + F.col("__i")).cast("int").alias("part"), clause.alias("clause"))
    return whole.unionByName(out)


def chunk_statistics(chunks: DataFrame, group: str, text: str) -> DataFrame:
    """Per strategy: chunks, least, largest and mean length."""
    n = F.length(text)
    return chunks.groupBy(group).agg(F.count("*").alias("n_chunks"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n), 4).alias("mean_length"))
