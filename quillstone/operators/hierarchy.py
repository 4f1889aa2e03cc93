"""Parents and children: resolving levels, building parent windows, scoring parents, spending a context budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import numeric_suffix, parent_id
from ..sources import store
from . import scan
from .chunking import greedy_groups

# Prefixes of a path's levels.
LEVELS = {"chapter": "chương", "section": "mục", "article": "điều", "clause": "khoản", "point": "điểm"}
CHAPTER_HEAD, ARTICLE_HEAD = r"(?iu)^\s*#{0,6}\s*(chương\s+[IVXLCDM\d]+)(?![\p{L}\p{N}_])", r"(?iu)^\s*#{0,6}\s*(điều\s+\d+[a-zđ]?)\s*\."
RRF_K, RANK_DIGITS = 60, 9
#: Children of a group above which its windows are found by scans over tasks instead of one fold.
GIANT = 10_000


def parse_path(c: Column) -> Column:
    """Struct of chapter, section, article, clause, point from 'Chương I > Điều 2'; the last of a level wins; unknown parts are ignored."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ">"), lambda p: F.trim(p)), lambda p: p != "")
    pick = lambda word: F.try_element_at(F.filter(parts, lambda p: p.rlike(rf"(?iu)^{word}\s+")), F.lit(-1))
    return F.struct(*(pick(word).alias(level) for level, word in LEVELS.items()))


def resolve_levels(chunks: DataFrame, source: str, key: str, path: str, text: str) -> DataFrame:
    """Adds chapter, article, clause, point, method and ambiguous to each child, in order of its number within its source.

    Article: from the path, else from a heading at the text's start, else carried from before in the same source, else none.
    What is carried ends where the chapter changes; an article before any chapter carries into the first.
    """
    found = lambda pattern: F.nullif(F.trim(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), pattern, 1)), F.lit(""))
    rows = chunks.withColumn("__p", parse_path(F.col(path))).withColumn("__hc", found(CHAPTER_HEAD)).withColumn("__ha", found(ARTICLE_HEAD))
    order = W.partitionBy(source).orderBy(*numeric_suffix(F.col(key)))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    fold = lambda c: F.trim(F.lower(c))
    rows = rows.withColumn("chapter", F.last(F.coalesce("__p.chapter", "__hc"), ignorenulls=True).over(upto))
    rows = rows.withColumn("__turn", F.coalesce((F.lag("chapter").over(order).isNotNull() & (fold(F.lag("chapter").over(order)) != fold(F.col("chapter")))).cast("int"), F.lit(0)))
    rows = rows.withColumn("__run", F.sum("__turn").over(upto)).withColumn("__own", F.coalesce("__p.article", "__ha"))
    carried = F.last("__own", ignorenulls=True).over(W.partitionBy(source, "__run").orderBy(*numeric_suffix(F.col(key))).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("article", carried)
    method = F.when(F.col("__p.article").isNotNull(), "metadata").when(F.col("__ha").isNotNull(), "heading_inferred").when(F.col("article").isNotNull(), "carried_forward").otherwise("document_fallback")
    clash = lambda a, b: F.coalesce(fold(F.col(a)) != fold(F.col(b)), F.lit(False))
    rows = rows.withColumn("method", method)
    ambiguous = clash("__p.chapter", "__hc") | clash("__p.article", "__ha") | F.col("method").isin("carried_forward", "document_fallback")
    return rows.select(*chunks.columns, "chapter", F.col("__p.section").alias("section"), "article", F.col("__p.clause").alias("clause"), F.col("__p.point").alias("point"), "method", ambiguous.alias("ambiguous"))


def article_key(source: str) -> Column:
    """Chapter and article; without article, chapter and clause or the document, marked as fallback."""
    fallback = F.concat_ws(" > ", "chapter", "clause")
    return F.when(F.col("article").isNotNull(), F.concat_ws(" > ", "chapter", "article")).otherwise(F.concat(F.when(fallback == "", F.concat(F.lit("[document:"), F.col(source).cast("string"), F.lit("]"))).otherwise(fallback), F.lit(" [fallback]")))


def parent_windows(children: DataFrame, group: list[str], order: list, key: str, text: str, most: int, giant: int = GIANT) -> DataFrame:
    """group, key, window: children in order packed whole into windows of at most `most` characters.

    A child counts its length and two more once held; a child longer than the window stands alone; a null text is empty. Groups of up to
    `giant` children are folded in one array each; larger ones, found by a count, spread over tasks with equal results. children are read twice.
    """
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    large = store.spill(children.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") > giant).drop("__n"), "giants")
    by = reduce(lambda a, b: a & b, [F.col(f"c.{g}").eqNullSafe(F.col(f"l.{g}")) for g in group])
    some = not large.isEmpty()
    small = children.alias("c").join(large.alias("l"), by, "left_anti") if some else children
    order_struct = F.struct(*order, F.col(key).alias("__key"), length.alias("__n"))
    packed = small.groupBy(*group).agg(F.array_sort(F.collect_list(order_struct)).alias("__m"))
    packed = packed.select(*group, "__m", greedy_groups(F.transform("__m", lambda m: m["__n"]), most, 2).alias("__w"))
    each = packed.select(*group, F.inline(F.arrays_zip(F.transform("__m", lambda m: m["__key"]).alias(key), F.col("__w").alias("window"))))
    if not some:
        return each
    rest = children.alias("c").join(large.alias("l"), by, "left_semi")
    rest = rest.select(*group, key, length.alias("__n"), *(o.alias(f"__ord{i}") for i, o in enumerate(order)))
    places = [*(F.col(f"__ord{i}") for i in range(len(order))), F.col(key)]
    spread = scan.windows(rest, [F.col(g) for g in group], places, F.col("__n"), most, 2, "window")
    return each.unionByName(spread.select(*group, key, F.col("window").cast("int").alias("window")))


def build_parents(children: DataFrame, source: str, key: str, text: str, page: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(parents, children with parent_id): windows of one article's children with joined text, pages and ambiguity."""
    keyed = store.spill(children.withColumn("article_key", article_key(source)), "keyed")
    suffix = numeric_suffix(F.col(key))
    windows = parent_windows(keyed, [source, "article_key"], [s.alias(f"__o{i}") for i, s in enumerate(suffix)], key, text, most)
    placed = keyed.join(windows, [source, "article_key", key]).withColumn("parent_id", parent_id(F.col(source).cast("string"), F.col("article_key"), F.col("window")))
    ordered = F.array_sort(F.collect_list(F.struct(*(s.alias(f"o{i}") for i, s in enumerate(suffix)), F.col(key).alias("id"), F.col(text).alias("t"))))
    parents = placed.groupBy("parent_id", source, "article_key", "window").agg(ordered.alias("m"), F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.count_if("ambiguous").alias("n_ambiguous"))
    joined = F.array_join(F.transform("m", lambda x: x["t"]), "\n\n")
    return parents.select("parent_id", source, "article_key", "window", F.transform("m", lambda x: x["id"]).alias("child_ids"), joined.alias("text"), F.length(joined).alias("char_count"), "page_start", "page_end", "n_ambiguous"), placed


def map_children(hits: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Hits with their parent; a hit whose child is unknown is an error, raised when rows are read."""
    joined = hits.join(children.select(key, "parent_id"), key, "left")
    return joined.withColumn("parent_id", F.when(F.col("parent_id").isNull(), F.raise_error(F.lit("a hit's child has no parent"))).otherwise(F.col("parent_id")))


def score_parents(hits: DataFrame, question: str, parent: str, key: str, rank: str, queries: str | None = None, limit: int = 3, k: int = RRF_K) -> DataFrame:
    """Parents of a question: score from their `limit` best children's ranks, support, anchor child and rank.

    Order: score down, number of supporting queries down, best child's rank, id.
    """
    w = W.partitionBy(question, parent).orderBy(rank, key)
    rows = hits.withColumn("__r", F.row_number().over(w))
    agg = [
        F.sum(F.when(F.col("__r") <= limit, 1.0 / (k + F.col(rank))).otherwise(0.0)).alias("score"), F.min(rank).alias("best_child_rank"),
        F.min_by(key, "__r").alias("anchor"), F.count("*").alias("n_children"),
        F.transform(F.array_sort(F.collect_list(F.struct("__r", key))), lambda x: x[key]).alias("child_ids"),
    ]
    if queries:
        agg.append(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__r", queries))), lambda x: x[queries]))).alias("support"))
    scored = rows.groupBy(question, parent).agg(*agg)
    support = F.size("support") if queries else F.lit(1)
    order = W.partitionBy(question).orderBy(F.round("score", RANK_DIGITS).desc(), support.desc(), "best_child_rank", parent)
    return scored.withColumn("parent_rank", F.row_number().over(order))


def context_budget(parents: DataFrame, question: str | list[str], parent: str, rank: str, length: str, most: int) -> DataFrame:
    """Adds selected: parents in rank order while the budget lasts; one that does not fit is skipped, later ones still tried.

    An oversized first parent is kept. One fold per question over its candidates.
    """
    by = [question] if isinstance(question, str) else question
    packed = parents.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(parent).alias("p"), F.col(length).cast("int").alias("n")))).alias("__m"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("held"), F.array().cast("array<boolean>").alias("take"))

    def step(s, m):
        take = (s["used"] + m["n"] <= most) | (s["held"] == 0)
        # with nothing selected an oversized parent is kept, whatever its rank
        return F.struct(F.when(take, s["used"] + m["n"]).otherwise(s["used"]).alias("used"), (s["held"] + take.cast("int")).alias("held"), F.concat(s["take"], F.array(take)).alias("take"))

    taken = packed.select(*by, F.inline(F.arrays_zip(F.transform("__m", lambda m: m["p"]).alias(parent), F.aggregate("__m", start, step, lambda s: s["take"]).alias("selected"))))
    return parents.join(taken, [*by, parent])


def hierarchy_audit(parents: DataFrame) -> DataFrame:
    """One row: least, upper median and largest size and child count of parents. The median comes from size counts, not from all sizes."""
    children = F.size("child_ids")
    sizes = parents.groupBy("char_count").agg(F.count("*").alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(W.orderBy("char_count"))).crossJoin(F.broadcast(parents.agg(F.count("*").alias("total"))))  # one row
    median = upto.filter(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("char_count").alias("median_chars"))
    return parents.agg(F.count("*").alias("n_parents"), F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars"), F.min(children).alias("min_children"), F.max(children).alias("max_children")).crossJoin(F.broadcast(median))  # one row
