"""Registered queries over document structure. Headings, paragraphs and thresholds are made from the tables the same way in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import chunking, graph, hierarchy, html, rerank, scan, stored_hierarchy, validation
from ..sources import store
from ..sources.tables import spread
from ..sources.tables import table as _table

def table(spark, sf, name):
    """A table; long texts of one small file are dealt over all cores."""
    df = _table(spark, sf, name)
    return spread(df) if name in ("documents", "pages") else df



def lines_of(spark, sf) -> DataFrame:
    """conv_id, turn, line: conversations as the lines of a structured document, a heading or item for each place in a cycle of five."""
    flat = F.regexp_replace("text", r"\s+", " ")
    n = F.col("turn").cast("string")
    line = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit("Chương "), n)).when(F.col("turn") % 5 == 1, F.concat(F.lit("Điều "), n, F.lit(". "), flat))
        .when(F.col("turn") % 5 == 2, F.concat(n, F.lit(". "), flat)).when(F.col("turn") % 5 == 3, F.concat(F.lit("a) "), flat)).otherwise(flat)
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))


def _structured(spark, sf) -> DataFrame:
    rows = lines_of(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def chunk_fixed(spark, sf):
    out = chunking.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "n", "start", "end", F.md5("text").alias("digest"))


def chunk_stats(spark, sf):
    out = chunking.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text").withColumn("strategy", F.lit("fixed-size"))
    return chunking.chunk_statistics(out, "strategy", "text")


def chunk_semantic(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    out = chunking.semantic_chunks(docs, "doc_id", "text")
    return out.select("doc_id", "n", F.length("text").alias("length"), F.md5("text").alias("digest"))


def page_lookup(spark, sf):
    pages = table(spark, sf, "conversations")
    last = pages.groupBy("conv_id").agg(F.sum(F.length("text") + 2).alias("total"))
    asked = last.select("conv_id", F.explode(F.sequence(F.lit(0), F.col("total").cast("int") - 3, F.lit(97))).alias("offset"))
    return chunking.page_at(pages, asked, "conv_id", "turn", "text", "offset")


def heading_path(spark, sf):
    rows = chunking.heading_lines(_structured(spark, sf), "conv_id", "text")
    return chunking.live_labels(rows, "conv_id", "at", "level", "label").select("conv_id", "at", "level", "path")


def chunk_hierarchical(spark, sf):
    return chunking.hierarchical_chunks(_structured(spark, sf), "conv_id", "text").select("conv_id", "n", "path", "detected", F.length("text").alias("length"))


def article_split(spark, sf):
    out = chunking.split_articles(_structured(spark, sf), "conv_id", "text")
    return out.select("conv_id", "block", "article", "chapter", F.length("text").alias("length"))


def dedupe_longest(spark, sf):
    blocks = table(spark, sf, "documents").select("source", (F.col("doc_id") % 10).cast("string").alias("article"), F.col("doc_id").alias("seq"), "text")
    return chunking.keep_longest(blocks, "source", "article", "seq", "text").select("source", "article", "seq", F.length("text").alias("length"))


def split_clauses(spark, sf):
    numbered = lambda: F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Header\n"), numbered()).alias("text"))
    out = chunking.split_clauses(docs, ["doc_id"], "text")
    return out.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.max(F.length("text")).alias("longest"), F.min("clause").alias("first_clause"))


def _children(spark, sf) -> DataFrame:
    rows = lines_of(spark, sf)
    chunks = rows.select((F.col("conv_id") % 50).alias("source"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit(":"), (F.col("conv_id") * 100 + F.col("turn")).cast("string")).alias("child_id"), F.when(F.col("turn") % 5 == 0, F.concat(F.lit("Chương "), ((F.col("conv_id") + F.col("turn")) % 3).cast("string"))).when((F.col("turn") % 5 == 1) & (F.col("conv_id") % 2 == 0), F.concat(F.lit("Điều "), F.col("turn").cast("string"))).alias("structure_path"), F.col("line").alias("text"), F.col("turn").alias("page"), (F.col("conv_id") * 100 + F.col("turn")).alias("num"))
    return chunks


def carry_forward(spark, sf):
    rows = hierarchy.resolve_levels(_children(spark, sf), "source", "child_id", "structure_path", "text")
    return rows.select("source", "child_id", "chapter", "article", "method", "ambiguous")


def parent_windows(spark, sf):
    rows = table(spark, sf, "conversations")
    return hierarchy.parent_windows(rows, ["conv_id"], [F.col("turn").alias("__t")], "turn", "text", 600)


def giant_windows(spark, sf):
    """All documents as one group."""
    rows = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    return scan.windows(rows, [], [F.col("doc_id")], F.col("n"), 20_000, 2, "window").select("doc_id", "window")


def parent_build(spark, sf):
    children = hierarchy.resolve_levels(_children(spark, sf), "source", "child_id", "structure_path", "text")
    parents, _ = hierarchy.build_parents(children, "source", "child_id", "text", "page", 1500)
    return parents.select("source", "article_key", "window", F.size("child_ids").alias("n_children"), "char_count", "page_start", "page_end", "n_ambiguous")


def _stored_hierarchy(spark, sf) -> tuple[str, DataFrame]:
    """A store built before a third of the sources changed and one came, then brought up to date; the states it found."""
    path, now = store.fresh_folder(spark, "hierarchy"), _children(spark, sf)
    digit = F.col("source") % 10
    before = now.filter(digit != 1).withColumn("text", F.when(digit.isin(2, 5, 8), F.concat("text", F.lit(" before"))).otherwise(F.col("text")))
    refresh = lambda chunks: stored_hierarchy.refresh(chunks, path, "source", "child_id", "structure_path", "text", "page", 1500)
    refresh(before)
    return path, refresh(now)


def hierarchy_refresh(spark, sf):
    path, _ = _stored_hierarchy(spark, sf)
    parents = store.load(spark, path, "parents")
    return parents.select("source", "article_key", "window", F.size("child_ids").alias("n_children"), "char_count", "page_start", "page_end", "n_ambiguous")


def hierarchy_status(spark, sf):
    return _stored_hierarchy(spark, sf)[1].select("source", "state")


#: Conversations of a question, from so many on that ten questions hold more.
_BLOCK = 50


def _child_hits(spark, sf) -> DataFrame:
    # rank of a turn among all turns of its question (a bucket of conversations), by length; ten questions, more as the table grows
    t = table(spark, sf, "conversations")
    n = t.agg(F.greatest(F.lit(10), F.ceil(F.count_distinct("conv_id") / _BLOCK)).alias("__n"))
    rows = t.crossJoin(F.broadcast(n)).select((F.col("conv_id") % F.col("__n")).alias("question_id"), F.col("conv_id").alias("parent_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("child_id"), F.length("text").alias("size"))  # one row
    from pyspark.sql import Window as W

    return rows.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.col("size").desc(), "child_id")))


def parent_score(spark, sf):
    out = hierarchy.score_parents(_child_hits(spark, sf), "question_id", "parent_id", "child_id", "rank")
    return out.select("question_id", "parent_id", F.round("score", 9).alias("score"), "best_child_rank", "anchor", "n_children", "parent_rank")


def child_to_parent(spark, sf):
    hits = _child_hits(spark, sf).drop("parent_id")
    children = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("child_id"), F.col("conv_id").alias("parent_id"))
    return hierarchy.map_children(hits, children, "child_id").select("question_id", "child_id", "parent_id", "rank")


def context_budget(spark, sf):
    scored = hierarchy.score_parents(_child_hits(spark, sf), "question_id", "parent_id", "child_id", "rank")
    sizes = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("parent_id")).agg(F.sum(F.length("text") + 2).alias("char_count"))
    out = hierarchy.context_budget(scored.join(sizes, "parent_id"), "question_id", "parent_id", "parent_rank", "char_count", 4000)
    return out.select("question_id", "parent_id", "parent_rank", "char_count", "selected")


def context_expansion(spark, sf):
    from ..operators import metrics

    hits = _child_hits(spark, sf)
    sizes = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("parent_id")).agg(F.sum(F.length("text")).alias("context"))
    per = hits.groupBy("question_id", "parent_id").agg(F.sum("size").alias("child")).join(sizes, "parent_id")
    return metrics.expansion_factor(per, "question_id", "context", "child")


def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.html_title(F.col("html")).alias("title"), html.meta_content(F.col("html"), "doc_id").alias("meta_id"))


def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(T.normalize_text(html.html_text(F.col("html")))).alias("n_chars"))


def html_blocks(spark, sf):
    return html.blocks(table(spark, sf, "pages"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


def _tree(spark, sf) -> DataFrame:
    rows = lines_of(spark, sf).select("conv_id", F.col("turn").alias("at"), F.col("line").alias("text"), F.lit(False).alias("is_table"))
    return html.heading_tree(rows, "conv_id")


def html_tree(spark, sf):
    return _tree(spark, sf).select("conv_id", "order_index", "level", "chunk_id", "parent_id", "document_fallback")


def tree_integrity(spark, sf):
    return graph.tree_integrity(_tree(spark, sf), "conv_id", "chunk_id", "parent_id", "order_index")


def ancestor_root(spark, sf):
    tree = _tree(spark, sf)
    return graph.ancestors(tree.select("chunk_id", "parent_id"), "chunk_id", "parent_id", 8)


def next_links(spark, sf):
    return graph.next_links(table(spark, sf, "conversations"), ["conv_id"], "turn", "turn")


def next_chain(spark, sf):
    return graph.next_chain(table(spark, sf, "conversations"), ["conv_id"], "turn", "turn")


def chunk_validation(spark, sf):
    t = table(spark, sf, "conversations")
    rows = t.select(
        F.when(F.col("turn") % 7 == 3, "").otherwise(F.concat_ws(":", "conv_id", "turn")).alias("chunk_id"), F.when(F.col("turn") % 3 == 0, "fixed_size").when(F.col("turn") % 3 == 1, "semantic").otherwise("other").alias("strategy"),
        F.col("role").alias("source"), F.col("turn").cast("int").alias("page_start"), F.when(F.col("turn") % 4 == 2, 0).otherwise(F.col("turn")).cast("int").alias("page_end"), "text",
    )
    return rows.groupBy(F.array_join(validation.chunk_faults(), ",").alias("faults")).agg(F.count("*").alias("n"))


def page_errors(spark, sf):
    text = F.when(F.col("doc_id") % 10 == 0, F.lit("  \n ")).when(F.col("doc_id") % 10 == 1, F.concat(F.col("text"), F.repeat(F.lit("\x01"), F.length("text")))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(validation.page_faults(text), ",").alias("faults"))


def null_profile(spark, sf):
    c = table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, " ").when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_mktsegment")))
    return validation.null_profile(c)


def duplicate_keys(spark, sf):
    return validation.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey"])


def group_counts(spark, sf):
    return validation.group_counts({"source": (table(spark, sf, "documents"), "source"), "lang": (table(spark, sf, "documents"), "lang"), "role": (table(spark, sf, "conversations"), "role"), "event": (table(spark, sf, "events"), "event_type")})


def catalog(spark, sf):
    return validation.catalog(table(spark, sf, "documents"), "source", "doc_id", ["doc_id", "lang", "n_chars"])


def key_overlap(spark, sf):
    return validation.key_overlap(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


def round_robin_pick(spark, sf):
    return validation.round_robin(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 24)


def unique_headings(spark, sf):
    return validation.unique_headings(table(spark, sf, "documents"), "doc_id", "text")


def seeded_sample(spark, sf):
    return validation.seeded_sample(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 5, 42)


def variant_filter(spark, sf):
    t = table(spark, sf, "conversations")
    originals = t.filter("turn = 0").select("conv_id", "text")
    variants = t.filter("turn > 0").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.lit("điều 99")).otherwise(F.col("text")).alias("text"))
    first = originals.withColumnRenamed("text", "q")
    rows = variants.join(first, "conv_id").select("conv_id", "turn", F.when(F.col("turn") == 1, F.col("q")).otherwise(F.col("text")).alias("text"))
    return validation.accept_variants(rows, originals, "conv_id", "text", "turn", 2).select("conv_id", "turn", "status")


def citation_labels(spark, sf):
    answers = table(spark, sf, "benchmark").select("item_id", F.concat("text", F.lit(" [E1] and [E2] or [E9] [E1]")).alias("answer"))
    evidence = table(spark, sf, "benchmark").select("item_id", F.explode(F.array(F.lit("E1"), F.lit("E2"), F.lit("E3"))).alias("label")).filter("label <> 'E2' OR item_id % 2 = 0")
    out = rerank.citation_check(answers, evidence, "item_id", "answer")
    return out.select("item_id", F.array_join("cited", ",").alias("cited"), F.array_join("unknown", ",").alias("unknown"), F.length("clean_answer").alias("n_chars"))


def citation_build(spark, sf):
    title, number = F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("No "), F.col("doc_id").cast("string")))
    article, clause = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 9).cast("string")).otherwise(""), F.when(F.col("doc_id") % 4 == 0, "p1").otherwise("2")
    said = T.citation(title, number, article, clause, F.concat(F.lit("c"), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", said.alias("citation"))


def stable_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", ids.parent_id(F.col("source"), F.col("lang"), F.lit(1)).alias("parent_id"), ids.tree_id(F.col("source"), F.col("lang")).alias("tree_id"), ids.chunk_id(F.col("source"), (F.col("doc_id") % 5).cast("string"), F.when(F.col("doc_id") % 2 == 0, "3").otherwise(""), F.col("doc_id") % 1000).alias("chunk_id"), ids.document_id(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("lang")).alias("document_id"))


def numeric_suffix_order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "none").otherwise(F.concat(F.lit("c_"), (F.col("doc_id") * 7919 % 10007).cast("string"))).alias("chunk_id"))
    return scan.numbers(d, [], [*ids.numeric_suffix(F.col("chunk_id")), F.col("doc_id")], "place").select("doc_id", "place")


def last_question(spark, sf):
    # the whole table is one group: the last user turn before or at each turn, across conversations
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    place = F.when(F.col("role") == "user", F.col("conv_id") * 1000 + F.col("turn"))
    return scan.carried(t, [], [F.col("conv_id"), F.col("turn")], place, "asked_at").select("conv_id", "turn", "asked_at")


def fingerprint(spark, sf):
    out = ids.fingerprint(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("n_rows", F.col("digest_a").cast("string").alias("digest_a"), F.col("digest_b").cast("string").alias("digest_b"))


def legal_refs(spark, sf):
    text = F.concat("text", F.lit(" theo Điều  "), (F.col("doc_id") % 20).cast("string"), F.lit("a, khoản "), (F.col("doc_id") % 4).cast("string"), F.lit(" và điều 3 điểm b."))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.legal_refs(text), ",").alias("refs"))


def normalize_dedupe(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_for_dedupe(F.col("text"))).alias("digest"))


def display_fields(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.snippet(F.col("text"), 80).alias("snippet"), T.page_range(F.col("doc_id") % 5, F.col("doc_id") % 5 + F.col("doc_id") % 2).alias("pages"), T.rank_arrow(F.col("doc_id") % 7, F.col("doc_id") % 4).alias("arrow"))


_FLAT_SQL = r"regexp_replace(text, '\s+', ' ', 'g')"
_LINES = f"lines AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Chương ' || turn WHEN 1 THEN 'Điều ' || turn || '. ' || {_FLAT_SQL} WHEN 2 THEN turn || '. ' || {_FLAT_SQL} WHEN 3 THEN 'a) ' || {_FLAT_SQL} ELSE {_FLAT_SQL} END AS line FROM conversations)"
#: level and label of a line, as the headings have it
_LEVELS = (
    _LINES
    + r""", heads AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS at, line,
 CASE WHEN regexp_matches(line, '^Chương \d+') THEN 0 WHEN regexp_matches(line, '^Điều \d+[a-zđ]?\.') THEN 2 WHEN regexp_matches(line, '^\s*\d{1,3}\.\s+\S') THEN 3 WHEN regexp_matches(line, '^\s*[a-zđ]\)\s+\S') THEN 4 END AS level,
 CASE WHEN regexp_matches(line, '^Chương \d+') THEN regexp_extract(line, '^(Chương \d+)', 1) WHEN regexp_matches(line, '^Điều \d+[a-zđ]?\.') THEN regexp_extract(line, '^(Điều \d+[a-zđ]?)\.', 1) WHEN regexp_matches(line, '^\s*\d{1,3}\.\s+\S') THEN 'Khoản ' || regexp_extract(line, '^\s*(\d{1,3})\.', 1) WHEN regexp_matches(line, '^\s*[a-zđ]\)\s+\S') THEN 'Điểm ' || regexp_extract(line, '^\s*([a-zđ])\)', 1) || ')' END AS label FROM lines),
 seen AS (SELECT *, """
    + ", ".join(f"last_value(CASE WHEN level = {k} THEN at END IGNORE NULLS) OVER w AS a{k}, last_value(CASE WHEN level = {k} THEN label END IGNORE NULLS) OVER w AS l{k}" for k in (0, 2, 3, 4))
    + """ FROM heads WINDOW w AS (PARTITION BY conv_id ORDER BY at ROWS UNBOUNDED PRECEDING)),
 paths AS (SELECT conv_id, at, line, level, concat_ws(' > ', l0, CASE WHEN a2 > coalesce(a0, -1) THEN l2 END, CASE WHEN a3 > greatest(coalesce(a0, -1), coalesce(a2, -1)) THEN l3 END, CASE WHEN a4 > greatest(coalesce(a0, -1), coalesce(a2, -1), coalesce(a3, -1)) THEN l4 END) AS path FROM seen)"""
)
_FIXED = "pieces AS (SELECT doc_id, s, substr(text, s + 1, 800) AS piece, length(text) AS n FROM documents, LATERAL (SELECT unnest(CASE WHEN length(text) = 0 THEN []::BIGINT[] WHEN length(text) <= 800 THEN [0] ELSE list_transform(range(0, ceil((length(text) - 800) / 680.0)::BIGINT + 1), lambda i: i * 680) END) AS s)), fixed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s)::INTEGER AS n, s AS start, least(s + 800, n) AS e, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS piece FROM pieces WHERE regexp_matches(piece, '\\S'))"
_GREEDY = "list_reduce({lens}, lambda s, x: {{'g': CASE WHEN s.u > 0 AND s.u + x.n > {most} THEN s.g + 1 ELSE s.g END, 'u': CASE WHEN s.u > 0 AND s.u + x.n > {most} THEN 0 ELSE s.u END + x.n + {gap}, 'n': 0::BIGINT, 'gs': list_append(s.gs, CASE WHEN s.u > 0 AND s.u + x.n > {most} THEN s.g + 1 ELSE s.g END)}}, {{'g': 1::BIGINT, 'u': 0::BIGINT, 'n': 0::BIGINT, 'gs': []::BIGINT[]}}).gs"
_AS_STRUCT = "list_transform({list}, lambda y: {{'g': 0::BIGINT, 'u': 0::BIGINT, 'n': length(y)::BIGINT, 'gs': []::BIGINT[]}})"
_HITS = "sized AS (SELECT conv_id % n AS question_id, conv_id AS parent_id, conv_id * 100 + turn AS child_id, length(text) AS size FROM conversations, (SELECT greatest(10, ceil(count(DISTINCT conv_id) / 50))::BIGINT AS n FROM conversations)), hits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY size DESC, child_id) AS rank FROM sized)"
_SCORED = _HITS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, parent_id ORDER BY rank, child_id) AS r FROM hits), sc AS (SELECT question_id, parent_id, sum(CASE WHEN r <= 3 THEN 1.0 / (60 + rank) ELSE 0 END) AS score, min(rank) AS best_child_rank, min_by(child_id, r) AS anchor, count(*) AS n_children FROM ranked GROUP BY ALL), scored AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, best_child_rank, parent_id) AS parent_rank FROM sc)"
_CHILDREN = _LINES + ", kids AS (SELECT conv_id % 50 AS source, conv_id || ':' || turn || ':' || (conv_id * 100 + turn) AS child_id, conv_id * 100 + turn AS num, turn, line, CASE WHEN turn % 5 = 0 THEN 'Chương ' || ((conv_id + turn) % 3) END AS mc, CASE WHEN turn % 5 = 1 AND conv_id % 2 = 0 THEN 'Điều ' || turn END AS ma, nullif(regexp_extract(line, '^(Chương \\d+)', 1), '') AS hc, nullif(regexp_extract(line, '^(Điều \\d+[a-zđ]?)\\.', 1), '') AS ha FROM lines), c1 AS (SELECT *, last_value(coalesce(mc, hc) IGNORE NULLS) OVER (PARTITION BY source ORDER BY num, child_id ROWS UNBOUNDED PRECEDING) AS chapter FROM kids), c2 AS (SELECT *, coalesce((lag(chapter) OVER (PARTITION BY source ORDER BY num, child_id) <> chapter)::INTEGER, 0) AS turned FROM c1), c3 AS (SELECT *, sum(turned) OVER (PARTITION BY source ORDER BY num, child_id ROWS UNBOUNDED PRECEDING) AS run FROM c2), c4 AS (SELECT *, last_value(coalesce(ma, ha) IGNORE NULLS) OVER (PARTITION BY source, run ORDER BY num, child_id ROWS UNBOUNDED PRECEDING) AS article FROM c3), res AS (SELECT *, CASE WHEN ma IS NOT NULL THEN 'metadata' WHEN ha IS NOT NULL THEN 'heading_inferred' WHEN article IS NOT NULL THEN 'carried_forward' ELSE 'document_fallback' END AS method FROM c4), kids2 AS (SELECT *, coalesce(mc <> hc, false) OR coalesce(ma <> ha, false) OR method IN ('carried_forward', 'document_fallback') AS ambiguous FROM res)"
#: the tree of the lines: level, live path of slugs
_TREE = _LINES + ", t1 AS (SELECT conv_id, turn AS at, line, CASE WHEN regexp_matches(line, '^Chương \\d+') THEN 'chuong' WHEN regexp_matches(line, '^Điều \\d+\\.') THEN 'dieu' END AS major FROM lines), t2 AS (SELECT *, last_value(major IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'dieu' AS inside FROM t1), t3 AS (SELECT conv_id, at, coalesce(major, CASE WHEN inside AND regexp_matches(line, '^(\\d{1,2})\\.\\s+\\S') THEN 'khoan' WHEN inside AND regexp_matches(lower(line), '^([a-zđ]{1,2})\\)\\s+\\S') THEN 'diem' END, 'doan') AS level FROM t2), t4 AS (SELECT *, " + ", ".join(f"last_value(CASE WHEN level = '{x}' THEN at END IGNORE NULLS) OVER w AS a{i}, count(CASE WHEN level = '{x}' THEN 1 END) OVER w AS n{i}" for i, x in enumerate(("chuong", "dieu", "khoan", "diem"))) + ", count(CASE WHEN level = 'doan' THEN 1 END) OVER w AS nl FROM t3 WINDOW w AS (PARTITION BY conv_id ORDER BY at ROWS UNBOUNDED PRECEDING)), t5 AS (SELECT *, CASE level WHEN 'chuong' THEN 0 WHEN 'dieu' THEN 1 WHEN 'khoan' THEN 2 WHEN 'diem' THEN 3 ELSE 9 END AS rk FROM t4), t6 AS (SELECT conv_id, at, level, list_filter([CASE WHEN a0 IS NOT NULL THEN 'chuong' || n0 END, CASE WHEN rk >= 1 AND a1 > coalesce(a0, -1) THEN 'dieu' || n1 END, CASE WHEN rk >= 2 AND a2 > greatest(coalesce(a0, -1), coalesce(a1, -1)) THEN 'khoan' || n2 END, CASE WHEN rk >= 3 AND a3 > greatest(coalesce(a0, -1), coalesce(a1, -1), coalesce(a2, -1)) THEN 'diem' || n3 END, CASE WHEN rk = 9 THEN 'doan' || nl END], lambda x: x IS NOT NULL) AS path FROM t5), tree AS (SELECT conv_id, at AS order_index, level, substr(sha1(conv_id || '::' || array_to_string(path, '/')), 1, 16) AS chunk_id, CASE WHEN len(path) > 1 THEN substr(sha1(conv_id || '::' || array_to_string(path[1:len(path) - 1], '/')), 1, 16) END AS parent_id, len(path) = 1 AS document_fallback FROM t6)"
_DIACRITICS = validation.DIACRITIC

QUERIES = {
    f.__name__: f
    for f in (
        chunk_fixed, chunk_stats, chunk_semantic, page_lookup, heading_path, chunk_hierarchical, article_split, dedupe_longest, split_clauses, carry_forward, parent_windows, giant_windows, parent_build, parent_score,
        child_to_parent, context_budget, context_expansion, html_title, html_text, html_blocks, html_tree, tree_integrity, ancestor_root, next_links, next_chain, chunk_validation, page_errors, null_profile,
        duplicate_keys, group_counts, catalog, key_overlap, round_robin_pick, unique_headings, seeded_sample, variant_filter, citation_labels, citation_build, stable_ids, numeric_suffix_order, last_question, hierarchy_refresh, hierarchy_status, fingerprint,
        legal_refs, normalize_dedupe, display_fields,
    )
}

ORACLES = {
    "chunk_fixed": f"WITH {_FIXED} SELECT doc_id, n, start, e AS \"end\", md5(piece) AS digest FROM fixed",
    "chunk_stats": f"WITH {_FIXED} SELECT 'fixed-size' AS strategy, count(*) AS n_chunks, min(length(piece)) AS min_length, max(length(piece)) AS max_length, round(avg(length(piece)), 4) AS mean_length FROM fixed",
    "chunk_semantic": "WITH p AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n+'), lambda x: regexp_matches(x, '\\S')), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS p FROM documents), m AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN length(x[1]) < 20 THEN list_append(a[1:len(a) - 1], a[len(a)] || chr(10) || chr(10) || x[1]) ELSE list_append(a, x[1]) END) AS p FROM p WHERE len(p) > 0), g AS (SELECT doc_id, p, "
    + _GREEDY.format(lens=_AS_STRUCT.format(list="p"), most=1000, gap=0)
    + " AS gs FROM m), e AS (SELECT doc_id, unnest(p) AS x, unnest(gs) AS n, unnest(range(len(p))) AS at FROM g), j AS (SELECT doc_id, n, string_agg(x, chr(10) || chr(10) ORDER BY at) AS t FROM e GROUP BY ALL) SELECT doc_id, n::INTEGER AS n, length(t) AS length, md5(t) AS digest FROM j",
    "page_lookup": "WITH s AS (SELECT conv_id, turn, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 2 AS start, sum(length(text) + 2) OVER (PARTITION BY conv_id) AS total FROM conversations), o AS (SELECT conv_id, unnest(range(0, any_value(total)::BIGINT - 2, 97)) AS o FROM s GROUP BY conv_id) SELECT o.conv_id, o.o::INTEGER AS \"offset\", max(turn) AS page FROM o JOIN s ON s.conv_id = o.conv_id AND s.start <= o.o GROUP BY o.conv_id, o.o",
    "heading_path": f"WITH {_LEVELS} SELECT conv_id, at, level, path FROM paths",
    "chunk_hierarchical": f"WITH {_LEVELS}, g AS (SELECT *, count(level) OVER (PARTITION BY conv_id ORDER BY at ROWS UNBOUNDED PRECEDING) AS n, count(level) OVER (PARTITION BY conv_id) AS most FROM paths), c AS (SELECT conv_id, n, any_value(most) AS most, min_by(path, at) AS path, length(regexp_replace(string_agg(line, chr(10) ORDER BY at), '^\\s+|\\s+$', '', 'g')) AS length FROM g GROUP BY conv_id, n) SELECT conv_id, greatest(n, 1) AS n, CASE WHEN n > 0 THEN path END AS path, n > 0 AS detected, length FROM c WHERE (n > 0 OR most = 0) AND length > 0",
    "article_split": f"WITH {_LINES}, a AS (SELECT conv_id, turn, CASE WHEN regexp_matches(line, '^Chương \\d+') AND length(line) < 200 THEN trim(line) END AS ch, nullif(regexp_extract(line, '^Điều (\\d+[a-z]?)\\s*[.:]', 1), '') AS art, line FROM lines), b AS (SELECT *, last_value(ch IGNORE NULLS) OVER w AS chapter, count(art) OVER w AS block FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)), c AS (SELECT conv_id, block, min_by(coalesce(art, ''), turn) AS article, CASE WHEN block = 0 THEN '' ELSE coalesce(min_by(coalesce(chapter, ''), turn), '') END AS chapter, length(trim(string_agg(trim(line), chr(10) ORDER BY turn))) AS length FROM b GROUP BY conv_id, block) SELECT * FROM c WHERE block > 0 OR length >= 40",
    "dedupe_longest": "WITH b AS (SELECT source, (doc_id % 10)::VARCHAR AS article, doc_id AS seq, length(text) AS length FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, article ORDER BY length DESC, seq) AS r, min(seq) OVER (PARTITION BY source, article) AS f FROM b) SELECT source, article, f AS seq, length FROM r WHERE r = 1",
    "carry_forward": f"WITH {_CHILDREN} SELECT source, child_id, chapter, article, method, ambiguous FROM kids2",
    "parent_windows": "WITH g AS (SELECT conv_id, list(turn ORDER BY turn) AS ts, list({'g': 0::BIGINT, 'u': 0::BIGINT, 'n': length(text)::BIGINT, 'gs': []::BIGINT[]} ORDER BY turn) AS xs FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, ts, " + _GREEDY.format(lens="xs", most=600, gap=2) + " AS gs FROM g) SELECT conv_id, unnest(ts) AS turn, unnest(gs)::INTEGER AS \"window\" FROM w",
    "giant_windows": "WITH RECURSIVE n AS (SELECT doc_id, coalesce(length(text), 0) + 2 AS s, row_number() OVER (ORDER BY doc_id) AS i FROM documents), c AS MATERIALIZED (SELECT doc_id, i, s, sum(s) OVER (ORDER BY i)::BIGINT AS p FROM n), nxt AS MATERIALIZED (SELECT a.i, greatest(b.i, a.i + 1) AS t FROM (SELECT i, (p - s + 20002)::BIGINT AS v FROM c) a ASOF JOIN c b ON a.v < b.p), st AS (SELECT 1::BIGINT AS i UNION ALL SELECT t FROM st JOIN nxt USING (i)) SELECT doc_id, sum((st.i IS NOT NULL)::INTEGER) OVER (ORDER BY c.i)::BIGINT AS \"window\" FROM c LEFT JOIN st ON st.i = c.i",
    "parent_build": f"WITH {_CHILDREN}, k AS (SELECT *, CASE WHEN article IS NOT NULL THEN concat_ws(' > ', chapter, article) ELSE coalesce(nullif(concat_ws(' > ', chapter), ''), '[document:' || source || ']') || ' [fallback]' END AS article_key FROM kids2), g AS (SELECT source, article_key, list(num ORDER BY num) AS ts, list({{'g': 0::BIGINT, 'u': 0::BIGINT, 'n': length(line)::BIGINT, 'gs': []::BIGINT[]}} ORDER BY num) AS xs FROM k GROUP BY ALL), w AS (SELECT source, article_key, unnest(ts) AS num, unnest({_GREEDY.format(lens='xs', most=1500, gap=2)}) AS win FROM g) SELECT source, article_key, win::INTEGER AS \"window\", count(*)::INTEGER AS n_children, (sum(length(line)) + 2 * (count(*) - 1))::INTEGER AS char_count, min(turn) AS page_start, max(turn) AS page_end, count(*) FILTER (ambiguous) AS n_ambiguous FROM k JOIN w USING (source, article_key, num) GROUP BY source, article_key, win",
    "parent_score": f"WITH {_SCORED} SELECT question_id, parent_id, round(score, 9) AS score, best_child_rank, anchor, n_children, parent_rank FROM scored",
    "child_to_parent": f"WITH {_HITS} SELECT question_id, child_id, parent_id, rank FROM hits",
    "context_budget": f"WITH RECURSIVE {_SCORED}, sz AS (SELECT conv_id AS parent_id, sum(length(text) + 2)::BIGINT AS char_count FROM conversations GROUP BY conv_id), c AS (SELECT * FROM scored JOIN sz USING (parent_id)), f AS (SELECT question_id, parent_id, parent_rank, char_count, true AS selected, char_count AS used FROM c WHERE parent_rank = 1 UNION ALL SELECT c.question_id, c.parent_id, c.parent_rank, c.char_count, f.used + c.char_count <= 4000, CASE WHEN f.used + c.char_count <= 4000 THEN f.used + c.char_count ELSE f.used END FROM f JOIN c ON c.question_id = f.question_id AND c.parent_rank = f.parent_rank + 1) SELECT question_id, parent_id, parent_rank, char_count, selected FROM f",
    "context_expansion": f"WITH {_HITS}, p AS (SELECT question_id, parent_id, sum(size) AS child FROM hits GROUP BY ALL), s AS (SELECT conv_id AS parent_id, sum(length(text)) AS context FROM conversations GROUP BY conv_id) SELECT question_id, round(sum(context) / nullif(sum(child), 0), 6) AS expansion FROM p JOIN s USING (parent_id) GROUP BY question_id",
    "html_title": "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, NULL::VARCHAR AS meta_id FROM pages",
    "html_tree": f"WITH {_TREE} SELECT * FROM tree",
    "tree_integrity": f"WITH {_TREE}, d AS (SELECT count(*) AS duplicate_ids FROM (SELECT chunk_id FROM tree GROUP BY chunk_id HAVING count(*) > 1)), u AS (SELECT chunk_id AS p, any_value(conv_id) AS pg, any_value(order_index) AS po FROM tree GROUP BY chunk_id) SELECT count(*) AS n_nodes, count(*) FILTER (parent_id IS NOT NULL AND pg IS NULL) AS missing_parents, count(*) FILTER (pg <> conv_id) AS foreign_parents, count(*) FILTER (po >= order_index) AS late_parents, (SELECT duplicate_ids FROM d) AS duplicate_ids FROM tree LEFT JOIN u ON u.p = tree.parent_id",
    "ancestor_root": f"WITH RECURSIVE {_TREE}, up AS (SELECT chunk_id, chunk_id AS root, 0 AS depth FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.chunk_id, up.root, up.depth + 1 FROM tree t JOIN up ON t.parent_id = up.chunk_id) SELECT chunk_id, root, depth FROM up",
    "next_links": "SELECT conv_id, turn AS src, nx AS dst FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) WHERE nx IS NOT NULL",
    "next_chain": "WITH l AS (SELECT conv_id, turn, " + ", ".join(f"lead(turn, {k}) OVER w AS d{k}" for k in range(1, 5)) + " FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) " + " UNION ALL ".join(f"SELECT conv_id, turn AS src, {k}::INTEGER AS steps, d{k} AS dst FROM l WHERE d{k} IS NOT NULL" for k in range(1, 5)),
    "chunk_validation": "SELECT concat_ws(',', CASE WHEN turn % 7 = 3 THEN 'chunk_id' END, CASE WHEN role IS NULL OR trim(role) = '' THEN 'source' END, CASE WHEN turn % 3 = 2 THEN 'strategy' END, CASE WHEN turn < 1 THEN 'page_start' END, CASE WHEN (CASE WHEN turn % 4 = 2 THEN 0 ELSE turn END) < turn THEN 'page_order' END) AS faults, count(*) AS n FROM conversations GROUP BY 1",
    "page_errors": f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'empty' WHEN NOT regexp_matches(text, '\\S') THEN 'empty' ELSE concat_ws(',', CASE WHEN doc_id % 10 = 1 THEN 'control' END, CASE WHEN length(b) >= 200 AND len(regexp_extract_all(b, '{_DIACRITICS}')) / length(b) < 0.01 THEN 'diacritics' END) END AS faults FROM (SELECT doc_id, text, CASE WHEN doc_id % 10 = 1 THEN regexp_replace(text, '^\\s+', '') || repeat(chr(1), length(text)::INTEGER) ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS b FROM documents)",
    "null_profile": "WITH c AS (SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS n_blank, count(DISTINCT {c}) AS n_distinct FROM c" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "duplicate_keys": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "group_counts": " UNION ALL ".join(f"SELECT '{w}' AS what, {c} AS value, count(*) AS n FROM {t} GROUP BY {c}" for w, t, c in (("source", "documents", "source"), ("lang", "documents", "lang"), ("role", "conversations", "role"), ("event", "events", "event_type"))),
    "catalog": "SELECT source, count(*) AS n, min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang, min_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY source",
    "key_overlap": "SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS \"both\", count(*) FILTER (l.doc_id IS NULL) AS only_first, count(*) FILTER (d.doc_id IS NULL) AS only_second FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id",
    "round_robin_pick": "SELECT source, doc_id, round FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents) ORDER BY round, source, doc_id LIMIT 24",
    "unique_headings": "WITH h AS (SELECT doc_id, lower(regexp_replace(regexp_extract(text, '^([^\\n]*)', 1), '[.:]+\\s*$', '')) AS heading FROM documents) SELECT min(doc_id) AS doc_id, heading FROM h WHERE length(heading) BETWEEN 12 AND 110 GROUP BY heading HAVING count(*) = 1",
    "citation_labels": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'E1,E2' ELSE 'E1' END AS cited, CASE WHEN item_id % 2 = 0 THEN 'E9' ELSE 'E2,E9' END AS unknown, length(trim(regexp_replace(text || CASE WHEN item_id % 2 = 0 THEN ' [E1] and [E2] or  [E1]' ELSE ' [E1] and  or  [E1]' END, '\\s+', ' ', 'g'))) AS n_chars FROM benchmark",
    "citation_build": "SELECT doc_id, concat_ws(' | ', 'Doc ' || doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'No ' || doc_id END, CASE WHEN doc_id % 2 = 0 THEN 'Điều ' || (doc_id % 9) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' khoản 2' END END, 'c' || doc_id) AS citation FROM documents",
    "stable_ids": "SELECT doc_id, 'P_' || substr(sha256(source || '||' || lang || '||1'), 1, 16) AS parent_id, substr(sha1(source || '::' || lang), 1, 16) AS tree_id, source || '_D' || (doc_id % 5) || CASE WHEN doc_id % 2 = 0 THEN 'K3' ELSE '' END || '_' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE substr(sha1(lang), 1, 12) END AS document_id FROM documents",
    "hierarchy_status": f"WITH {_CHILDREN} SELECT DISTINCT source, CASE WHEN source % 10 = 1 THEN 'missing' WHEN source % 10 IN (2, 5, 8) THEN 'stale' ELSE 'ready' END AS state FROM kids2",
    "last_question": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN conv_id * 1000 + turn END IGNORE NULLS) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations",
    "numeric_suffix_order": "SELECT doc_id, row_number() OVER (ORDER BY doc_id % 9 = 0, CASE WHEN doc_id % 9 <> 0 THEN doc_id * 7919 % 10007 END, doc_id)::INTEGER AS place FROM documents",
    "fingerprint": "SELECT count(*) AS n_rows, sum(('0x' || substr(h, 1, 12))::BIGINT)::HUGEINT::VARCHAR AS digest_a, sum(('0x' || substr(h, 13, 12))::BIGINT)::HUGEINT::VARCHAR AS digest_b FROM (SELECT sha256(doc_id || ':' || length(text)) AS h FROM documents)",
    "legal_refs": "WITH t AS (SELECT doc_id, lower(text || ' theo Điều  ' || (doc_id % 20) || 'a, khoản ' || (doc_id % 4) || ' và điều 3 điểm b.') AS t FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(t, 'điều\\s+\\d+[a-zđ]?'), regexp_extract_all(t, 'khoản\\s+\\d+'), regexp_extract_all(t, 'điểm\\s+[a-zđ]')), lambda r: regexp_replace(r, '\\s+', ' ', 'g')))), ',') AS refs FROM t",
    "normalize_dedupe": "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents",
    "display_fields": "SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(substr(text, 1, 80)) || '...' ELSE text END AS snippet, CASE WHEN doc_id % 2 = 0 THEN 'p. ' || (doc_id % 5) ELSE 'p. ' || (doc_id % 5) || '-' || (doc_id % 5 + 1) END AS pages, CASE WHEN doc_id % 7 > doc_id % 4 THEN '↑' || (doc_id % 7 - doc_id % 4) WHEN doc_id % 7 < doc_id % 4 THEN '↓' || (doc_id % 4 - doc_id % 7) ELSE '=' END AS arrow FROM documents",
    "variant_filter": "WITH o AS (SELECT conv_id, text AS q FROM conversations WHERE turn = 0), v AS (SELECT c.conv_id, turn, q, CASE WHEN turn = 1 THEN q WHEN turn % 3 = 0 THEN 'điều 99' ELSE text END AS t FROM conversations c JOIN o USING (conv_id) WHERE turn > 0), n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS k, trim(regexp_replace(regexp_replace(lower(q), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS kq FROM v), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS first FROM n), s AS (SELECT conv_id, turn, CASE WHEN length(trim(t)) NOT BETWEEN 5 AND 400 THEN 'length' WHEN k = kq OR first > 1 THEN 'duplicate' WHEN t = 'điều 99' THEN 'invented_reference' END AS status FROM f) SELECT conv_id, turn, coalesce(status, CASE WHEN sum((status IS NULL)::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) > 2 THEN 'surplus' ELSE 'accepted' END) AS status FROM s",
}

ORACLES["hierarchy_refresh"] = ORACLES["parent_build"]  # the store holds what a whole build gives
# "at" is a keyword in DuckDB
for _name in ("chunk_semantic", "heading_path", "chunk_hierarchical", "html_tree", "tree_integrity", "ancestor_root"):
    ORACLES[_name] = re.sub(r"\bat\b", '"at"', ORACLES[_name])
