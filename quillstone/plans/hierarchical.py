"""Answers from chunks or from their parents, for one query of a question or for several: all questions and modes in one plan.

The modes share one retrieval; their candidates are scored by one pass of the reranker. What a mode can't give is a status, never a
missing row: every question has a row in every mode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokenize_code
from ..operators import fusion, hierarchy, rerank
from ..sources import store
from . import search
from .retrieval import _CODE, _corpus, fused_sql

#: mode: (several queries, by parents)
MODES = {"single_flat": (False, False), "multi_flat": (True, False), "single_parent": (False, True), "multi_parent": (True, True)}
PARENT_MODES = [m for m, (_, by_parent) in MODES.items() if by_parent]


def units(hits: DataFrame, variants: DataFrame, chunks: DataFrame, parents: DataFrame | None, question: str, query: str, key: str, cfg: search.SearchConfig) -> DataFrame:
    """mode, question, unit, rank, text, ambiguous: each mode's candidates for reranking, the first `rerank_candidates` of them.

    hits: query, key, fused_rank; variants: question, query (the least is the question itself); chunks: key, parent_id, text;
    parents: parent_id, text, ambiguous, or None where the hierarchy is not built: the parent modes then have no candidates.
    """
    hits = store.spill(hits.join(variants, query).select(question, query, key, "fused_rank"), "hits")  # questions times candidates; four modes read it
    own = variants.groupBy(question).agg(F.min(query).alias(query))
    single = hits.join(own, [question, query], "left_semi").select(question, key, F.col("fused_rank").alias("rank"))
    multi = fusion.fuse_queries(hits, question, query, key, k=cfg.rrf_k).select(question, key, F.col("multi_query_rank").alias("rank"))
    parts = []
    for mode, (many, by_parent) in MODES.items():
        found = multi if many else single
        if by_parent and parents is None:
            continue
        if by_parent:
            mapped = hierarchy.map_children(found, chunks, key)
            placed = hierarchy.score_parents(mapped, question, "parent_id", key, "rank", limit=cfg.parent_child_limit, k=cfg.rrf_k)
            first = placed.filter(F.col("parent_rank") <= cfg.rerank_candidates).select(question, "parent_id", F.col("parent_rank").alias("rank"))
            rows = first.join(parents, "parent_id").withColumnRenamed("parent_id", "unit")
        else:
            rows = found.filter(F.col("rank") <= cfg.rerank_candidates).join(chunks.select(F.col(key), "text"), key).withColumnRenamed(key, "unit").withColumn("ambiguous", F.lit(False))
        parts.append(rows.select(F.lit(mode).alias("mode"), question, F.col("unit").cast("string").alias("unit"), "rank", "text", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous")))
    return reduce(DataFrame.unionByName, parts)


def evidence(candidates: DataFrame, questions: DataFrame, question: str, score: Callable[[DataFrame], DataFrame], cfg: search.SearchConfig) -> DataFrame:
    """Every candidate with score, new_rank, rank_change, kept, selected, accepted, label, warned and lost.

    score adds `score` (0 to 1; null where the reranker gave none) to rows with question_text and text. A mode's question that lacks a
    score is lost: it shows nothing, rather than an order that only seems reranked. kept: the best top_k; selected: those that the
    context budget takes (parents only); accepted: selected and at the bound; warned: accepted, but its place was inferred.
    """
    by = ["mode", question]
    scored = score(candidates.join(questions.select(question, F.col("text").alias("question_text")), question))
    scored = scored.withColumn("lost", F.max(F.col("score").isNull()).over(W.partitionBy(*by)))
    order = W.partitionBy(*by).orderBy(F.round("score", fusion.RANK_DIGITS).desc_nulls_last(), "rank", "unit")
    ranked = scored.withColumn("new_rank", F.row_number().over(order)).withColumn("rank_change", F.col("rank") - F.col("new_rank"))
    ranked = ranked.withColumn("kept", (F.col("new_rank") <= cfg.top_k) & ~F.col("lost"))
    sized = ranked.select(*by, "unit", "new_rank", "kept", F.when(F.col("mode").isin(PARENT_MODES), F.length("text")).otherwise(0).alias("size")).filter("kept")
    taken = hierarchy.context_budget(sized, by, "unit", "new_rank", "size", cfg.context_max_chars).select(*by, "unit", "selected")
    rows = ranked.join(taken, [*by, "unit"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    rows = rows.withColumn("accepted", F.coalesce(F.col("selected") & (F.col("score") >= cfg.min_rerank_score), F.lit(False)))
    number = F.sum(F.col("accepted").cast("int")).over(W.partitionBy(*by).orderBy("new_rank").rowsBetween(W.unboundedPreceding, 0))
    letter = F.when(F.col("mode").isin(PARENT_MODES), "P").otherwise("E")
    rows = rows.withColumn("label", F.when(F.col("accepted"), F.concat(letter, number.cast("string"))))
    return rows.withColumn("warned", F.col("accepted") & F.col("ambiguous"))


def said(found: DataFrame, questions: DataFrame, question: str, answer: Callable[[str, list[tuple[str, str]]], str | None]) -> DataFrame:
    """mode, question, answer for the questions with accepted evidence alone: each asked once, in tasks. A failure or a blank answer is null."""
    kind = questions.schema[question].dataType.simpleString()
    parts = F.array_sort(F.collect_list(F.struct("new_rank", "label", "text")))
    packed = found.filter("accepted").groupBy("mode", question).agg(parts.alias("parts"))  # at most top_k units each
    asked = packed.join(questions.select(question, F.col("text").alias("__text")), question).select("mode", question, "__text", F.to_json("parts").alias("parts"))

    def ask(batches):
        import json

        for pdf in batches:
            out = []
            for mode, q, text, parts in zip(pdf["mode"], pdf[question], pdf["__text"], pdf["parts"], strict=True):
                try:
                    got = answer(text or "", [(p["label"], p.get("text") or "") for p in json.loads(parts)])
                except Exception:  # noqa: BLE001 - a call that fails leaves the evidence without an answer
                    got = None
                out.append((mode, q, got if got and got.strip() else None))
            yield pd.DataFrame(out, columns=["mode", question, "answer"])

    return asked.mapInPandas(ask, f"mode string, `{question}` {kind}, answer string")


def answered(found: DataFrame, questions: DataFrame, variants: DataFrame, question: str, answers: DataFrame, built: bool = True) -> DataFrame:
    """mode, question, status, n_reranked, n_accepted, context_chars, labels, dropped, answer, citations, warnings of every question in every mode.

    status: hierarchy_not_ready, reranker_unavailable, insufficient_evidence (nothing passed the gate; no model is asked), retrieval_only
    (no answer, or nothing of it is left without labels that don't exist) or answered. dropped: units that the budget left out.
    """
    by = ["mode", question]
    listed = lambda flag, value: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("new_rank", F.col(value).alias("v"))))), lambda x: x["v"])
    told = found.groupBy(*by).agg(
        F.count("*").alias("n_reranked"), F.count_if("accepted").alias("n_accepted"), F.max("lost").alias("lost"), F.max("warned").alias("warned"),
        F.coalesce(F.sum(F.when(F.col("selected"), F.length("text"))), F.lit(0)).alias("context_chars"), listed(F.col("accepted"), "label").alias("labels"), listed(F.col("kept") & ~F.col("selected"), "unit").alias("dropped"),
    )
    checked = rerank.citation_check(answers, found.select(*by, "label"), by, "answer")
    alone = variants.groupBy(question).agg((F.count("*") == 1).alias("alone"))
    grid = questions.select(question, F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    rows = grid.join(told, by, "left").join(checked, by, "left").join(alone, question, "left")
    clean = F.nullif(F.trim("clean_answer"), F.lit(""))
    parent, none = F.col("mode").isin(PARENT_MODES), F.array().cast("array<string>")
    n = F.coalesce("n_accepted", F.lit(0))
    status = F.when(parent & F.lit(not built), "hierarchy_not_ready").when(F.coalesce("lost", F.lit(False)), "reranker_unavailable").when(n == 0, "insufficient_evidence").when(clean.isNull(), "retrieval_only").otherwise("answered")
    rows = rows.withColumn("status", status)
    several = F.col("mode").isin([m for m, (many, _) in MODES.items() if many])
    notes = {
        "query_generation_unavailable": several & F.coalesce("alone", F.lit(True)),
        "over_budget": F.size("dropped") > 0,
        "inferred_place": F.col("warned"),
        "generation_failed": (F.col("status") == "retrieval_only") & F.col("answer").isNull(),
        "unknown_citations": F.size("unknown") > 0,
        "nothing_but_unknown_citations": (F.col("status") == "retrieval_only") & F.col("answer").isNotNull(),
    }
    warnings = F.array_compact(F.array(*(F.when(c, name) for name, c in notes.items())))
    done = F.col("status") == "answered"
    return rows.select(
        *by, "status", F.coalesce("n_reranked", F.lit(0)).alias("n_reranked"), n.alias("n_accepted"), F.coalesce("context_chars", F.lit(0)).alias("context_chars"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("dropped", none).alias("dropped"), F.when(done, clean).alias("answer"), F.when(done, F.col("cited")).otherwise(none).alias("citations"), warnings.alias("warnings"),
    )


def compared(found: DataFrame, question: str) -> DataFrame:
    """question, kind, unit and its new rank in every mode (null: not shown): retrieval and reranking alone, no model answers."""
    kind = F.when(F.col("mode").isin(PARENT_MODES), "parent").otherwise("child")
    return found.filter("selected").groupBy(question, kind.alias("kind"), "unit").pivot("mode", list(MODES)).agg(F.min("new_rank"))


#: Of the registered queries: four items are the queries of a question, two documents the children of a parent.
_CFG = search.SearchConfig(top_k=3, candidate_k=20, rerank_candidates=10, min_rerank_score=0.2, context_max_chars=9000, parent_max_chars=9000)
_QUERIES_OF, _CHILDREN_OF = 4, 2


def _overlap(rows: DataFrame) -> DataFrame:
    """Share of the question's words in the unit: a reranker that SQL can follow."""
    asked, held = F.array_distinct(tokenize_code(F.col("question_text"))), F.array_distinct(tokenize_code(F.col("text")))
    return rows.withColumn("score", F.coalesce(F.size(F.array_intersect(asked, held)) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0)))


def _quote(question: str, parts: list[tuple[str, str]]) -> str | None:
    """A stand-in model: cites all evidence and one label too many; it fails on questions whose length 5 divides and has nothing but a wrong label where 7 does."""
    if len(question) % 5 == 0:
        raise RuntimeError("no answer")
    if len(question) % 7 == 0:
        return "[E99]"
    return " ".join(f"Item [{label}]" for label, _ in parts) + " [E99]"


def _evidence(spark, sf):
    c = _corpus(spark, sf)
    variants = c.questions.select(F.floor(F.col("item_id") / _QUERIES_OF).alias("question_id"), "item_id")
    questions = c.questions.filter(F.col("item_id") % _QUERIES_OF == 0).select(F.floor(F.col("item_id") / _QUERIES_OF).alias("question_id"), "text")
    # a vector may stand without its document
    keys = c.chunks.join(c.vectors.select("doc_id"), "doc_id", "full_outer")
    chunks = keys.select("doc_id", F.floor(F.col("doc_id") / _CHILDREN_OF).alias("parent_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    parents = chunks.groupBy("parent_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"), (F.col("parent_id") % 3 == 0).alias("ambiguous"))
    hits = search.hybrid(c, _CFG).filter(F.col("fused_rank") <= _CFG.candidate_k)
    found = evidence(units(hits, variants, chunks, parents, "question_id", "item_id", "doc_id", _CFG), questions, "question_id", _overlap, _CFG)
    return store.spill(found, "evidence"), questions, variants


def hierarchical_answers(spark, sf):
    found, questions, variants = _evidence(spark, sf)
    out = answered(found, questions, variants, "question_id", said(found, questions, "question_id", _quote))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("question_id", "mode", "status", "n_reranked", "n_accepted", "context_chars", joined("labels"), joined("dropped"), "answer", joined("citations"), joined("warnings"))


def hierarchical_compare(spark, sf):
    return compared(_evidence(spark, sf)[0], "question_id")


QUERIES = {f.__name__: f for f in (hierarchical_answers, hierarchical_compare)}

_P = ", ".join(f"'{m}'" for m in PARENT_MODES)
_FOUND = f"""{fused_sql()}, hits AS (SELECT item_id // {_QUERIES_OF} AS qid, item_id, doc_id, fused_rank FROM fused WHERE fused_rank <= {_CFG.candidate_k}),
qs AS (SELECT item_id // {_QUERIES_OF} AS qid, text AS qt FROM benchmark WHERE item_id % {_QUERIES_OF} = 0),
multi AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, n DESC, b, doc_id) AS rank FROM (SELECT qid, doc_id, sum(1.0 / (60 + fused_rank)) AS s, count(*) AS n, min(fused_rank) AS b FROM hits GROUP BY ALL)),
kids AS (SELECT 'single' AS m, qid, doc_id, fused_rank AS rank FROM hits WHERE item_id % {_QUERIES_OF} = 0 UNION ALL SELECT 'multi', qid, doc_id, rank FROM multi),
pr AS (SELECT m, qid, doc_id // {_CHILDREN_OF} AS parent_id, sum(CASE WHEN r <= {_CFG.parent_child_limit} THEN 1.0 / (60 + rank) ELSE 0 END) AS s, min(rank) AS b FROM (SELECT *, row_number() OVER (PARTITION BY m, qid, doc_id // {_CHILDREN_OF} ORDER BY rank, doc_id) AS r FROM kids) GROUP BY ALL),
chunks AS (SELECT coalesce(doc_id, vec_id) AS doc_id, coalesce(text, '') AS text FROM documents FULL JOIN embeddings ON doc_id = vec_id),
par AS (SELECT doc_id // {_CHILDREN_OF} AS parent_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM chunks GROUP BY 1),
cand AS (SELECT m || '_flat' AS mode, qid, doc_id::VARCHAR AS unit, rank, text, false AS amb FROM kids JOIN chunks USING (doc_id) UNION ALL SELECT m || '_parent', qid, parent_id::VARCHAR, row_number() OVER (PARTITION BY m, qid ORDER BY round(s, 9) DESC, b, parent_id), text, parent_id % 3 = 0 FROM pr JOIN par USING (parent_id)),
sc AS (SELECT c.*, coalesce(len(list_intersect(list_distinct({_CODE.format(text="qt")}), list_distinct({_CODE.format(text="text")}))) / nullif(len(list_distinct({_CODE.format(text="qt")})), 0), 0) AS score FROM cand c JOIN qs USING (qid) WHERE rank <= {_CFG.rerank_candidates}),
rk AS MATERIALIZED (SELECT mode, qid, unit, amb, score, row_number() OVER (PARTITION BY mode, qid ORDER BY round(score, 9) DESC, rank, unit) AS nr, length(text) AS len FROM sc),
fold AS (SELECT mode, qid, unit, nr, len AS used, true AS sel FROM rk WHERE nr = 1 UNION ALL SELECT k.mode, k.qid, k.unit, k.nr, CASE WHEN f.used + k.len <= {_CFG.context_max_chars} THEN f.used + k.len ELSE f.used END, k.mode NOT IN ({_P}) OR f.used + k.len <= {_CFG.context_max_chars} FROM fold f JOIN rk k ON k.mode = f.mode AND k.qid = f.qid AND k.nr = f.nr + 1 WHERE k.nr <= {_CFG.top_k}),
ev AS (SELECT f.mode, f.qid, f.unit, f.nr, f.sel, k.len, k.amb, f.sel AND k.score >= {_CFG.min_rerank_score} AS acc FROM fold f JOIN rk k USING (mode, qid, unit))"""
_LABELLED = f"lab AS (SELECT *, CASE WHEN mode IN ({_P}) THEN 'P' ELSE 'E' END || sum(acc::INTEGER) OVER (PARTITION BY mode, qid ORDER BY nr)::BIGINT AS label FROM ev), per AS (SELECT mode, qid, count(*) FILTER (acc) AS n, coalesce(sum(len) FILTER (sel), 0)::BIGINT AS chars, coalesce(string_agg(label, ',' ORDER BY nr) FILTER (acc), '') AS labels, coalesce(string_agg(unit, ',' ORDER BY nr) FILTER (NOT sel), '') AS dropped, string_agg('Item [' || label || ']', ' ' ORDER BY nr) FILTER (acc) AS told, bool_or(acc AND amb) AS warned FROM lab GROUP BY ALL), nre AS (SELECT mode, qid, count(*) AS n_reranked FROM rk GROUP BY ALL), alone AS (SELECT item_id // {_QUERIES_OF} AS qid, count(*) = 1 AS alone FROM benchmark GROUP BY 1)"
ORACLES = {
    "hierarchical_answers": f"""WITH RECURSIVE {_FOUND}, {_LABELLED}, st AS (SELECT qid, mode, n_reranked, n, chars, labels, dropped, told, warned, alone, length(qt) % 5 = 0 AS failed, length(qt) % 7 = 0 AS odd, CASE WHEN n = 0 THEN 'insufficient_evidence' WHEN length(qt) % 5 = 0 OR length(qt) % 7 = 0 THEN 'retrieval_only' ELSE 'answered' END AS status FROM per JOIN qs USING (qid) JOIN nre USING (mode, qid) JOIN alone USING (qid))
SELECT qid AS question_id, mode, status, n_reranked, n AS n_accepted, chars AS context_chars, labels, dropped, CASE WHEN status = 'answered' THEN told END AS answer, CASE WHEN status = 'answered' THEN labels ELSE '' END AS citations,
concat_ws(',', CASE WHEN alone AND mode LIKE 'multi%' THEN 'query_generation_unavailable' END, CASE WHEN dropped <> '' THEN 'over_budget' END, CASE WHEN warned THEN 'inferred_place' END, CASE WHEN status = 'retrieval_only' AND failed THEN 'generation_failed' END, CASE WHEN n > 0 AND NOT failed THEN 'unknown_citations' END, CASE WHEN status = 'retrieval_only' AND NOT failed THEN 'nothing_but_unknown_citations' END) AS warnings FROM st""",
    "hierarchical_compare": f"WITH RECURSIVE {_FOUND} SELECT qid AS question_id, CASE WHEN mode IN ({_P}) THEN 'parent' ELSE 'child' END AS kind, unit, " + ", ".join(f"min(nr) FILTER (mode = '{m}') AS {m}" for m in MODES) + " FROM ev WHERE sel GROUP BY ALL",
}
