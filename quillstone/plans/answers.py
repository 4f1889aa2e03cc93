"""Registered queries of the composites: permitted search and its audit, evaluation, hierarchical modes, lookups, catalogues, graph questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, graph, metrics, rerank, validation
from ..sources.tables import table as _table
from . import search
from .documents import _HITS, _child_hits
from .indexes import tagged as _tagged
from .policy import _TAG
from .retrieval import _CODE, K, _corpus, _qrels, bm25_sql, cosine_sql, fused_sql, table

#: Questions of the registered permitted searches keep their ten best of thirty candidates.
_CFG = search.SearchConfig(top_k=10, candidate_k=30)


def _secured(spark, sf) -> search.Corpus:
    c = _corpus(spark, sf)
    return search.Corpus(_tagged(spark, sf), c.vectors, c.questions, c.query_vectors, index=c.index)


def secure_search(spark, sf):
    return search.secure_retrieve(_secured(spark, sf), "allowed", ["Staff"], "hybrid", _CFG).select("item_id", "doc_id", "rank", F.round("score", 8).alias("score"))


def secure_statistics(spark, sf):
    return search.secure_statistics(_secured(spark, sf), "allowed", ["Staff"], _CFG)


#: Roles of the audit: who must not see a restricted category, and who may.
_AUDIT = {"staff": ["Staff"], "hr": ["HR"], "guest": ["Guest"], "risk": ["Risk_Manager"]}


#: Words of an audit question: those that a document opens with.
_OPENING = 40


def _opening(text):
    return F.array_join(F.slice(F.split(text, " "), 1, _OPENING), " ")


def _audit_corpus(spark, sf) -> tuple[search.Corpus, DataFrame]:
    """(corpus, cases): of each restricted category the first five documents that have a vector; each is asked for with its own first words and its vector."""
    from pyspark.sql import Window as W

    c = _secured(spark, sf)
    rows = c.chunks.filter("category <> 'GENERAL'").join(c.vectors.select("doc_id"), "doc_id", "left_semi").select("doc_id", "category")
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy("doc_id"))).filter("r <= 5")
    hr = F.col("category") == "HR"
    cases = first.select(F.concat(F.lower("category"), F.lit("-"), F.col("r").cast("string")).alias("case"), F.col("doc_id").alias("item_id"), F.col("doc_id").alias("target"), F.when(hr, "staff").otherwise("guest").alias("outsider"), F.when(hr, "hr").otherwise("risk").alias("insider"))
    own = cases.select(F.col("target").alias("doc_id"))
    questions = c.chunks.join(F.broadcast(own), "doc_id").select(F.col("doc_id").alias("item_id"), _opening(F.col("text")).alias("text"))  # ten rows at most
    vectors = c.vectors.join(F.broadcast(own), "doc_id").withColumnRenamed("doc_id", "item_id")
    return search.Corpus(c.chunks, c.vectors, questions, vectors, index=c.index), cases


def leak_audit(spark, sf):
    c, cases = _audit_corpus(spark, sf)
    return search.leak_audit(c, "allowed", cases, _AUDIT, _CFG)


def internal_lookup(spark, sf):
    c = _secured(spark, sf)
    c = search.Corpus(c.chunks.withColumn("citation", F.concat(F.lit("c"), F.col("doc_id").cast("string"))), c.vectors, c.questions, c.query_vectors, index=c.index)
    answers, _ = search.internal_lookup(c, "allowed", ["Staff"], "citation", cfg=_CFG, method="bm25")
    return answers.select("item_id", F.md5("answer").alias("digest"), "n_evidence", "status")


def internal_lookup_denied(spark, sf):
    c = _secured(spark, sf)
    answers, events = search.internal_lookup(c, "allowed", ["Intruder"], "source")
    return answers.select("item_id", "answer", "n_evidence", "status").join(events.select(F.col("query").cast("long").alias("item_id"), F.size("retrieved_chunk_ids").alias("n_logged"), F.col("status").alias("logged")), "item_id")


def evaluate_modes(spark, sf):
    c = _corpus(spark, sf)
    cfg = search.SearchConfig(top_k=K)

    def broken(questions):
        raise RuntimeError("no model")

    def partly(questions):  # tells which questions it could not answer
        odd = questions.filter("item_id % 2 = 1").select("item_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("rank"), F.lit("timeout").alias("error"))
        rows = search.retrieve(c, "semantic", cfg).filter("item_id % 2 = 0").select("item_id", "doc_id", "rank", F.lit(None).cast("string").alias("error"))
        return rows.unionByName(odd).withColumn("latency_ms", F.col("item_id") * 2.0)

    modes = {m: lambda q, m=m: search.retrieve(c, m, cfg) for m in ("bm25", "semantic", "hybrid")}
    rows = metrics.evaluate(modes | {"broken": broken, "partly": partly}, c.questions, _qrels(spark, sf), "item_id", "doc_id", K)
    out = metrics.evaluation_summary(rows)
    told = F.when(F.col("mode") == "partly", F.col("p50_latency_ms"))  # the others' are this machine's
    return out.drop("mean_latency_ms").withColumn("p50_latency_ms", told)


def ask(spark, sf):
    out = search.ask(_corpus(spark, sf), search.SearchConfig(top_k=5, max_distance=0.75))
    return out.select("item_id", "n_accepted", "status", F.md5(F.coalesce("context", F.lit(""))).alias("digest"))


def index_status(spark, sf):
    return search.status(_corpus(spark, sf))


def rrf_by_id(spark, sf):
    c = _corpus(spark, sf)
    out = fusion.fuse_by_id(search.lexical(c, 20), search.semantic(c, 20), "item_id", "doc_id")
    return out.select("item_id", "doc_id", "rrf_score", "fused_rank")


def hierarchical_modes(spark, sf):
    c = _corpus(spark, sf)
    variants = c.questions.select(F.floor(F.col("item_id") / 4).alias("question_id"), "item_id")
    # a hundred ids stand for the children of a parent
    keys = c.chunks.select("doc_id", F.length("text").alias("n")).join(c.vectors.select("doc_id"), "doc_id", "full_outer")
    children = keys.select("doc_id", F.floor(F.col("doc_id") / 100).alias("parent_id"), F.least(F.coalesce("n", F.lit(100)), F.lit(1000)).alias("char_count"))
    parents = children.groupBy("parent_id").agg(F.least(F.sum("char_count"), F.lit(3000)).alias("char_count"))
    return search.hierarchical_modes(c, variants, children, parents, "question_id", search.SearchConfig(context_max_chars=6000)).select("question_id", "mode", "n_hits", "n_parents", "context_chars")


def _parents(spark, sf) -> DataFrame:
    t = _child_hits(spark, sf).groupBy("question_id", "parent_id").agg(F.min("rank").alias("best"), F.sum("size").cast("long").alias("char_count"))
    from pyspark.sql import Window as W

    ranked = t.withColumn("parent_rank", F.row_number().over(W.partitionBy("question_id").orderBy("best", "parent_id")))
    return ranked.withColumn("logit", ((F.col("parent_id") * 37) % 11 - 5) / 2.0).withColumn("ambiguous", F.col("parent_id") % 3 == 0)


def parent_rerank(spark, sf):
    out = rerank.rerank_parents(_parents(spark, sf), "question_id", "parent_id", "logit", 10)
    return out.select("question_id", "parent_id", "parent_rank", "parent_rerank_rank", "parent_rank_change", F.round("parent_rerank_score", 6).alias("score"))


def parent_gate(spark, sf):
    out = rerank.parent_gate(rerank.rerank_parents(_parents(spark, sf), "question_id", "parent_id", "logit", 10), 0.5)
    return out.groupBy("question_id").agg(F.count_if("accepted").alias("n_accepted"), F.max("warned").alias("warned"))


def final_parents(spark, sf):
    out = rerank.final_parents(_parents(spark, sf), "question_id", "parent_id", "logit", "char_count", 10, 5, 0.5, 1500)
    return out.select("question_id", "parent_id", "final_parent_rank", "selected")


def parent_support(spark, sf):
    from ..operators import hierarchy

    hits = _child_hits(spark, sf).withColumn("queries", F.array(F.concat(F.lit("q"), (F.col("child_id") % 3).cast("string"))))
    out = hierarchy.score_parents(hits, "question_id", "parent_id", "child_id", "rank", queries="queries")
    return out.select("question_id", "parent_id", F.array_join("support", ",").alias("support"), F.size("support").alias("n_support"))


def hit_lookup(spark, sf):
    hits = _child_hits(spark, sf).filter("rank <= 20").select("question_id", (F.col("child_id") - F.col("child_id") % 2 * 1000003).alias("child_id"), "rank")
    stored = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("child_id"), F.length("text").alias("n_chars"))
    return validation.in_hit_order(hits, stored, "question_id", "child_id", "rank").select("question_id", "child_id", "rank", "place", "n_chars")


def content_metadata(spark, sf):
    out = validation.with_metadata(_table(spark, sf, "documents").select("doc_id", "source"), _table(spark, sf, "labels"), "doc_id")
    return out.select("doc_id", "source", "quality", "toxic")


def index_text(spark, sf):
    d = table(spark, sf, "documents")
    number, title = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat((F.col("doc_id") % 50).cast("string"), F.lit("/2024"))), F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string")).otherwise("Title")
    return d.select("doc_id", F.md5(T.index_text([number, title], F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 9).cast("string")), F.coalesce("text", F.lit("")))).alias("digest"))


def running_sequence(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return validation.running_sequence(rows, "conv_id", ["turn"], "text", 40).select("conv_id", "turn", "seq")


def long_texts(spark, sf):
    return validation.long_texts(table(spark, sf, "documents"), "doc_id", "text")


def domain_catalog(spark, sf):
    d = _table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id")
    domains = d.select("source").distinct().filter(F.col("source").rlike("[0-6]$")).select("source", F.when(F.col("source").rlike("[02468]$"), "EVEN").otherwise("ODD").alias("domain"))
    return validation.domain_catalog(d, domains, "source", "domain")


def _edges(spark, sf) -> DataFrame:
    o = _table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 4 == 0, "VERIFIED").when(F.col("o_orderkey") % 4 == 1, "PROPOSED").when(F.col("o_orderkey") % 4 == 2, "REJECTED")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "MITIGATES").otherwise("OBSERVED_AS")
    return o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), kind.alias("kind"), status.alias("status"), F.round(F.col("o_totalprice"), 2).alias("confidence"))


def unverified_edges(spark, sf):
    return graph.unverified(_edges(spark, sf)).select("src", "dst", "kind", "status")


def trusted_edges(spark, sf):
    return graph.trusted(_edges(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


def in_force(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", "lang")
    return graph.in_force(d, "lang", "fr")


def risk_lookup(spark, sf):
    nodes = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("price"))
    targets = _table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("dst"))
    return graph.linked_from(_edges(spark, sf), nodes, targets, "MITIGATES", ["src"]).select("dst", "src", "status", "place")


def graph_order_limit(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 7 == 0, "x").otherwise((F.col("doc_id") % 13).cast("string")).alias("article"))
    return graph.first_rows(d, "article", "doc_id", 40)


def review_queue(spark, sf):
    return graph.review_queue(_edges(spark, sf)).select("kind", "src", "dst", "confidence", "place")


def wiki_totals(spark, sf):
    c, s = _table(spark, sf, "customer"), _table(spark, sf, "supplier")
    nodes = c.select(F.lit("customer").alias("kind")).unionByName(s.select(F.lit("supplier").alias("kind")))
    return graph.wiki_totals(nodes, _edges(spark, sf))


def _role_nodes(spark, sf) -> DataFrame:
    c = _table(spark, sf, "customer")
    roles = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("Admin"), F.lit("HR"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("Staff")))
    n = _table(spark, sf, "nation")
    up = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("HR")))
    return c.select((F.col("c_custkey") + 1000).alias("node"), roles.alias("roles")).unionByName(n.select(F.col("n_nationkey").cast("long").alias("node"), up.alias("roles")))


def secure_graph(spark, sf):
    edges = _table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") + 1000).alias("dst"))
    return graph.secure_children(edges, _role_nodes(spark, sf), ["HR"], 200)


def graph_session(spark, sf):
    session = graph.GraphSession(_role_nodes(spark, sf), _edges(spark, sf), {"unverified": lambda nodes, edges, kind: graph.unverified(edges).filter(F.col("kind") == kind)})
    return session.run("unverified", kind="MITIGATES").groupBy("status").agg(F.count("*").alias("n"))


def judge_means(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", (1 - F.col("l_discount")).alias("faithfulness"), (1 - F.col("l_tax")).alias("relevancy"))
    return metrics.judge_means(rows, ["l_returnflag", "l_linenumber"], ["faithfulness", "relevancy"])


QUERIES = {
    f.__name__: f
    for f in (
        secure_search, secure_statistics, leak_audit, internal_lookup, internal_lookup_denied, evaluate_modes, ask, index_status, rrf_by_id, hierarchical_modes, parent_rerank, parent_gate, final_parents, parent_support,
        hit_lookup, content_metadata, index_text, running_sequence, long_texts, domain_catalog, unverified_edges, trusted_edges, in_force, risk_lookup, graph_order_limit, review_queue, wiki_totals, secure_graph, graph_session, judge_means,
    )
}

def _leak_sql() -> str:
    """All views at once, every method, from the documents themselves."""
    views = ", ".join(f"('{v}', '{r[0]}')" for v, r in _AUDIT.items())
    return f"""WITH {_TAG}, views(view, role) AS (VALUES {views}),
vis AS MATERIALIZED (SELECT view, doc_id FROM tagged JOIN views ON list_contains(allowed, role)),
cases AS (SELECT lower(category) || '-' || r AS c, doc_id AS target, CASE category WHEN 'HR' THEN 'staff' ELSE 'guest' END AS outsider, CASE category WHEN 'HR' THEN 'hr' ELSE 'risk' END AS insider FROM (SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS r FROM tagged WHERE category <> 'GENERAL' AND doc_id IN (SELECT vec_id FROM embeddings)) WHERE r <= 5),
asks AS (SELECT DISTINCT unnest([outsider, insider]) AS view, target AS q FROM cases),
said AS (SELECT q, array_to_string(string_split(text, ' ')[1:{_OPENING}], ' ') AS text FROM (SELECT DISTINCT q FROM asks) JOIN documents ON doc_id = q),
asked AS (SELECT view, q, term, count(*) AS times FROM (SELECT q, unnest({_CODE.format(text="text")}) AS term FROM said) JOIN asks USING (q) GROUP BY ALL),
toks AS MATERIALIZED (SELECT doc_id, text, {_CODE.format(text="text")} AS t FROM documents),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
tot AS (SELECT view, count(*) AS n, avg(len(t)) AS av FROM vis JOIN toks USING (doc_id) GROUP BY view),
raw AS (SELECT view, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT view, term, count(*) AS df FROM vis JOIN post USING (doc_id) GROUP BY ALL) JOIN tot USING (view)),
idf AS MATERIALIZED (SELECT view, term, df, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY view) ELSE r END AS idf FROM raw),
lexs AS (SELECT a.view, a.q, p.doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / av))) AS score FROM asked a JOIN post p ON p.term = a.term JOIN vis ON vis.view = a.view AND vis.doc_id = p.doc_id JOIN idf ON idf.view = a.view AND idf.term = a.term JOIN tot ON tot.view = a.view GROUP BY ALL),
lex AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view, q ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lexs) WHERE rank <= 30 AND score > 0),
sims AS (SELECT view, q, v.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM asks JOIN embeddings e ON e.vec_id = q JOIN vis USING (view) JOIN embeddings v ON v.vec_id = vis.doc_id),
sem AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view, q ORDER BY similarity DESC, doc_id) AS rank FROM sims) WHERE rank <= 30),
fused AS (SELECT *, row_number() OVER (PARTITION BY view, q ORDER BY round(rrf, 9) DESC, doc_id) AS rank FROM (SELECT view, q, doc_id, coalesce(1.0 / (60 + l.rank), 0.0) + coalesce(1.0 / (60 + s.rank), 0.0) AS rrf FROM lex l FULL JOIN sem s USING (view, q, doc_id))),
cand AS (SELECT f.view, q, f.doc_id, rank AS fused_rank, c.text AS ct, c.t AS ctoks FROM fused f JOIN toks c ON c.doc_id = f.doc_id WHERE rank <= 30),
w AS (SELECT DISTINCT a.view, q, a.term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w FROM asked a JOIN tot ON tot.view = a.view LEFT JOIN idf ON idf.view = a.view AND idf.term = a.term),
cover AS (SELECT c.view, c.q, c.doc_id, sum(CASE WHEN p.doc_id IS NULL THEN 0 ELSE w END) / sum(w) AS c FROM cand c JOIN w ON w.view = c.view AND w.q = c.q LEFT JOIN post p ON p.doc_id = c.doc_id AND p.term = w.term GROUP BY ALL),
ph AS (SELECT q, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS p FROM (SELECT q, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS ws FROM said)),
re AS (SELECT view, q, doc_id, row_number() OVER (PARTITION BY view, q ORDER BY s DESC, fused_rank, doc_id) AS rank FROM (SELECT c.view, c.q, c.doc_id, fused_rank, round((coalesce(c, 0) + 0.3 * CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: contains(lower(ct), x))) / len(p) ELSE 0 END) / (1 + greatest(0, length(ct) - 2500) / 5000.0), 6) AS s FROM cand c JOIN cover ON cover.view = c.view AND cover.q = c.q AND cover.doc_id = c.doc_id JOIN ph ON ph.q = c.q)),
found AS (SELECT view, q, 'bm25' AS method, doc_id, rank FROM lex WHERE rank <= 10 UNION ALL SELECT view, q, 'dense', doc_id, rank FROM sem WHERE rank <= 10 UNION ALL SELECT view, q, 'hybrid', doc_id, rank FROM fused WHERE rank <= 10 UNION ALL SELECT view, q, 'hybrid_rerank', doc_id, rank FROM re WHERE rank <= 10)
SELECT c AS "case", m AS method, o.rank IS NOT NULL AS leaked, i.rank::INTEGER AS authorized_rank FROM cases, unnest(['bm25', 'dense', 'hybrid', 'hybrid_rerank']) u(m) LEFT JOIN found o ON o.view = outsider AND o.q = target AND o.doc_id = target AND o.method = m LEFT JOIN found i ON i.view = insider AND i.q = target AND i.doc_id = target AND i.method = m"""


_STAFF = f"{_TAG}, staff AS (SELECT * FROM tagged WHERE list_contains(allowed, 'Staff'))"
_STAFF_LEX = f"{_STAFF}, {bm25_sql(_CODE, docs='staff', fill=False, positive=True, k=30)}"
_STAFF_SEM = "ssimi AS (SELECT q.vec_id AS item_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM staff)), sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM ssimi) WHERE rank <= 30)"
_BY_ID = "both_ AS (SELECT item_id, doc_id, coalesce(1.0 / (60 + l.rank), 0.0) + coalesce(1.0 / (60 + s.rank), 0.0) AS rrf FROM lex l FULL JOIN sem s USING (item_id, doc_id)), fused AS (SELECT item_id, doc_id, round(rrf, 8) AS rrf_score, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 9) DESC, doc_id) AS fused_rank FROM both_)"
_EDGES = "edges AS (SELECT o_orderkey AS src, o_custkey AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 'MITIGATES' ELSE 'OBSERVED_AS' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'PROPOSED' WHEN 2 THEN 'REJECTED' END AS status, round(o_totalprice, 2) AS confidence FROM orders)"
_PARENTS = f"{_HITS}, pr AS (SELECT question_id, parent_id, min(rank) AS best, sum(size)::BIGINT AS char_count FROM hits GROUP BY ALL), par AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY best, parent_id) AS parent_rank, 1 / (1 + exp(-((parent_id * 37) % 11 - 5) / 2.0)) AS s, parent_id % 3 = 0 AS ambiguous FROM pr), rer AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 9) DESC, parent_rank, parent_id) AS rr FROM par WHERE parent_rank <= 10)"
_EVAL = f"""{fused_sql()}, rel AS (SELECT DISTINCT doc_id % (SELECT count(*) FROM benchmark) AS item_id, doc_id FROM labels WHERE quality = 1),
modes AS (SELECT item_id, doc_id, rank, 'bm25' AS mode FROM lex WHERE rank <= {K} UNION ALL SELECT item_id, doc_id, rank, 'semantic' FROM sem WHERE rank <= {K} UNION ALL SELECT item_id, doc_id, fused_rank, 'hybrid' FROM fused WHERE fused_rank <= {K}),
hit AS (SELECT mode, item_id, count(*) AS h, min(rank) AS f, sum(1.0 / log2(rank + 1)) AS dcg FROM modes JOIN rel USING (item_id, doc_id) GROUP BY ALL), n AS (SELECT item_id, count(*) AS n FROM rel GROUP BY item_id),
ideal AS (SELECT item_id, n, (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(n, {K}) + 1) t(i)) AS idcg FROM n),
per AS (SELECT m AS mode, b.item_id, CASE WHEN n IS NULL THEN 0.0 ELSE coalesce(h / n, 0.0) END AS recall, CASE WHEN n IS NULL THEN 0.0 ELSE coalesce(1.0 / f, 0.0) END AS mrr, CASE WHEN n IS NULL THEN 0.0 ELSE coalesce(dcg / idcg, 0.0) END AS ndcg FROM benchmark b CROSS JOIN (SELECT unnest(['bm25', 'semantic', 'hybrid']) AS m) LEFT JOIN ideal USING (item_id) LEFT JOIN hit ON hit.item_id = b.item_id AND hit.mode = m)"""

ORACLES = {
    "secure_search": f"WITH {_STAFF_LEX}, {_STAFF_SEM}, {_BY_ID} SELECT item_id, doc_id, fused_rank AS rank, rrf_score AS score FROM fused WHERE fused_rank <= 10",
    "secure_statistics": f"WITH {_TAG}, {bm25_sql(_CODE, fill=False, positive=True, k=30)}, r AS (SELECT item_id, count(*) FILTER (NOT list_contains(allowed, 'Staff')) AS n FROM lex JOIN tagged USING (doc_id) GROUP BY item_id), t AS (SELECT count(*) FILTER (list_contains(allowed, 'Staff')) AS v, count(*) FILTER (NOT list_contains(allowed, 'Staff')) AS h FROM tagged) SELECT item_id, coalesce(n, 0) AS n_rejected, v AS n_visible, h AS n_hidden FROM benchmark LEFT JOIN r USING (item_id), t",
    "leak_audit": _leak_sql(),
    "internal_lookup": f"WITH {_STAFF_LEX}, e AS (SELECT item_id, rank, replace(trim(text, ' '), chr(10), ' ') AS t, doc_id FROM lex JOIN documents USING (doc_id) WHERE rank <= 10), l AS (SELECT item_id, rank, '- [c' || doc_id || '] ' || CASE WHEN length(t) > 400 THEN rtrim(substr(t, 1, 400), ' ') || '...' ELSE t END AS line FROM e) SELECT item_id, md5(coalesce(string_agg(line, chr(10) ORDER BY rank), '{search.NO_CONTEXT}')) AS digest, count(line)::INTEGER AS n_evidence, 'SUCCESS' AS status FROM benchmark LEFT JOIN l USING (item_id) GROUP BY item_id",
    "internal_lookup_denied": f"SELECT item_id, '{search.NO_CONTEXT}' AS answer, 0 AS n_evidence, 'DENIED' AS status, 0 AS n_logged, 'DENIED' AS logged FROM benchmark",
    "evaluate_modes": f"WITH {_EVAL} SELECT mode, count(*) AS n_questions, 0 AS n_failed, round(avg(recall), 4) AS mean_recall, round(avg(mrr), 4) AS mean_mrr, round(avg(ndcg), 4) AS mean_ndcg, NULL::DOUBLE AS p50_latency_ms FROM per GROUP BY mode UNION ALL SELECT 'broken', count(*), count(*), NULL, NULL, NULL, NULL FROM benchmark UNION ALL SELECT 'partly', count(*), count(*) FILTER (item_id % 2 = 1), round(avg(recall) FILTER (item_id % 2 = 0), 4), round(avg(mrr) FILTER (item_id % 2 = 0), 4), round(avg(ndcg) FILTER (item_id % 2 = 0), 4), median(item_id * 2.0) FILTER (item_id % 2 = 0) FROM per WHERE mode = 'semantic'",
    "ask": f"WITH {cosine_sql(5)}, a AS (SELECT item_id, doc_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM sem WHERE round(1 - similarity, 6) <= 0.75), c AS (SELECT item_id, string_agg('[E' || n || '] ' || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM a JOIN documents USING (doc_id) GROUP BY item_id), k AS (SELECT item_id, count(*) AS n FROM a GROUP BY item_id) SELECT item_id, coalesce(n, 0) AS n_accepted, CASE WHEN n IS NULL THEN 'insufficient_evidence' ELSE 'retrieval_only' END AS status, md5(coalesce(context, '')) AS digest FROM benchmark LEFT JOIN k USING (item_id) LEFT JOIN c USING (item_id)",
    "index_status": "SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing",
    "rrf_by_id": f"WITH {bm25_sql(k=20)}, {cosine_sql(20)}, {_BY_ID} SELECT item_id, doc_id, rrf_score, fused_rank FROM fused",
    "parent_rerank": f"WITH {_PARENTS} SELECT question_id, parent_id, parent_rank, rr AS parent_rerank_rank, parent_rank - rr AS parent_rank_change, round(s, 6) AS score FROM rer",
    "parent_gate": f"WITH {_PARENTS} SELECT question_id, count(*) FILTER (s >= 0.5) AS n_accepted, bool_or(s >= 0.5 AND ambiguous) AS warned FROM rer GROUP BY question_id",
    "parent_support": f"WITH {_HITS}, r AS (SELECT question_id, parent_id, 'q' || child_id % 3 AS q, row_number() OVER (PARTITION BY question_id, parent_id ORDER BY rank, child_id) AS r FROM hits), f AS (SELECT question_id, parent_id, q, min(r) AS r FROM r GROUP BY ALL) SELECT question_id, parent_id, string_agg(q, ',' ORDER BY r) AS support, count(*)::INTEGER AS n_support FROM f GROUP BY ALL",
    "hit_lookup": f"WITH {_HITS}, h AS (SELECT question_id, child_id - child_id % 2 * 1000003 AS child_id, rank FROM hits WHERE rank <= 20) SELECT question_id, h.child_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place, length(text) AS n_chars FROM h JOIN conversations c ON c.conv_id * 100 + c.turn = h.child_id",
    "content_metadata": "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "index_text": "SELECT doc_id, md5(CASE WHEN h <> '' THEN h || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END) AS digest FROM (SELECT doc_id, text, concat_ws(' ', CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 50) || '/2024' END, CASE WHEN doc_id % 4 <> 0 THEN 'Title' END, CASE WHEN doc_id % 2 = 0 THEN 'Điều ' || (doc_id % 9) END) AS h FROM documents)",
    "running_sequence": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations WHERE length(trim(text, ' ')) >= 40",
    "long_texts": "SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) > 1536",
    "domain_catalog": "WITH d AS (SELECT coalesce(source, 'none') AS source, count(*) AS n FROM documents GROUP BY 1) SELECT CASE WHEN regexp_matches(source, '[0246]$') THEN 'EVEN' WHEN regexp_matches(source, '[135]$') THEN 'ODD' ELSE 'UNCLASSIFIED' END AS domain, count(*) AS n_documents, sum(n)::BIGINT AS n_chunks FROM d GROUP BY 1",
    "unverified_edges": f"WITH {_EDGES} SELECT src, dst, kind, status FROM edges WHERE status <> 'VERIFIED'",
    "trusted_edges": f"WITH {_EDGES} SELECT kind, count(*) AS n FROM edges WHERE coalesce(status, 'VERIFIED') = 'VERIFIED' GROUP BY kind",
    "in_force": "SELECT doc_id, lang FROM documents WHERE lang <> 'fr'",
    "risk_lookup": f"WITH {_EDGES} SELECT dst, src, status, row_number() OVER (PARTITION BY dst ORDER BY src) AS place FROM edges WHERE kind = 'MITIGATES' AND dst % 10 = 0 AND dst IN (SELECT c_custkey FROM customer)",
    "graph_order_limit": "SELECT doc_id, article FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'x' ELSE (doc_id % 13)::VARCHAR END AS article FROM documents) ORDER BY try_cast(coalesce(article, '0') AS BIGINT) ASC NULLS LAST, doc_id LIMIT 40",
    "review_queue": f"WITH {_EDGES} SELECT kind, src, dst, confidence, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, src, dst) AS place FROM edges WHERE status = 'PROPOSED'",
    "wiki_totals": f"WITH {_EDGES} SELECT 'nodes' AS what, 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'nodes', 'supplier', count(*) FROM supplier UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'edges', NULL, count(*) FROM edges",
    "secure_graph": "SELECT c_nationkey::BIGINT AS src, c_custkey + 1000 AS dst FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND c_nationkey % 2 = 0) ORDER BY 1, 2 LIMIT 200",
    "graph_session": f"WITH {_EDGES} SELECT status, count(*) AS n FROM edges WHERE status <> 'VERIFIED' AND kind = 'MITIGATES' GROUP BY status",
    "judge_means": "WITH m AS (SELECT l_returnflag, l_linenumber, 1 - l_discount AS f, 1 - l_tax AS r FROM lineitem), u AS (SELECT NULL AS \"by\", NULL AS value, f, r FROM m UNION ALL SELECT 'l_returnflag', l_returnflag, f, r FROM m UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, f, r FROM m) SELECT \"by\", value, count(*) AS n, round(avg(f), 4) AS mean_faithfulness, round(avg(r), 4) AS mean_relevancy FROM u GROUP BY ALL",
}
