"""Registered graph queries: nations, customers, suppliers, orders and parts as nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import store
from ..sources.tables import table
from . import search


def _edges(spark, sf) -> DataFrame:
    """Customers and suppliers to nations, nations to regions."""
    part = lambda t, p, a, q, b, kind: table(spark, sf, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"), F.lit(kind).alias("kind"))
    return part("customer", "c", "c_custkey", "n", "c_nationkey", "LIVES").unionByName(part("supplier", "s", "s_suppkey", "n", "s_nationkey", "SITS")).unionByName(part("nation", "n", "n_nationkey", "r", "n_regionkey", "PART_OF"))


def entity_union(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return graph.union_entities(c, s, p)


def orphan_edges(spark, sf):
    edges = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("src"), F.col("o_orderkey").alias("dst"), F.lit("PLACED").alias("kind"))
    return graph.orphan_edges(edges, table(spark, sf, "customer"), table(spark, sf, "lineitem").select("l_orderkey").distinct(), "c_custkey", "l_orderkey").groupBy("missing").agg(F.count("*").alias("n"))


def uncovered_nodes(spark, sf):
    edges = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.when(F.col("o_totalprice") > 250000, "LARGE").otherwise("OF").alias("kind"))
    return graph.uncovered(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name"), edges, "LARGE")


def two_edge_paths(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("dst"))
    order = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.two_edge_paths(line, order).groupBy("a", "b").agg(F.count("*").alias("n"))


def multi_hop(spark, sf):
    seeds = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seed"))
    return graph.neighbour_counts(_edges(spark, sf), seeds, 3)


def min_hop_dedupe(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 200).alias("chunk_id"), (F.col("l_linenumber") - 1).alias("hop"), F.round(F.col("l_discount") + F.col("l_orderkey") / 1e7, 9).alias("score"))
    return graph.nearest_only(rows, ["chunk_id"], "hop", "score")


def graph_hints(spark, sf):
    hits = table(spark, sf, "orders").select((F.col("o_orderkey") % 20).alias("query_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc"), F.col("o_orderkey").alias("rank"))
    edges = _edges(spark, sf).unionByName(table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, "CONTAINS").otherwise("PLACED").alias("kind")))
    return graph.graph_hints(hits, edges, "query_id", "doc", "rank", 5, 3)


def node_upsert(spark, sf):
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name"))
    return graph.merge_nodes(known, new, "id")


def edge_upsert(spark, sf):
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")).union(table(spark, sf, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    known = _edges(spark, sf).filter("kind = 'PART_OF'")
    return graph.merge_edges(known, _edges(spark, sf).filter("kind <> 'PART_OF'"), nodes, ["LIVES", "SITS"]).select("src", "dst", "kind")


def property_set(spark, sf):
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("role"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 40).alias("id"), F.lit("SUPPLIER").alias("role"))
    return graph.set_property(known, new, "id", "role")


def tenant_delete(spark, sf):
    return graph.delete_tenant(table(spark, sf, "documents").select("doc_id", "source"), "source", "src3")


def keyed_store(spark, sf):
    """Documents as a keyed store: an upsert, a property set on known and new keys, and a tenant that goes, each rewriting its buckets only."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n"), F.lit("old").alias("role"))
    path = store.fresh_folder(spark, "keyed")
    store.save({"rows": (d, "doc_id", "source", ())}, path)
    again = d.filter("source LIKE '%2' AND doc_id % 5 = 0").withColumn("n", F.col("n") + 1)
    more = d.filter("source LIKE '%2' AND doc_id % 5 = 1").withColumn("doc_id", -F.col("doc_id"))
    store.upsert(spark, path, "rows", again.unionByName(more))
    store.upsert(spark, path, "rows", d.filter("source LIKE '%2'").select("doc_id", "source", F.lit("new").alias("role")), only=["role"])
    store.delete(spark, path, "rows", F.col("source") == "src3")
    return store.load(spark, path, "rows").select("doc_id", "source", "n", "role")


def wiki_pages(spark, sf):
    entities = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("").alias("note")).unionByName(table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("note")))
    pages = graph.entity_pages(entities, _edges(spark, sf).filter("kind = 'PART_OF'"), "id", "name", ["note"])
    return pages.select("id", F.md5("page").alias("digest"), graph.frontmatter_id(F.col("page")).alias("front_id"))


def wiki_faults(spark, sf):
    pages = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("page"), F.concat(F.lit("[[n"), (F.col("n_nationkey") * 2).cast("string"), F.lit("|x]] [[missing"), (F.col("n_nationkey") % 3).cast("string"), F.lit("]]")).alias("text"))
    return graph.wiki_faults(pages, "page", "text")


def context_search(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    direct = search.dense.cosine_top_k(v, q, "vec_id", "query_id", "embedding", 5)
    chunks = v.select("vec_id", F.col("label").alias("doc"))
    edges = chunks.select(F.col("doc").alias("src"), (F.col("doc") + 1).alias("dst")).distinct().filter("dst % 4 <> 0")
    direct = store.spill(direct.select("query_id", "vec_id", "similarity"), "direct")
    nearest = lambda pairs, k: search.dense.cosine_top_k_within(v.withColumnRenamed("label", "doc"), pairs, q, "vec_id", "query_id", "doc", "embedding", k)
    found = search.expand_context(direct, chunks, edges, "query_id", "vec_id", "doc", nearest, 2, 2)
    return found.select("query_id", "vec_id", "doc", "hop", "similarity")


_E = "edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'LIVES' AS kind FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'SITS' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF' FROM nation)"

QUERIES = {f.__name__: f for f in (entity_union, orphan_edges, uncovered_nodes, two_edge_paths, multi_hop, min_hop_dedupe, graph_hints, node_upsert, edge_upsert, property_set, tenant_delete, keyed_store, wiki_pages, wiki_faults, context_search)}

ORACLES = {
    "entity_union": "SELECT c_custkey AS id, 'customer' AS kind, c_name AS name, c_mktsegment AS segment, '' AS brand FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_name, '', '' FROM supplier UNION ALL SELECT p_partkey, 'part', p_name, '', p_brand FROM part",
    "orphan_edges": "SELECT 'source' AS missing, count(*) AS n FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0 UNION ALL SELECT 'target', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0",
    "uncovered_nodes": "SELECT c_custkey AS id, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "two_edge_paths": "SELECT l_suppkey AS a, o_custkey AS b, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL",
    "multi_hop": f"WITH RECURSIVE {_E}, both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT 's' || s_suppkey AS seed, 's' || s_suppkey AS node, 0 AS hop FROM supplier UNION SELECT seed, b, hop + 1 FROM walk JOIN both_ ON node = a WHERE hop < 3), least_ AS (SELECT seed, node, min(hop) AS hop FROM walk GROUP BY ALL) SELECT seed, hop, count(*) AS n FROM least_ WHERE hop > 0 GROUP BY ALL",
    "min_hop_dedupe": "WITH r AS (SELECT l_partkey % 200 AS chunk_id, l_linenumber - 1 AS hop, round(l_discount + l_orderkey / 1e7, 9) AS score FROM lineitem) SELECT chunk_id, hop, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY hop, score DESC) AS r FROM r) WHERE r = 1",
    "graph_hints": f"WITH {_E}, e AS (SELECT * FROM edges UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'CONTAINS' ELSE 'PLACED' END FROM orders), b AS (SELECT o_orderkey % 20 AS query_id, 'c' || o_custkey AS doc, min(o_orderkey) AS best FROM orders GROUP BY ALL), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, doc) AS r FROM b) WHERE r <= 5) SELECT * FROM (SELECT query_id, doc, kind, dst, row_number() OVER (PARTITION BY query_id, doc ORDER BY kind, dst) AS n FROM t JOIN e ON e.src = t.doc WHERE kind <> 'CONTAINS') WHERE n <= 3",
    "node_upsert": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier) UNION ALL SELECT s_suppkey * 3, s_name FROM supplier",
    "edge_upsert": f"WITH {_E}, nodes AS (SELECT 'c' || c_custkey AS id FROM customer UNION SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 20) SELECT DISTINCT src, dst, kind FROM edges WHERE kind = 'PART_OF' OR (src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))",
    "property_set": "SELECT coalesce(c_custkey, s_suppkey * 40) AS id, CASE WHEN s_suppkey IS NOT NULL THEN 'SUPPLIER' ELSE c_mktsegment END AS role FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 40",
    "tenant_delete": "SELECT doc_id, source FROM documents WHERE source <> 'src3' OR source IS NULL",
    "keyed_store": "WITH d AS (SELECT doc_id, source, length(text) AS n, coalesce(source LIKE '%2', false) AS hit FROM documents) SELECT doc_id, source, (n + CASE WHEN hit AND doc_id % 5 = 0 THEN 1 ELSE 0 END)::INTEGER AS n, CASE WHEN hit THEN 'new' ELSE 'old' END AS role FROM d WHERE source IS DISTINCT FROM 'src3' UNION ALL SELECT -doc_id, source, n::INTEGER, 'old' FROM d WHERE hit AND doc_id % 5 = 1",
    "wiki_pages": "WITH e AS (SELECT 'n' || n_nationkey AS id, n_name AS name, 'Chua co du lieu.' AS note, '- PART_OF: [[r' || r_regionkey || '|' || r_name || ']]' AS links FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name, 'region', 'Chua co du lieu.' FROM region) SELECT id, md5(concat_ws(chr(10), '---', 'id: ' || id, '---', '# ' || name, '**note**: ' || note, '## Links', links)) AS digest, id AS front_id FROM e",
    "wiki_faults": "WITH l AS (SELECT 'n' || n_nationkey AS page, unnest(['n' || (n_nationkey * 2), 'missing' || (n_nationkey % 3)]) AS target FROM nation), p AS (SELECT 'n' || n_nationkey AS page FROM nation) SELECT 'broken_link' AS fault, page, target FROM l WHERE target NOT IN (SELECT page FROM p) UNION ALL SELECT 'orphan_page', page, NULL FROM p WHERE page NOT IN (SELECT target FROM l)",
    "context_search": "WITH RECURSIVE s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label AS doc, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)), d AS (SELECT * FROM n WHERE rank <= 5), e AS (SELECT DISTINCT label AS a, label + 1 AS b FROM embeddings WHERE (label + 1) % 4 <> 0), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT DISTINCT query_id, doc AS node, 0 AS hop FROM d UNION SELECT query_id, b.b, hop + 1 FROM w JOIN b ON node = b.a WHERE hop < 2), m AS (SELECT query_id, node AS doc, min(hop) AS hop FROM w GROUP BY ALL HAVING min(hop) > 0), f AS (SELECT * FROM (SELECT n.query_id, n.vec_id, n.doc, m.hop, n.similarity, row_number() OVER (PARTITION BY n.query_id, n.doc ORDER BY similarity DESC, vec_id) AS r FROM n JOIN m ON m.query_id = n.query_id AND m.doc = n.doc) WHERE r <= 2) SELECT query_id, vec_id, doc, 0 AS hop, similarity FROM d UNION ALL SELECT query_id, vec_id, doc, hop, similarity FROM f",
}
