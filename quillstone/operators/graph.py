"""Property graphs as node and edge tables: integrity, paths, bounded expansion, upserts and pages.

Nodes: id and properties. Edges: src, dst, kind and properties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import store
from . import scan


def union_entities(*tables: DataFrame) -> DataFrame:
    """Rows of tables with different columns; what a table lacks is empty text (null for other types)."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return both.select(*(F.coalesce(c, F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in both.dtypes))


def orphan_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, source_id: str = "id", target_id: str = "id") -> DataFrame:
    """Edges whose source or target is missing, with the side that is."""
    no_src = edges.join(sources.select(F.col(source_id).alias("src")), "src", "left_anti").withColumn("missing", F.lit("source"))
    no_dst = edges.join(targets.select(F.col(target_id).alias("dst")), "dst", "left_anti").withColumn("missing", F.lit("target"))
    return no_src.unionByName(no_dst)


def uncovered(nodes: DataFrame, edges: DataFrame, kind: str | None = None, end: str = "dst", node_id: str = "id") -> DataFrame:
    """Nodes without an edge (of a kind) at that end."""
    own = edges.filter(F.col("kind") == kind) if kind else edges
    return nodes.join(own.select(F.col(end).alias(node_id)), node_id, "left_anti")


def two_edge_paths(first: DataFrame, second: DataFrame) -> DataFrame:
    """a, via, b: edges of the first kind that end where edges of the second begin."""
    return first.select(F.col("src").alias("a"), F.col("dst").alias("via")).join(second.select(F.col("src").alias("via"), F.col("dst").alias("b")), "via").select("a", "via", "b")


def cut(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage: written to the shared folder and read again."""
    return store.spill(df, "graph")


#: Seeds of a block: the bits of one number. Seeds are dealt to blocks by hash, at this fill on average.
BITS, FILL = 64, 48


def numbered(seeds: DataFrame, seed: str) -> DataFrame:
    """seed, block, bit: every distinct seed a bit of its own. Numbers are given within hash groups, so no task sees all seeds."""
    own = seeds.select(F.col(seed).alias("seed")).distinct()
    groups = max(1, -(-own.count() // FILL))
    group = F.pmod(F.xxhash64("seed"), F.lit(groups))
    placed = own.withColumn("g", group).withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("seed")) - 1)
    over = F.floor(F.col("n") / BITS).cast("long")  # a group of more seeds than bits goes on in further blocks
    return placed.select("seed", (F.col("g") + over * groups).alias("block"), (F.col("n") % BITS).cast("int").alias("bit"))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int, seed: str = "seed") -> DataFrame:
    """seed, node, hop: nodes within so many edges, either way, at their least distance; the seed itself is left out.

    The frontier holds a row for each node and block of seeds, whose bits say which of them have just come there: joins and
    shuffles grow with nodes, not with pairs. Bits become pairs in the result only.
    """
    both = edges.select(F.col("src").alias("__a"), F.col("dst").alias("node")).union(edges.select("dst", "src")).distinct()
    numbers = cut(numbered(seeds, seed))
    pairs = _reached(both, numbers, hops).select("node", "block", "hop", F.explode(_on()).alias("bit"))
    return pairs.join(numbers, ["block", "bit"]).select(F.col("seed").alias(seed), "node", "hop")


def _on() -> Column:
    """The bits of a row that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.bit_get(F.col("bits"), i) == 1)


def _reached(both: DataFrame, numbers: DataFrame, hops: int) -> DataFrame:
    """node, block, bits, hop: which seeds of a block come to a node at that distance, 1 at least. both: __a, node; numbers: seed, block, bit."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    frontier = cut(numbers.groupBy(F.col("seed").alias("node"), "block").agg(F.bit_or(one).alias("bits")).withColumn("hop", F.lit(0)))
    reached = frontier
    for hop in range(1, hops + 1):
        step = frontier.select(F.col("node").alias("__a"), "block", "bits").join(both, "__a").groupBy("node", "block").agg(F.bit_or("bits").alias("bits"))
        known = reached.groupBy("node", "block").agg(F.bit_or("bits").alias("known"))
        new = step.join(known, ["node", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long")))))
        frontier = cut(new.filter("bits <> 0").select("node", "block", "bits", F.lit(hop).alias("hop")))
        reached = reached.unionByName(frontier)
    return reached.filter("hop > 0")


#: Nodes of at most so many neighbours are compared by them.
FEW = 8
#: Stands for an end that is null: it is come to, but nothing is reached from it.
_NOWHERE = "\0"


def neighbour_counts(edges: DataFrame, seeds: DataFrame, hops: int, seed: str = "seed") -> DataFrame:
    """seed, hop, n: how many nodes lie at that least distance from each seed, either way; the counts of `neighbours`, without its pairs.

    Nodes of the same few neighbours are as far from every other node, and two edges from each other: they are one node of a smaller
    graph, with a weight. The search goes over that graph from the seeds' classes alone; counts are sums of weights, added up before
    anything but them is shuffled. Leaves of hubs, however many, cost one node a hub.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NOWHERE))
    ends = edges.select(named("src").alias("__a"), named("dst").alias("node"))
    both = ends.union(ends.select("node", "__a")).filter(F.col("__a") != F.col("node")).filter(F.col("__a") != _NOWHERE).distinct()
    both = cut(both)
    few = both.groupBy("__a").agg(F.count("*").alias("n")).filter(F.col("n") <= FEW).select("__a")
    alike = both.join(few, "__a").groupBy("__a").agg(F.sort_array(F.collect_list("node")).alias("near"))  # at most FEW each
    alike = cut(alike)
    classes = cut(alike.groupBy("near").agg(F.min("__a").alias("class"), F.count("*").alias("weight")))
    # joined by a few groups of any size: one row each on the right side
    members = cut(alike.join(classes.filter("weight > 1"), "near").select(F.col("__a").alias("node"), "class"))
    of = lambda df, c, name: df.join(members.select(F.col("node").alias(c), F.col("class").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    small = of(of(both, "__a", "__from"), "node", "__to").select(F.col("__from").alias("__a"), F.col("__to").alias("node")).distinct()
    small = cut(small)
    asked = seeds.select(F.col(seed)).distinct().withColumn("__a", F.col(seed).cast("string")).filter(F.col("__a").isNotNull())
    asked = cut(of(asked, "__a", "__from").select(seed, F.col("__from").alias("class")))
    numbers = cut(numbered(asked, "class"))
    heavy = classes.filter("weight > 1").select(F.col("class").alias("node"), "weight")
    met = _reached(small, numbers, hops).join(heavy, "node", "left").select("block", "hop", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), F.explode(_on()).alias("bit"))
    counted = met.groupBy("block", "bit", "hop").agg(F.sum("weight").alias("n")).join(numbers, ["block", "bit"]).select(F.col("seed").alias("class"), "hop", "n")
    # the other nodes of a seed's own class, by way of a neighbour that leads on
    own = classes.filter("weight > 1").filter(F.exists("near", lambda x: x != _NOWHERE)).select("class", F.lit(2).alias("hop"), (F.col("weight") - 1).alias("n"))
    every = counted.unionByName(own).filter(F.col("hop") <= hops).groupBy("class", "hop").agg(F.sum("n").alias("n"))
    return asked.join(every, "class").select(seed, "hop", "n")


def ancestors(nodes: DataFrame, node_id: str, parent: str, most: int = 32) -> DataFrame:
    """Each node with its root and depth; a chain longer than `most` keeps a null root. Pointer doubling: log2(most) joins."""
    up = nodes.select(F.col(node_id).alias("id"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"))
    up = up.withColumn("up", F.coalesce("up", "id"))
    for _ in range(max(1, (most - 1).bit_length())):
        next_up = up.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"))
        up = cut(up.join(next_up, "up", "left").select("id", F.coalesce("__up", "up").alias("up"), (F.col("depth") + F.when(F.col("up") == F.col("id"), 0).otherwise(F.coalesce("__depth", F.lit(0)))).alias("depth")))
    roots = nodes.filter(F.col(parent).isNull()).select(F.col(node_id).alias("root"))
    return up.join(roots, F.col("up") == F.col("root"), "left").select(F.col("id").alias(node_id), "root", "depth")


def nearest_only(rows: DataFrame, keys: list[str], hop: str, score: str) -> DataFrame:
    """One row per key: least hop, then best score; order hop, score down."""
    w = W.partitionBy(*keys).orderBy(hop, F.col(score).desc())
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def next_links(rows: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """src, dst: each row and the next of its group."""
    w = W.partitionBy(*group).orderBy(order)
    return rows.withColumn("__next", F.lead(key).over(w)).filter(F.col("__next").isNotNull()).select(*group, F.col(key).alias("src"), F.col("__next").alias("dst"))


def next_chain(rows: DataFrame, group: list[str], order: str, key: str, most: int = 4) -> DataFrame:
    """src, dst, steps: what follows within so many links."""
    w = W.partitionBy(*group).orderBy(order)
    led = rows.select(*group, F.col(key).alias("src"), *(F.lead(key, k).over(w).alias(f"__{k}") for k in range(1, most + 1)))
    ahead = F.array_compact(F.array(*(F.when(F.col(f"__{k}").isNotNull(), F.struct(F.lit(k).alias("steps"), F.col(f"__{k}").alias("dst"))) for k in range(1, most + 1))))
    return led.select(*group, "src", F.inline(ahead))


def tree_integrity(nodes: DataFrame, group: str, key: str, parent: str, order: str, text: str | None = None) -> DataFrame:
    """One row of counts that must be 0: duplicate ids, missing parents, parents in another document, parents after children, and with a text column blank texts."""
    own = nodes.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(parent).alias("p"), F.col(order).alias("o"))
    up = own.select(F.col("k").alias("p"), F.col("g").alias("pg"), F.col("o").alias("po"), F.lit(True).alias("known"))
    joined = own.join(up.dropDuplicates(["p"]), "p", "left")
    duplicates = own.groupBy("k").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    links = joined.agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("p").isNotNull() & F.col("known").isNull()).alias("missing_parents"),
        F.count_if(F.col("pg") != F.col("g")).alias("foreign_parents"), F.count_if(F.col("po") >= F.col("o")).alias("late_parents"),
    )
    blank = nodes.agg(F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("blank_texts")) if text else None
    return links.crossJoin(duplicates).crossJoin(blank) if text else links.crossJoin(duplicates)  # one row each


def graph_hints(hits: DataFrame, edges: DataFrame, query_key: str, doc: str, rank: str, documents: int = 5, relations: int = 25, without: str = "CONTAINS") -> DataFrame:
    """For the first documents of a query's hits their outgoing relations but one kind, so many each."""
    first = hits.groupBy(query_key, doc).agg(F.min(rank).alias("__best"))
    top = first.withColumn("__r", F.row_number().over(W.partitionBy(query_key).orderBy("__best", doc))).filter(F.col("__r") <= documents)
    out = top.join(edges.filter(F.col("kind") != without).select(F.col("src").alias(doc), "kind", "dst"), doc)
    w = W.partitionBy(query_key, doc).orderBy("kind", "dst")
    return out.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= relations).select(query_key, doc, "kind", "dst", "n")


def merge_nodes(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of new replace those of the same key; of several new ones the greatest by all columns."""
    w = W.partitionBy(key).orderBy(*(F.col(c).desc() for c in new.columns if c != key))
    once = new.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return known.join(once.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)


def merge_edges(known: DataFrame, new: DataFrame, nodes: DataFrame, kinds: list[str], node_id: str = "id") -> DataFrame:
    """Upsert of edges of known kinds whose ends exist; an unknown kind is an error when rows are read."""
    checked = new.withColumn("kind", F.when(F.col("kind").isin(kinds), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown relation: "), F.coalesce("kind", F.lit("null"))))))
    ends = nodes.select(node_id)
    real = checked.join(ends.select(F.col(node_id).alias("src")), "src", "left_semi").join(ends.select(F.col(node_id).alias("dst")), "dst", "left_semi")
    return known.unionByName(real, allowMissingColumns=True).dropDuplicates(["src", "dst", "kind"])


def set_property(known: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Set a property on known nodes and create those that are missing."""
    given = new.select(key, F.col(column).alias("__new"))
    return known.join(given, key, "full_outer").withColumn(column, F.coalesce("__new", column)).drop("__new")


def delete_tenant(rows: DataFrame, tenant: str, value: str) -> DataFrame:
    """All rows but one tenant's; a null tenant stays."""
    return rows.filter(~F.col(tenant).eqNullSafe(F.lit(value)))


def entity_pages(entities: DataFrame, edges: DataFrame, key: str, name: str, fields: list[str], empty: str = "Chua co du lieu.") -> DataFrame:
    """One Markdown page per entity: its fields and links [[id|name]] to what it points to; blanks say that there is nothing."""
    ends = entities.select(F.col(key).alias("dst"), F.col(name).alias("__name"))
    links = edges.join(ends, "dst").groupBy(F.col("src").alias(key)).agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "kind", F.lit(": [["), F.col("dst").cast("string"), F.lit("|"), "__name", F.lit("]]")))).alias("__links"))
    said = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(empty)).otherwise(F.col(c).cast("string"))
    body = [F.concat(F.lit(f"**{c}**: "), said(c)) for c in fields]
    rows = entities.join(links, key, "left")
    listed = F.coalesce(F.array_join("__links", "\n"), F.lit(empty))
    page = F.concat_ws("\n", F.concat(F.lit("---\nid: "), F.col(key).cast("string"), F.lit("\n---\n# "), said(name)), *body, F.lit("## Links"), listed)
    return rows.select(key, page.alias("page"))


def page_links(pages: DataFrame, key: str, text: str) -> DataFrame:
    """src, target of each wiki link."""
    return pages.select(F.col(key).alias("src"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))).alias("target"))


def frontmatter_id(c: Column) -> Column:
    """The id line of a page's front matter."""
    return F.nullif(F.regexp_extract(c, r"(?m)\A---\s*\n(?:.*\n)*?id:\s*(\S+)", 1), F.lit(""))


def wiki_faults(pages: DataFrame, key: str, text: str, home: str = "Home") -> DataFrame:
    """fault, page, target: links to no page; pages to which no page but the home page links."""
    links = page_links(pages, key, text)
    names = pages.select(F.col(key).cast("string").alias("target"))
    broken = links.join(names, "target", "left_anti").select(F.lit("broken_link").alias("fault"), F.col("src").cast("string").alias("page"), "target")
    linked = links.filter(F.col("src").cast("string") != home).select("target").distinct()
    orphan = names.filter(F.col("target") != home).join(linked, "target", "left_anti").select(F.lit("orphan_page").alias("fault"), F.col("target").alias("page"), F.lit(None).cast("string").alias("target"))
    return broken.unionByName(orphan)


def unverified(edges: DataFrame, status: str = "status") -> DataFrame:
    """Edges whose status is known and not VERIFIED (an unknown one is not compared)."""
    return edges.filter(F.col(status) != "VERIFIED")


def trusted(edges: DataFrame, status: str = "status") -> DataFrame:
    """Edges that are verified; those without a status count as verified."""
    return edges.filter(F.coalesce(F.col(status), F.lit("VERIFIED")) == "VERIFIED")


def in_force(rows: DataFrame, status: str, expired: str, include_history: bool = False) -> DataFrame:
    """Rows that have not expired, or all with the history; without a status a row is left out unless the history is asked for."""
    return rows if include_history else rows.filter(F.col(status) != expired)


def linked_from(edges: DataFrame, nodes: DataFrame, targets: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """For each of the given target nodes the nodes that an edge of that kind leads from, numbered in order.

    edges: src, dst, kind and properties; nodes: node and properties; targets: dst.
    """
    met = edges.filter(F.col("kind") == kind).join(targets.select("dst").distinct(), "dst").join(nodes.withColumnRenamed("node", "src"), "src")
    return met.withColumn("place", F.row_number().over(W.partitionBy("dst").orderBy(*order)))


def first_rows(rows: DataFrame, number: str, key: str, limit: int) -> DataFrame:
    """The first rows by a number kept as text (none or no number: 0 and null), then key: a top-k, not a sort of all rows."""
    return rows.orderBy(F.expr(f"try_cast(coalesce(`{number}`, '0') AS BIGINT)").asc_nulls_last(), key).limit(limit)


def review_queue(edges: DataFrame) -> DataFrame:
    """Proposed edges, the most confident first; a kind of any number of edges spreads over tasks."""
    proposed = edges.filter(F.col("status") == "PROPOSED")
    down = F.coalesce(-F.col("confidence"), F.lit(float("-inf")))  # nulls first
    return scan.numbers(proposed, [F.col("kind")], [down, F.col("src"), F.col("dst")], "place")


def wiki_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (nodes or edges), kind and count; a kind of null counts all edges."""
    by_kind = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "kind", "n")
    edge = edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "kind", "n")
    return by_kind.unionByName(edge).unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.lit(None).cast("string").alias("kind"), "n"))


def secure_children(edges: DataFrame, nodes: DataFrame, roles: list[str], limit: int = 200) -> DataFrame:
    """src, dst of parent-child edges whose child the roles may see: its own roles, else its parent's, else none; the first `limit` by id."""
    from .rbac import overlaps, validate_roles

    own = nodes.select(F.col("node").alias("dst"), F.col("roles").alias("__child"))
    up = nodes.select(F.col("node").alias("src"), F.col("roles").alias("__parent"))
    met = edges.join(own, "dst").join(up, "src").withColumn("__roles", F.coalesce("__child", "__parent", F.array().cast("array<string>")))
    return met.filter(overlaps(F.col("__roles"), validate_roles(roles))).select("src", "dst").orderBy("src", "dst").limit(limit)


class GraphSession:
    """Named queries over node and edge tables, as a graph server's session would run them: name -> function(nodes, edges, parameters)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, catalogue: dict):
        self.nodes, self.edges, self.catalogue = nodes, edges, dict(catalogue)

    def run(self, name: str, **parameters) -> DataFrame:
        if name not in self.catalogue:
            raise ValueError(f"unknown query: {name}")
        return self.catalogue[name](self.nodes, self.edges, **parameters)
