"""Exact Jaccard self-join of documents by their sets of five-word shingles, and the components of its links.

A set holds the distinct runs of five consecutive words (lower-cased, split at white space); a text of one to four words is one
shingle. Two documents link when 100 * intersection >= 80 * union.

Equal sets are one class before anything is paired. A class whose shingles that no other class has are already more than a fifth
of its set can link with nothing and leaves; the count over a quarter of all shingles (chosen by hash) is enough to prove it for
most. The classes that stay order their shingles by document frequency among themselves, rarest first. Linked sets share a shingle
within their prefixes, the first size - ceil(0.8 * size) + 1; prefixes are joined on the shingle under three filters: length (sizes
within 0.8 of each other, which also cuts the join key into bands of size), position (what is left after the shared shingle must
suffice) and suffix (what is left, counted in eight hash classes, must suffice too).

A group of n copies that differ slightly would give n * n / 2 pairs. So in each prefix shingle's list every member first meets one
leader; a second round gives the members outside the leader's component another. Components follow; only pairs of different
components are left for the exact join, where the two rounds' similarities serve as pivots: Jaccard distance is a metric, so two
sets whose similarities to one leader differ by more than 0.2 can't link. A pair is verified once, on whole sets, in tasks that take a
leader's partners in salted parts. What is not pruned grows with the square of the sets that share a rare shingle, have like sizes
and still don't link; Spark splits such lists, none is cut.

A shingle is known by a 61-bit hash, a set by two 64-bit sums over its shingles' hashes.

Null and empty texts have empty sets, link with nothing and are components of their own. A row with a null id takes part; its
component is named by the smallest id in it, null if there is none. Repeated rows, and rows of one id with different texts, each
give a row. A very long text is one row of one task. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hasher, batches, chunks, materialize, mix, release
from .native_text import bounded, text_key
from .near_dedup import components

SHINGLE = 5
#: Two documents link at so many hundredths.
PERCENT = 80
#: One shingle in so many is counted to find classes that can't link.
SAMPLE = 4
#: Pairs of one leader that a task takes at once.
LEADER_PAIRS = 2000
#: Rounds in which lists meet one leader before the exact join.
ROUNDS = 2
#: A-Z lower-cased, ASCII white space as spaces, everything else kept.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))
_WORDS, _SHINGLES = Hasher(41), Hasher(42)
_SECOND = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list, n: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per chunk of texts: the first text's number, and each text's sorted distinct shingles."""
    for first, low, start, end, bound in chunks(texts, TABLE):
        words = _WORDS.words(low, start, end)
        at = np.arange(max(0, len(words) - n + 1))
        grams = _SHINGLES.spans(words, at, at + n)
        sets = []
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            own = grams[a : b - n + 1] if b - a >= n else _SHINGLES.spans(words, np.array([a]), np.array([b])) if b > a else grams[:0]
            sets.append(np.unique(own))
        yield first, sets


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of each set that do not depend on an order."""
    first, second = ([np.uint64(mix(own ^ x).sum(dtype=np.uint64)) for own in sets] for x in (np.uint64(0), _SECOND))
    return np.array(first, dtype=np.uint64).view(np.int64), np.array(second, dtype=np.uint64).view(np.int64)


def _sketch(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        for first, sets in shingle_sets(list(pdf["text"])):
            c1, c2 = set_keys(sets)
            own = pdf.iloc[first : first + len(sets)]
            yield pd.DataFrame({"id": own["id"].to_numpy(), "row": own["row"].to_numpy(), "n": [len(s) for s in sets], "c1": c1, "c2": c2}).astype({"n": "int64"}).assign(id=own["id"].array)


def _sampled(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        for _, sets in shingle_sets(list(pdf["text"])):
            c1, _ = set_keys(sets)
            picked = [s[s % np.uint64(SAMPLE) == 0] for s in sets]
            yield pd.DataFrame({"token": np.concatenate(picked).view(np.int64), "c1": np.repeat(c1, [len(s) for s in picked])})


def _own_sets(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, tokens of the rows whose text is their class's (a row key that two texts share does not count)."""
    for pdf in rows:
        for first, sets in shingle_sets(list(pdf["text"])):
            own = pdf.iloc[first : first + len(sets)]
            c1, c2 = set_keys(sets)
            same = (own["c1"].to_numpy() == c1) & (own["c2"].to_numpy() == c2)
            yield pd.DataFrame({"node": own["node"].to_numpy()[same], "copies": own["copies"].to_numpy()[same], "tokens": [s.view(np.int64) for s, ok in zip(sets, same, strict=True) if ok]})


def prefix_size(size: int) -> int:
    """How many of a set's first shingles a linked set must meet."""
    return size - -(-size * PERCENT // 100) + 1


def _prefixes(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefix postings: shared shingles in order of rarity within the prefix, their place, and what follows them in eight classes."""
    for pdf in rows:
        out = []
        for node, size, tokens in zip(pdf["node"].tolist(), pdf["size"].tolist(), pdf["tokens"], strict=True):
            tokens = np.asarray(tokens, dtype=np.int64)
            alone = size - len(tokens)  # shingles of this set alone come first
            take = min(len(tokens), prefix_size(size) - alone)
            if take > 0:
                kind = (tokens & 7).astype(np.int64)
                seen = np.zeros((take, 8), dtype=np.int64)
                seen[np.arange(take), kind[:take]] = 1
                after = np.minimum(np.bincount(kind, minlength=8) - np.cumsum(seen, axis=0), 255).astype(np.uint8)
                out.append(pd.DataFrame({"node": node, "token": tokens[:take], "size": size, "pos": alone + np.arange(take), "after": np.ascontiguousarray(after).view(np.int64).ravel()}))
        if out:
            yield pd.concat(out, ignore_index=True)


def may_link(x: str = "", y: str = "2") -> Column:
    """Length, position and suffix filter of two prefix postings that share a shingle; sound at the first one that they share."""
    c = lambda name, side: F.col(name + side)
    sizes = c("size", x) + c("size", y)
    length = (100 * c("size", x) >= PERCENT * c("size", y)) & (100 * c("size", y) >= PERCENT * c("size", x))
    # at least so much in common: 100 * i >= P * (sizes - i)
    enough = lambda common: common * (100 + PERCENT) >= PERCENT * sizes
    position = enough(F.least(c("size", x) - c("pos", x), c("size", y) - c("pos", y)))
    common = F.lit(1)
    for k in range(8):
        a, b = (F.shiftrightunsigned(c("after", s), 8 * k).bitwiseAND(255) for s in (x, y))
        common = common + F.when((a == 255) & (b == 255), F.least(c("size", x), c("size", y))).otherwise(F.least(a, b))  # 255: that many or more
    return length & position & enough(common)


def _verify(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by leader and part, the leader's own set first."""
    leader, held = None, None
    for pdf in rows:
        out = []
        for lead, node, member, tokens in zip(pdf["leader"].tolist(), pdf["node"].tolist(), pdf["member"].tolist(), pdf["tokens"], strict=True):
            if not member:
                leader, held = lead, np.asarray(tokens)
            elif leader == lead:
                both = len(np.intersect1d(held, np.asarray(tokens), assume_unique=True))
                out.append((lead, node, both, len(held) + len(tokens) - both))
            else:
                raise ValueError("a leader's set is missing")
        yield pd.DataFrame(out, columns=["leader", "node", "both", "either"]).astype("int64")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """leader, node, sim, linked of distinct (leader, node) pairs. A leader's set goes once to each salted part of its partners."""
    parts = pairs.groupBy("leader").agg(F.count("*").alias("n")).select("leader", F.ceil(F.col("n") / LEADER_PAIRS).cast("int").alias("parts"))
    salted = pairs.join(parts, "leader").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    members = salted.join(sets, "node").select("leader", "salt", "node", F.lit(True).alias("member"), "tokens")
    leads = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).join(sets.withColumnRenamed("node", "leader"), "leader")
    both = members.unionByName(leads.select("leader", "salt", F.col("leader").alias("node"), F.lit(False).alias("member"), "tokens"))
    dealt = both.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member", "node")
    out = dealt.mapInPandas(_verify, "leader long, node long, both long, either long")
    return materialize(out.select("leader", "node", (F.col("both") / F.col("either")).alias("sim"), (100 * F.col("both") >= PERCENT * F.col("either")).alias("linked")), "verified")


def linkable(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The classes that few enough own shingles leave in play."""
    tokens = docs.select("text").mapInPandas(_sampled, "token long, c1 long")
    # added up inside each task first: a shingle of a third of all rows is one row a task
    single = tokens.groupBy("token").agg(F.min("c1").alias("c1"), F.max("c1").alias("other")).filter("c1 = other")
    alone = single.groupBy("c1").agg(F.count("*").alias("alone"))
    return nodes.join(alone, "c1", "left").filter(100 * F.coalesce("alone", F.lit(0)) <= (100 - PERCENT) * F.col("n")).drop("alone")


def class_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, tokens of the given classes, one row each."""
    rows = docs.select("row", "text").join(bounded(classes.select("row", "node", "copies", "c1", "c2")), "row")
    sets = rows.mapInPandas(_own_sets, "node long, copies long, tokens array<long>")
    sets = materialize(sets, "sets")
    return sets.filter("copies = 1").unionByName(sets.filter("copies > 1").dropDuplicates(["node"])).select("node", "tokens")


def prefixes(sets: DataFrame) -> DataFrame:
    """node, token, size, pos, after: the postings of all prefixes, of shingles that at least two prefixes hold."""
    tokens = sets.select("node", F.size("tokens").cast("long").alias("size"), F.explode("tokens").alias("token"))
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    shared = tokens.join(counts, "token").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    out = materialize(shared.select("node", "size", F.col("t.token").alias("tokens")).mapInPandas(_prefixes, "node long, token long, size long, pos long, after long"), "prefixes")
    met = materialize(out.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "met")
    joined = materialize(out.join(met, "token"), "members")
    release(counts, out, met)
    return joined


def star(members: DataFrame, sets: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(leaders: token, leader; verified pairs): each list's members against the one that shares most; known pairs are not repeated."""
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    best = members.join(degree, "node").groupBy("token").agg(F.max_by(F.struct("node", "size", "pos", "after"), F.struct("degree", -F.col("node"))).alias("b"))
    leaders = materialize(best.select("token", F.col("b.node").alias("leader"), F.col("b.size").alias("size2"), F.col("b.pos").alias("pos2"), F.col("b.after").alias("after2")), "leaders")
    pairs = members.join(leaders, "token").filter((F.col("node") != F.col("leader")) & may_link()).select("leader", "node").distinct()
    if known is not None:
        both = known.select("leader", "node").unionByName(known.select(F.col("node").alias("leader"), F.col("leader").alias("node")))
        pairs = pairs.join(both, ["leader", "node"], "left_anti")
    return leaders.select("token", "leader"), verified(materialize(pairs, "pairs"), sets)


def exact_pairs(members: DataFrame, comps: DataFrame, stars: list[tuple[DataFrame, DataFrame]], known: DataFrame) -> DataFrame:
    """leader, node: the pairs of different components that pass all filters and were not verified yet, each once."""
    rows = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = materialize(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token"), "mixed")
    rows = rows.join(mixed, "token")
    pivots = []
    for k, (leaders, sims) in enumerate(stars):
        rows = rows.join(leaders.withColumnRenamed("leader", f"leader_{k}"), "token", "left")
        to = sims.select(F.col("leader").alias(f"leader_{k}"), "node", F.col("sim").alias(f"found_{k}"))
        rows = rows.join(to, [f"leader_{k}", "node"], "left").withColumn(f"sim_{k}", F.when(F.col(f"leader_{k}") == F.col("node"), 1.0).otherwise(F.col(f"found_{k}")))
        pivots.append(f"sim_{k}")
    band = F.floor(F.log("size") / float(np.log(100 / PERCENT))).cast("int")
    rows = materialize(rows.select("token", "node", "comp", "size", "pos", "after", band.alias("band"), *pivots), "loose")
    other = rows.select(*[F.col(c).alias(f"{c}2") if c not in ("token", "band") else F.col(c) for c in rows.columns])
    other = other.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    near = F.lit(True)
    for p in pivots:
        near &= F.coalesce(F.abs(F.col(p) - F.col(f"{p}2")) <= 1 - PERCENT / 100 + 1e-9, F.lit(True))
    pairs = rows.join(other, ["token", "band"]).filter((F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")) & near & may_link())
    pairs = pairs.select(F.col("node").alias("leader"), F.col("node2").alias("node")).distinct()
    done = known.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node"))
    return materialize(pairs.join(done, ["leader", "node"], "left_anti"), "pairs")


def links_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    """node, comp over the links of all prefix postings; comp is the smallest node reachable."""
    comps, stars, known, rest = None, [], None, members
    for k in range(ROUNDS):
        leaders, found = star(rest, sets, known)
        stars.append((leaders, found))
        known = found if known is None else known.unionByName(found)
        comps = components(known.filter("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")))
        if k + 1 < ROUNDS:  # the next leader comes from outside this one's component
            home = comps.select(F.col("node").alias("leader"), F.col("comp").alias("home"))
            placed = rest.join(leaders, "token").join(comps, "node", "left").join(home, "leader", "left")
            outside = F.coalesce("comp", "node") != F.coalesce("home", "leader")
            rest = materialize(placed.filter(outside).select(*members.columns), "outside")
    more = verified(exact_pairs(members, comps, stars, known), sets)
    if more.filter("linked").isEmpty():
        return comps
    return components(known.unionByName(more).filter("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_shingles and component_id."""
    batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    sketches = materialize(rows.mapInPandas(_sketch, f"id {kind}, row long, n long, c1 long, c2 long"), "sketches")
    each = sketches.filter("n > 0").groupBy("n", "c1", "c2", "row").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = each.groupBy("n", "c1", "c2").agg(F.min("id").alias("least"), F.min(F.struct("row", "copies")).alias("r"))
    nodes = materialize(nodes.select("n", "c1", "c2", "least", "r.row", "r.copies").withColumn("node", F.monotonically_increasing_id()), "nodes")
    classes = materialize(linkable(rows, nodes), "classes")
    sets = class_sets(rows, classes)
    members = prefixes(sets)
    comps = links_of(members, sets)
    placed = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = materialize(placed.select("n", "c1", "c2", "comp").join(least, "comp").select("n", "c1", "c2", "component_id"), "named")
    release(classes, members)
    out = sketches.join(named, ["n", "c1", "c2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
