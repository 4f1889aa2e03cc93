"""Near-duplicate groups by BagMinHash over multisets of five-word shingles.

A text is the multiset of its runs of five consecutive words (lower-cased runs of letters and digits); a text of one to four
words is one shingle. Weights are discretised at whole counts. For every shingle, independent Poisson processes run over the
intervals [0,1), [1,2), [2,4), [4,8) and so on of its weight; inside an interval a point's binary place says to which nested
half it belongs, and points beyond the text's weight are dropped. Points come in rising order and each falls to one of the
signature's components; a process stops when it passes the largest component. The component's smallest point is an unbiased
weighted Jaccard sketch: two texts agree in a component with the probability of their similarity.

Texts of equal words are one class before anything is paired. Bands of the signature give buckets. In each bucket every
member is compared with one leader, the member that shares most buckets with others, so that a group of n copies gives about n
pairs; connected components follow. Members of buckets that still hold several components then meet in an exact prefix join
(rarest tokens first), which leaves only pairs that can reach the threshold. Every pair is verified by the exact overlap of its
multisets. Pairs go to their leader's task in salted parts.

"Equal words" means two equal 61-bit hashes of the words; overlaps are exact on shingles' 61-bit hashes.

Null and empty texts are classes of their own. Rows of one id share its class. A null id stays null and its class is named by a
negative number from its text where no other row is in it. A very long text is one row of one task. Repeated rows give one result
each; of leaders that tie, the smallest id leads. An empty table gives an empty result. Extra columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_TABLE, Hasher, batches, chunks, fresh, materialize, mix, release
from .native_text import text_key

SHINGLE, SIMILARITY = 5, 0.8
#: Most components of a band; at 0.8 there are 24 bands of 5, and a pair shares none with probability 0.00007.
ROWS = 5
#: Pairs of one leader that a task takes at once.
LEADER_PAIRS = 2000
#: Words of 64 bits of the filter that says which texts are compared: bounds what is broadcast. A fuller filter lets more rows through to the exact join.
FILTER_WORDS = 1 << 18
#: Points that are drawn at once beyond the first of each process: bounds a task's memory.
POINTS = 200_000
_WORDS, _SHINGLES, _TEXT = Hasher(21), Hasher(22), Hasher(23)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list, n: int = SHINGLE) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]]:
    """Per chunk: first text, (distinct shingles, counts) of each text, and two hashes of its words."""
    for first, low, start, end, bound in chunks(texts, WORD_TABLE):
        words = _WORDS.words(low, start, end)
        at = np.arange(max(0, len(words) - n + 1))
        grams = _SHINGLES.spans(words, at, at + n)
        sets = []
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            own = grams[a : b - n + 1] if b - a >= n else _SHINGLES.spans(words, np.array([a]), np.array([b])) if b > a else grams[:0]
            sets.append(np.unique(own, return_counts=True))
        yield first, sets, _SHINGLES.spans(words, bound[:-1], bound[1:]), _TEXT.spans(words, bound[:-1], bound[1:])


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = 120) -> np.ndarray:
    """BagMinHash: for each multiset the ids of the smallest points of its components (0: no shingles)."""
    lengths = [len(h) for h, _ in sets]
    doc = np.repeat(np.arange(len(sets)), lengths)
    shingle = np.concatenate([h for h, _ in sets] or [np.zeros(0, np.uint64)])
    weight = np.concatenate([c for _, c in sets] or [np.zeros(0, np.int64)])
    left, width, part = 0, 1, 0
    seeds, docs, weights, lefts, widths = [], [], [], [], []
    while True:  # the intervals below each weight
        use = weight > left
        if not use.any():
            break
        seeds.append(mix(shingle[use] + np.uint64((part + 1) * int(_STEP) % 2**64)))
        docs.append(doc[use])
        weights.append(weight[use])
        lefts.append(np.full(use.sum(), left))
        widths.append(np.full(use.sum(), width))
        left, part = left + width, part + 1
        width = left
    point, ids = np.full(len(sets) * size, np.inf), np.zeros(len(sets) * size, dtype=np.uint64)
    if not seeds:
        return ids.reshape(len(sets), size)
    seed, doc, weight, left, width = map(np.concatenate, (seeds, docs, weights, lefts, widths))
    time, r, block = np.zeros(len(seed)), 0, 1
    while len(seed):
        x = mix(seed[:, None] + np.arange(r + 1, r + block + 1, dtype=np.uint64) * _STEP)
        times = time[:, None] + np.cumsum(-np.log(((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / width[:, None], axis=1)
        y = mix(x ^ np.uint64(0xD1B54A32D192ED03))
        comp = ((y >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        place = left[:, None] + (y & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32 * width[:, None]
        inside = (place < weight[:, None]).ravel()
        at = (doc[:, None] * size + comp.astype(np.int64)).ravel()[inside]
        t, name = times.ravel()[inside], x.ravel()[inside]
        np.minimum.at(point, at, t)
        won = point[at] == t
        ids[at[won]] = name[won]
        r = r + block
        time = times[:, -1]
        go = time < point.reshape(len(sets), size).max(axis=1)[doc]
        seed, doc, weight, left, width, time = seed[go], doc[go], weight[go], left[go], width[go], time[go]
        block = max(1, min(64, POINTS // max(1, len(seed))))  # few processes left: several points of each at once
    return ids.reshape(len(sets), size)


def band_keys(ids: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each signature."""
    key = np.zeros((len(ids), bands), dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(31) + ids[:, j * bands : (j + 1) * bands])
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64) * _STEP).view(np.int64)


def _sketch(n_bands: int, n_rows: int):
    def sketch(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for first, sets, c1, c2 in shingle_sets(list(pdf["text"])):
                bands = band_keys(signatures(sets, n_bands * n_rows), n_bands, n_rows)
                full, own = [len(h) > 0 for h, _ in sets], pdf.iloc[first : first + len(sets)]
                yield pd.DataFrame({"id": own["id"], "ord": own["ord"], "full": full, "c1": c1.view(np.int64), "c2": c2.view(np.int64), "bands": [b.tolist() if f else [] for b, f in zip(bands, full, strict=True)]})

    return sketch


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(1, a[1].sum() + b[1].sum() - both))


def _verify(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by leader, the leader's own text first; a batch after another."""
    leader, held = None, None
    for pdf in rows:
        out = []
        sets = [s for _, found, _, _ in shingle_sets(list(pdf["text"])) for s in found]
        for row, own in zip(zip(pdf["leader"].tolist(), pdf["node"].tolist(), pdf["member"].tolist(), strict=True), sets, strict=True):
            if not row[2]:
                leader, held = row[0], own
            elif leader == row[0]:
                out.append((row[0], row[1], similarity(held, own)))
            else:
                raise ValueError("a leader's text is missing")
        yield pd.DataFrame(out, columns=["leader", "node", "sim"]).astype({"leader": "int64", "node": "int64", "sim": "float64"})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact similarity of (leader, node) pairs; texts: node, text. A leader's text goes once to each salted part."""
    parts = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    parts = parts.select("leader", F.ceil(F.col("n") / LEADER_PAIRS).cast("int").alias("parts"))
    salted = pairs.join(parts, "leader").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    members = salted.join(texts, "node").select("leader", "salt", "node", F.lit(True).alias("member"), "text")
    leads = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).join(texts.withColumnRenamed("node", "leader"), "leader")
    both = members.unionByName(leads.select("leader", "salt", F.col("leader").alias("node"), F.lit(False).alias("member"), "text"))
    dealt = both.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member", "node")
    return materialize(dealt.mapInPandas(_verify, "leader long, node long, sim double"), "verified")


def wanted_rows(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a long) wanted, distinct, has. A broadcast bit filter of bounded size keeps nearly all others out of the exact join's shuffle."""
    place = F.pmod(F.xxhash64(key), F.lit(64 * FILTER_WORDS))
    word, bit = F.shiftright(place, 6).alias("__word"), F.pmod(place, F.lit(64)).cast("int")
    bits = wanted.select(word, bit.alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    near = rows.withColumn("__word", word).join(F.broadcast(bits), "__word").filter(F.getbit("__bits", bit) == 1)
    return near.drop("__word", "__bits").join(wanted, key)  # a semi-join would be pushed below the filter


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node it is linked to, over any number of links), for nodes with links: least labels with pointer jumping."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "comp": "other"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        least = labels.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "other").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = materialize(least.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        changed = new.filter(F.col("old") != F.col("comp")).limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def stable_id(id_col: str, text_col: str):
    """A row's id; for a null one a negative number from its text."""
    return F.coalesce(F.col(id_col).cast("long"), -1 - F.abs(F.shiftright(text_key(id_col, text_col), 1)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs with the smallest id of their group, once each; same columns."""
    kept = _classes(docs, id_col, text_col, threshold).filter(F.col("ord") == F.col("class_id")).select(F.col("class_id").alias("__kept")).distinct()
    own = fresh(docs, "__kept")
    rows = docs.withColumn(own, stable_id(id_col, text_col)).join(kept.withColumnRenamed("__kept", own), own, "left_semi")
    return rows.dropDuplicates([own]).select(*docs.columns)


def _tokens(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's multiset as distinct tokens: a shingle's repeats are tokens of their own."""
    for pdf in rows:
        nodes = pdf["node"].to_numpy()
        for first, sets, _, _ in shingle_sets(list(pdf["text"])):
            for k, (h, c) in enumerate(sets):
                again = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                tokens = mix(np.repeat(h, c) + again.astype(np.uint64) * _STEP)
                yield pd.DataFrame({"node": nodes[first + k], "token": tokens.view(np.int64), "size": np.int32(len(tokens))})


def prefix_pairs(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(leader, node) pairs of different components that may reach the threshold; rows: node, comp, leader, sim (to that leader).

    Exact: with tokens in order of rarity, two multisets of that similarity share a token among their first
    size - ceil(threshold * size) + 1, and at the first one shared the tokens that are left must suffice. A text that differs
    by many rare tokens of its own has no such token and costs nothing. Distances to a common leader must differ by at most
    1 - threshold. Components that are settled around their leaders are not joined with themselves.
    """
    tokens = texts.join(rows.select("node"), "node", "left_semi").mapInPandas(_tokens, "node long, token long, size int")
    tokens = materialize(tokens, "tokens")
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    rare = W.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "token")
    ranked = tokens.join(counts, "token", "left").withColumn("pos", F.row_number().over(rare))
    prefix = ranked.filter((F.col("pos") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1) & F.col("n").isNotNull())
    home = rows.select(F.col("node").alias("leader"), F.col("comp").alias("home"))
    known = rows.join(home, "leader", "left").withColumn("settled", F.coalesce(F.col("home") == F.col("comp"), F.lit(False)))
    prefix = materialize(prefix.select("node", "token", "size", "pos").join(known.select("node", "comp", "leader", "sim", "settled"), "node"), "prefix")

    def pairs(x: DataFrame, y: DataFrame, once):
        y = y.withColumnsRenamed({c: f"{c}2" for c in y.columns if c != "token"})
        enough = 1 + F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2")) >= threshold / (1 + threshold) * (F.col("size") + F.col("size2")) - 1e-9
        near = (F.col("leader") != F.col("leader2")) | (F.abs(F.col("sim") - F.col("sim2")) <= 1 - threshold + 1e-9)
        sizes = F.least("size", "size2") >= threshold * F.greatest("size", "size2") - 1e-9
        return x.join(y, "token").filter(once & (F.col("comp") != F.col("comp2")) & enough & near & sizes).select(F.col("node").alias("leader"), F.col("node2").alias("node"))

    loose, settled = prefix.filter(~F.col("settled")), prefix.filter("settled")
    several = settled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    settled = settled.join(several, "token", "left_semi")
    found = pairs(loose, prefix, F.col("settled2") | (F.col("node") < F.col("node2"))).unionByName(pairs(settled, settled, F.col("node") < F.col("node2")))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """Per row: id and class_id, the smallest id of its group; and n_links, the verified links that found the group's text."""
    return _classes(docs, id_col, text_col, threshold).select(F.col("id").alias(id_col), "class_id", "n_links")


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, components of each): the fewest bands by which a pair at the threshold is missed with probability 0.0001 at most."""
    rows = max(2, min(ROWS, round(1 + 5 * threshold)))
    return max(2, -(-int(np.ceil(np.log(0.0001) / np.log1p(-(threshold**rows)))) // 1)), rows


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Per row: id, ord (the id, or a number in its place), class_id, n_links."""
    batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), stable_id(id_col, text_col).alias("ord"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketches = materialize(texts.mapInPandas(_sketch(*bands_for(threshold)), f"id {kind}, ord long, full boolean, c1 long, c2 long, bands array<long>"), "sketches")

    # rows of equal words: one node, named by its smallest id
    nodes = sketches.filter("full").groupBy("c1", "c2").agg(F.min("ord").alias("node"), F.min_by("bands", "ord").alias("bands"))
    nodes = materialize(nodes, "nodes")
    bands = nodes.select("node", F.explode("bands").alias("bucket"))
    # written before it meets the rows: both sides of the join are plain shuffles, of which Spark splits a hot bucket
    shared = materialize(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = members_table = materialize(bands.join(shared, "bucket"), "members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = materialize(members.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("leader")), "leaders")
    led = materialize(members.select("bucket", "node").join(leaders, "bucket"), "led")
    pairs = led.filter(F.col("node") != F.col("leader")).select("leader", "node").distinct()

    wanted = materialize(members.select("node").distinct(), "wanted")
    own = wanted_rows(texts.select(F.col("ord").alias("node"), "text"), wanted, "node")
    own = materialize(own.groupBy("node").agg(F.min("text").alias("text")), "texts")
    first = verified(pairs, own)
    linked = first.filter(F.col("sim") >= threshold)
    comps = components(linked.select(F.col("leader").alias("a"), F.col("node").alias("b")))

    # buckets of several components: an exact join of their members
    sims = first.select("leader", "node", "sim")
    placed = led.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(placed, "placed")
    mixed = materialize(placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket"), "mixed")
    members = placed.join(mixed, "bucket").select("node", "comp", "leader").distinct().join(sims, ["leader", "node"], "left").withColumn("sim", F.coalesce("sim", F.lit(1.0)))
    near = members.groupBy("node", "comp").agg(F.max_by(F.struct("leader", "sim"), F.struct("sim", "leader")).alias("near"))
    unsettled = materialize(near.select("node", "comp", "near.leader", "near.sim"), "unsettled")
    more = verified(prefix_pairs(unsettled, own, threshold), own).filter(F.col("sim") >= threshold)
    links = linked.unionByName(more).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    if not more.isEmpty():
        comps = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))

    named = nodes.select("c1", "c2", "node").join(comps, "node", "left").join(degree, "node", "left")
    named = named.select("c1", "c2", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")).withColumn("full", F.lit(True))
    named = materialize(named, "named")
    release(members_table, led, own, first, unsettled, shared, leaders, placed, mixed)
    out = sketches.select("id", "ord", "full", "c1", "c2").join(named, ["full", "c1", "c2"], "left")
    return out.select("id", "ord", F.coalesce("comp", "ord").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
