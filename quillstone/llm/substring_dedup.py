"""Removal of repeated passages by compaction of a de Bruijn graph of the corpus.

Nodes are token k-mers: of every window of 50 consecutive words, the k-mer of the least hash (equal windows choose the same
k-mer at the same place, so that no repeated window is missed). Edges are the runs of words from one node of a document to the
next. A node repeated in several documents whose occurrences all have the same edge before and the same edge after does not
branch. Joins link each of them to the one before it, and pointer jumping compacts the links into paths: a table of nodes with
their path and their place in it. Joined to the occurrences it gives each path's source coordinates (document, first word), and
the least of them is the path's source. Windows inside a path occur where the path does, and nowhere else. Windows over
branching nodes or over a path's ends are compared by two hashes of their 50 words, which give the least document and place
that has them. Before a word goes, its span is verified at its source coordinates: both spans' words must have the same SHA-256.

Nothing is paired with every copy: each span meets its least source only. Tables joined on a key that one passage may dominate
are both written or plainly shuffled first, so that Spark splits the hot key.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A word is removed if a window over it also starts in a document of a smaller id.
Null and empty texts have no words; a very long text is one row of one task. A null id counts as larger than every other.
Repeated rows (same id) do not remove each other and give one result each; ties between sources of one id go to any of them, as
their words are the same. An empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_TABLE, Hasher, batches, chunks, materialize, release
from .native_text import bounded, text_key

WINDOW, K = 50, 8
_WORDS, _NODES, _EDGES, _SECOND = (Hasher(s) for s in (31, 32, 33, 34))
_LAST = 2**63 - 1


def _nodes(words: np.ndarray, bound: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window starts inside documents, their document, the place of each one's node, hash of the k-mer at every word)."""
    n = np.diff(bound)
    starts = np.concatenate([np.arange(a, a + m - window + 1) for a, m in zip(bound[:-1], n, strict=True) if m >= window] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - window + 1, 0))
    if not len(starts):
        return starts, doc, starts, np.zeros(0, dtype=np.uint64)
    at = np.arange(len(words) - k + 1)
    kmers = _NODES.spans(words, at, at + k)
    view = np.lib.stride_tricks.sliding_window_view(kmers, window - k + 1)
    place = np.empty(len(starts), dtype=np.int64)
    for a in range(0, len(starts), 65536):
        s = starts[a : a + 65536]
        place[a : a + 65536] = s + (view[s[0] : s[-1] + 1].argmin(axis=1)[s - s[0]])
    return starts, doc, place, kmers


def _occurrences(window: int, k: int):
    def find(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            texts = list(pdf["text"])
            ords, keys = pdf["ord"].to_numpy(), pdf["key"].to_numpy()
            for first, low, start, end, bound in chunks(texts, SPACE_TABLE):
                words = _WORDS.words(low, start, end)
                _, doc, place, kmers = _nodes(words, bound, window, k)
                if not len(place):
                    continue
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
                place, doc = place[new], doc[new]
                inner = doc[1:] == doc[:-1]
                edge = _EDGES.spans(words, place[:-1][inner], place[1:][inner] + k).view(np.int64)
                # 0 at a document's first and last node
                before, after = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
                gap, ahead = np.zeros(len(place), dtype=np.int32), np.zeros(len(place), dtype=np.int32)
                before[1:][inner], after[:-1][inner] = edge, edge
                gap[1:][inner] = ahead[:-1][inner] = np.diff(place)[inner]
                yield pd.DataFrame({"ord": ords[first + doc], "key": keys[first + doc], "node": kmers[place].view(np.int64), "pos": (place - bound[doc]).astype(np.int32), "before": before, "after": after, "gap": gap, "ahead": ahead})

    return find


def paths(nodes: DataFrame) -> DataFrame:
    """node, path (its first node) and place (words from that): unbranched nodes linked by their common edges, by pointer jumping.

    nodes: node, before, after (its edges), gap (words from the node before). Rings have no first node and are left out.
    """
    inside = nodes.filter("inside")
    ends = inside.select(F.col("after").alias("before"), F.col("node").alias("up"))
    links = inside.select("node", "before", "gap").join(ends, "before", "left").select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(F.col("gap")).cast("long").alias("place"))
    links, rounds = materialize(links, "links"), 0
    most = links.count()
    while 2**rounds <= most:  # longer walks are rings
        there = links.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("place").alias("more"))
        moved = links.join(there, "up").select("node", F.col("far").alias("up"), (F.col("place") + F.col("more")).alias("place"), (F.col("far") != F.col("up")).alias("moved"))
        new = materialize(moved, "links")
        release(links)
        links, rounds = new.select("node", "up", "place"), rounds + 1
        links.__dict__["written"] = new.__dict__["written"]
        if new.filter("moved").isEmpty():
            break
    roots = links.filter("node = up AND place = 0").select(F.col("node").alias("up"))
    return links.join(roots, "up", "left_semi").select("node", F.col("up").alias("path"), F.col("place").cast("int").alias("place"))


def _asks(window: int, k: int):
    """Per document with repeated nodes: the windows over them that no path holds, and their hashes."""

    def ask(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            keys, orders = pdf["key"].tolist(), pdf["ord"].tolist()
            for first, low, start, end, bound in chunks(list(pdf["text"]), SPACE_TABLE):
                words = _WORDS.words(low, start, end)
                starts, doc, place, _ = _nodes(words, bound, window, k)
                cut = np.searchsorted(doc, np.arange(len(bound)))
                wanted, owner = [], []
                for d in range(len(bound) - 1):
                    a, b = cut[d], cut[d + 1]
                    if a == b:
                        continue
                    own, s = place[a:b] - bound[d], starts[a:b] - bound[d]
                    repeated, los, his = (np.asarray(pdf[c].iloc[first + d], dtype=np.int64) for c in ("pos", "lo", "hi"))
                    ask = np.isin(own, repeated)
                    if len(los):  # paths by their start: a later one ends later, as they share no node
                        order = np.lexsort((his, los))
                        los, his = los[order], np.maximum.accumulate(his[order])
                        j = np.searchsorted(los, s, side="right") - 1
                        ask &= ~((j >= 0) & (s + window <= his[np.maximum(j, 0)]))
                    wanted.append(s[ask] + bound[d])
                    owner.append(np.full(len(wanted[-1]), first + d))
                if not wanted or not sum(map(len, wanted)):
                    continue
                at, row = np.concatenate(wanted), np.concatenate(owner)
                h1, h2 = _EDGES.spans(words, at, at + window).view(np.int64), _SECOND.spans(_SECOND.words(low, start, end), at, at + window).view(np.int64)
                cuts = np.flatnonzero(np.diff(row, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)], strict=True):
                    r = row[a]
                    out.append((orders[r], keys[r], (at[a:b] - bound[r - first]).astype(np.int32), h1[a:b], h2[a:b]))
            yield pd.DataFrame(out, columns=["ord", "key", "at", "h1", "h2"])

    return ask


def _joined(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of a document: windows that follow each other here and at their source are one."""
    for pdf in rows:
        out = []
        for order, key, spans in zip(pdf["ord"], pdf["key"], pdf["spans"], strict=True):
            held = None
            for s in sorted((x["src"], x["src_key"], x["at"] - x["from"], x["at"], x["len"]) for x in spans):
                if held and s[:3] == held[:3] and s[3] <= held[3] + held[4]:
                    held[4] = max(held[4], s[3] + s[4] - held[3])
                    continue
                if held:
                    out.append((order, key, *held))
                held = list(s)
            if held:
                out.append((order, key, *held))
        made = pd.DataFrame(out, columns=["ord", "key", "src", "src_key", "shift", "at", "len"])
        yield made.assign(**{"from": made["at"] - made["shift"]})[["ord", "key", "at", "len", "src", "src_key", "from"]].astype("int64")


def _digest(words: list[bytes], at: int, n: int) -> bytes:
    return hashlib.sha256(b" ".join(words[at : at + n])).digest()


def _words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(SPACE_TABLE).split()


def _source_digests(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        out = []
        for order, key, text, spans in zip(pdf["ord"], pdf["key"], pdf["text"], pdf["spans"], strict=True):
            words = _words_of(text)
            out += [(order, key, s["from"], s["len"], _digest(words, s["from"], s["len"])) for s in spans]
        yield pd.DataFrame(out, columns=["src", "src_key", "from", "len", "digest"])


def _cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        out = []
        for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
            words = _words_of(text)
            gone = np.zeros(len(words) + 1, dtype=np.int32)
            for s in spans if spans is not None else ():
                if _digest(words, s["at"], s["len"]) == bytes(s["digest"]):
                    gone[s["at"]] += 1
                    gone[s["at"] + s["len"]] -= 1
            removed = np.cumsum(gone[:-1]) > 0
            kept = b" ".join([words[i] for i in np.flatnonzero(~removed).tolist()]) if removed.any() else b" ".join(words)
            out.append((len(words), int(removed.sum()), kept))
        yield pd.DataFrame({"id": pdf["id"], "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], "kept_sha256": [hashlib.sha256(x[2]).hexdigest() for x in out], "kept": [x[2].decode("utf-8", "surrogatepass") for x in out]})


def repeated_spans(texts: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Spans of words that also stand in a document of a smaller ord: ord, key, at, len, and the source's src, src_key, from.

    texts: ord, key, text. Each step is written before the next begins and drops what it needed itself.
    """
    found = materialize(texts.mapInPandas(_occurrences(window, k), "ord long, key long, node long, pos int, before long, after long, gap int, ahead int"), "nodes")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(0)).alias(c)
    nodes = found.groupBy("node").agg(F.min("ord").alias("least"), F.max("ord").alias("most"), one("before"), one("after"), F.max("gap").alias("gap"), F.max("ahead").alias("ahead"))
    nodes = materialize(nodes.filter("least < most").withColumn("inside", (F.col("before") != 0) & (F.col("after") != 0)), "repeated")
    linked = materialize(paths(nodes).join(nodes.select("node", "gap", "ahead"), "node"), "paths")
    # a path reaches from the node before its first to the end of the node after its last
    reach = linked.groupBy("path").agg(F.max(F.when(F.col("node") == F.col("path"), F.col("gap"))).alias("lead"), F.max(F.col("place") + F.col("ahead")).alias("reach"))
    placed = materialize(nodes.select("node").join(linked.join(reach, "path").select("node", "path", "place", "lead", "reach"), "node", "left"), "placed")
    start = F.col("pos") - F.col("place")
    at = found.select("ord", "key", "node", "pos").join(placed, "node").select("ord", "key", "pos", "path", (start - F.col("lead")).alias("lo"), (start + F.col("reach") + k).alias("hi"))
    at = materialize(at, "occurrences")
    release(found, nodes, linked, placed)

    spans = at.filter("path IS NOT NULL").select("ord", "key", "path", "lo", "hi").distinct()
    places = at.groupBy("ord", "key").agg(F.collect_set("pos").alias("pos"), F.collect_set(F.when(F.col("path").isNotNull(), F.struct("lo", "hi"))).alias("held"))  # at most a document's words
    places = places.select("ord", "key", "pos", F.col("held.lo").alias("lo"), F.col("held.hi").alias("hi"))
    asked = texts.join(places, ["ord", "key"]).select("ord", "key", "text", "pos", "lo", "hi").mapInPandas(_asks(window, k), "ord long, key long, at array<int>, h1 array<long>, h2 array<long>")
    asked, spans = materialize(asked, "asked"), materialize(spans, "spans")
    release(at)
    asks = asked.select("ord", "key", F.inline(F.arrays_zip("at", "h1", "h2")))
    source = lambda c, name: (F.min("ord").alias("src"), F.min_by("key", "ord").alias("src_key"), F.min_by(c, "ord").alias(name))
    # written before they meet the rows, so that both sides of a join are plain shuffles
    first = materialize(asks.groupBy("h1", "h2").agg(F.max("ord").alias("most"), *source("at", "from")).filter("src < most").drop("most"), "windows")
    head = materialize(spans.groupBy("path").agg(*source("lo", "from")), "sources")
    earlier = F.col("src") < F.col("ord")
    columns = ["ord", "key", "at", "len", "src", "src_key", "from"]
    by_window = asks.join(first, ["h1", "h2"]).filter(earlier).withColumn("len", F.lit(window)).select(*columns)
    by_path = spans.join(head, "path").filter(earlier & (F.col("hi") - F.col("lo") >= window)).select("ord", "key", F.col("lo").alias("at"), (F.col("hi") - F.col("lo")).alias("len"), "src", "src_key", "from")
    each = by_window.unionByName(by_path).groupBy("ord", "key").agg(F.collect_list(F.struct("at", "len", "src", "src_key", "from")).alias("spans"))
    out = materialize(each.mapInPandas(_joined, "ord long, key long, at long, len long, src long, src_key long, from long"), "joined")
    release(asked, spans, first, head)
    return out


def verified_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document with spans: their at, len and the SHA-256 of the words at the source coordinates. A source is read in parts of 512 words."""
    wanted = spans.select("src", "src_key", "from", "len").distinct().groupBy("src", "src_key", F.expr("`from` div 512").alias("part")).agg(F.collect_list(F.struct("from", "len")).alias("spans"))
    wanted = materialize(wanted.select(F.col("src").alias("ord"), F.col("src_key").alias("key"), "spans"), "wanted")
    digests = texts.join(bounded(wanted), ["ord", "key"]).select("ord", "key", "text", "spans").mapInPandas(_source_digests, "src long, src_key long, from long, len long, digest binary")
    digests = materialize(digests.dropDuplicates(["src", "src_key", "from", "len"]), "digests")
    found = spans.join(digests, ["src", "src_key", "from", "len"]).groupBy("ord", "key").agg(F.collect_list(F.struct("at", "len", "digest")).alias("spans"))
    found = materialize(found, "verified")
    release(wanted, digests)
    return found


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, with_text: bool = True) -> DataFrame:
    """Per text: id, n_words, n_removed, kept_sha256 and the kept words joined by one space."""
    batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"), text_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = texts.select("ord", "key", "text")
    spans = repeated_spans(own, window, k)
    found = verified_spans(own, spans)
    release(spans)
    out = texts.join(found, ["ord", "key"], "left").select("id", "text", "spans").mapInPandas(_cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept"] * with_text)
