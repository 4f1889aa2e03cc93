"""Jaccard join, ranked search and spelling variants against plain re-implementations, on real rows and on odd ones."""

import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest

from quillstone.llm import jaccard_join, lexical_search, queries, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """One (id, set size, component) a row: all pairs of rows are compared."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                up[top(j)] = top(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, len(s), least.get(top(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def joined(df):
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str)


def test_jaccard_join(spark, docs, odd):
    got = sorted((tuple(r) for r in queries.QUERIES["op11_jaccard_join"](spark, SF).collect()), key=str)
    assert got == components(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))
    assert joined(odd) == components(pairs(odd))
    assert joined(odd.limit(0)) == []


def test_jaccard_join_at_the_threshold_and_in_drifting_groups(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, base = [], fresh(104)  # 100 shingles
    rows += [(1, base), (2, base[:93] + fresh(11)), (3, base[:92] + fresh(12))]  # 89 of 111 shared: a link; 88 of 112: none
    drift = fresh(60)
    for k in range(100, 140):  # each differs a little from the one before, the ends share nothing
        rows.append((k, drift))
        drift = drift[2:] + fresh(2)
    family = fresh(80)
    rows += [(k, family[: 30 + k % 7] + fresh(3) + family[30 + k % 7 :]) for k in range(200, 240)]  # near copies of one text
    shared = fresh(50)
    rows += [(k, fresh(60) + shared) for k in range(300, 330)]  # a passage that many share and that makes no link
    short = fresh(9)
    rows += [(400, short), (401, [*short, "x"]), (402, short[:4]), (403, short[:4]), (404, short[1:4]), (405, short[:5])]
    rows = [(k, " ".join(w)) for k, w in rows]
    rows += [(200, rows[-1][1]), (None, " ".join(base)), (None, "nothing like it"), (500, rows[0][1].upper())]
    want = components(rows)
    assert (1, 100, 1) in want and (2, 100, 1) in want and (3, 100, 3) in want
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == want
    renamed = spark.createDataFrame([(f"k{k}", t) for k, t in rows if k is not None], "node string, tokens string")
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(renamed, "node", "tokens").collect()), key=str)
    assert got == components([(f"k{k}", t) for k, t in rows if k is not None])


def test_no_filter_loses_a_link(spark):
    """Prefixes of linked sets share a posting that passes length, position and suffix."""
    rng = random.Random(6)
    rows = []
    for k in range(60):
        words = [f"v{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))]
        rows.append((3 * k, words))
        for j in (1, 2):
            near = list(words)
            for _ in range(rng.randrange(1, 3)):
                near[rng.randrange(len(near))] = f"v{rng.randrange(40)}"
            rows.append((3 * k + j, near))
    rows = [(k, " ".join(w)) for k, w in rows]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == components(rows)


# --- ranked search


def ranking(docs, items, k=10):
    """item, rank, document, score by scoring every document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in bags:
            m = 100 - 90 + ((90 * n * n_docs) // n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, -1 if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **more):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **more).collect()), key=str)


def test_lexical_search(spark, docs):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op12_lexical_search"](spark, SF).collect()), key=str)
    assert got == ranking(list(zip(docs.doc_id.tolist(), docs.text, strict=True)), list(zip(items.item_id, items.text, strict=True)))


def test_lexical_search_of_odd_rows(spark, odd):
    items = [("a", "cc by token 7 W3"), ("a", "reserved p3"), (None, "p1 p2 É"), ("none", "nowhere to be found qqq"), ("empty", ""), ("null", None), ("a", "cc by token 7 W3")]
    asked = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 AS item", "2 AS t", "3 AS doc", "4 AS impact")
    assert found(odd, asked) == ranking(pairs(odd), items)
    assert found(odd.limit(0), asked) == [] and found(odd, asked.limit(0)) == []


def test_search_stops_early_and_misses_nothing(spark, monkeypatch):
    """Small rounds, so that items stop in different ones; many ties at the tenth place."""
    monkeypatch.setattr(lexical_search, "FIRST", 8)
    monkeypatch.setattr(lexical_search, "GROWTH", 3)
    monkeypatch.setattr(lexical_search, "AHEAD", 3)
    rng = random.Random(7)
    word = lambda: f"t{min(rng.randrange(60), rng.randrange(60), rng.randrange(60))}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(1, 40)))) for k in range(300)]
    docs += [(1000 - k, docs[5][1]) for k in range(40)]
    items = [(f"i{k}", " ".join(word() for _ in range(rng.randrange(1, 14)))) for k in range(12)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert found(*frames) == ranking(docs, items)
    assert found(*frames, k=3) == ranking(docs, items, 3)


def test_proof_levels(spark):
    asked = [("a", 0, 10), ("a", 1, 100), ("a", 2, 100), ("b", 0, 5), ("b", 1, 6), ("c", 0, 9)]
    best = [("a", 90), ("b", 100), ("c", 0)]
    levels = {r["item"]: r["level"] for r in lexical_search.proof_levels(spark.createDataFrame(asked, "item string, t long, top long"), spark.createDataFrame(best, "item string, kth long")).collect()}
    assert levels == {"a": 39, "b": 6, "c": 0}  # 10 + 39 + 39 < 90; all of b sums to less; nothing is proven for c


# --- spelling variants


def variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    cut = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            cut[w[:k] + w[k + 1 :]].add((w, k))
    near = {w: set() for w in n}
    for rest, held in cut.items():
        for w, k in held:
            near[w] |= {v for v, j in held if v != w and j == k}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled(df):
    return {tuple(r) for r in spelling.spelling_variants(df).collect()}


def test_spelling_variants(spark, docs, odd):
    got = queries.QUERIES["op13_spelling_variants"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == variants(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))
    assert spelled(odd) == variants(pairs(odd))
    assert spelled(odd.limit(0)) == set()


def test_spelling_edits_and_anagrams(spark):
    counts = {
        "letter": 40, "leter": 9, "lettre": 5, "letters": 20, "lettters": 4, "xetter": 3, "lettex": 3, "retter": 10, "better": 40, "étter": 6, "létter": 12, "ÿétter": 3, "abcde": 3, "bacde": 3, "abced": 3, "zbcde": 7, "abcdz": 7,
        "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "gggg": 9, "twice": 2, "Ünique": 3, "ünique": 8, "a×b÷c": 5,
    }
    rows = [(7, " ".join([w] * c).upper() if w == "letter" else " ".join([w] * c)) for w, c in counts.items()]
    rows += [(None, "letter " * 3), (8, "x" * 50_000 + " 1 " + "letter2letter")]
    want = variants(rows)
    assert {r for r in want if r[0] == "aaaaa"} == {("aaaaa", "aaaaaa", "aaaaaaaaa", 3, 1, 6)}
    assert spelled(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS run")) == want
