"""Best-fit packing of token sequences by a configuration linear program.

A document longer than the capacity is cut into pieces of that capacity; its last piece may be shorter. The histogram of
piece lengths (at most `capacity` rows, whatever the corpus) goes to the driver. There the configuration program (the least
number of sequences, of any mixes of lengths, that cover the histogram) is solved by multiplicative weights: each round weighs
lengths by how far they lag behind, a knapsack dynamic program over the capacity prices, for every length, the best
configuration that holds it, and the lengths that lag take their configurations until all reach the round's share. After the
last round every length is covered; the prices bound the optimum from below.

Rounding: configurations that fill a sequence are taken in turn, each as often as the fractions up to it sum to whole sequences and as
the pieces that are left allow; the program is solved again for a large rest. The residue is repaired: the longest piece that is
left opens a sequence, which a knapsack bounded by the pieces that are left fills by the dual prices (at the volume bound a
length's price is its share of the capacity), or best fit, whichever needs fewer sequences. The rounding is done with more and
less of each length held back for the residue, and the least plan kept; it says how many sequences came from which step.

Pieces get their rank among those of their length in parts (a salt of the id), so that a length which a third of all pieces
share is not one task; rank and length give sequence and offset from the broadcast plan.

Null texts are empty documents (the end id alone), as are empty ones; very long texts are cut into as many pieces as they need,
in one task; null ids are kept; repeated rows are packed each (their order among themselves is of no account); ties in length are
ordered by id and piece. An empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import logging
import math
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, materialize
from .tokens import encoder

CAPACITY = 4096
#: A mix of lengths: (length, how many) pairs, longest first.
Config = tuple[tuple[int, int], ...]
#: Rounds of multiplicative weights and the rate at which lengths ahead of the others lose weight.
ROUNDS, RATE = 4, 0.5
#: Times a round prices anew; shares of its need by which a length counts as ahead at most.
PRICED, MOST = 8, 16
#: A filling may be so much cheaper than the best; configurations of one length in a round that stop where another length stops lagging.
NEAR, TRIES = 0.01, 8
#: Most pieces that are left to be placed by price one sequence at a time.
LAST = 50_000
#: Shares of a length's pieces that a rounding leaves, so that the rest is no worse a mix than the whole. The last leaves all.
HELD = (0.15, 0.5, 0.8, 0.95, 1.0)
#: Pieces among which a priced sequence is first sought.
SPREAD = 128
#: Pieces of one length that are ranked together, about.
RANK_ROWS = 20_000


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32; written once."""
    batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, end = encoder(tokenizer_path), np.array([end_id], dtype=np.uint32).tobytes()
        for pdf in rows:
            out = []
            for key, ids in zip(pdf["id"], tool.encode(list(pdf["text"])), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    own = np.frombuffer(ids[4 * at : 4 * (at + capacity)], dtype=np.uint32).astype("<u4", copy=False)
                    out.append((key, k, at, len(own), zlib.crc32(own.tobytes())))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")


# --- the plan, on the driver: sizes are at most capacity, whatever the corpus -------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best fit, longest first, of a histogram: [(content, repeats)]. Bins of equal content are handled together. One repair of the residue."""
    open_bins: dict[int, Counter] = defaultdict(Counter)  # room left -> content -> bins
    rooms = np.zeros(capacity + 1, dtype=bool)
    done: Counter = Counter()

    def put(content: tuple, room: int, bins: int) -> None:
        if room == 0:
            done[content] += bins
        else:
            open_bins[room][content] += bins
            rooms[room] = True

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                per = capacity // size
                if left >= per:
                    put(((size, per),), capacity - per * size, left // per)
                    left -= left // per * per
                else:
                    put(((size, left),), capacity - left * size, 1)
                    left = 0
                continue
            room = int(fits[0]) + size
            content, bins = next(iter(open_bins[room].items()))
            per = min(room // size, left)
            use = min(bins, left // per)
            open_bins[room][content] -= use
            if open_bins[room][content] == 0:
                del open_bins[room][content]
            if not open_bins[room]:
                rooms[room] = False
            put((*content, (size, per)), room - per * size, use)
            left -= use * per
    for by_content in open_bins.values():
        done.update(by_content)
    return list(done.items())


def knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """For each capacity the greatest price of lengths that fill it to the last token (-inf: none do)."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        n = upto[c]
        if n:
            best[c] = (best[c - sizes[:n]] + price[:n]).max()
    return best


def _column(k: int, sizes: np.ndarray, price: np.ndarray, best: np.ndarray, lag: np.ndarray, capacity: int, rng: np.random.Generator) -> Counter:
    """A configuration that holds length k and fills what it leaves at the best price, or nearly so; of such fillings one of lengths that lag."""
    mix, room = Counter([k]), int(capacity - sizes[k])
    while room:
        if best[room] == -np.inf:
            room -= 1
            continue
        n = int(np.searchsorted(sizes, room, side="right"))
        got = best[room - sizes[:n]] + price[:n]
        near = np.flatnonzero(got >= best[room] * (1 - NEAR))
        want = np.maximum(lag[near], 1e-9) * sizes[near]
        total = np.cumsum(want)
        i = int(near[np.searchsorted(total, rng.random() * total[-1])])
        mix[i] += 1
        room -= int(sizes[i])
    return mix


def configurations(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[dict[Config, float], float]:
    """(fractional cover of the histogram: configuration -> sequences; lower bound of any cover)."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[int(s)] for s in sizes], dtype=float)
    lag, rng = np.zeros(len(sizes)), np.random.default_rng(len(sizes))
    found: dict[Config, float] = defaultdict(float)
    bound, step = float(need @ sizes) / capacity, -(-len(sizes) // PRICED)
    for _ in range(rounds):
        lag += need / rounds  # what this round must still cover; below 0: ahead
        for k in range(len(sizes) - 1, -1, -1):  # long lengths first: short ones fill what they leave
            if (len(sizes) - 1 - k) % step == 0:
                price = sizes / capacity * np.exp(RATE * (lag / need - 1 / rounds).clip(-MOST, 1))
                best = knapsack(sizes, price, capacity)
                bound = max(bound, float(need @ price) / best.max())  # prices by which no configuration exceeds 1
            tries = 0
            while lag[k] > 1e-9 * need[k]:
                tries += 1
                mix = _column(k, sizes, price, best, lag, capacity, rng)
                share = lag[k] / mix[k]
                if tries < TRIES:  # no more than each of its lengths lags, as far as any does
                    share = min(share, *(lag[i] / n for i, n in mix.items() if lag[i] > 1e-9 * need[i]))
                found[tuple((int(sizes[i]), n) for i, n in sorted(mix.items(), reverse=True))] += share
                for i, n in mix.items():
                    lag[i] -= n * share
    return dict(found), bound


def priced(pieces: list[int], capacity: int) -> list[int]:
    """Take from the sorted pieces the longest and the filling of greatest price of the room it leaves, if possible of longer pieces.

    A knapsack over some pieces, evenly spread, whose sums reach the whole room is already the best; otherwise over more, up to all.
    """
    own = pieces.pop()
    room, out = capacity - own, [own]
    fits, tried = bisect_right(pieces, room), SPREAD
    while fits and room:
        step = max(1, fits // tried)
        some = list(range(fits - 1, -1, -step))[::-1]
        reach = [1]  # bit t of reach[j]: some of the first j reach the sum t
        for i in some:
            reach.append((reach[-1] | reach[-1] << pieces[i]) & (2 << room) - 1)
        left = reach[-1].bit_length() - 1
        if left == room or step == 1:
            for j in range(len(some), 0, -1):
                piece = pieces[some[j - 1]]
                if piece <= left and reach[j - 1] >> left - piece & 1:
                    out.append(piece)
                    left -= piece
                    del pieces[some[j - 1]]
            break
        tried *= 4
    return out


@dataclass
class Plan:
    """content: [(configuration, sequences)] that hold exactly the histogram; origin: sequences by the step they came from; bound: least possible by prices."""

    content: list[tuple[Config, int]]
    origin: dict[str, int]
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.content)


def _rounded(left: dict[int, int], fractional: dict[Config, float], capacity: int, held: float) -> tuple[Counter, dict[int, int]]:
    """(whole sequences of the program's configurations that fill one, what is left)."""
    plan, left, carry = Counter(), dict(left), 0.0
    free = {s: round(n * (1 - held)) for s, n in left.items()}
    for c in sorted(fractional):
        if sum(s * n for s, n in c) < capacity:
            continue  # what leaves room is placed below, by what is left then
        carry += fractional[c]
        take = min(int(carry), *(free[s] // n for s, n in c))
        carry -= int(carry)
        if take:
            plan[c] += take
            for s, n in c:
                left[s] -= n * take
                free[s] -= n * take
    return plan, {s: n for s, n in left.items() if n}


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Round the configuration program to whole sequences that hold exactly the histogram.

    It is rounded with each of the shares HELD and the rest placed by price (up to LAST pieces) and by best fit; the least plan is returned.
    """
    counts = {s: n for s, n in counts.items() if n}
    full = counts.get(capacity, 0)
    rest = {s: n for s, n in counts.items() if s < capacity}
    start = {((capacity, 1),): full} if full else {}
    bound = -(-sum(s * n for s, n in counts.items()) // capacity)
    if not rest:
        return Plan(list(start.items()), {"full": full, "program": 0, "priced": 0, "fitted": 0}, bound)
    fractional, least = configurations(rest, capacity)
    bound, found = max(bound, full + math.ceil(least - 1e-6)), []
    for held in HELD:
        plan, left = _rounded(rest, fractional, capacity, held)
        while sum(left.values()) > LAST:  # solve the program again for a large rest
            more, less = _rounded(left, configurations(left, capacity, 1)[0], capacity, held)
            if 10 * sum(less.values()) > 9 * sum(left.values()):
                break
            plan, left = plan + more, less
        done = plan.total() + full
        ends = {"fitted": Counter(dict(best_fit(left, capacity)))}
        if sum(left.values()) <= LAST and done + ends["fitted"].total() > bound:
            pieces, ends["priced"] = [s for s in sorted(left) for _ in range(left[s])], Counter()
            while pieces:
                ends["priced"][tuple(sorted(Counter(priced(pieces, capacity)).items(), reverse=True))] += 1
        for name, end in ends.items():
            origin = {"full": full, "program": plan.total(), "priced": 0, "fitted": 0} | {name: end.total()}
            found.append(Plan(list((Counter(start) + plan + end).items()), origin, bound))
        if min(x.sequences for x in found) == bound:
            break  # none can be smaller
    return min(found, key=lambda x: (x.sequences, -x.origin["program"]))


class Slots:
    """Sequence and offset of the r-th piece of a length, from a plan."""

    def __init__(self, plan: list, capacity: int):
        rows, base = [], 0
        for content, repeats in plan:
            at = 0
            for s, n in content:
                rows.append((s, base, n, at, n * repeats))
                at += s * n
            base += repeats
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        size = table[:, 0]
        before = np.cumsum(table[:, 4]) - table[:, 4]
        first = np.searchsorted(size, size)  # ranks begin anew with each length
        self.sequences, self.size = base, size
        self.base, self.per, self.at, self.low = table[:, 1], table[:, 2], table[:, 3], before - before[first] if len(table) else before
        self.bits = 44
        self.keys = (size << self.bits) | self.low

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, (length << self.bits) | rank, side="right") - 1
        q = rank - self.low[i]
        return self.base[i] + q // self.per[i], self.at[i] + q % self.per[i] * length


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col)
    salts = max(1, -(-pieces.count() // RANK_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_sequences(histogram, capacity)
    logging.getLogger(__name__).info("%d sequences (%s), lower bound %d", plan.sequences, plan.origin, plan.bound)
    slots = spark.sparkContext.broadcast(Slots(plan.content, capacity))
    before = parts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"])

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.value.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = F.pandas_udf(place, "sequence_id long, offset long")(F.col("length"), F.col("own") + F.col("before"))
    placed = ranked.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", at.alias("at"))
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
