"""Numbers and carried values over one giant group, over many small ones and over both."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import graph, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    made = [(("giant", f"g{i % 40}", None)[0 if i % 3 else 1 + i % 2], rng.randrange(10**6), i, rng.choice([None, None, None, f"v{i}"])) for i in range(3000)]
    return made, spark.createDataFrame(made, "g string, o long, id long, v string").repartition(7)


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small ranges stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_group(made):
    groups = {}
    for r in sorted(made, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_numbers(spark, rows):
    made, df = rows
    want = {r[2]: n for own in by_group(made).values() for n, r in enumerate(own, 1)}
    got = scan.numbers(df, [F.col("g")], [F.col("o"), F.col("id")], "n")
    assert got.columns == ["g", "o", "id", "v", "n"] and {r["id"]: r["n"] for r in got.collect()} == want
    whole = {r["id"]: r["n"] for r in scan.numbers(df, [], [F.col("o"), F.col("id")], "n").collect()}
    assert whole == {r[2]: n for n, r in enumerate(sorted(made, key=lambda r: (r[1], r[2])), 1)}
    assert scan.numbers(df.limit(0), [], [F.col("o")], "n").count() == 0


def test_carried(spark, rows):
    made, df = rows
    want = {}
    for own in by_group(made).values():
        last = None
        for r in own:
            last = r[3] or last
            want[r[2]] = last
    assert {r["id"]: r["c"] for r in scan.carried(df, [F.col("g")], [F.col("o"), F.col("id")], F.col("v"), "c").collect()} == want


def test_a_giant_group_spreads_over_ranges(spark, rows):
    sizes = sorted(r["count"] for r in scan.ranged(rows[1], [], [F.col("o"), F.col("id")]).groupBy("__range").count().collect())
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_reach_of_many_seeds(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(130)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for s in range(0, 150):
        hops = {s: 0}
        for hop in (1, 2, 3):
            for x in [x for x, h in hops.items() if h == hop - 1]:
                for y in near.get(x, ()):
                    hops.setdefault(y, hop)
        want |= {(s, x, h) for x, h in hops.items() if h}
    got = graph.neighbours(spark.createDataFrame(edges, "src long, dst long"), spark.range(150).toDF("seed").union(spark.range(3)), 3)
    assert sorted(tuple(r) for r in got.select("seed", "node", "hop").collect()) == sorted(want)


def test_sums(spark, rows):
    made, df = rows
    want = {}
    for own in by_group(made).values():
        total = 0
        for r in own:
            total += r[2] % 7
            want[r[2]] = total
    got = scan.summed(df, [F.col("g")], [F.col("o"), F.col("id")], {"s": F.col("id") % 7, "n": F.lit(1)})
    assert got.columns == ["g", "o", "id", "v", "s", "n"] and {r["id"]: r["s"] for r in got.collect()} == want


def packed(lengths, most, gap):
    out, used, window = [], 0, 1
    for n in lengths:
        if used > 0 and used + n > most:
            window, used = window + 1, 0
        used += n + gap
        out.append(window)
    return out


def test_windows(spark, rows):
    made, df = rows
    length = F.when(F.col("id") % 11 == 0, F.lit(None).cast("int")).otherwise((F.col("o") % 97).cast("int"))
    size = lambda r: 0 if r[2] % 11 == 0 else r[1] % 97
    for most in (60, 500):
        want = {r[2]: w for own in by_group(made).values() for r, w in zip(own, packed([size(r) for r in own], most, 2), strict=True)}
        got = scan.windows(df, [F.col("g")], [F.col("o"), F.col("id")], length, most, 2, "w")
        assert got.columns == ["g", "o", "id", "v", "w"] and {r["id"]: r["w"] for r in got.collect()} == want
    assert scan.windows(df.limit(0), [], [F.col("id")], F.lit(1), 5, 1, "w").count() == 0
    with pytest.raises(ValueError):
        scan.windows(df, [], [F.col("id")], F.lit(1), 5, 0, "w")


def test_giant_groups_have_the_windows_of_the_fold(spark, rows):
    _, df = rows
    from quillstone.operators import hierarchy

    texts = df.withColumn("t", F.repeat(F.lit("x"), (F.col("o") % 97).cast("int")))
    find = lambda giant: {tuple(r) for r in hierarchy.parent_windows(texts, ["g"], [F.col("o")], "id", "t", 120, giant).collect()}
    assert find(10_000) == find(50) == find(0)
