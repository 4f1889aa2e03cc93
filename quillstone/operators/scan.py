"""Order over groups of any size: numbers, sums and carried values by a two-level prefix scan, and greedy windows from them.

Rows are dealt by ranges of (group, order), so that a group of any size spreads over tasks and every range follows the one before it.
Each range is scanned for itself; a summary of each range and group (its rows, its last value) is scanned over the ranges, and what
came before is added back. Only groups that continue over a border have such a summary: at most one for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import store


def ranged(rows: DataFrame, group: list[Column], order: list[Column]) -> DataFrame:
    """rows with __g (the group), __o (the order) and __range: sorted ranges, written, so that every later step sees the same ones."""
    keyed = rows.withColumn("__g", F.struct(*[g.alias(f"g{i}") for i, g in enumerate(group)]) if group else F.lit(0)).withColumn("__o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    dealt = keyed.repartitionByRange("__g", "__o").withColumn("__range", F.spark_partition_id())
    return store.spill(dealt, "ranges")


def _over_borders(summary: DataFrame) -> DataFrame:
    """Summaries of groups that lie in several ranges; a broadcast of at most two rows for each range (its first and last group)."""
    w = W.partitionBy("__g")
    return summary.withColumn("__n", F.count("*").over(w)).filter("__n > 1").drop("__n")


def numbers(rows: DataFrame, group: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in its group, from 1. The order should tell all rows apart."""
    held = ranged(rows, group, order)
    counts = _over_borders(held.groupBy("__range", "__g").agg(F.count("*").alias("__rows")))
    earlier = F.coalesce(F.sum("__rows").over(W.partitionBy("__g").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__range", "__g", earlier.alias("__before"))
    own = held.withColumn("__place", F.row_number().over(W.partitionBy("__range", "__g").orderBy("__o")))
    out = own.join(F.broadcast(counts), ["__range", "__g"], "left").withColumn(name, F.col("__place") + F.coalesce("__before", F.lit(0)))
    return out.select(*rows.columns, name)


def carried(rows: DataFrame, group: list[Column], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null, up to and with each row of its group."""
    held = ranged(rows.withColumn("__v", value), group, order)
    last = held.groupBy("__range", "__g").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__o"))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(W.partitionBy("__g").orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    last = _over_borders(last).select("__range", "__g", before.alias("__before"))
    up_to = F.last("__v", ignorenulls=True).over(W.partitionBy("__range", "__g").orderBy("__o").rowsBetween(W.unboundedPreceding, 0))
    out = held.withColumn("__seen", up_to).join(F.broadcast(last), ["__range", "__g"], "left")
    return out.withColumn(name, F.coalesce("__seen", "__before")).select(*rows.columns, name)


def summed(rows: DataFrame, group: list[Column], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds for each value its sum up to and with each row of its group."""
    named = rows.select("*", *(v.alias(f"__v_{name}") for name, v in values.items()))
    held = ranged(named, group, order)
    sums = _over_borders(held.groupBy("__range", "__g").agg(*(F.sum(f"__v_{name}").alias(f"__s_{name}") for name in values)))
    before = W.partitionBy("__g").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("__range", "__g", *(F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0)).alias(f"__b_{name}") for name in values))
    within = W.partitionBy("__range", "__g").orderBy("__o").rowsBetween(W.unboundedPreceding, 0)
    out = held.select("*", *(F.sum(f"__v_{name}").over(within).alias(f"__u_{name}") for name in values)).join(F.broadcast(sums), ["__range", "__g"], "left")
    return out.select(*rows.columns, *((F.col(f"__u_{name}") + F.coalesce(f"__b_{name}", F.lit(0))).alias(name) for name in values))


def windows(rows: DataFrame, group: list[Column], order: list[Column], length: Column, most: int, gap: int, name: str) -> DataFrame:
    """Adds the number of each row's window, from 1: rows in order packed whole while a window's lengths, each with gap more, and the next length stay within most.

    The rule of `greedy_groups` for groups of any size. Every row's successor, the first row that a window begun there can't hold,
    follows from running sums by one pass over the sums and the bounds merged; pointer doubling marks the successors that are met from
    the first row: as many rounds as the logarithm of a group's windows. The order should tell all rows apart, gap be at least 1; a
    null length is 0, a row longer than a window stands alone.
    """
    if gap < 1:
        raise ValueError("gap must be at least 1")
    size = F.coalesce(length, F.lit(0)).cast("long") + gap
    base = rows.select("*", F.struct(*[g.alias(f"g{i}") for i, g in enumerate(group)] or [F.lit(0)]).alias("__h"), size.alias("__size"))
    placed = store.spill(summed(base, group, order, {"__at": F.lit(1), "__upto": F.col("__size")}), "placed")
    sums = placed.select("__h", F.col("__upto").alias("value"), F.lit(1).alias("kind"), "__at")
    bounds = placed.select("__h", (F.col("__upto") - F.col("__size") + most + gap).alias("value"), F.lit(0).alias("kind"), "__at")
    # by falling value the last sum before a bound is the first one above it in the rows' order; at equal values the bound comes first
    met = carried(sums.unionByName(bounds), [F.col("__h")], [-F.col("value"), F.col("kind"), F.col("__at")], F.when(F.col("kind") == 1, F.col("__at")), "above").filter("kind = 0 AND above IS NOT NULL")
    jumps = store.spill(met.select("__h", "__at", F.greatest(F.col("above"), F.col("__at") + 1).alias("to")), "jumps")
    starts, new = None, placed.filter("__at = 1").select("__h", "__at")
    while True:
        starts = store.spill(new if starts is None else starts.unionByName(new), "starts")
        new = store.spill(starts.join(jumps, ["__h", "__at"]).select("__h", F.col("to").alias("__at")), "new-starts")
        if new.isEmpty():
            break
        jumps = store.spill(jumps.alias("a").join(jumps.select("__h", F.col("__at").alias("to"), F.col("to").alias("further")), ["__h", "to"]).select("__h", "__at", F.col("further").alias("to")), "jumps")
    marked = placed.join(starts.withColumn("__first", F.lit(1)), ["__h", "__at"], "left")
    out = summed(marked, [F.col("__h")], [F.col("__at")], {name: F.coalesce("__first", F.lit(0))})
    return out.select(*rows.columns, name)
