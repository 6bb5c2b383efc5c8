"""Hash-threshold histograms: the part of each group, in hash order, that fits a budget, found without sorting.

Sizes are summed by (group, leading bits of the hash): the sums merge by addition, and a group costs at most 4096 rows however
large it is. Running sums give the bucket in which a budget ends; only that bucket's items are looked at again, by the next
bits; what is left is one cell of one in 16 million of a group, whose items are put in order. The result per budget is a single
hash value: items up to it are in. Budgets of one group are nested, as they cut the same order.

Budgets and the cells where they end are one row a budget; more than MAX_BUDGETS are an error, so what is broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.runtime import bounded_table

MAX_BUDGETS = 100_000
BITS = 12
LOWEST = -(2**63)


def hash_of(key: Column | str, seed: int) -> Column:
    """A hash in the order of signed numbers."""
    return F.xxhash64(F.lit(seed), key)


def _bucket(h: Column, level: int) -> Column:
    """The level-th group of bits, so that (bucket 0, bucket 1, h) sorts as h does."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(LOWEST)), 64 - BITS * (level + 1)).bitwiseAND(F.lit(2**BITS - 1))


def _edge(cells: DataFrame, plan: list[str], bucket: str) -> DataFrame:
    """Of cells with `left` (what the budget had before them) and `size`: the first bucket that doesn't fit whole, with what is left there."""
    w = Window.partitionBy(*plan).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.withColumn("upto", F.sum("size").over(w)).where("upto > left")
    first = run.groupBy(*plan).agg(F.min_by(F.struct(bucket, (F.col("left") - F.col("upto") + F.col("size")).alias("left")), bucket).alias("e"))
    return first.select(*plan, f"e.{bucket}", "e.left")


def histogram(items: DataFrame) -> DataFrame:
    """(g, b0, size): sizes summed by group and leading bits, at most 4096 rows a group."""
    return items.groupBy("g", _bucket(F.col("h"), 0).alias("b0")).agg(F.sum("size").cast("double").alias("size"))


def budget_thresholds(items: DataFrame, budgets: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """items: g, h, size (>= 0); budgets: plan, g, budget (one row each); sums: the items' histogram, if it is there already.

    (plan, g, tau): the items of g with h <= tau are the longest beginning of g in hash order whose sizes add up to at most
    budget. tau is null where all of g fits (h <= tau must then be read as true) and the lowest number where nothing does."""
    items = items.withColumns({"b0": _bucket(F.col("h"), 0), "b1": _bucket(F.col("h"), 1)})
    plan = ["plan", "g"]
    budgets = bounded_table(budgets.select("plan", "g", F.col("budget").cast("double").alias("left")), MAX_BUDGETS, "the table of budgets")
    sums = histogram(items) if sums is None else sums
    edge0 = bounded_table(_edge(sums.join(budgets, "g"), plan, "b0"), MAX_BUDGETS, "the list of buckets")
    sums = items.join(F.broadcast(edge0.select("g", "b0").distinct()), ["g", "b0"]).groupBy("g", "b0", "b1").agg(F.sum("size").cast("double").alias("size"))
    edge1 = bounded_table(_edge(sums.join(edge0, ["g", "b0"]), [*plan, "b0"], "b1"), MAX_BUDGETS, "the list of cells")
    cell = items.join(edge1, ["g", "b0", "b1"])
    w = Window.partitionBy(*plan).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = cell.withColumn("upto", F.sum("size").over(w)).groupBy(*plan).agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("h"))).alias("tau"))
    floor = F.shiftleft(F.col("b0") * F.lit(2**BITS) + F.col("b1"), 64 - 2 * BITS).bitwiseXOR(F.lit(LOWEST))
    below = F.when(floor > F.lit(LOWEST), floor - 1).otherwise(F.lit(LOWEST))  # everything under the cell is in
    cut = edge1.select(*plan, below.alias("below")).join(inside, plan, "left").select(*plan, F.coalesce("tau", "below").alias("tau"))
    return budgets.select(*plan).join(cut, plan, "left")
