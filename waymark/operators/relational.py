"""Aggregates, de-duplication and joins that recur in curation. Ties are always broken by a unique column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.runtime import cut_lineage


def keep_best(df: DataFrame, keys: Sequence[str], order: Column, least: bool = False) -> DataFrame:
    """Per key the row of greatest (or least) order, which should be a struct that ends in a unique column; nulls are least.

    An aggregate rather than a window: it combines before the shuffle, so a heavy key, null too, is no task of its own."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.min_by if least else F.max_by)(F.struct(*rest), order)
    return df.groupBy(*keys).agg(pick.alias("__row")).select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def succeeded(error: str) -> Column:
    return F.col(error).isNull() | (F.col(error) == "")


def last_success(df: DataFrame, key: str, error: str, order: Sequence[str]) -> DataFrame:
    """Per key the last row without an error, else its last row."""
    return keep_best(df, [key], F.struct(succeeded(error).alias("__ok"), *order))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_best(df, keys, F.struct(*order), least=True)


def ranked(df: DataFrame, group: Sequence[str], order: Column, tie: str, digits: int = 3) -> DataFrame:
    """df with `rank` (from 1, by order and tie within the group) and `group_size`. order: a hexadecimal hash, as text.

    A group is ranked in parts by the first digits of the hash, which sort as the hash does, and the parts before are added: a
    heavy group is spread over 16 ** digits windows. Null group values form groups like others."""
    parts = df.withColumns({"__g": F.struct(*group), "__h": order})
    parts = parts.withColumn("__b", F.substring("__h", 1, digits))
    sizes = parts.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = sizes.select("__g", "__b", (F.sum("__n").over(w) - F.col("__n")).alias("__ahead"), F.sum("__n").over(Window.partitionBy("__g")).alias("group_size"))
    inside = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__h", tie)))
    return inside.join(ahead, ["__g", "__b"]).select(*df.columns, (F.col("__r") + F.col("__ahead")).alias("rank"), "group_size")


def running_totals(df: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """df with `upto` (sum of value to this row in the total order), `number` (from 1) and `total`, without one task for all:
    sums by range partition, then offsets. An empty table has no rows."""
    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    sums = parts.groupBy("__p").agg(F.sum(value).alias("__s"), F.count("*").alias("__c"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # as many rows as partitions
    ahead = sums.select("__p", (F.sum("__s").over(w) - F.col("__s")).alias("__before"), (F.sum("__c").over(w) - F.col("__c")).alias("__rows"), F.sum("__s").over(Window.partitionBy(F.lit(1))).alias("total"))
    inside = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = parts.withColumns({"__upto": F.sum(value).over(inside), "__k": F.row_number().over(inside)}).join(F.broadcast(ahead), "__p")
    return run.select(*df.columns, (F.col("__upto") + F.col("__before")).alias("upto"), (F.col("__k") + F.col("__rows")).cast("bigint").alias("number"), "total")


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def shares(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """n and its share of all rows, or of the rows of the `within` group. The window runs over the counts only."""
    n = counts(df, *keys)
    total = n.groupBy(*[F.col(k).alias(f"__{k}") for k in within]).agg(F.sum("n").alias("__total"))
    joined = n.crossJoin(F.broadcast(total)) if not within else n.join(total, on=[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in within])
    return joined.select(*n.columns, (F.col("n") / F.col("__total")).alias("share"))


def cumulative_shares(df: DataFrame, key: str) -> DataFrame:
    """n, share, running share and number from the most frequent value down; the totals run over distinct values only."""
    t = running_totals(counts(df, key), [F.col("n").desc(), F.col(key).asc_nulls_first()], "n")
    return t.select(key, "n", (F.col("n") / F.col("total")).alias("share"), (F.col("upto") / F.col("total")).alias("cum_share"), "number")


def distinct_count(c: str) -> Column:
    """Distinct values with null as one of them."""
    return (F.count_distinct(F.col(c)) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))).cast("bigint")


def dominant(df: DataFrame, key: str, cell: Sequence[str]) -> DataFrame:
    """Per key its most frequent cell with n; equal counts go to the smaller cell."""
    n = counts(df, key, *cell)
    return keep_best(n, [key], F.struct(-F.col("n"), *cell), least=True).select(key, *cell, "n")


def nearest_quantile(df: DataFrame, c: str, q: float) -> DataFrame:
    """One row: the value at rank rint(q (n - 1)), counted over distinct values rather than sorted rows."""
    per = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("many"))
    return running_totals(per, [F.col("v").asc()], "many").where(F.col("upto") > F.rint(F.lit(q) * (F.col("total") - 1))).agg(F.min("v").alias("value"))


def pivot_counts(df: DataFrame, key: str, by: str, values: Sequence[str]) -> DataFrame:
    """Counts of each value in a column of its own, 0 where there are none."""
    wide = df.groupBy(key).pivot(by, list(values)).agg(F.count(F.lit(1)))
    return wide.select(key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])


def top_values(df: DataFrame, c: str, most: int) -> list:
    """The `most` frequent values, most frequent first; the list has `most` entries."""
    return [r[0] for r in counts(df.where(F.col(c).isNotNull()), c).orderBy(F.col("n").desc(), c).limit(most).collect()]


def top_or_other(c: str, top: Sequence, other: str = "Other") -> Column:
    """A column that keeps the values of `top`; nulls are among the others."""
    return F.when(F.col(c).isin(list(top)), F.col(c)).otherwise(other)


def first_n(df: DataFrame, key: str, value: str, score: str, n: int) -> DataFrame:
    """Per key the n values of highest score, as a list in that order. Ranks first, so no list grows beyond n."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), F.col(value).asc())
    top = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    packed = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__r", value))).alias("__l"))
    return packed.select(key, F.transform("__l", lambda x: x[value]).alias(value))


def element_counts(df: DataFrame, values: str) -> DataFrame:
    """How often each element of an array column occurs; a null list counts as one null element, as does an empty one."""
    return counts(df.select(F.explode_outer(values).alias("value")), "value")


def fill_from(df: DataFrame, other: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Nulls of the fields filled from the matching row of `other` (one per key)."""
    o = other.select(*on, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = df.join(o, list(on), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in df.columns])


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet. Null keys are never pending."""
    return inputs.where(F.col(key).isNotNull()).join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def only_missing(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """df and the rows of `more` whose key df doesn't have, one row a key."""
    extra = more.join(df.select(key).distinct(), key, "left_anti")
    return df.unionByName(extra)


def cell_ids(df: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Dense ids from 0 of the distinct cells in order."""
    cells = df.select(*cell).distinct().withColumn("__one", F.lit(1))
    numbered = running_totals(cells, [F.col(c).asc_nulls_first() for c in cell], "__one")
    return numbered.select(*cell, (F.col("number") - 1).cast("int").alias("cell_id"))


def row_numbers(df: DataFrame, order: str, name: str = "row_idx") -> DataFrame:
    """Dense numbers from 0 in a total order, without one task for all: counts by range partition, then offsets."""
    numbered = running_totals(df.withColumn("__one", F.lit(1)), [F.col(order).asc()], "__one")
    return numbered.select(*df.columns, (F.col("number") - 1).alias(name))
