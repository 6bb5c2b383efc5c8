"""Splits and samples in a reproducible order: md5 of seed and id, then the id. The same input gives the same rows on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.relational import dominant, keep_best, ranked


def shuffled(key: str | Column, seed: int) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def url_disjoint_split(rows: DataFrame, url: str, cell: Sequence[str], small: int = 5, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """(url, cell..., n, split): each url goes as a whole to one split, by quota within the cell that most of its rows have.

    Cells of fewer than `small` urls are for training only; else test and validation get max(1, rint(share * W)) urls each."""
    home = ranked(dominant(rows.where(F.col(url).isNotNull()), url, cell), cell, shuffled(url, seed), url).withColumnRenamed("group_size", "w")
    quota = lambda f: F.when(F.col("w") >= small, F.greatest(F.lit(1.0), F.rint(F.lit(f) * F.col("w")))).otherwise(0).cast("bigint")
    split = F.when(F.col("w") < small, "train").when(F.col("rank") <= quota(test), "test").when(F.col("rank") <= quota(test) + quota(val), "val").otherwise("train")
    return home.select(url, *cell, "n", "w", split.alias("split"))


def stratified_split(rows: DataFrame, key: str, cell: Sequence[str], share: float = 0.1, least: int = 10, seed: int = 42) -> DataFrame:
    """Rows with is_test: the first floor(share * size) of each cell that has at least `least` rows."""
    r = ranked(rows, cell, shuffled(key, seed), key)
    return r.select(*rows.columns, ((F.col("group_size") >= least) & (F.col("rank") <= F.floor(F.lit(share) * F.col("group_size")))).alias("is_test"))


def stratified_random_split(rows: DataFrame, key: str, label: str, test: float = 0.2, val: float = 0.3, seed: int = 42) -> DataFrame:
    """Rows with split: of each label the share `test` is for testing, of what that leaves the share `val` for validation.

    Within a label the numbers are exact to a row: rint(test * n), then rint(val * the rest). Null is a label like others."""
    r = ranked(rows, [label], shuffled(key, seed), key)
    first = F.rint(F.lit(test) * F.col("group_size"))
    second = first + F.rint(F.lit(val) * (F.col("group_size") - first))
    return r.select(*rows.columns, F.when(F.col("rank") <= first, "test").when(F.col("rank") <= second, "val").otherwise("train").alias("split"))


def random_split(rows: DataFrame, key: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows with split: a hash of the key decides, so no order is needed; val is a share of what test leaves."""
    u = F.conv(F.substring(shuffled(key, seed), 1, 8), 16, 10).cast("double") / 2**32
    return rows.withColumn("split", F.when(u < test, "test").when(u < test + (1 - test) * val, "val").otherwise("train"))


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of the shuffled order; a top-n per task, then one merge."""
    return rows.orderBy(shuffled(key, seed), key).limit(n)


def shard(rows: DataFrame, number: str, shards: int, which: int) -> DataFrame:
    return rows.where(F.pmod(F.col(number), F.lit(shards)) == which)


def balanced_seeds(rows: DataFrame, key: str, category: str, continent: str, country: str, entity: str, total: int, seed: int = 42) -> DataFrame:
    """One row per (category, continent, country, entity), then equal quotas per (category, continent) and, within, per country."""
    order = [shuffled(key, seed), F.col(key)]
    one = keep_best(rows, [category, continent, country, entity], F.struct(*order), least=True)
    cells = one.select(category, continent).distinct().agg(F.count("*").alias("__cells"))
    countries = one.groupBy(category, continent).agg((F.count_distinct(country) + F.max(F.when(F.col(country).isNull(), 1).otherwise(0))).alias("__countries"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("__cells")))
    sized = one.alias("o").join(countries.alias("c"), F.col(f"o.{category}").eqNullSafe(F.col(f"c.{category}")) & F.col(f"o.{continent}").eqNullSafe(F.col(f"c.{continent}"))).select("o.*", "c.__countries").crossJoin(F.broadcast(cells))
    in_country = F.row_number().over(Window.partitionBy(category, continent, country).orderBy(*order))
    # no cell or country gives more than the total, so each task keeps only so many of a group before the shuffle
    kept = sized.withColumn("__i", in_country).where(F.col("__i") <= total).withColumn("__q", quota).where(F.col("__i") <= F.greatest(F.lit(1), F.floor(F.col("__q") / F.col("__countries"))))
    in_cell = F.row_number().over(Window.partitionBy(category, continent).orderBy(F.col("__i"), F.col(country).asc_nulls_first(), *order))
    return kept.withColumn("__j", in_cell).where(F.col("__j") <= total).where("__j <= __q").select(*rows.columns)
