"""Retrieval queries with their ground truth.

ground_truth() gives one row per relevant row, at any size. The operators that give lists are for query files: a list of more than
MAX_LIST entries is an error, so no group is gathered without a bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import display_country, query_text, training_caption
from waymark.runtime import cut_lineage, join_counted


MAX_LIST = 1_000_000


def short_groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows as they are; an error where a group has more than MAX_LIST of them."""
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0]
    if (most or 0) > MAX_LIST:
        raise ValueError(f"a list of {most} entries; ask for ground_truth() rows instead")
    return rows


def _queries(groups: DataFrame, granularity: str) -> list[Column]:
    return [F.concat_ws("|", "category", "geo").alias("stratify_key"), query_text(granularity, F.col("category"), F.col("geo")).alias("text"), F.col("category"), F.col("geo"), F.lit(granularity).alias("granularity")]


def ground_truth(rows: DataFrame, granularity: str, geo: str, category: str = "category", row: str = "row_idx", min_relevant: int = 5) -> DataFrame:
    """(stratify_key, text, category, geo, granularity, n_relevant, row): each relevant row of each query of at least min_relevant rows.

    Null categories and geos give no query. Rows of a heavy group aren't shuffled."""
    own = rows.where(F.col(category).isNotNull() & F.col(geo).isNotNull()).select(F.col(category).alias("category"), F.col(geo).alias("geo"), row)
    groups = cut_lineage(own.groupBy("category", "geo").agg(F.count("*").alias("n")))
    found = join_counted(own, groups.withColumn("n_relevant", F.col("n")), ["category", "geo"]).where(F.col("n_relevant") >= min_relevant)
    return found.select(*_queries(found, granularity), "n_relevant", row)


def build_queries(rows: DataFrame, granularity: str, geo: str, category: str = "category", row: str = "row_idx", min_relevant: int = 5) -> DataFrame:
    """(stratify_key, text, category, geo, granularity, relevant): one per (category, geo) of at least min_relevant rows, which are
    listed in order. Null categories and geos give no query."""
    own = rows.where(F.col(category).isNotNull() & F.col(geo).isNotNull()).select(F.col(category).alias("category"), F.col(geo).alias("geo"), row)
    groups = short_groups(own, ["category", "geo"]).groupBy("category", "geo").agg(F.sort_array(F.collect_list(row)).alias("relevant"))
    return groups.where(F.size("relevant") >= min_relevant).select(*_queries(groups, granularity), "relevant")


def templated_grid(countries: DataFrame, categories: DataFrame, rows: DataFrame, item: str) -> DataFrame:
    """Every category in every country of two fixed lists, with the matching items; no match is an empty list."""
    grid = countries.select("country", "region").crossJoin(F.broadcast(categories.select("category")))
    truth = short_groups(rows, ["category", "country"]).groupBy("category", "country").agg(F.sort_array(F.collect_list(item)).alias("relevant"))
    full = grid.join(truth, ["category", "country"], "left")
    return full.select(training_caption(F.col("category"), F.col("country")).alias("text"), "category", F.col("country").alias("raw_country"), display_country(F.col("country")).alias("country"), "region", F.coalesce("relevant", F.array().cast(truth.schema["relevant"].dataType)).alias("relevant"))


def fan_out(queries: DataFrame, variants: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Each variant text becomes a row with all keys of its query; queries without variants give none."""
    return queries.drop("text").join(variants.select(*on, F.explode(column).alias("text")), list(on))


def marginal_queries(rows: DataFrame, axis: str, template: str, row: str, min_relevant: int = 5, display: Column | None = None) -> DataFrame:
    """(key, text, n_relevant): one query per value of a single attribute; null and '' give none."""
    n = rows.where(F.coalesce(F.col(axis), F.lit("")) != "").groupBy(F.col(axis).alias("key")).agg(F.count(row).alias("n_relevant")).where(F.col("n_relevant") >= min_relevant)
    shown = display_country(F.col("key")) if axis == "country" else F.col("key")
    return n.select("key", F.format_string(template, shown).alias("text"), "n_relevant")


def translate(relevant: DataFrame, items: DataFrame, item: str, row: str) -> DataFrame:
    """relevant: query_id and item, one row each. (query_id, item, row): row is null where the item isn't in the index."""
    return relevant.select("query_id", item).join(items.select(item, row), item, "left").select("query_id", item, row)


def usable_queries(translated: DataFrame, row: str, min_relevant: int) -> DataFrame:
    """(query_id, n_found, n_missing, kept): misses don't count for the minimum."""
    per = translated.groupBy("query_id").agg(F.count(row).alias("n_found"), F.count(F.when(F.col(row).isNull(), 1)).alias("n_missing"))
    return per.withColumn("kept", F.col("n_found") >= min_relevant)


def mined_targets(ranking: DataFrame, meta: DataFrame, max_score: float = 0.95) -> DataFrame:
    """After the top-k, not before: not the seed itself, below max_score, same category, another country.

    meta: vec_id, category, country, continent. Null attributes match nothing."""
    ref = meta.select(F.col("vec_id").alias("query_id"), F.col("category").alias("ref_category"), F.col("country").alias("ref_country"), F.col("continent").alias("ref_continent"))
    joined = ranking.join(ref, "query_id").join(meta, "vec_id")
    return joined.where((F.col("vec_id") != F.col("query_id")) & (F.col("score") < max_score) & (F.col("category") == F.col("ref_category")) & (F.col("country") != F.col("ref_country")))


def composed_queries(targets: DataFrame, level: str) -> DataFrame:
    """(query_id, granularity, caption, ref_id, target_ids): one per seed and target country, or per other continent."""
    rows = targets if level == "country" else targets.where("continent <> ref_continent")
    mark = {"country": "c1", "continent": "c2"}[level]
    g = short_groups(rows, ["query_id", level]).groupBy(F.col("query_id").alias("ref_id"), F.col(level).alias("geo")).agg(F.sort_array(F.collect_list("vec_id")).alias("target_ids"))
    name = F.concat(F.lit("sub_"), F.col("ref_id"), F.lit("_q_"), F.col("ref_id"), F.lit(f"_{mark}_"), F.col("geo"))
    return g.select(name.alias("query_id"), F.lit(level).alias("granularity"), F.concat(F.lit("similar landmark located in "), F.col("geo")).alias("caption"), "ref_id", "target_ids")
