"""Sources mixed to target shares of a total size, small sources repeated up to a cap.

Tokens are summed by (source, hash bucket). A source gives floor(target / size) whole copies, and of the next copy the documents
under a hash threshold (waymark.llm.thresholds), so nothing is sorted and the mixes are nested. A source that can't reach its
target with max_repeat copies gives all it has and is reported as short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.thresholds import budget_thresholds, hash_of, histogram
from waymark.runtime import bounded_table, cut_lineage

SEED = 23
MAX_TARGETS = 10_000


def _items(sizes: DataFrame, seed: int) -> DataFrame:
    """g is the source. Documents without tokens add nothing; those without a source count in the total only."""
    return sizes.where("n_tokens > 0").withColumns({"g": F.col("source"), "h": hash_of(F.col("doc_id"), seed), "size": F.col("n_tokens")})


def _plans(sums: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: target_tokens, available_tokens (0 for absent sources), copies (whole ones), rest_tokens of one more, short."""
    per = sums.groupBy(F.col("g").alias("source")).agg(F.sum("size").cast("bigint").alias("available_tokens"))
    total = sums.agg(F.coalesce(F.sum("size").cast("bigint"), F.lit(0)).alias("total"))
    t = targets.crossJoin(F.broadcast(total)).join(per, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    t = t.withColumn("target_tokens", F.col("target_share") * F.col("total"))
    t = t.withColumn("short", F.col("available_tokens") * F.col("max_repeat") < F.col("target_tokens"))
    copies = F.when(F.col("short"), F.col("max_repeat")).when(F.col("available_tokens") == 0, 0).otherwise(F.floor(F.col("target_tokens") / F.nullif(F.col("available_tokens"), F.lit(0)))).cast("int")
    t = t.withColumn("copies", copies)
    rest = F.when(F.col("short") | (F.col("copies") >= F.col("max_repeat")), F.lit(0.0)).otherwise(F.col("target_tokens") - F.col("copies") * F.col("available_tokens"))
    return t.select("mix_id", "source", "target_share", "max_repeat", "total", "target_tokens", "available_tokens", "copies", rest.alias("rest_tokens"), "short")


def plan_mixes(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The plan of every target, without dealing the documents."""
    return _plans(histogram(_items(sizes, SEED)), targets)


def _deal(sizes: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The plans and the documents used; both from one histogram of tokens by source and hash bucket."""
    items = _items(sizes, seed)
    sums = cut_lineage(histogram(items))
    plans = bounded_table(_plans(sums, targets), MAX_TARGETS, "the table of mixes")
    budgets = plans.select(F.col("mix_id").alias("plan"), F.col("source").alias("g"), F.col("rest_tokens").alias("budget"))
    cut = budget_thresholds(items.select("g", "h", "size"), budgets, sums)
    rule = plans.join(cut.select(F.col("plan").alias("mix_id"), F.col("g").alias("source"), "tau"), ["mix_id", "source"]).select("mix_id", "source", "copies", "rest_tokens", "tau")
    once_more = F.when((F.col("rest_tokens") > 0) & (F.col("tau").isNull() | (F.col("h") <= F.col("tau"))), 1).otherwise(0)
    return plans, items.join(F.broadcast(rule), "source").select("mix_id", "source", "doc_id", "n_tokens", (F.col("copies") + once_more).alias("copies")).where("copies > 0")


def mix(sizes: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, copies): every document that a mix uses, and how often. Documents without tokens aren't used."""
    return _deal(sizes, targets, seed)[1]


def mix_report(sizes: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """Per target the tokens and share reached."""
    plans, dealt = _deal(sizes, targets, seed)
    got = dealt.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    t = plans.join(got, ["mix_id", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("reached_tokens", "n_documents", "most_copies")})
    return t.select("mix_id", "source", "target_share", "max_repeat", "available_tokens", "target_tokens", "reached_tokens", F.try_divide("reached_tokens", "total").alias("reached_share"), "n_documents", "most_copies", "short")
