"""Contrastive losses within batches, as pair tables. A batch is small by definition; pairs never cross batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.vectors import dot


def batch_pairs(items: DataFrame) -> DataFrame:
    """items: batch, i, cell, a, b (two vectors). All ordered pairs of a batch with both products and the positive mark."""
    one = items.select("batch", F.col("i").alias("i"), F.col("cell").alias("ci"), F.col("a").alias("ai"), F.col("b").alias("bi"))
    two = items.select("batch", F.col("i").alias("j"), F.col("cell").alias("cj"), F.col("a").alias("aj"), F.col("b").alias("bj"))
    both = one.join(two, "batch")
    return both.select("batch", "i", "j", dot(F.col("ai"), F.col("bj")).alias("ab"), dot(F.col("bi"), F.col("aj")).alias("ba"), ((F.col("ci") == F.col("cj")) & (F.col("i") != F.col("j"))).alias("positive"))


def _anchor(pairs: DataFrame, product: str, temperature: float) -> DataFrame:
    z = pairs.select("batch", "i", "j", "positive", (F.col(product) / temperature).alias("z"))
    top = z.groupBy("batch", "i").agg(F.max("z").alias("m"), F.count_if("positive").alias("n"), F.sum(F.when(F.col("positive"), F.col("z"))).alias("zp"), F.max(F.when(F.col("i") == F.col("j"), F.col("z"))).alias("own"))
    total = z.join(top.select("batch", "i", "m"), ["batch", "i"]).groupBy("batch", "i").agg(F.sum(F.exp(F.col("z") - F.col("m"))).alias("e"))
    return top.join(total, ["batch", "i"]).withColumn("lse", F.col("m") + F.log("e"))


def multi_positive_infonce(pairs: DataFrame, temperature: float, weights: DataFrame | None = None) -> DataFrame:
    """(batch, loss): mean over both directions; anchors without a positive don't count; a batch without any has loss 0.

    weights: batch, i, w."""
    loss = None
    for product in ("ab", "ba"):
        a = _anchor(pairs, product, temperature).withColumn("l", F.when(F.col("n") > 0, F.col("lse") - F.col("zp") / F.col("n")))
        a = a.withColumn("w", F.lit(1.0)) if weights is None else a.join(weights, ["batch", "i"], "left")
        w = F.when(F.col("n") > 0, F.col("w"))
        one = a.groupBy("batch").agg(F.coalesce(F.sum(F.col("l") * w) / F.greatest(F.sum(w), F.lit(1e-8)), F.lit(0.0)).alias(product))
        loss = one if loss is None else loss.join(one, "batch")
    return loss.select("batch", ((F.col("ab") + F.col("ba")) / 2).alias("loss"))


def cross_entropy(pairs: DataFrame, temperature: float) -> DataFrame:
    """(batch, loss): each item's own partner is its target, both directions."""
    one = lambda product: _anchor(pairs, product, temperature).groupBy("batch").agg(F.avg(F.col("lse") - F.col("own")).alias(product))
    return one("ab").join(one("ba"), "batch").select("batch", ((F.col("ab") + F.col("ba")) / 2).alias("loss"))
