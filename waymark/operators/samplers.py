"""Training batches as tables: which item goes to which batch.

Positions in the epoch come from ranks within cells and from counts of cells. Where a cap says how many members of a cell can
take part, each task keeps only so many before the shuffle; else a heavy cell is ranked in parts. The order of pairs or draws across cells is numbered in two steps (ranks within rounds, offsets of rounds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.vectors import class_balance
from waymark.operators.relational import ranked
from waymark.operators.splits import shuffled


def _numbered(df: DataFrame, rounds: str, order: Sequence) -> DataFrame:
    """df with `pos`, dense from 0 by (rounds, order): ranks within a round plus the sizes of the rounds before."""
    inside = df.withColumn("__i", F.row_number().over(Window.partitionBy(rounds).orderBy(*order)) - 1)
    n = df.groupBy(rounds).agg(F.count("*").alias("__n"))
    ahead = n.select(rounds, (F.sum("__n").over(Window.orderBy(rounds)) - F.col("__n")).alias("__ahead"))
    return inside.join(ahead, rounds).withColumn("pos", F.col("__ahead") + F.col("__i")).drop("__i", "__ahead")


def _first(rows: DataFrame, key: str, most: int | None, seed: int) -> DataFrame:
    """rows (key, c) with r, the rank in the shuffled cell from 0; only the first `most` of a cell, where a number is given."""
    if most is None:
        return ranked(rows, ["c"], shuffled(key, seed), key).select(*rows.columns, (F.col("rank") - 1).alias("r"))
    w = Window.partitionBy("c").orderBy(shuffled(key, seed), key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).select(*rows.columns, (F.col("__r") - 1).alias("r"))


def pair_batches(rows: DataFrame, key: str, cell: Sequence[str], batch_size: int, cap: int = 1157, drop_last: bool = True, seed: int = 0) -> DataFrame:
    """(batch, pos, first, second): consecutive members of a shuffled cell form pairs, at most `cap` a cell; the cells take turns."""
    if batch_size % 2:
        raise ValueError("pairs don't fill a batch of odd size")
    members = _first(rows.select(key, F.struct(*cell).alias("c")), key, 2 * cap, seed)
    pairs = members.withColumn("pair", F.floor(F.col("r") / 2)).groupBy("c", "pair").agg(F.min_by(key, "r").alias("first"), F.max_by(key, "r").alias("second"), F.count("*").alias("n")).where((F.col("n") == 2) & (F.col("pair") < cap))
    order = [F.md5(F.concat(F.lit(f"{seed}|"), F.to_json("c"))), F.col("c")]
    placed = _numbered(pairs, "pair", order)
    per = batch_size // 2
    out = placed.withColumn("batch", F.floor(F.col("pos") / per))
    if drop_last:
        total = pairs.agg(F.count("*").alias("__t"))
        out = out.crossJoin(F.broadcast(total)).where(F.col("batch") < F.floor(F.col("__t") / per))
    return out.select("batch", "pos", "first", "second")


def pk_batches(rows: DataFrame, key: str, cell: Sequence[str], batch_size: int, per_cell: int = 4, cap: int | None = None, drop_last: bool = True, seed: int = 0) -> DataFrame:
    """(batch, slot, j, item): P cells with K items each. A cell is drawn max(1, min(size, cap) // K) times and goes through its
    shuffled members in turn; cells smaller than K repeat members, cells of one are left out."""
    if batch_size % per_cell:
        raise ValueError("a batch must hold whole cells of per_cell items")
    every = rows.select(F.col(key).alias("item"), F.struct(*cell).alias("c"))
    members = _first(every, "item", max(cap, per_cell) if cap else None, seed)
    sizes = every.groupBy("c").agg(F.count("*").alias("size")).where("size >= 2")
    take = F.col("size") if cap is None else F.least(F.col("size"), F.lit(cap))
    draws = sizes.select("c", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(1), F.floor(take / per_cell)) - 1)).alias("draw"))
    placed = _numbered(draws, "draw", [F.md5(F.concat(F.lit(f"{seed}|"), F.to_json("c"))), F.col("c")]).withColumnRenamed("pos", "slot")
    p = batch_size // per_cell
    placed = placed.withColumn("batch", F.floor(F.col("slot") / p))
    if drop_last:
        total = draws.agg(F.count("*").alias("__t"))
        placed = placed.crossJoin(F.broadcast(total)).where(F.col("batch") < F.floor(F.col("__t") / p))
    wanted = placed.select("batch", "slot", "c", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))).alias("j"), F.col("draw"), F.col("size")).withColumn("r", F.pmod(F.col("draw") * per_cell + F.col("j"), F.col("size")))
    return wanted.join(members, ["c", "r"]).select("batch", "slot", "j", "item")


def class_weights(rows: DataFrame, cell: Sequence[str], beta: float) -> DataFrame:
    """(cell..., n, weight): class-balanced weights whose mean over the cells is 1."""
    n = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    raw = n.withColumn("__w", class_balance(F.col("n"), beta))
    mean = raw.agg(F.avg("__w").alias("__m"))
    return raw.crossJoin(F.broadcast(mean)).select(*cell, "n", (F.col("__w") / F.col("__m")).alias("weight"))
