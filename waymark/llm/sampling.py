"""Samples whose shares by category come out as asked.

One pass over the pool: its rows are brought together by entity (combined before the shuffle), so each task holds whole entities,
counts them, and maintains a reservoir for each category asked for: the entities of smallest hash, at most as many as any plan can
want (a bound known from the number of rows before the pass). Reservoirs merge by union, and a task's is as good as the whole's for
the entities it has. They are written once to the shared folder; what follows reads only them.

After the final counts a quota is feasible up to what there is. Trimming a merged reservoir to its quota lowers one hash threshold
(waymark.llm.thresholds), so it is uniform, and no task or driver ever holds a category. A category that is drawn whole and falls
short is exhausted. Every entity of a category has the same chance; repeated rows of an entity count once.

Null entities and null labels are in no category. Targets of unknown fields or labels have nothing available.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.thresholds import budget_thresholds, hash_of, histogram
from waymark.runtime import bounded_rows, cut_lineage

SEED = 11
MAX_TARGETS = 10_000
#: Members that a task gathers before it trims its reservoirs.
GATHER = 2_000_000


def plain(c: str):
    """A label without case and outer blanks."""
    return F.lower(F.regexp_replace(F.col(c), r"^[\s ]+|[\s ]+$", ""))


def _group():
    return F.concat_ws("\x1f", "field_name", "label")


def _wanted(least: int | None, share: float | None, fraction: float | None, n: int) -> float:
    return max(float(least or 0), (share or 0.0) * (fraction or 0.0) * n, 0.0)


def reservoirs(pool: DataFrame, entity: str, fields: list[str], capacity: dict[str, int], seed: int = SEED) -> DataFrame:
    """(g, h, entity, n): the members of each reservoir by task (n null), and how many entities each task saw in all of a
    category (g) and in the whole pool (g null). capacity: by category, named as field, \\x1f and label."""
    labels = F.array(*[F.concat(F.lit(f + "\x1f"), plain(f)) for f in fields])
    rows = pool.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), labels.alias("labels"))
    held = rows.groupBy("entity").agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("labels"))
    names = sorted(capacity)
    most = np.array([capacity[x] for x in names], np.int64)
    asked = pa.array(names, pa.string())

    def trim(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, g))
        own = g[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        return order[rank < most[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = 0, np.zeros(len(names), np.int64)
        g, h, who = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            total += batch.num_rows
            flat = batch.column(2).flatten()
            of = pc.list_parent_indices(batch.column(2)).to_numpy().astype(np.int64)
            at = pc.index_in(flat, asked)
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            of, at = of[known], at.drop_null().to_numpy().astype(np.int64)
            count += np.bincount(at, minlength=len(names))
            whole = batch.column(0).take(pa.array(of))
            g, h = np.concatenate([g, at]), np.concatenate([h, batch.column(1).to_numpy()[of]])
            who = whole if who is None else pa.concat_arrays([who, whole])
            if len(g) > GATHER:
                keep = trim(g, h)
                g, h, who = g[keep], h[keep], who.take(pa.array(keep))
        yield pa.record_batch([pa.array([*names, None], pa.string()), pa.nulls(len(names) + 1, pa.int64()), pa.nulls(len(names) + 1, kind), pa.array([*count.tolist(), total], pa.int64())], names=["g", "h", "entity", "n"])
        keep = trim(g, h)
        if len(keep):
            yield pa.record_batch([asked.take(pa.array(g[keep])), pa.array(h[keep]), who.take(pa.array(keep)), pa.nulls(len(keep), pa.int64())], names=["g", "h", "entity", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(pool.schema[entity].dataType)
    simple = pool.schema[entity].dataType.simpleString()
    return held.select("entity", hash_of(F.col("entity"), seed).alias("h"), "labels").mapInArrow(run, f"g string, h bigint, entity {simple}, n bigint")


class Draw:
    """The reservoirs of a pool, kept, and what each target asks of them."""

    def __init__(self, pool: DataFrame, targets: DataFrame, entity: str, fields: list[str], seed: int = SEED) -> None:
        named = targets.withColumn("label", plain("field_value")).withColumn("g", _group())
        asked = bounded_rows(named.select("plan_id", "field_name", "field_value", "label", "g", "target_share", "sample_fraction", "min_rows"), MAX_TARGETS, "the table of targets")
        rows = pool.count()
        capacity: dict[str, int] = {}
        for r in asked:
            if r["field_name"] in fields and r["label"] is not None:
                capacity[r["g"]] = max(capacity.get(r["g"], 0), ceil(_wanted(r["min_rows"], r["target_share"], r["sample_fraction"], rows)))
        self.kept = cut_lineage(reservoirs(pool, entity, fields, capacity, seed))
        self.items = self.kept.where("n is null").select("g", "h", F.lit(1).alias("size"), "entity")
        seen = {r["g"]: r["n"] for r in bounded_rows(self.kept.where("n is not null").groupBy("g").agg(F.sum("n").alias("n")), MAX_TARGETS + 1, "the list of categories")}
        n = seen.get(None, 0)
        out = []
        for r in asked:
            wanted, there = _wanted(r["min_rows"], r["target_share"], r["sample_fraction"], n), seen.get(r["g"], 0) if r["label"] is not None else 0
            out.append((r["g"], r["plan_id"], r["field_name"], r["field_value"], wanted, there, min(ceil(wanted - 1e-9), there), wanted <= there))
        kinds = {f.name: f.dataType.simpleString() for f in targets.schema}
        shape = f"g string, plan_id {kinds['plan_id']}, field_name {kinds['field_name']}, field_value {kinds['field_value']}, wanted double, available bigint, quota bigint, met boolean"
        self.asked = targets.sparkSession.createDataFrame(out, shape)

    def trimmed(self) -> DataFrame:
        """(plan, g, tau) of the reservoirs trimmed to their quotas: one row a target."""
        budgets = self.asked.withColumn("plan", F.struct("plan_id", "field_name", "field_value")).groupBy("plan", "g").agg(F.max("quota").alias("budget"))
        return budget_thresholds(self.items.drop("entity"), budgets, histogram(self.items))


def quotas(pool: DataFrame, targets: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """Per target: wanted = max(min_rows, share * fraction * N), available distinct entities, quota = what is drawn, met.

    N counts all distinct entities. An empty pool meets only a target of 0."""
    return Draw(pool, targets, entity, fields).asked.drop("g")


def draw(pool: DataFrame, targets: DataFrame, entity: str, fields: list[str], seed: int = SEED) -> DataFrame:
    """(plan_id, field_name, field_value, entity): every plan's sample, exactly its quotas."""
    return _drawn(Draw(pool, targets, entity, fields, seed)).withColumnRenamed("entity", entity)


def _drawn(d: Draw) -> DataFrame:
    return d.items.join(F.broadcast(d.trimmed()), "g").where("tau is null or h <= tau").select("plan.plan_id", "plan.field_name", "plan.field_value", "entity")


def exhausted(pool: DataFrame, targets: DataFrame, entity: str, fields: list[str], seed: int = SEED) -> DataFrame:
    """(plan_id, field_name, field_value, wanted, available) of the targets whose reservoir is drawn whole and still falls short."""
    d = Draw(pool, targets, entity, fields, seed)
    asked = d.asked.withColumn("plan", F.struct("plan_id", "field_name", "field_value"))
    return asked.join(F.broadcast(d.trimmed()), ["plan", "g"]).where("tau is null and not met").select("plan_id", "field_name", "field_value", "wanted", "available")


def report(pool: DataFrame, targets: DataFrame, entity: str, fields: list[str], seed: int = SEED) -> DataFrame:
    """Per target what was wanted, what there is, what was drawn, and the share reached of the plan's sample."""
    d = Draw(pool, targets, entity, fields, seed)
    key = ["plan_id", "field_name", "field_value"]
    got = _drawn(d).groupBy(*key).agg(F.count("*").alias("drawn"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    r = d.asked.alias("a").join(got.alias("b"), same, "left").select("a.*", F.coalesce("b.drawn", F.lit(0)).alias("drawn"))
    whole = r.groupBy("plan_id").agg(F.sum("drawn").alias("plan_drawn"))
    return r.join(whole, "plan_id").select(*key, "wanted", "available", "drawn", F.try_divide("drawn", "plan_drawn").alias("share"), "met")
