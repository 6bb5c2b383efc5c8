"""Containers of fixed capacity filled with items of varying length.

Only the histogram of lengths goes to the driver: at most `capacity` numbers, however many items there are. Two plans come from it:

* filled_buckets, the default: a dynamic programme chooses the bucket boundaries that leave least padding, where each bucket costs
  1/64 of a container besides, so that a boundary has to be worth it. Every item takes the room of its bucket's boundary.
  Batches form under the token budget inside each bucket, from the longest down, and the room that a bucket's batches leave goes to
  the next shorter buckets it fits before these open batches of their own.
* length_buckets: the same programme for buckets that never share a batch: it counts whole batches, so long items leave much open.
* best_fit: every length is a bucket of its own, so nothing is padded; what the others can be measured against.

Items get a rank within their length (hash buckets of bounded size and an offset each, so no length is ranked in one task) and
the plan maps (length, rank) to a container. An item longer than the capacity is cut into full pieces and a rest, which is packed
like any other; nothing else is cut. Items of no length take no container.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
PER_TASK = 50_000

#: One stretch of a plan: ranks from first on of a length go to container base + (start + rank - first) // per.
Plan = list[tuple[int, int, int, int, int]]


def length_buckets(histogram: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """The plan and its number of containers. Batches hold floor(capacity / boundary) items, which never exceeds the budget."""
    lengths = sorted(histogram)
    counts = np.concatenate([[0], np.cumsum([histogram[x] for x in lengths])]).astype(float)
    best, cut = np.zeros(len(lengths) + 1), np.zeros(len(lengths) + 1, int)
    for j in range(1, len(lengths) + 1):
        per = capacity // lengths[j - 1]
        cost = best[:j] + np.ceil((counts[j] - counts[:j]) / per)  # containers, so the unused space too
        cut[j] = int(np.argmin(cost))
        best[j] = cost[cut[j]]
    bounds = [len(lengths)]
    while bounds[-1]:
        bounds.append(int(cut[bounds[-1]]))
    plan: Plan = []
    base = 0
    for j, i in zip(bounds, bounds[1:]):
        per, seen = capacity // lengths[j - 1], 0
        for x in lengths[i:j]:
            plan.append((x, 0, base, seen, per))
            seen += histogram[x]
        base += -(-seen // per)
    return sorted(plan), base


def boundaries(histogram: dict[int, int], per_bucket: float) -> list[int]:
    """The longest length of each bucket, ascending: least padding plus so much a bucket."""
    lengths = np.array(sorted(histogram))
    n = np.concatenate([[0], np.cumsum([histogram[x] for x in lengths.tolist()])]).astype(float)
    filled = np.concatenate([[0], np.cumsum([x * histogram[x] for x in lengths.tolist()])]).astype(float)
    best, cut = np.zeros(len(lengths) + 1), np.zeros(len(lengths) + 1, int)
    for j in range(1, len(lengths) + 1):
        cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (filled[j] - filled[:j]) + per_bucket
        cut[j] = int(np.argmin(cost))
        best[j] = cost[cut[j]]
    bounds, j = [], len(lengths)
    while j:
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def filled_buckets(histogram: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """The plan and its number of containers: ranks run through a bucket's lengths in order."""
    bounds = boundaries(histogram, capacity / 64)
    inside: dict[int, list[int]] = {}
    for x in sorted(histogram):
        inside.setdefault(bounds[bisect.bisect_left(bounds, x)], []).append(x)
    by_bucket, total = best_fit({b: sum(histogram[x] for x in xs) for b, xs in inside.items()}, capacity)
    stretches: dict[int, list[tuple[int, int, int, int]]] = {}
    for b, first, base, start, per in by_bucket:
        stretches.setdefault(b, []).append((first, base, start, per))
    plan: Plan = []
    for b, xs in inside.items():
        ahead, own = 0, stretches[b]
        for x in xs:
            at = bisect.bisect_right(own, (ahead, float("inf"))) - 1
            while at < len(own) and own[at][0] < ahead + histogram[x]:
                first, base, start, per = own[at]
                skip = max(0, ahead - first)
                plan.append((x, max(0, first - ahead), base, start + skip, per))
                at += 1
            ahead += histogram[x]
    return sorted(plan), total


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """The plan and its number of containers. Groups of equally filled neighbouring containers are kept by the room they have."""
    plan: Plan = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> [(first container, how many)]
    order: list[int] = []  # rooms in use, ascending
    total = 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((first, many))

    for x in sorted(histogram, reverse=True):
        left, rank = histogram[x], 0
        while left:
            at = bisect.bisect_left(order, x)
            if at < len(order):
                room = order[at]
                first, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, first, many = capacity, total, -(-left // (capacity // x))
                total += many
            per = room // x
            full = min(many, left // per)
            if full:
                plan.append((x, rank, first, 0, per))
                put(room - per * x, first, full)
                rank, left, first, many = rank + full * per, left - full * per, first + full, many - full
            if left and many and left < per:
                plan.append((x, rank, first, 0, left))
                put(room - left * x, first, 1)
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            put(room, first, many)
    return sorted(plan), total


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, length): one row per item, or per piece of an item that is too long; pieces count from 0."""
    whole = F.floor(F.col(size) / capacity)
    n = F.ceil(F.col(size) / capacity)
    parts = sizes.where(F.col(size) > 0).select(key, F.col(size).alias("_size"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece"), whole.alias("_whole"))
    return parts.select(key, F.col("piece").cast("int").alias("piece"), F.when(F.col("piece") < F.col("_whole"), capacity).otherwise(F.col("_size") - F.col("_whole") * capacity).cast("int").alias("length"))


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, planner=filled_buckets) -> DataFrame:
    """(key, piece, length, container) of every item with a length. sizes should be cheap to read twice."""
    items = pieces(sizes, key, size, capacity)
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = planner(histogram, capacity)
    spread = max(1, -(-max(histogram.values(), default=0) // PER_TASK))
    items = items.withColumn("b", F.pmod(F.xxhash64(key, "piece"), F.lit(spread)))
    sizes_of = items.groupBy("length", "b").agg(F.count("*").alias("n"))
    ahead = sizes_of.select("length", "b", (F.sum("n").over(Window.partitionBy("length").orderBy("b")) - F.col("n")).alias("ahead"))
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("length", "b").orderBy(key, "piece")) - 1).join(ahead, ["length", "b"])
    table = np.array(plan, np.int64).reshape(len(plan), 5)
    codes = table[:, 0] * (1 << 44) + table[:, 1]  # lengths and ranks in one ascending number

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            row = table[np.searchsorted(codes, length * (1 << 44) + rank, side="right") - 1]
            where = row[:, 2] + (row[:, 3] + rank - row[:, 1]) // row[:, 4]
            yield pa.record_batch([*batch.columns[:3], pa.array(where)], names=[key, "piece", "length", "container"])

    kind = sizes.schema[key].dataType.simpleString()
    return ranked.select(key, "piece", "length", (F.col("r") + F.col("ahead")).cast("bigint").alias("rank")).mapInArrow(place, f"`{key}` {kind}, piece int, length int, container bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, items, tokens, fill (share of the capacity in use), fullest and emptiest container."""
    per = packed.groupBy("container").agg(F.sum("length").alias("used"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("tokens"), F.try_divide(F.sum("used"), F.count("*") * capacity).alias("fill"), F.max("used").alias("fullest"), F.min("used").alias("emptiest"))
