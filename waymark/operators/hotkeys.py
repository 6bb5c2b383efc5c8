"""Per-key results in order, where a few keys hold most rows.

Rows are range partitioned on (key, order, tie) by sampled quantiles, so a heavy key is spread over as many partitions as its
share asks for and light keys share one. Each partition walks its sorted runs and emits one partial state per key; the states
of a key in partition order are stitched: counts add up, and what happens between two neighbouring rows is also looked at
across each boundary. After the first pass only (keys + partitions) rows move.

Null keys have no result. A null order value sorts first and takes part in counts only; a null label counts as the label ''.
Equal order values are told apart by the tie column. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.runtime import cut_lineage


class _Open:
    """The run that a partition's last batch left open."""

    __slots__ = ("key", "n", "first", "last", "gap", "label_1", "label_2", "changes")


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    names = ["part", "key", "n", "first_at", "last_at", "gap", "label_1", "label_2", "changes"]
    types = [pa.int32(), None, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.int64()]
    held: _Open | None = None

    def single(s: _Open, kind: pa.DataType) -> pa.RecordBatch:
        values = [part, s.key, s.n, s.first, s.last, s.gap, s.label_1, s.label_2, s.changes]
        return pa.record_batch([pa.array([v], t or kind) for v, t in zip(values, types)], names=names)

    kind = pa.string()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, label = batch.column(0), batch.column(2)
        kind = key.type
        at = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        new = np.ones(n, bool)
        turn = np.zeros(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            turn[1:] = pc.not_equal(label.slice(1), label.slice(0, n - 1)).to_numpy(zero_copy_only=False) & ~new[1:]
        step = np.full(n, np.nan)
        step[1:] = np.diff(at)
        step[new] = np.nan
        head = np.flatnonzero(new)
        tail = np.append(head[1:], n) - 1
        count = tail - head + 1
        first, last = np.fmin.reduceat(at, head), np.fmax.reduceat(at, head)
        gap, changes = np.fmax.reduceat(step, head), np.add.reduceat(turn.astype(np.int64), head)
        if held is not None:
            if key[0].as_py() == held.key:  # the open run goes on in this batch
                between = at[0] - held.last
                gap[0] = np.fmax(np.fmax(gap[0], held.gap), between)
                changes[0] += held.changes + (label[0].as_py() != held.label_2)
                count[0] += held.n
                first[0], last[0] = np.fmin(first[0], held.first), np.fmax(last[0], held.last)
                begun = held.label_1
            else:
                yield single(held, kind)
                begun = label[0].as_py()
        else:
            begun = label[0].as_py()
        done = len(head) - 1
        if done:
            labels = label.take(pa.array(head[:done])).to_pylist()
            labels[0] = begun
            yield pa.record_batch([pa.array(np.full(done, part, np.int32)), key.take(pa.array(head[:done])), pa.array(count[:done]), pa.array(first[:done]), pa.array(last[:done]), pa.array(gap[:done]), pa.array(labels, pa.string()), label.take(pa.array(tail[:done])), pa.array(changes[:done])], names=names)
            begun = label[int(head[done])].as_py()
        held = _Open()
        held.key, held.n, held.first, held.last, held.gap = key[int(head[-1])].as_py(), int(count[-1]), float(first[-1]), float(last[-1]), float(gap[-1])
        held.label_1, held.label_2, held.changes = begun, label[n - 1].as_py(), int(changes[-1])
    if held is not None:
        yield single(held, kind)


def key_states(df: DataFrame, key: str | Column, order: str | Column | None, tie: str | Column, label: str | Column | None = None, partitions: int | None = None) -> DataFrame:
    """One row per key: n, first_at and last_at (order as a number), longest_gap between neighbours, n_runs of equal labels.

    Where order is None, the rows' order is that of tie and no time is reported."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    none = F.lit(None).cast("double")
    rows = df.select(
        column(key).alias("key"),
        (none if order is None else column(order).cast("double")).alias("at"),
        (F.lit("") if label is None else F.coalesce(column(label), F.lit(""))).alias("label"),
        column(tie).alias("tie"),
    ).where("key is not null")
    by = ["key", "tie"] if order is None else ["key", "at", "tie"]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["key"].dataType.simpleString()
    parts = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("tie").mapInArrow(
        _partials, f"part int, key {kind}, n bigint, first_at double, last_at double, gap double, label_1 string, label_2 string, changes bigint"
    )
    # not-a-number stands for nothing seen in a partial
    seen = lambda c: F.when(~F.isnan(c), F.col(c))
    w = Window.partitionBy("key").orderBy("part")
    stitched = parts.select("part", "key", "n", seen("first_at").alias("first_at"), seen("last_at").alias("last_at"), seen("gap").alias("gap"), "label_1", "label_2", "changes").withColumns(
        {
            "across": F.col("first_at") - F.lag("last_at").over(w),
            "turned": F.coalesce((F.col("label_1") != F.lag("label_2").over(w)).cast("bigint"), F.lit(0)),
        }
    )
    return stitched.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.max(F.greatest("gap", "across")).alias("longest_gap"),
        (F.sum(F.col("changes") + F.col("turned")) + 1).alias("n_runs"),
    )


def hot_keys(states: DataFrame, share: float) -> DataFrame:
    """Keys with more than `share` of all rows that have a key."""
    states = cut_lineage(states)  # one row a key; made once for the total and the rows
    total = states.agg(F.sum("n").alias("total"))
    return states.crossJoin(F.broadcast(total)).where(F.col("n") > F.lit(share) * F.col("total")).select("key", "n")
