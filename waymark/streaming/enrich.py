"""Resumable enrichment by an outside provider, in batch and as a stream; last success wins in both."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.operators.relational import last_success, pending, succeeded
from waymark.operators.retries import Retry, with_retries  # noqa: F401
from waymark.sources.writers import append, stored, swap


def enrich(inputs: DataFrame, key: str, columns: list[str], provider: Callable[[dict], str], concurrency: int = 8, interval: float = 0.0) -> DataFrame:
    """(key, result, error): the provider is called once per row, at most one call per `interval` seconds and partition.

    For a rate limit over all, use one partition. A failure is the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = 0.0
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                if interval:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + interval
                try:
                    out.append((row[key], provider(row), None))
                except Exception as e:  # noqa: BLE001
                    out.append((row[key], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "result", "error"])

    kind = inputs.schema[key].dataType.simpleString()
    return inputs.select(*dict.fromkeys([key, *columns])).repartition(concurrency, key).mapInPandas(run, f"{key} {kind}, result string, error string")


def encode(inputs: DataFrame, key: str, columns: list[str], encoder: Callable[[pd.DataFrame], np.ndarray], width: int) -> DataFrame:
    """(key, embedding array<float>): the encoder turns a batch of rows into a matrix of `width` columns, one row each.

    A result of another shape is an error of the job, as it would put vectors to the wrong keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.asarray(encoder(batch.to_pandas()), np.float32)
                if m.shape != (batch.num_rows, width):
                    raise ValueError(f"the encoder gave {m.shape} for {batch.num_rows} rows of width {width}")
                yield pa.record_batch([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), width).cast(pa.list_(pa.float32()))], names=[key, "embedding"])

    kind = inputs.schema[key].dataType.simpleString()
    return inputs.select(*dict.fromkeys([key, *columns])).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def geocode_missing(rows: DataFrame, lat: str, lon: str, missing: str, provider: Callable[[dict], dict | None], fields: list[str], interval: float = 1.0) -> DataFrame:
    """rows with nulls of the fields filled from the provider where `missing` is null and both coordinates are there.

    Each distinct coordinate is asked for once, from one partition, at most one call per `interval` seconds, as public services
    demand. The provider gives a field's value or None; a failed call fills nothing. Not-a-number is no coordinate."""
    from waymark.runtime import cut_lineage

    fine = F.col(missing).isNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    todo = rows.where(fine).select(F.col(lat).alias("__x"), F.col(lon).alias("__y")).distinct().coalesce(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = 0.0
        for b in batches:
            out = []
            for x, y in zip(b["__x"], b["__y"]):
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + interval
                try:
                    found = provider({"latitude": float(x), "longitude": float(y)}) or {}
                except Exception:  # noqa: BLE001
                    found = {}
                out.append((x, y, *[found.get(f) for f in fields]))
            yield pd.DataFrame(out, columns=["__x", "__y", *[f"__{f}" for f in fields]])

    found = cut_lineage(todo.mapInPandas(run, "__x double, __y double, " + ", ".join(f"`__{f}` string" for f in fields)))
    open_ = rows.where(fine).join(found, (F.col(lat) == F.col("__x")) & (F.col(lon) == F.col("__y")), "left")
    filled = open_.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in rows.columns])
    return rows.where(~fine).unionByName(filled)


def resume(spark: SparkSession, inputs: DataFrame, key: str, columns: list[str], provider: Callable[[dict], str], path: str, run: int, **options) -> DataFrame:
    """Calls the provider for the keys without a success at `path`, appends, and returns the state: last success, else last error.

    Only a missing table counts as empty; one that can't be read is an error, and nothing is called or written."""
    done = stored(spark, path)
    todo = inputs if done is None else pending(inputs, done.where(succeeded("error")), key)
    append(enrich(todo, key, columns, provider, **options).withColumn("run", F.lit(run)), path)
    return last_success(spark.read.parquet(path), key, "error", ["run"])


def stream_last_success(source: DataFrame, key: str, error: str, order: list[str], state: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into the table at `state` and swapped in; the same batch twice changes nothing.

    The state grows with the keys, not with the attempts. A state that can't be read is an error, never replaced. Runs over what
    is there, then stops."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = stored(spark, state)
        if known is not None:
            batch = batch.unionByName(known)
        swap(spark, state, last_success(batch, key, error, order))

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
