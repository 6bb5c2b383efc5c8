"""Sinks. Overwriting goes through a new path and a swap, as a path that is being read can't be replaced in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_lists(df: DataFrame) -> DataFrame:
    """List columns of plain values joined by commas, as CSV can't hold lists."""
    plain = lambda f: isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType))
    return df.select(*[F.array_join(F.transform(f.name, lambda x: x.cast("string")), ",").alias(f.name) if plain(f) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    flat_lists(df).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_wrapped_json(df: DataFrame, path: str, name: str = "data", max_rows: int = 1_000_000) -> None:
    """{"data": [...]} in one file: for results that are meant to be read whole; more than max_rows rows are an error. Large
    tables go out as JSON lines."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows for one JSON document")
    one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    one.select(F.to_json(F.struct(name)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_by(df: DataFrame, path: str, *columns: str, form: str = "parquet") -> None:
    """One folder per value, so that readers prune."""
    df.write.mode("overwrite").partitionBy(*columns).format(form).save(path)


def write_vectors(df: DataFrame, path: str, row: str = "row_idx") -> None:
    """The vector table in ranges of its row id, which readers can skip by."""
    df.repartitionByRange(F.col(row)).sortWithinPartitions(row).write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _rename(fs, one, two) -> None:
    if not fs.rename(one, two):
        raise OSError(f"could not rename {one} to {two}")


def _recover(spark: SparkSession, path: str):
    """(file system, path, path of the old table), after what a crash within swap() left there has been put right."""
    at, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.old"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(at):  # the new table is in place
            fs.delete(old, True)
        else:  # it isn't: the old one is the last good
            _rename(fs, old, at)
    return fs, at, old


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, None where there is none. One that is there but can't be read is an error."""
    fs, at, _ = _recover(spark, path)
    return spark.read.parquet(path) if fs.exists(at) else None


def swap(spark: SparkSession, path: str, df: DataFrame) -> None:
    """Replaces the table at `path` by df, which may be made from it: a new folder first, then two renames.

    At every moment the old or the new table is whole under `path` or `path`.old; stored() and the next swap() put right what a
    crash between the renames leaves. One writer at a time."""
    fs, at, old = _recover(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    df.write.parquet(new.toString())
    there = fs.exists(at)
    if there:
        _rename(fs, at, old)
    try:
        _rename(fs, new, at)
    except OSError:
        if there:
            _rename(fs, old, at)
        raise
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def metric_report(metrics: DataFrame, path: str) -> None:
    """Long metrics (slice_type, slice_key, metric, k, value) as one nested JSON object per slice type."""
    named = metrics.select("slice_type", "slice_key", F.concat_ws("@", "metric", F.col("k").cast("string")).alias("name"), "value")
    per = named.groupBy("slice_type", "slice_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("scores"))
    tree = per.groupBy("slice_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("slice_key", F.to_json("scores").alias("scores"))))).alias("groups"))
    tree.select(F.to_json(F.struct("slice_type", "groups")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
