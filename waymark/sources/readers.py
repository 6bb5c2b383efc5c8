"""Scans with declared schemas. Nothing infers a schema; ids stay strings."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header under a declared schema; a cell that doesn't fit its type is null. Quoted line breaks are part of a value."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as a string."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def csv_tolerant(spark: SparkSession, path: str, schema: str, key: str, columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """Damaged lines are kept as far as they go, with their text in _corrupt_record; rows without a key go."""
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("escape", '"').csv(path)
    rows = rows.where(F.coalesce(F.trim(key), F.lit("")) != "")
    return rows.select(*columns) if columns else rows


def wrapped_json(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Rows of {"data": [...]} or of a bare list; `text` is renamed to `caption` by rename() where a caller wants that."""
    text = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{element}>>"
    parsed = text.select(F.coalesce(F.from_json("value", f"struct<data:{kind}>")["data"], F.from_json("value", kind)).alias("data"))
    return parsed.select(F.inline("data"))


def indexed_metadata(spark: SparkSession, path: str, element: str) -> DataFrame:
    """{"metadata": [...]}: the place in the list is the row id."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"struct<metadata:array<struct<{element}>>>")["metadata"].alias("m"))
    return parsed.select(F.posexplode("m").alias("row_idx", "r")).select(F.col("row_idx").cast("bigint").alias("row_idx"), "r.*")


def label_prompts(spark: SparkSession, path: str) -> DataFrame:
    """{"label": ["prompt", ...]}: (label, pos, prompt)."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("label", "prompts"))
    return parsed.select("label", F.posexplode("prompts").alias("pos", "prompt"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vector table: an id, the vector and its attributes in one Parquet table."""
    return spark.read.parquet(path)


def gallery(spark: SparkSession, path: str) -> DataFrame:
    return csv_typed(spark, path, "LAT double, LON double")


def images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """path, length, content; filters on path and length need not read the content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def tar_members(spark: SparkSession, path: str, ending: str = ".jpg", more_than: int = 5120) -> DataFrame:
    """(archive, member, size, content) of the members with the ending and more bytes than given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(ending) and m.size > more_than:
                            yield pd.DataFrame({"archive": [archive], "member": [m.name], "size": [m.size], "content": [tar.extractfile(m).read()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, size bigint, content binary")


def harmonise(df: DataFrame, wanted: str = "category", others: tuple[str, ...] = ("pred_label", "predicted_label")) -> DataFrame:
    """The first of the other names renamed to the wanted one, where that is missing."""
    if wanted in df.columns:
        return df
    for name in others:
        if name in df.columns:
            return df.withColumnRenamed(name, wanted)
    return df


def country_table(codes: DataFrame, official: DataFrame, continents: DataFrame, subregions: DataFrame) -> DataFrame:
    """codes: country_code, gazetteer_name, gazetteer_continent. Official names and continents win; 'not found' is no subregion."""
    joined = codes.join(official, "country_code", "left").join(continents, "country_code", "left").join(subregions, "country_code", "left")
    return joined.select(
        "country_code",
        F.coalesce("official_name", "gazetteer_name").alias("country"),
        F.coalesce("continent", "gazetteer_continent").alias("region"),
        F.when(F.col("subregion_name") != "not found", F.col("subregion_name")).alias("subregion"),
    )
