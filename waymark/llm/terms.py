"""How often every distinct term occurs, in how many records, and which terms are too rare or too common.

Each batch splits its records' values, counts terms per record and adds them up by hash before anything moves; Spark then adds
up the partial counts. The number of records that hold any value travels as one more row per batch. Terms are values without
outer blanks in lower case; null and blank values are no terms; repeated values in a record are several occurrences in one record.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.packed import inner_marks, split_packed
from waymark.runtime import cut_lineage

RARE_RECORDS = 2
COMMON_SHARE = 0.1
_SCHEMA = "term string, occurrences bigint, records bigint"


def packed_term_counts(df: DataFrame, column: str, canonical: Sequence[str] = ()) -> DataFrame:
    """Partial (term, occurrences, records) of a packed column; a null term carries the number of records with any value."""
    marks = inner_marks(canonical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, _, values = split_packed(batch.column(0), marks)
            if not len(parent):
                continue
            t = pa.table({"r": parent, "term": pc.utf8_trim_whitespace(pc.utf8_lower(values))})
            once = t.group_by(["r", "term"]).aggregate([([], "count_all")])
            per = once.group_by("term").aggregate([("count_all", "sum"), ([], "count_all")])
            records = pc.count_distinct(t["r"]).as_py()
            yield pa.record_batch([pa.concat_arrays([per["term"].combine_chunks().cast(pa.string()), pa.nulls(1, pa.string())]), pa.concat_arrays([per["count_all_sum"].combine_chunks().cast(pa.int64()), pa.array([0])]), pa.concat_arrays([per["count_all"].combine_chunks().cast(pa.int64()), pa.array([records])])], names=["term", "occurrences", "records"])

    return df.select(column).where(F.col(column).isNotNull()).mapInArrow(run, _SCHEMA)


def plain_term_counts(df: DataFrame, column: str) -> DataFrame:
    """The same for a column that holds one value a record: raw spellings are counted first, then merged."""
    raw = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    term = F.lower(F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", ""))
    named = raw.select(term.alias("term"), "n").where("term <> ''")
    return named.select(F.inline(F.array(F.struct("term", F.col("n").alias("occurrences"), F.col("n").alias("records")), F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("occurrences"), F.col("n").alias("records")))))


def term_frequencies(partial: DataFrame, field: str, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """(field, term, occurrences, records, mark): mark is 'rare', 'common' or null; rare goes first in tiny tables."""
    added = cut_lineage(partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")))  # once, for the terms and for the records that hold any
    holding = added.where("term is null").select(F.col("records").alias("holding"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * F.col("holding"), "common")
    return added.where("term is not null").crossJoin(F.broadcast(holding)).select(F.lit(field).alias("field"), "term", "occurrences", "records", mark.alias("mark"))
