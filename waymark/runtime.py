"""What operators need from the session: reading tables, cutting lineage, size-checked broadcasts, joins on heavy keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy where it holds over 1 / HEAVY of all rows; there are at most so many.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A folder of this machine stands in only where the master is
    local; on a cluster without the setting it is an error, as executors couldn't read each other's files."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.gettempdir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder. Spark removes it with the last reference where
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint where it has at most max_rows rows, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows for the driver, of a table whose size is bounded by its meaning; more than max_rows is an error."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows")
    return rows


def bounded_table(df: DataFrame, max_rows: int, what: str) -> DataFrame:
    """The same as a broadcast table of the rows read, so that its size is proven and it is computed once."""
    return F.broadcast(df.sparkSession.createDataFrame(bounded_rows(df, max_rows, what), df.schema))


def join_counted(rows: DataFrame, side: DataFrame, on: Sequence[str], n: str = "n") -> DataFrame:
    """rows with the columns of side (left join), which has one row per key and in `n` how many of the rows hold it.

    Heavy keys are broadcast, of which there can be at most HEAVY; only the rows of light keys are shuffled. Rows with a null in
    the first key column find nothing and stay where they are. Both tables are read twice, so they should be cheap to read."""
    total = side.agg(F.sum(n)).collect()[0][0] or 0
    heavy = F.col(n) * HEAVY > total
    known = bounded_table(side.where(heavy).drop(n), HEAVY, "the list of heavy keys")
    added = [c for c in side.columns if c not in on and c != n]
    here = rows.join(known.withColumn("__heavy", F.lit(True)), list(on), "left").where(F.col("__heavy") | F.col(on[0]).isNull()).drop("__heavy")
    light = rows.where(F.col(on[0]).isNotNull()).join(known.select(*on), list(on), "left_anti").join(side.where(~heavy).drop(n), list(on), "left")
    return here.select(*rows.columns, *added).unionByName(light.select(*rows.columns, *added))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/waymark-{name}-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{folder.toString()}/data"
