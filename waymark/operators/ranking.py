"""Exact nearest vectors and ranking metrics.

A stated set of queries goes against all vectors, up to PASS queries in a pass: a broadcast of bounded size. Each task answers
them a block at a time with one matrix product per Arrow batch, keeps the best k of each query over all its batches, and emits
them once; a window with a group limit merges the tasks' answers. Scores are rounded before ranking, equal scores rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.runtime import bounded_rows

BLOCK = 2048
PASS = 16 * BLOCK
KS = (5, 10, 25, 50, 100)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width)


class _Best:
    """The k best (score, id) of each query of a block so far; open places hold -inf."""

    def __init__(self, names: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.names, self.queries, self.k = names, queries, k
        self.score, self.id = np.full((len(names), k), -np.inf), np.zeros((len(names), k), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        score = np.round(vectors @ self.queries.T, 6).T
        better = score > self.score[:, -1:] if len(ids) > self.k else np.ones(score.shape, bool)
        better |= (score == self.score[:, -1:]) & (ids[None, :] < self.id[:, -1:])
        i, j = np.nonzero(better)
        kept = np.flatnonzero(np.isfinite(self.score).ravel())
        row = np.concatenate([kept // self.k, i])
        value, name = np.concatenate([self.score.ravel()[kept], score[i, j]]), np.concatenate([self.id.ravel()[kept], ids[j]])
        order = np.lexsort((name, -value, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, rank = order[rank < self.k], row[rank < self.k], rank[rank < self.k]
        self.score.fill(-np.inf)
        self.score[row, rank], self.id[row, rank] = value[order], name[order]

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.score))
        return pa.record_batch([pa.array(self.names[i]), pa.array(self.id[i, j]), pa.array(self.score[i, j])], names=["query_id", "vec_id", "score"])


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of greatest inner product. Null vectors and vectors of another width answer nothing."""
    queries = queries.where(F.col(vector).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    passes = max(1, -(-queries.count() // PASS))
    parts = []
    for b in range(passes):
        own = queries.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == b).toArrow()  # about PASS rows
        lengths = np.asarray(own["v"].combine_chunks().value_lengths().fill_null(-1)) if own.num_rows else np.zeros(0, int)
        blocks = []
        for w in sorted(set(lengths.tolist()) - {0}):
            at = np.flatnonzero(lengths == w)
            for part in np.array_split(at, -(-len(at) // BLOCK)):
                blocks.append((int(w), own["q"].combine_chunks().take(pa.array(part)).to_numpy(), _matrix(own["v"].combine_chunks().take(pa.array(part)), int(w))))
        shared = vectors.sparkSession.sparkContext.broadcast(blocks)

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = [(w, _Best(names, q, k)) for w, names, q in shared.value]
            for batch in batches:
                ids, column = batch.column(0).to_numpy(), batch.column(1)
                lengths = np.asarray(column.value_lengths().fill_null(-1))
                for w in {w for w, _ in found}:
                    of = np.flatnonzero(lengths == w)
                    if len(of):
                        m = _matrix(column.take(pa.array(of)), w)
                        for own_w, block in found:
                            if own_w == w:
                                block.add(ids[of], m)
            for _, block in found:
                yield block.rows()

        parts.append(vectors.where(F.col(vector).isNotNull() & F.col(vector_id).isNotNull()).select(F.col(vector_id).cast("bigint"), F.col(vector)).mapInArrow(best, "query_id bigint, vec_id bigint, score double"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_centre(vectors: DataFrame, centres: DataFrame, vector_id: str, centre_id: str, vector: str = "embedding", max_centres: int = 20_000) -> DataFrame:
    """(vec_id, nearest, score): the centre of greatest inner product, equal ones by id; null where no centre has the width.

    Few centres, broadcast, against all vectors in one narrow pass; more than max_centres are an error."""
    known = bounded_rows(centres.where(F.col(vector).isNotNull() & F.col(centre_id).isNotNull()).select(F.col(centre_id).cast("bigint"), F.col(vector).cast("array<double>")).orderBy(centre_id), max_centres, "the table of centres")
    widths = {len(r[1]) for r in known} - {0}
    packed = {w: (np.array([r[0] for r in known if len(r[1]) == w], np.int64), np.array([r[1] for r in known if len(r[1]) == w], float)) for w in widths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.asarray(column.value_lengths().fill_null(-1))
            name, score = np.zeros(len(lengths), np.int64), np.full(len(lengths), np.nan)
            for w, (ids, m) in packed.items():
                of = np.flatnonzero(lengths == w)
                for part in np.array_split(of, max(1, -(-len(of) * len(ids) // 4_000_000))):
                    if len(part):
                        s = np.round(_matrix(column.take(pa.array(part)), w) @ m.T, 6)
                        at = s.argmax(axis=1)  # the first of equal ones has the smallest id
                        name[part], score[part] = ids[at], s[np.arange(len(part)), at]
            none = np.isnan(score)
            yield pa.record_batch([batch.column(0), pa.array(name, mask=none), pa.array(score, mask=none)], names=[vector_id, "nearest", "score"])

    return vectors.select(F.col(vector_id).cast("bigint"), vector).mapInArrow(run, f"`{vector_id}` bigint, nearest bigint, score double")


def without_self(ranking: DataFrame) -> DataFrame:
    """The query's own vector taken out and the ranks closed up, before any cut."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranking.where("vec_id <> query_id").withColumn("rank", F.row_number().over(w))


def per_query_metrics(queries: DataFrame, ranking: DataFrame, relevant: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """queries: query_id; relevant: query_id, vec_id (repeats count in R, a hit counts once).

    (query_id, r, ap_<k>..., recall_<k>...): queries without a hit keep 0; without anything relevant AP is null and recall 0."""
    many = relevant.groupBy("query_id").agg(F.count("*").alias("r"))
    hits = ranking.join(relevant.distinct(), ["query_id", "vec_id"], "left_semi")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = hits.withColumn("p", F.count("*").over(w) / F.col("rank"))
    sums = scored.groupBy("query_id").agg(*[x for k in ks for x in (F.sum(F.when(F.col("rank") <= k, F.col("p"))).alias(f"s{k}"), F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}"))])
    every = queries.select("query_id").distinct().join(many, "query_id", "left").join(sums, "query_id", "left").withColumn("r", F.coalesce("r", F.lit(0)))
    ap = lambda k: F.when(F.col("r") > 0, F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / F.least(F.col("r"), F.lit(k))).alias(f"ap_{k}")
    recall = lambda k: F.when(F.col("r") > 0, F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("r")).otherwise(0.0).alias(f"recall_{k}")
    return every.select("query_id", "r", *[ap(k) for k in ks], *[recall(k) for k in ks])


def mean_metrics(per_query: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = KS) -> DataFrame:
    """Long form: by..., metric, k, value, in one pass over the queries."""
    means = per_query.groupBy(*by).agg(*[F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in ("ap", "recall") for k in ks])
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.lit(k).alias("k"), F.col(f"{m}_{k}").alias("value")) for m, name in (("ap", "mAP"), ("recall", "Recall")) for k in ks])
    return means.select(*by, F.inline(rows))


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group: partial sums by (group, position), so a large group costs no more than its width."""
    parts = vectors.where(F.col(group).isNotNull()).select(group, F.posexplode(vector)).groupBy(group, "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias(vector))
